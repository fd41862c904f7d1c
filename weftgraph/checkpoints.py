"""Cutting the lineage of iterative plans so that lost executors don't lose the work."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"
_own: dict[str, str] = {}  # folders of our own, by application


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``.

    Only where that is unset and the master is this machine a folder of our own is made; a cluster
    without the setting is an error, since its workers don't see each other's folders.
    """
    sc = spark.sparkContext
    named = spark.conf.get(SETTING, None) or sc.getConf().get(SETTING)
    if named:
        return named.rstrip("/")
    if not (sc.master == "local" or sc.master.startswith("local[")):
        raise RuntimeError(f"{SETTING} must name a folder that all machines of the cluster share")
    if sc.applicationId not in _own:
        _own[sc.applicationId] = tempfile.mkdtemp(prefix="weftgraph-")
    return _own[sc.applicationId]


def saved(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder as Parquet and read from there by all that follows.

    Unlike a checkpoint's rows, a written table has its true size: the planner of the
    next step broadcasts a small frontier instead of shuffling what it is joined with.
    """
    folder = f"{shared_folder(df.sparkSession)}/step-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def saved_by(df: DataFrame, key: str, parts: int) -> DataFrame:
    """Like :func:`saved`, in ``parts`` buckets by hash of ``key``: joins by it move the other side alone.

    Only a table knows its buckets; this one's name is dropped at once, its files stay.
    """
    spark = df.sparkSession
    name = f"step_{uuid.uuid4().hex}"
    df.repartition(parts, key).write.bucketBy(parts, key).format("parquet").option("path", f"{shared_folder(spark)}/{name}").saveAsTable(name)
    out = spark.table(name)
    spark.sql(f"DROP TABLE {name}")
    return out


def remove(spark: SparkSession, folder: str) -> None:
    """Deletes a folder of steps that nothing reads any more."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
