"""Keeping a graph up to date from streams of files and of edges."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..model import Graph
from ..sources.ingest import Parser, parse, to_graph
from ..sources.store import GraphStore


def watch_tree(spark: SparkSession, root: str, store: GraphStore, checkpoint: str, parser: Parser = Parser(), every: str | None = None) -> StreamingQuery:
    """Parses new files of a tree and puts their rows in the store, batch by batch.

    ``every`` is the quiet time between batches (a trigger interval); without it all that is there is processed
    once. The file source sees neither deletions nor changes under the same name and time: :func:`drop_vanished`
    compares with the present listing.
    """
    schema = "path string, modificationTime timestamp, length bigint, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", "true").load(root)
    top = root.rstrip("/") + "/"
    bare = F.regexp_replace(F.col("path"), r"^[a-z0-9]+:/+", "/") if "://" not in root else F.col("path")

    def put(batch: DataFrame, _: int) -> None:
        own = batch.select(bare.substr(F.lit(len(top) + 1), F.length(bare)).alias("rel"), "content")
        g = to_graph(parse(own, parser))
        if not g.nodes.isEmpty():
            store.upsert(g)

    out = files.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)
    return (out.trigger(processingTime=every) if every else out.trigger(availableNow=True)).start()


def drop_vanished(g: Graph, listing: DataFrame) -> Graph:
    """The graph without nodes of files that ``listing`` (rel) lacks, and without edges from them."""
    file = F.coalesce(F.nullif(F.coalesce(F.col("attrs")["source_file"], F.lit("")), F.lit("")), F.col("attrs")["path"])
    own = g.nodes.withColumn("_file", file)
    gone = own.where("_file is not null").join(listing.select(F.col("rel").alias("_file")), "_file", "left_anti").select("id")
    edges = g.edges.join(gone.select(F.col("id").alias("src")), "src", "left_anti").select(*g.edges.columns)
    return Graph(g.nodes.join(gone, "id", "left_anti").select(*g.nodes.columns), edges)


def bursts(events: DataFrame, quiet: str = "500 milliseconds", late: str = "10 seconds", key: str = "path", time: str = "ts") -> DataFrame:
    """(key, start, end, n): runs of events of a key that no gap of ``quiet`` parts, as session windows; works on streams and tables."""
    if events.isStreaming:
        events = events.withWatermark(time, late)
    return events.groupBy(F.session_window(time, quiet).alias("w"), key).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def running_degrees(edges: DataFrame, checkpoint: str, publish: Callable[[DataFrame], None], once: bool = True) -> StreamingQuery:
    """Counts degrees over a stream of edges (src, dst); ``publish`` gets (id, in_degree, out_degree) of the ids that a batch changed."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("src").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o")), F.struct(F.col("dst").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o")))).alias("x"))
    counted = ends.groupBy("x.id").agg(F.sum("x.i").alias("in_degree"), F.sum("x.o").alias("out_degree"))
    out = counted.writeStream.outputMode("update").foreachBatch(lambda batch, _: publish(batch)).option("checkpointLocation", checkpoint)
    return (out.trigger(availableNow=True) if once else out).start()
