"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..checkpoints import saved


#: Materialises a table in the shared checkpoint folder, cutting its lineage: it survives the loss of executors.
durable = saved


def released(run: Callable) -> Callable:
    """A function for ``mapInArrow`` or ``applyInArrow`` that gives memory back to the system when its task ends.

    Workers are kept for later tasks of other steps; what their allocators hold on to would count against these.
    """

    def wrapped(*args):
        try:
            yield from run(*args)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL("libc.so.6").malloc_trim(0)
            except (OSError, AttributeError):  # another C library
                pass

    return wrapped


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Characters that separate words for counting: the four ASCII blanks that text files hold.
WORD = r"[^ \t\n\r]+"


def word_count(text: Column) -> Column:
    """Number of blank-separated words; 0 for a null or empty text."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def own_prefix(columns: list[str]) -> str:
    """A prefix that no column of the input begins with, for an operator's own columns."""
    prefix = "weft_"
    while any(c.lower().startswith(prefix) for c in columns):
        prefix = "_" + prefix
    return prefix


def quoted(name: str) -> Column:
    """The top-level column of exactly this name, whatever dots it holds."""
    return F.col("`" + name.replace("`", "``") + "`")
