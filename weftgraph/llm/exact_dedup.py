"""Exact deduplication by a distributed content sort.

Spark samples splitters and range-partitions the documents by their normalised
text, each partition is sorted externally (it spills to disk where it must), so
that equal texts lie next to each other, and the running window over the sorted
rows compares each text in full with its neighbour's. No hash decides equality.

The splitters are the first ``HEAD`` characters of normalised texts and, where these are
equal, a hash of the whole, so that the sample on the driver stays small and documents
of one template spread; equal texts have equal splitters, hence meet in one partition.

Two kinds of rows don't take part. Null texts equal nothing and pass by without a shuffle. A group of copies that holds
``HOT_COUNT`` of about ``SAMPLE`` sampled rows is too large for one task: such groups (at most
SAMPLE / HOT_COUNT) are aggregated by their whole text before any shuffle, to the smallest id
of each, and their rows look that up. The sample decides the way alone, never the result.

The normalised text is recomputed on both sides of the exchange and not sent
along, so that only the document's own columns cross the network.

Cases: a null text equals nothing and is kept; an empty or blank text equals other
blank texts; within a group the smallest ``doc_id`` stays (null ids last), and of
rows that repeat the smallest id one stays; an empty table gives an empty result.
Columns of the input that the operator doesn't know pass through
:func:`drop_exact_duplicates` unchanged; no names are reserved, since the
operator's own columns carry a prefix that is extended until it is free. Ids may be of any type with an order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from .common import durable, own_prefix

#: Characters of the normalised text that splitters are made of.
HEAD = 64
BLANKS = r"[ \t\n\r\f\x0B]+"
SAMPLE, HOT_COUNT = 1_000_000, 100


def normalised(text: Column) -> Column:
    """Text with each run of ASCII blanks made one space and no blank at its ends."""
    return F.trim(F.regexp_replace(text, BLANKS, " "))


def hot_groups(docs: DataFrame, text_col: str = "text", sample: int = SAMPLE, least: int = HOT_COUNT) -> list[int]:
    """Hashes of the normalised texts that occur ``least`` times in about ``sample`` rows; at most sample / least of them."""
    n = docs.count()
    some = docs.where(F.col(text_col).isNotNull()).select(text_col).sample(min(1.0, sample / max(n, 1)), 1)
    found = some.groupBy(F.xxhash64(normalised(F.col(text_col))).alias("h")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    return sorted(r["h"] for r in found.collect())


def _sorted_runs(docs: DataFrame, own: str, id_col: str, text_col: str) -> tuple[DataFrame, list[str], WindowSpec]:
    norm = normalised(F.col(text_col))
    ends = {f"{own}head": F.substring(norm, 1, HEAD), f"{own}hash": F.xxhash64(norm)}
    key = f"{own}key"
    # The aliases below are the partitioning expressions themselves: Spark recognises that
    # the range partitioning already clusters by them and adds no second exchange.
    runs = docs.repartitionByRange(*ends.values()).withColumns(ends | {key: norm})
    order = Window.partitionBy(*ends, key).orderBy(F.col(id_col).asc_nulls_last())
    return runs, [*ends, key], order


def _hot_rows(hot: DataFrame, own: str, id_col: str, text_col: str) -> tuple[DataFrame, list[str]]:
    """The rows with the number of their group, its smallest id, and whether the row has that id."""
    g, first, norm = f"{own}group", f"{own}first", f"{own}norm"
    groups = hot.groupBy(normalised(F.col(text_col)).alias(norm)).agg(F.min(id_col).alias(first))
    groups = durable(groups.withColumn(g, F.monotonically_increasing_id()))
    rows = hot.join(groups, normalised(F.col(text_col)) == F.col(norm)).drop(norm)
    return rows.withColumn(f"{own}is", F.col(id_col).eqNullSafe(F.col(first))), [g, first, f"{own}is"]


def _ways(docs: DataFrame, text_col: str, sample: int, least: int) -> tuple[DataFrame, DataFrame | None, DataFrame]:
    """Documents that are sorted, those of hot groups if there are any, and those without text."""
    hashes = hot_groups(docs, text_col, sample, least)
    known, none = docs.where(F.col(text_col).isNotNull()), docs.where(F.col(text_col).isNull())
    if not hashes:
        return known, None, none
    is_hot = F.xxhash64(normalised(F.col(text_col))).isin(*hashes)
    return known.where(~is_hot), known.where(is_hot), none


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, least: int = HOT_COUNT) -> DataFrame:
    """(doc_id, canonical_id, is_duplicate), one row for each document."""
    docs = docs.select(id_col, text_col)
    own = own_prefix(docs.columns)
    known, hot, none = _ways(docs, text_col, sample, least)
    runs, _, order = _sorted_runs(known, own, id_col, text_col)
    i = F.col(id_col)
    out = runs.select(i, F.first(id_col).over(order).alias("canonical_id"), (F.row_number().over(order) > 1).alias("is_duplicate"))
    out = out.union(none.select(i, i.alias("canonical_id"), F.lit(False).alias("is_duplicate")))
    if hot is not None:
        rows, (g, first, is_first) = _hot_rows(hot, own, id_col, text_col)
        again = F.row_number().over(Window.partitionBy(g).orderBy(F.lit(1))) > 1  # of the rows that repeat the smallest id
        out = out.union(rows.where(~F.col(is_first)).select(i, F.col(first), F.lit(True)))
        out = out.union(rows.where(F.col(is_first)).select(id_col, g, first).select(i, F.col(first), again))
    return out


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, least: int = HOT_COUNT) -> DataFrame:
    """The documents without those that :func:`exact_duplicates` marks, columns unchanged."""
    own = own_prefix(docs.columns)
    rank = f"{own}rank"
    known, hot, none = _ways(docs, text_col, sample, least)
    runs, made, order = _sorted_runs(known, own, id_col, text_col)
    out = runs.withColumn(rank, F.row_number().over(order)).where(F.col(rank) == 1).drop(*made, rank).union(none)
    if hot is not None:
        rows, made = _hot_rows(hot, own, id_col, text_col)
        rows = rows.where(F.col(made[-1])).withColumn(rank, F.row_number().over(Window.partitionBy(made[0]).orderBy(F.lit(1))))
        out = out.union(rows.where(F.col(rank) == 1).drop(*made, rank))
    return out
