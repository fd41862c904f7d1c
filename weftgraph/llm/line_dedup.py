"""Line deduplication over overlapping three-line windows.

A line is what a line feed ends or, within a long line, what a sentence's end and a blank
(``.``, ``!`` or ``?`` and one space) end, so that a passage is found wherever it stands in
a paragraph. Each run of three consecutive lines of a text is hashed; a window that occurs more
than once in the whole table keeps its first occurrence, in order of (doc_id,
text hash, position), and the lines that any later occurrence covers are removed with what
ends them; overlapping occurrences merge by their covered positions. Two independent 64-bit hashes
identify a window, so that chance collisions don't matter at trillions of windows.

The windows alone are shuffled in the counting step, without text. The first
occurrences are aggregated with a map-side combine and joined back, so that a
window that millions of documents share never becomes one row; adaptive execution
splits such a key in the join.

A repeated passage is removed in whole where it begins and ends with lines of its own; of one
that begins or ends inside a line that line stays, and one of fewer than three lines
between different neighbours stays.

Cases: a text of fewer lines than the window has no window and stays; a window of
nothing but blank lines is not counted; a null text stays null; an empty one
empty. Lines are compared without blanks at their ends and removed whole. Rows
that repeat doc_id and text share positions: all of them are the first occurrence; different texts
of one id, or of the null id, are in order of their hashes. A null doc_id sorts last. Ids
are integers. Extra columns, also of clashing names, are left out of the result of :func:`line_dedup`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW = 3
#: Between any two lines; nothing is consumed, so that the lines of a text make up the text.
LINE_END = r"(?<=\n)|(?<=[.!?] )"
_MARK = "\x01"


def lines_of(text: Column) -> Column:
    """The lines of a text. Plain replacements mark their ends, many times faster than the expression, unless the text has such marks itself."""
    marked = text
    for end in ("\n", ". ", "! ", "? "):
        marked = F.replace(marked, F.lit(end), F.lit(end + _MARK))
    return F.when(F.contains(text, F.lit(_MARK)), F.split(text, LINE_END)).otherwise(F.split(marked, _MARK))


def line_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """(doc_id, tag, pos, h1, h2): one row for each window; ``tag`` tells apart texts that share an id."""
    bare = F.transform(lines_of(F.col(text_col)), lambda x: F.btrim(x, F.lit(" \t\r\n")))
    hashed = F.transform(bare, lambda x: F.struct(F.xxhash64(x).alias("a"), F.xxhash64(F.lit("b"), x).alias("b"), (F.length(x) > 0).alias("full")))
    parts = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(text_col)).alias("tag"), hashed.alias("ls")).where(F.size("ls") >= window)

    def at(i: Column) -> list[Column]:
        return [F.get(F.col("ls"), i + F.lit(j)) for j in range(window)]

    spans = F.transform(
        F.sequence(F.lit(0), F.size("ls") - window),
        lambda i: F.struct(
            i.alias("pos"),
            F.xxhash64(*(x["a"] for x in at(i))).alias("h1"),
            F.xxhash64(*(x["b"] for x in at(i))).alias("h2"),
            F.greatest(*(x["full"] for x in at(i))).alias("full"),
        ),
    )
    return parts.select("doc_id", "tag", F.inline(spans)).where("full").drop("full")


def covered_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """(doc_id, tag, covered): for each text with a later occurrence the positions of the lines that go."""
    w = line_windows(docs, id_col, text_col, window)
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tag", "pos")
    repeated = (
        w.groupBy("h1", "h2")
        .agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n"))
        .where("n > 1")
        .select(F.col("h1").alias("r1"), F.col("h2").alias("r2"), "first")
    )
    later = w.join(repeated, (F.col("h1") == F.col("r1")) & (F.col("h2") == F.col("r2"))).where(~place.eqNullSafe(F.col("first")))
    span = F.sequence(F.col("pos"), F.col("pos") + (window - 1))
    return later.select("doc_id", "tag", F.explode(span).alias("pos")).groupBy("doc_id", "tag").agg(F.collect_set("pos").alias("covered"))


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """(doc_id, text, removed_lines): every document with its remaining lines."""
    gone = covered_lines(docs, id_col, text_col, window).select(F.col("doc_id").alias("g_id"), F.col("tag").alias("g_tag"), "covered")
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(F.col(text_col)).alias("tag"))
    joined = base.join(gone, F.col("doc_id").eqNullSafe(F.col("g_id")) & (F.col("tag") == F.col("g_tag")), "left")

    def remaining(ls: Column) -> Column:
        left = F.array_except(F.sequence(F.lit(0), F.size(ls) - 1), "covered")
        return F.array_join(F.transform(left, lambda i: F.get(ls, i)), "")

    # As the argument of a function the lines are evaluated once, not anew for each line that is taken from them.
    text = F.get(F.transform(F.array(lines_of(F.col("text"))), remaining), F.lit(0))
    return joined.select("doc_id", F.when(F.col("covered").isNull(), F.col("text")).otherwise(text).alias("text"), F.coalesce(F.size("covered"), F.lit(0)).cast("bigint").alias("removed_lines"))
