"""Full-text search over nodes: an inverted index of built-in expressions.

The index is a table of postings (term, id, tf) and one of document lengths, kept as
Parquet; a query reads the postings of its terms alone, which a file sorted by term prunes
to a few row groups. A hit scores the sum over its terms of sqrt(tf) (1 + ln(N / (1 + df))) / sqrt(length).
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import attr

WORDS = r"[\p{L}\p{Nd}_]+"
STOP_WORDS = tuple("a an and are as at be but by for if in into is it no not of on or such that the their then there these they this to was will with".split())
SNIPPET = 150


def search_docs(nodes: DataFrame) -> DataFrame:
    """(id, type, label, doc, package, source_file, module, signature, all_text) of each node."""
    fields = ("doc", "package", "source_file", "module", "signature")
    d = nodes.select("id", "type", F.coalesce("label", F.lit("")).alias("label"), *(attr(f).alias(f) for f in fields))
    return d.withColumn("all_text", F.concat("label", F.lit(" "), "doc", F.lit(" "), "package", F.lit(" "), "signature", F.lit(" "), "id"))


def terms(text: Column) -> Column:
    return F.filter(F.regexp_extract_all(F.lower(text), F.lit(WORDS), F.lit(0)), lambda t: ~t.isin(*STOP_WORDS))


@dataclass
class Index:
    docs: DataFrame
    postings: DataFrame  # term, id, tf, length

    def save(self, path: str) -> None:
        self.docs.write.mode("overwrite").parquet(f"{path}/docs")
        self.postings.repartitionByRange("term").sortWithinPartitions("term").write.mode("overwrite").parquet(f"{path}/postings")

    @staticmethod
    def load(spark: SparkSession, path: str) -> Index:
        return Index(spark.read.parquet(f"{path}/docs"), spark.read.parquet(f"{path}/postings"))


def build(nodes: DataFrame) -> Index:
    """The last word on an id is its only row; nodes are expected to be distinct by id."""
    docs = search_docs(nodes)
    everything = terms(F.concat_ws(" ", "all_text", "source_file", "module", "type"))
    split = docs.select("id", everything.alias("ts")).select("id", F.size("ts").alias("length"), F.explode("ts").alias("term"))
    return Index(docs, split.groupBy("term", "id", "length").agg(F.count(F.lit(1)).alias("tf")))


def upsert(ix: Index, nodes: DataFrame) -> Index:
    """The index with these nodes' rows in place of those of the same ids."""
    new = build(nodes)
    ids = new.docs.select("id")
    return Index(ix.docs.join(ids, "id", "left_anti").unionByName(new.docs), ix.postings.join(ids, "id", "left_anti").unionByName(new.postings))


def remove(ix: Index, ids: DataFrame) -> Index:
    """The index without the nodes of these ids (id)."""
    return Index(ix.docs.join(ids, "id", "left_anti"), ix.postings.join(ids, "id", "left_anti"))


def open_or_build(nodes: DataFrame, path: str) -> Index:
    """The index saved at ``path``; where there is none that was finished, it is built and saved there first."""
    spark = nodes.sparkSession
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/postings/_SUCCESS")
    if not done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done):
        build(nodes).save(path)
    return Index.load(spark, path)


def _query_terms(spark: SparkSession, text: str) -> list[str]:
    return sorted(set(spark.range(1).select(terms(F.lit(text)).alias("t")).first()["t"]))


def _scored(ix: Index, hits: DataFrame, n_docs: DataFrame) -> DataFrame:
    df = hits.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    weight = F.sqrt("tf") * (1 + F.log(F.col("n_docs") / (1 + F.col("df")))) / F.sqrt("length")
    return hits.join(df, "term").crossJoin(n_docs).groupBy("id").agg(F.round(F.sum(weight), 6).alias("score"))


def match(ix: Index, query: str, types: Sequence[str] = ()) -> DataFrame:
    """(id, type, label, package, source_file, doc, score) of the documents with any of the query's terms."""
    words = _query_terms(ix.docs.sparkSession, query)
    hits = ix.postings.where(F.col("term").isin(*words)) if words else ix.postings.where(F.lit(False))
    return _with_docs(ix, hits, types)


def fuzzy(ix: Index, query: str, distance: int, types: Sequence[str] = ()) -> DataFrame:
    """Like :func:`match` for one term, unanalysed, within an edit distance."""
    d = F.levenshtein(F.col("term"), F.lit(query), distance)
    return _with_docs(ix, ix.postings.where(d >= 0), types)


def _with_docs(ix: Index, hits: DataFrame, types: Sequence[str]) -> DataFrame:
    docs = ix.docs.where(F.col("type").isin(*types)) if types else ix.docs
    n = ix.docs.agg(F.count(F.lit(1)).alias("n_docs"))
    return _scored(ix, hits, n).join(docs.select("id", "type", "label", "package", "source_file", "doc"), "id")


def page(found: DataFrame, limit: int = 20, offset: int = 0) -> DataFrame:
    """(id, type, label, score, snippet, total, truncated), by score, then id."""
    total = found.agg(F.count(F.lit(1)).alias("total"))
    cut = F.when(F.length("doc") > SNIPPET, F.concat(F.substring("doc", 1, SNIPPET), F.lit("..."))).otherwise(F.col("doc"))
    rows = found.select("id", "type", "label", "score", cut.alias("snippet")).orderBy(F.desc("score"), "id").offset(offset).limit(limit)
    return rows.crossJoin(total).withColumn("truncated", F.col("total") > limit + offset)


def highlight(text: Column, words: Sequence[str]) -> Column:
    """Marks the words of a query in a text."""
    import re

    pattern = r"(?iu)(?<![\p{L}\p{Nd}_])(" + "|".join(re.escape(w) for w in sorted(words)) + r")(?![\p{L}\p{Nd}_])"
    return F.regexp_replace(text, pattern, "<mark>$1</mark>") if words else text


def facets(found: DataFrame, top: int = 10) -> DataFrame:
    """(type, n) over all hits."""
    return found.groupBy("type").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "type").limit(top)


def stats(ix: Index) -> DataFrame:
    p = ix.postings.agg(F.count_distinct("term").alias("terms"), F.count(F.lit(1)).alias("postings"))
    return ix.docs.agg(F.count(F.lit(1)).alias("docs")).crossJoin(p)
