"""From a tree of source files to a graph: list, choose an extractor, skip what the cache has, parse, explode.

Files are read by Spark's binary source and parsed by executors in Arrow batches; a file's result is
one row, so nodes and edges of millions of files never meet on the driver.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import cache_key, content_hash, estimate_tokens
from ..model import Graph
from .extractors.base import Extractor, Registry, default_registry

SKIPPED_FOLDERS = tuple("Pods __pycache__ build dist node_modules target testdata vendor".split())
DOC_EXTENSIONS = (".markdown", ".md", ".rst", ".txt")
_NODE = "array<struct<id:string,type:string,label:string,attrs:map<string,string>>>"
_EDGE = "array<struct<src:string,dst:string,type:string,confidence:string,confidence_score:double,attrs:map<string,string>>>"
PARSED = f"path_key string, path string, file_hash string, language string, framework string, error string, nodes {_NODE}, edges {_EDGE}"

_N = pa.list_(pa.struct([("id", pa.string()), ("type", pa.string()), ("label", pa.string()), ("attrs", pa.map_(pa.string(), pa.string()))]))
_E = pa.list_(pa.struct([("src", pa.string()), ("dst", pa.string()), ("type", pa.string()), ("confidence", pa.string()), ("confidence_score", pa.float64()), ("attrs", pa.map_(pa.string(), pa.string()))]))


def in_skipped_folder(rel: Column) -> Column:
    """Whether a folder above the file is hidden or holds what others wrote or tools made."""
    folders = F.slice(F.split(rel, "/"), F.lit(1), F.greatest(F.size(F.split(rel, "/")) - 1, F.lit(0)))
    return F.exists(folders, lambda p: p.startswith(".") | p.isin(*SKIPPED_FOLDERS))


def is_test_file(rel: Column, language: Column | None = None) -> Column:
    """By the rules of the file's language; without one, by those of any."""
    base = F.substring_index(rel, "/", -1)
    script = base.rlike(r"\.(test|spec)\.(ts|tsx|js)$") | rel.contains("__tests__")
    java = base.rlike(r"Tests?\.java$") | F.concat(F.lit("/"), rel).contains("/test/")
    swift = base.rlike(r"Tests?\.swift$")
    if language is None:
        return base.endswith("_test.go") | script | java
    return (
        F.when(language == "go", base.endswith("_test.go")).when(language.isin("typescript", "javascript"), script)
        .when(language == "java", java).when(language == "swift", swift).otherwise(False)
    )


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """(rel, length, content) of all files below a folder but those in skipped folders; content is read only where it is used."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    top = root.rstrip("/") + "/"
    bare = F.regexp_replace(F.col("path"), r"^[a-z0-9]+:/+", "/") if "://" not in root else F.col("path")
    rel = bare.substr(F.lit(len(top) + 1), F.length(bare))
    return files.select(rel.alias("rel"), "length", "content").where(~in_skipped_folder(F.col("rel")))


def extension(rel: Column) -> Column:
    base = F.substring_index(rel, "/", -1)
    return F.when(base.contains("."), F.lower(F.concat(F.lit("."), F.substring_index(base, ".", -1)))).otherwise("")


def source_files(spark: SparkSession, root: str, extensions: Sequence[str] = (".go",), skip_tests: bool = True) -> DataFrame:
    """(rel, text) of the files of these extensions (all for none)."""
    df = list_files(spark, root)
    if extensions:
        df = df.where(extension(F.col("rel")).isin(*(e.lower() for e in extensions)))
    if skip_tests:
        df = df.where(~is_test_file(F.col("rel")))
    return df.select("rel", F.decode("content", "UTF-8").alias("text"))


def source_tokens(spark: SparkSession, root: str, extensions: Sequence[str] = (".go",)) -> DataFrame:
    """One row (files, source_tokens)."""
    return source_files(spark, root, extensions).agg(F.count("*").alias("files"), F.coalesce(F.sum(estimate_tokens(F.col("text"))), F.lit(0)).alias("source_tokens"))


def doc_files(spark: SparkSession, root: str) -> DataFrame:
    """(path, tokens, type) of documents; a word is 1.3 tokens here."""
    from ..functions.scalars import classify_doc

    df = source_files(spark, root, DOC_EXTENSIONS, skip_tests=False)
    return df.select(F.col("rel").alias("path"), F.floor(F.regexp_count("text", F.lit(r"\S+")) * F.lit(1.3).cast("double")).cast("bigint").alias("tokens"), classify_doc(F.col("rel")).alias("type"))


@dataclass(frozen=True)
class Parser:
    """``registry`` makes the extractors on the workers; ``custom`` maps an extension to a factory that comes before it."""

    registry: Callable[[], Registry] = default_registry
    custom: tuple[tuple[str, Callable[[], Extractor]], ...] = ()

    def extractor(self, reg: Registry, path: str) -> Extractor | None:
        for ext, make in self.custom:
            if path.lower().endswith(ext.lower()):
                return make()
        return reg.get_by_path(path)

    def languages(self) -> dict[str, str]:
        """Language by extension."""
        reg = self.registry()
        found = {e: reg.get(e).language for e in reg.extensions()}
        return found | {e.lower(): make().language for e, make in self.custom}


def parse(files: DataFrame, parser: Parser = Parser()) -> DataFrame:
    """One row of :data:`PARSED` for each file (rel, content) that has an extractor; a file that fails has an error and no rows."""
    languages = parser.languages()
    pairs = F.create_map(*(F.lit(x) for kv in languages.items() for x in kv))
    own = files.withColumn("language", pairs[extension(F.col("rel"))]).where(F.col("language").isNotNull())
    own = own.where(~is_test_file(F.col("rel"), F.col("language"))).select("rel", "content", content_hash(F.col("content")).alias("file_hash"), cache_key(F.col("rel")).alias("path_key"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reg = parser.registry()
        for batch in batches:
            for i in range(batch.num_rows):  # a row at a time: a parsed file may be large
                path = batch.column("rel")[i].as_py()
                text = (batch.column("content")[i].as_py() or b"").decode("utf-8", "replace")
                one = parser.extractor(reg, path)
                nodes, edges, error, framework = [], [], None, ""
                try:
                    if one is None or not one.can_extract(path, text):
                        continue
                    found = one.extract(path, text)
                    framework = one.framework(path, text)
                    nodes = [{"id": a, "type": b, "label": c, "attrs": list(d.items())} for a, b, c, d in found.nodes]
                    edges = [{"src": a, "dst": b, "type": c, "confidence": d, "confidence_score": e, "attrs": list(f.items())} for a, b, c, d, e, f in found.edges]
                except Exception as e:  # noqa: BLE001 - one bad file doesn't end the run; it is counted
                    error = f"{type(e).__name__}: {e}"
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([batch.column("path_key")[i].as_py()]), pa.array([path]), pa.array([batch.column("file_hash")[i].as_py()]), pa.array([one.language]), pa.array([framework]),
                        pa.array([error], pa.string()), pa.array([nodes], _N), pa.array([edges], _E),
                    ],
                    names=["path_key", "path", "file_hash", "language", "framework", "error", "nodes", "edges"],
                )

    return own.mapInArrow(run, PARSED)


def to_graph(parsed: DataFrame) -> Graph:
    """Distinct nodes and edges of parsed files."""
    nodes = parsed.select(F.explode("nodes").alias("n")).select("n.*")
    edges = parsed.select(F.explode("edges").alias("e")).select("e.*")
    return Graph(nodes, edges).distinct()


def stats(parsed: DataFrame, hits: int = 0) -> dict:
    """Counts of a run: files, cache hits and misses, errors, files by language."""
    rows = parsed.groupBy("language").agg(F.count("*").alias("n"), F.count("error").alias("errors")).collect()
    misses = sum(r["n"] for r in rows)
    return {"files": hits + misses, "hits": hits, "misses": misses, "errors": sum(r["errors"] for r in rows), "by_language": {r["language"]: r["n"] for r in rows}}


def frameworks(parsed: DataFrame) -> DataFrame:
    """(language, frameworks)"""
    return parsed.where("framework <> ''").groupBy("language").agg(F.array_sort(F.collect_set("framework")).alias("frameworks"))


class Cache:
    """Parsed files as a Parquet table. A file is a hit if its path's entry has its content's hash."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def entries(self) -> DataFrame:
        try:
            return self.spark.read.schema(PARSED).parquet(self.path)
        except Exception as e:  # noqa: BLE001
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], PARSED)

    def check(self, files: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(cached entries, files without one) of files (rel, content)."""
        have = self.entries()
        keyed = files.withColumn("path_key", cache_key(F.col("rel"))).withColumn("file_hash", content_hash(F.col("content")))
        key = ["path_key", "file_hash"]
        return have.join(keyed.select(*key), key, "left_semi"), keyed.join(have.select(*key), key, "left_anti").drop(*key)

    def put(self, parsed: DataFrame) -> None:
        """Adds entries that have a node; of older ones of the same path, the newer content's hash is what counts."""
        parsed.where(F.size("nodes") > 0).write.mode("append").parquet(self.path)

    def size(self) -> int:
        return self.entries().count()

    def clear(self) -> None:
        self.spark.createDataFrame([], PARSED).write.mode("overwrite").parquet(self.path)


def extract_tree(spark: SparkSession, root: str, cache: Cache | None = None, parser: Parser = Parser()) -> tuple[Graph, dict]:
    """The graph of a source tree and the run's counts."""
    files = list_files(spark, root).select("rel", "content")
    if cache is None:
        parsed = parse(files, parser)
        return to_graph(parsed), stats(parsed)
    from ..checkpoints import saved

    hits, misses = cache.check(files)
    hits, fresh = saved(hits), saved(parse(misses, parser))
    cache.put(fresh)
    return to_graph(hits.unionByName(fresh)), stats(fresh, hits.count())


def semantic_json(spark: SparkSession, text: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) with ``ordinal``, of a model's answer; its JSON may be fenced. Malformed JSON raises ValueError."""
    from ..functions.scalars import strip_fence

    bare = spark.createDataFrame([(text,)], "t string").select(strip_fence(F.col("t")).alias("t")).first()["t"]
    root = json.loads(bare)
    nodes = [(n["id"], n.get("type", ""), n.get("label", ""), {k: str(v) for k, v in (n.get("attrs") or {}).items()}, i) for i, n in enumerate(root.get("nodes") or [])]
    edges = [(e.get("from", ""), e.get("to", ""), e.get("type", ""), e.get("confidence", ""), float(e.get("confidence_score") or 0), e.get("reason", ""), i) for i, e in enumerate(root.get("edges") or [])]
    return (
        spark.createDataFrame(nodes, "id string, type string, label string, attrs map<string,string>, ordinal bigint"),
        spark.createDataFrame(edges, "src string, dst string, type string, confidence string, confidence_score double, reason string, ordinal bigint"),
    )
