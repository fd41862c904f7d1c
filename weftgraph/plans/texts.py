"""Queries of the scalar functions and of the rules by which files are listed, over columns of ordinary tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..sources import ingest as N
from ..sources import projections as P
from .registry import query


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _mask(column: str, signs: str) -> str:
    return f"translate({column}, {_q(signs)}, '{'_' * len(signs)}')"


@query(
    f"""n AS (SELECT p_partkey AS k, p_type || '/' || p_brand AS x, CASE p_partkey % 3 WHEN 0 THEN 'func_' WHEN 1 THEN 'type_' ELSE 'doc_' END || p_name AS y FROM part)
    => SELECT k, 'part_' || {_mask("x", S._ID_SIGNS)} AS made, lower({_mask("x", S._DOC_ID_SIGNS)}) AS doc_id, regexp_replace(y, '{S._COMPACT}', '') AS compact,
      regexp_replace(translate(lower(x), ' _', '--'), '[^a-z0-9-]', '', 'g') AS slug, {_mask("x", '/:*?"<>|' + chr(92))} AS note FROM n""",
    graph="",
)
def scalar_ids(spark: SparkSession, d: str) -> DataFrame:
    prefix = F.element_at(F.array(F.lit("func_"), F.lit("type_"), F.lit("doc_")), (F.col("p_partkey") % 3 + 1).cast("int"))
    n = P.read(spark, d, "part").select(F.col("p_partkey").alias("k"), F.concat("p_type", F.lit("/"), "p_brand").alias("x"), F.concat(prefix, "p_name").alias("y"))
    x = F.col("x")
    return n.select("k", S.make_id("part_", x).alias("made"), S.sanitize_doc_id(x).alias("doc_id"), S.compact_id(F.col("y")).alias("compact"), S.slugify(x).alias("slug"), S.vault_name(x).alias("note"))


def _one_decimal(x: str) -> str:
    return f"printf('%.1f', floor(({x}) * 10 + 0.5) / 10)"


@query(
    f"""n AS (SELECT doc_id, text, source, CASE doc_id % 3 WHEN 0 THEN n_chars WHEN 1 THEN n_chars * 1000 ELSE n_chars * 1000000 END::BIGINT AS n FROM documents)
    => SELECT doc_id, CASE WHEN n < 1024 THEN n || ' B' WHEN n < 1048576 THEN {_one_decimal("n / 1024")} || ' KB' WHEN n < 1073741824 THEN {_one_decimal("n / 1048576")} || ' MB' ELSE {_one_decimal("n / 1073741824")} || ' GB' END AS bytes,
      CASE WHEN n < 1000 THEN n || '' WHEN n < 1000000 THEN {_one_decimal("n / 1000")} || 'K' ELSE {_one_decimal("n / 1000000")} || 'M' END AS number, sha256(text) AS hash, left(sha256(source), 32) AS key FROM n""",
    graph="",
)
def scalar_sizes(spark: SparkSession, d: str) -> DataFrame:
    scale = F.element_at(F.array(F.lit(1), F.lit(1_000), F.lit(1_000_000)), (F.col("doc_id") % 3 + 1).cast("int"))
    n = P.read(spark, d, "documents").withColumn("n", F.col("n_chars").cast("bigint") * scale)
    return n.select("doc_id", S.format_bytes(F.col("n")).alias("bytes"), S.format_number(F.col("n")).alias("number"), S.content_hash(F.col("text")).alias("hash"), S.cache_key(F.col("source")).alias("key"))


_PATHS = r"""p AS (SELECT page_id, regexp_replace(url, '^https?://[^/]*/', '') AS path FROM pages),
  f AS (SELECT page_id, CASE page_id % 6 WHEN 0 THEN 'vendor/' || path WHEN 1 THEN path || '/.git/x.go' WHEN 2 THEN path || '_test.go' WHEN 3 THEN 'src/test/' || path || '.java' WHEN 4 THEN path || '.spec.ts' ELSE path || '.MD' END AS rel FROM p),
  b AS (SELECT *, string_split(rel, '/')[-1] AS base, string_split(rel, '/')[:-2] AS folders FROM f)"""


def _paths(spark: SparkSession, d: str) -> DataFrame:
    p = P.read(spark, d, "pages").select("page_id", F.regexp_replace("url", "^https?://[^/]*/", "").alias("path"))
    path = F.col("path")
    kinds = [F.concat(F.lit("vendor/"), path), F.concat(path, F.lit("/.git/x.go")), F.concat(path, F.lit("_test.go")), F.concat(F.lit("src/test/"), path, F.lit(".java")), F.concat(path, F.lit(".spec.ts")), F.concat(path, F.lit(".MD"))]
    return p.select("page_id", F.element_at(F.array(*kinds), (F.col("page_id") % 6 + 1).cast("int")).alias("rel"))


@query(
    _PATHS
    + f""" => SELECT page_id, rel, len([x FOR x IN folders IF starts_with(x, '.') OR x IN ({", ".join(map(_q, N.SKIPPED_FOLDERS))})]) > 0 AS skipped,
      ends_with(base, '_test.go') OR regexp_matches(base, '\\.(test|spec)\\.(ts|tsx|js)$') OR contains(rel, '__tests__') OR regexp_matches(base, 'Tests?\\.(java|swift)$') OR contains('/' || rel, '/test/') AS test,
      CASE WHEN contains(base, '.') THEN lower('.' || string_split(base, '.')[-1]) ELSE '' END AS extension FROM b""",
    graph="",
)
def listing_rules(spark: SparkSession, d: str) -> DataFrame:
    rel = F.col("rel")
    swift = F.substring_index(rel, "/", -1).rlike(r"Tests?\.swift$")
    return _paths(spark, d).select("page_id", "rel", N.in_skipped_folder(rel).alias("skipped"), (N.is_test_file(rel) | swift).alias("test"), N.extension(rel).alias("extension"))


@query(
    r"""SELECT page_id, regexp_replace(string_split(regexp_replace(url, '/+$', ''), '/')[-1], '\.git$', '') AS repo,
      CASE WHEN starts_with(e, '.') OR e = '' THEN e ELSE '.' || e END AS extension, NOT contains(string_split(replace(url, '://', '/'), '/')[1], '.') AS standard
    FROM (SELECT page_id, url, lower(string_split(url, '.')[-1]) AS e FROM pages)""",
    graph="",
)
def scalar_urls(spark: SparkSession, d: str) -> DataFrame:
    p = P.read(spark, d, "pages")
    path = F.replace("url", F.lit("://"), F.lit("/"))
    return p.select("page_id", S.repo_name(F.col("url")).alias("repo"), S.normalize_extension(F.substring_index("url", ".", -1)).alias("extension"), S.is_standard_package(path).alias("standard"))


@query("SELECT src || '|' || dst || '|' || type AS key FROM edges")
def edge_keys(spark: SparkSession, d: str) -> DataFrame:
    return P.commerce_edges(spark, d).select(S.edge_key(F.col("src"), F.col("dst"), F.col("type")).alias("key"))


@query("""g AS (SELECT package, list(label ORDER BY id) AS l FROM nodes WHERE type IN ('file', 'package', 'interface') GROUP BY package)
    => SELECT package, CASE WHEN len(l) > 9 THEN array_to_string(l[:9], ', ') WHEN len(l) = 1 THEN l[1] ELSE array_to_string(l[:-2], ', ') || ' and ' || l[-1] END AS names FROM g""")
def joined_labels(spark: SparkSession, d: str) -> DataFrame:
    own = P.commerce_nodes(spark, d).where(F.col("type").isin("file", "package", "interface"))
    groups = own.groupBy(F.coalesce(F.col("attrs")["package"], F.lit("")).alias("package")).agg(F.array_sort(F.collect_list(F.struct("id", "label"))).alias("x"))
    return groups.select("package", S.join_max(F.transform("x", lambda v: v["label"]), 9).alias("names"))
