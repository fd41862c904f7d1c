"""Queries of the training-data operators, each over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, exact_dedup, fingerprints, huffman, line_dedup, lm_scoring, mixing, near_dedup, packing, toxicity
from .common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprints(table(spark, sf_dir, "documents"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents"), labels=table(spark, sf_dir, "labels")).select("doc_id", "source", "n_tokens", "copies")


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.lm_scores(table(spark, sf_dir, "documents"))


def as_layouts(turns: DataFrame) -> DataFrame:
    """(json): each row of ``conversations`` as a record of one of five layouts, by its conversation's number."""
    said = [F.when(F.col("role") == r, F.col("text")).otherwise("").alias(f) for r, f in (("system", "system"), ("user", "prompt"), ("assistant", "response"))]
    speaker = F.when(F.col("role") == "user", "human").when(F.col("role") == "assistant", "gpt").otherwise(F.col("role"))
    parts = F.array(F.struct(F.lit("text").alias("type"), "text"))
    records = [
        F.struct("conv_id", "turn", "role", "text"),
        F.struct(F.col("conv_id").alias("id"), F.array(F.struct("role", F.col("text").alias("content"))).alias("messages")),
        F.struct(F.col("conv_id").alias("id"), F.array(F.struct(speaker.alias("from"), F.col("text").alias("value"))).alias("conversations")),
        F.struct(F.col("conv_id").alias("uuid"), F.array(F.struct("role", parts.alias("content"))).alias("messages")),
        F.struct(F.col("conv_id").alias("conversation_id"), *said),
    ]
    which = F.pmod(F.coalesce("conv_id", F.lit(0)), F.lit(len(records)))
    out = F.to_json(records[0])
    for i, r in enumerate(records[1:], 1):
        out = F.when(which == i, F.to_json(r)).otherwise(out)
    return turns.select(out.alias("json"))


def op5_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.to_turns(as_layouts(table(spark, sf_dir, "conversations")))


def op6_huffman(spark: SparkSession, sf_dir: str) -> DataFrame:
    return huffman.huffman(table(spark, sf_dir, "documents"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_dedup(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (op1_toxicity, op2_fingerprints, op3_mixing, op4_lm_scoring, op5_chat_formatting, op6_huffman, op7_exact_dedup, op8_packing, op9_near_dedup, op10_line_dedup)}


OP3_SQL = r"""
WITH measured AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^ \t\n\r]+')) AS n_tokens,
    len(regexp_extract_all(coalesce(text, ''), '[!-/0-9:-@\[-`{-~]')) / greatest(length(coalesce(text, '')), 1) AS marks,
    len(list_distinct(string_split(coalesce(text, ''), ' '))) / len(string_split(coalesce(text, ''), ' ')) AS words
  FROM documents),
celled AS (
  SELECT *, (SELECT count(*) FROM unnest([0.01::DOUBLE, 0.02, 0.03, 0.04, 0.06, 0.1, 0.2]) AS t(b) WHERE marks >= b) * 5
    + (SELECT count(*) FROM unnest([0.3::DOUBLE, 0.6, 0.7, 0.9]) AS t(b) WHERE words >= b) AS cell
  FROM measured),
known AS (SELECT doc_id, min(quality) > 0 AS good FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id),
weights AS (SELECT cell, (count(*) FILTER (good) + 1) / (count(*) + 2) AS w FROM celled JOIN known USING (doc_id) GROUP BY cell),
rows AS (
  SELECT doc_id, source, n_tokens,
    (-ln((('0x' || substr(md5('17:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 12))::BIGINT::DOUBLE + 0.5) / 281474976710656.0)) / greatest(coalesce(w, 0.5), 0.05) AS k
  FROM celled LEFT JOIN weights USING (cell)),
totals AS (SELECT source, sum(n_tokens)::BIGINT AS src_tokens, pow(sum(n_tokens)::DOUBLE, 0.5) AS target FROM rows GROUP BY source),
plan AS (SELECT source, src_tokens, floor(sum(src_tokens) OVER () * (target / sum(target) OVER ()))::BIGINT AS goal FROM totals),
placed AS (
  SELECT doc_id, source, n_tokens, sum(n_tokens) OVER (PARTITION BY source ORDER BY k, doc_id)::BIGINT AS run FROM rows)
SELECT doc_id, p.source, n_tokens, (goal // src_tokens + CASE WHEN run <= goal % src_tokens THEN 1 ELSE 0 END)::BIGINT AS copies
FROM placed p JOIN plan q ON p.source IS NOT DISTINCT FROM q.source
WHERE src_tokens > 0 AND goal // src_tokens + CASE WHEN run <= goal % src_tokens THEN 1 ELSE 0 END > 0
"""

OP5_SQL = r"""
WITH l AS (SELECT i, layout, md5(array_to_string(string_split(paths, ' '), chr(10))) AS fingerprint FROM (VALUES
  (0, 'flat_turn', 'conv_id role text turn'),
  (1, 'messages', 'id messages[].content messages[].role'),
  (2, 'sharegpt', 'conversations[].from conversations[].value id'),
  (3, 'messages_parts', 'messages[].content[].text messages[].content[].type messages[].role uuid'),
  (4, 'prompt_response', 'conversation_id prompt response system')) AS v(i, layout, paths))
SELECT CAST(conv_id AS VARCHAR) AS conv_id, CASE WHEN i = 0 THEN turn ELSE 0 END AS turn, CASE WHEN text <> '' THEN role END AS role, nullif(text, '') AS content,
  CASE WHEN text <> '' THEN layout ELSE 'empty' END AS layout, fingerprint
FROM conversations JOIN l ON l.i = conv_id % 5
"""

OP7_SQL = r"""
WITH n AS (SELECT doc_id, trim(regexp_replace(text, '[ \t\n\r\f\v]+', ' ', 'g')) AS k FROM documents)
SELECT doc_id,
  CASE WHEN k IS NULL THEN doc_id ELSE min(doc_id) OVER (PARTITION BY k) END AS canonical_id,
  k IS NOT NULL AND row_number() OVER (PARTITION BY k ORDER BY doc_id) > 1 AS is_duplicate
FROM n
"""

OP10_SQL = r"""
WITH l AS (SELECT doc_id, text, string_split(regexp_replace(text, '(\n|[.!?] )', '\1' || chr(1), 'g'), chr(1)) AS raw FROM documents),
p AS (SELECT doc_id, unnest(raw) AS line, unnest(range(len(raw))) AS pos FROM l),
t AS (SELECT doc_id, pos, line, trim(line, ' ' || chr(9) || chr(10) || chr(13)) AS s FROM p),
w AS (
  SELECT doc_id, pos, s || chr(10) || lead(s) OVER o || chr(10) || lead(s, 2) OVER o AS k
  FROM t WINDOW o AS (PARTITION BY doc_id ORDER BY pos)),
later AS (
  SELECT doc_id, pos FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY doc_id, pos) AS r FROM w WHERE k IS NOT NULL AND length(k) > 2) WHERE r > 1),
gone AS (SELECT DISTINCT doc_id, pos + j AS pos FROM later, (SELECT unnest(range(3)) AS j)),
kept AS (SELECT t.doc_id, t.pos, t.line, g.pos IS NOT NULL AS out FROM t LEFT JOIN gone g ON t.doc_id = g.doc_id AND t.pos = g.pos),
a AS (SELECT doc_id, coalesce(string_agg(line, '' ORDER BY pos) FILTER (NOT out), '') AS text, count(*) FILTER (out) AS removed_lines FROM kept GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(a.text, d.text) END AS text, coalesce(a.removed_lines, 0)::BIGINT AS removed_lines
FROM documents d LEFT JOIN a ON d.doc_id = a.doc_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_mixing": OP3_SQL, "op5_chat_formatting": OP5_SQL, "op7_exact_dedup": OP7_SQL, "op10_line_dedup": OP10_SQL}
