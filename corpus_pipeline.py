"""The corpus pipeline: from raw documents to packed training windows.

Each stage is a function (spark, docs, sf_dir) -> DataFrame of one operator of
``weftgraph.llm``; its result is written as Parquet and read again as the next stage's
``docs``. All stages but the last return the columns of ``documents``:

1. toxicity: documents whose context-weighted hits reach the threshold go;
2. exact_dedup: of equal normalised texts the smallest id stays;
3. near_dedup: of each group of near duplicates the smallest id stays;
4. mixing: documents are drawn to the sources' target weights, a document of a second epoch is a second row;
5. packing: each row's tokens are placed in windows.

Cases: a document with a null or empty text isn't toxic, is a copy of nothing if null and of other empty
texts if empty, has no near copies and no tokens, and takes no place in a window; repeated rows are exact copies;
ids may be null; an empty table gives an empty result; extra columns pass through to the last stage, which has its own.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from weftgraph.checkpoints import remove, shared_folder
from weftgraph.llm import exact_dedup, mixing, near_dedup, packing, toxicity
from weftgraph.llm.common import table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_exact_duplicates(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.drop_near_duplicates(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs, labels=table(spark, sf_dir, "labels"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("mixing", mix),
    ("packing", pack),
]

#: Neither the learned lexicon nor the signatures nor the packing rule can be put in SQL.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the steps between lie in the shared folder, where a lost executor can't take them."""
    folder = f"{shared_folder(spark)}/corpus-pipeline-{uuid.uuid4().hex}"
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        if before:
            remove(spark, before)
        before = f"{folder}/{name}"
        docs = spark.read.parquet(before)
    return STAGES[-1][1](spark, docs, sf_dir)
