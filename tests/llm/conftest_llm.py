import random

import pytest


def rows_of(df):
    return [r.asDict() for r in df.collect()]


SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def docs_of(spark, rows, schema=SCHEMA):
    """rows: (doc_id, text[, source])"""
    return spark.createDataFrame([(r[0], r[1], None, r[2] if len(r) > 2 else "s", None if r[1] is None else len(r[1])) for r in rows], schema)


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, and columns whose names clash."""
    long = " ".join(f"w{i % 977} x{i}" for i in range(60_000)) + "\n" + "same words here\n" * 3000
    rows = [
        (1, "alpha beta gamma delta epsilon", "a"), (1, "alpha beta gamma delta epsilon", "a"), (2, "alpha beta gamma delta epsilon", "b"),
        (None, "a null id keeps its own text here", "a"), (None, None, None), (3, None, "a"), (4, "", "a"), (5, "   \n\t ", None), (6, "", "b"),
        (7, long, "a"), (8, long, "b"), (9, "x" * 300_000, "b"), (10, "!!! ... ???", "a"), (1, "another text of the same id", "a"), (11, "one", "a"), (12, "Ünïcödé ñandú \U0001f600 «ça»", "b"),
    ]
    extra = ["weft_key string", "weft_rank int", "canonical_id bigint", "is_duplicate boolean", "tag string", "copies int", "node string", "label string", "score string", "toxic string", "shard int", "key string", "block string", "`a.b` string"]
    schema = SCHEMA + ", " + ", ".join(extra)
    return spark.createDataFrame([(i, t, None, s, None, *[None] * len(extra)) for i, t, s in rows], schema)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def syllables():
    rng = random.Random(5)
    parts = "an be ti on er in re th st ou ha ed or la mi ko".split()
    vocab = ["".join(rng.choices(parts, k=rng.randint(1, 4))) for _ in range(900)]

    def make(n, seed):
        r = random.Random(seed)
        return " ".join(r.choices(vocab, k=n))

    return make
