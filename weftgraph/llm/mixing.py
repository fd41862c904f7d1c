"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Each document draws the exponential key ``-ln(u) / w``, where ``u`` is a
deterministic uniform number from a hash of its id and the seed, and ``w`` its
quality weight. Within a source the keys order the documents; the prefix sum of
their tokens is cut at the source's token budget. A budget of more than the
source's tokens takes the whole source as often as it fits (complete epochs)
before the ordered fraction.

The quality weight is estimated from ``labels``: two measures of the text, its share of digits and
punctuation and its share of distinct words, divide documents into ``CELLS`` cells, and a document weighs the
share of good ones among all labelled documents of its cell, smoothed by one of either kind.

Nothing is sorted globally and no source has to fit in one task, however hot. The keys fall in
``BUCKETS`` bands by a monotone function; the bands' token sums are prefix-summed (a table of sources times
bands), which shows the one band of each source that its budget cuts. Only the rows of that band are
sorted, for the last key that is still taken; every row then decides by comparing its own key with its
source's. The result is that of one sort by source, exactly. Each text is read and hashed once: the
rows that carry the keys are written to the shared folder without text.

Cases: a null or empty text has no tokens and is selected with its position in
the order like others; a null source is a source of its own; documents that share
an id share ``u``, and ties are broken by id, then text hash; rows that are equal in all of these are
taken or left together; a source without a target, or of target 0, contributes nothing; an empty table gives an
empty result. A label that is null is none, of several of a document the lowest counts, and without labels all weigh 1.
A quality weight that is null, not finite or not above ``MIN_WEIGHT`` counts as ``MIN_WEIGHT``. Ids are integers.
Extra columns, also of clashing names, pass through :func:`mixed_documents` unchanged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import durable, own_prefix, quoted, word_count

#: Bands of the key order within a source.
BUCKETS = 65_536
MIN_WEIGHT = 0.05
#: Exponent of a source's share of tokens in the default targets: below 1 it lifts small sources.
TEMPERATURE = 0.5
SEED = 17


#: Upper bounds of the shares of marks and of distinct words that divide the cells.
MARKS = (0.01, 0.02, 0.03, 0.04, 0.06, 0.1, 0.2)
DISTINCT = (0.3, 0.6, 0.7, 0.9)
CELLS = (len(MARKS) + 1) * (len(DISTINCT) + 1)


def quality_cell(text: Column) -> Column:
    """The cell of a text, 0 to CELLS - 1; a null one is an empty one."""
    text = F.coalesce(text, F.lit(""))
    marks = F.regexp_count(text, F.lit(r"[!-/0-9:-@\[-`{-~]")) / F.greatest(F.length(text), F.lit(1))
    words = F.split(text, " ")
    distinct = F.size(F.array_distinct(words)) / F.size(words)

    def above(x: Column, bounds: tuple[float, ...]) -> Column:
        out = F.lit(len(bounds))
        for i, b in reversed(list(enumerate(bounds))):
            out = F.when(x < b, i).otherwise(out)
        return out

    return above(marks, MARKS) * (len(DISTINCT) + 1) + above(distinct, DISTINCT)


def cell_weights(rows: DataFrame, labels: DataFrame | None) -> Column:
    """The weight of a row of (doc_id, cell); what comes to the driver is bounded by the cells."""
    if labels is None:
        return F.lit(1.0)
    known = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy(F.col("doc_id").alias("l_id")).agg(F.min("quality").alias("good"))
    found = rows.join(known, F.col("doc_id") == F.col("l_id")).groupBy("cell").agg(F.count_if(F.col("good") > 0).alias("good"), F.count(F.lit(1)).alias("n"))
    share = [0.5] * CELLS
    for cell, good, n in found.collect():
        share[cell] = (good + 1) / (n + 2)
    return F.get(F.array(*(F.lit(x) for x in share)), F.col("cell"))


def uniform(id_col: Column, seed: int = SEED) -> Column:
    """A number in (0, 1) from the first 48 bits of MD5 of seed and id."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit("")))
    return (F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("double") + 0.5) / float(2**48)


def _key_of(key: Column, doc_id: Column, tag: Column) -> Column:
    return F.struct(key.alias("key"), doc_id.isNull().alias("none"), doc_id.alias("doc_id"), tag.alias("tag"))


def _keyed(docs: DataFrame, labels: DataFrame | None, id_col: str, text_col: str, source_col: str, weight: Column | None, seed: int) -> DataFrame:
    """(doc_id, source, tag, n_tokens, key, band) of all documents, from a table without text in the shared folder."""
    own = F.lit(None).cast("double") if weight is None else weight.cast("double")
    rows = durable(
        docs.select(
            F.col(id_col).cast("bigint").alias("doc_id"),
            F.col(source_col).alias("source"),
            F.xxhash64(text_col).alias("tag"),
            word_count(F.col(text_col)).alias("n_tokens"),
            quality_cell(F.col(text_col)).alias("cell"),
            own.alias("own"),
        )
    )
    w = cell_weights(rows, labels) if weight is None else F.col("own")
    w = F.when(w.isNull() | F.isnan(w) | (w == float("inf")) | ~(w > MIN_WEIGHT), F.lit(MIN_WEIGHT)).otherwise(w)
    rows = rows.withColumn("key", -F.log(uniform(F.col("doc_id"), seed)) / w)
    # -ln(u)/w is at most about 34/MIN_WEIGHT; 1 - exp(-key) would crowd, so bands follow the logarithm of the key.
    band = F.greatest(F.lit(0), F.least(F.lit(BUCKETS - 1), F.floor((F.log("key") + 14) * (BUCKETS / 21.0)))).cast("int")
    return rows.select("doc_id", "source", "tag", "n_tokens", "key", band.alias("band"))


def _cuts(rows: DataFrame, targets: dict[str, float] | None, budget: int | None) -> DataFrame:
    """(c_source, epochs, cut, last): of each source that has tokens its complete epochs, the band that its budget cuts, and the last key taken there."""
    spark = rows.sparkSession
    bands = durable(rows.groupBy("source", "band").agg(F.sum("n_tokens").alias("band_tokens")))
    totals = bands.groupBy("source").agg(F.sum("band_tokens").alias("src_tokens"))
    if targets is None:
        totals = totals.withColumn("target", F.pow(F.col("src_tokens").cast("double"), F.lit(TEMPERATURE)))
    else:
        given = spark.createDataFrame([(k, float(v)) for k, v in targets.items()], "t_source string, target double")
        totals = totals.join(given, F.col("source").eqNullSafe(F.col("t_source")), "left").drop("t_source").fillna({"target": 0.0})
    totals = durable(totals)
    tokens, weight = totals.agg(F.sum("src_tokens"), F.sum("target")).first()
    share = F.col("target") / F.lit(float(weight)) if weight else F.lit(0.0)
    goal = F.floor(F.lit(int(tokens or 0) if budget is None else budget) * share).cast("bigint")
    plan = (
        totals.withColumn("goal", goal)
        .where("src_tokens > 0")
        .select(F.col("source").alias("p_source"), F.floor(F.col("goal") / F.col("src_tokens")).cast("bigint").alias("epochs"), (F.col("goal") % F.col("src_tokens")).alias("rest"))
    )
    upto = F.sum("band_tokens").over(Window.partitionBy("source").orderBy("band"))  # at most BUCKETS rows a source
    placed = bands.withColumn("upto", upto).join(plan, F.col("source").eqNullSafe(F.col("p_source")))
    over = placed.where(F.col("upto") > F.col("rest")).groupBy("source").agg(
        F.min("band").alias("cut"), F.min_by(F.col("upto") - F.col("band_tokens"), "band").alias("before"), F.first("epochs").alias("epochs"), F.first("rest").alias("rest")
    )
    over = durable(over.select(F.col("source").alias("c_source"), "cut", "before", "epochs", "rest"))
    at_cut = rows.join(over, F.col("source").eqNullSafe(F.col("c_source")) & (F.col("band") == F.col("cut")))
    # the frame takes in rows that are equal in the whole order
    run = F.sum("n_tokens").over(Window.partitionBy("source").orderBy(_key_of(F.col("key"), F.col("doc_id"), F.col("tag"))))
    taken = at_cut.withColumn("run", run).where(F.col("before") + F.col("run") <= F.col("rest"))
    last = taken.groupBy(F.col("source").alias("l_source")).agg(F.max(_key_of(F.col("key"), F.col("doc_id"), F.col("tag"))).alias("last"))
    return durable(over.join(last, F.col("c_source").eqNullSafe(F.col("l_source")), "left").select("c_source", "epochs", "cut", "last"))


def mix_sources(
    docs: DataFrame,
    targets: dict[str, float] | None = None,
    budget: int | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weight: Column | None = None,
    seed: int = SEED,
    labels: DataFrame | None = None,
) -> DataFrame:
    """(doc_id, source, tag, n_tokens, copies): the documents selected at least once.

    ``targets`` gives each source its weight (scaled to sum 1), by default its share of
    tokens to the power TEMPERATURE; ``budget`` is the number of tokens to emit, by
    default as many as the table has. ``weight`` is an expression of the input's columns that takes the place
    of the estimate from ``labels`` (doc_id, quality). ``tag`` is the hash of the text.
    """
    rows = _keyed(docs, labels, id_col, text_col, source_col, weight, seed)
    placed = rows.join(_cuts(rows, targets, budget), F.col("source").eqNullSafe(F.col("c_source")))
    at_cut = (F.col("band") == F.col("cut")) & F.coalesce(_key_of(F.col("key"), F.col("doc_id"), F.col("tag")) <= F.col("last"), F.lit(False))
    copies = F.col("epochs") + F.when((F.col("band") < F.col("cut")) | at_cut, 1).otherwise(0)
    return placed.select("doc_id", "source", "tag", "n_tokens", copies.cast("bigint").alias("copies")).where("copies > 0")


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The input's own rows and columns, each repeated as often as :func:`mix_sources` selects it; ``options`` as there."""
    id_col, text_col, source_col = (options.get(k, v) for k, v in (("id_col", "doc_id"), ("text_col", "text"), ("source_col", "source")))
    own = own_prefix(docs.columns)
    chosen = mix_sources(docs, **options).groupBy("doc_id", "source", "tag").agg(F.max("copies").alias("copies"))
    chosen = chosen.select(*(F.col(c).alias(own + c) for c in chosen.columns))
    same = F.col(id_col).cast("bigint").eqNullSafe(F.col(f"{own}doc_id")) & F.col(source_col).eqNullSafe(F.col(f"{own}source"))
    same &= F.xxhash64(F.col(text_col)) == F.col(f"{own}tag")
    copies = F.explode(F.sequence(F.lit(1), F.col(f"{own}copies").cast("int")))
    return docs.join(chosen.hint("merge"), same).select(*(quoted(c) for c in docs.columns), copies.alias(f"{own}copy")).drop(f"{own}copy")
