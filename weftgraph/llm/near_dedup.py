"""Near deduplication by BagMinHash signatures, bands and verified multiset overlap.

A document is the multiset of its three-word shingles. Each shingle's multiplicity is a
weight, discretised at the integers. As in BagMinHash (Ertl, 2018) the weight axis
carries independent Poisson processes in a hierarchy of dyadic intervals (0, 1], (1, 2],
(2, 4], (4, 8] and so on, of rates equal to their lengths; a point has a time, a
register and, by successive halving, a position on the weight axis, and counts for a
document whose weight reaches that position. A register keeps the smallest
time. Since the processes depend on the shingle alone, two documents agree in a
register with a probability of exactly their weighted Jaccard similarity. Points are
generated in order of time and stop at the document's largest register.

``BANDS`` bands of ``ROWS`` registers give the candidates: a pair at similarity
THRESHOLD meets with probability 0.90, at 0.6 with 0.99. Contents whose multisets are
equal (by two homomorphic 64-bit digests) are one node from the start. Within a
bucket each node is first compared with the bucket's smallest, and the verified
pairs are joined to components, so that groups of any size cost one comparison a
member where they are alike. Buckets that still hold different components are settled by
prefix filtering (Bayardo et al., 2007): with the shingles in one order, rare ones first, two texts of
similarity THRESHOLD share one of the first half of either's. Hence pages that share a bucket through
their template alone, whose own words come first, are never paired, and no candidate is left out: every two nodes of a
bucket that share such a shingle and whose sizes allow it are compared. The order comes from a
table of ``SLOTS`` counters, which may mix up shingles but is one order for all.

A comparison is the full overlap of the two multisets: sum of minima over sum of
maxima, at least THRESHOLD. The texts that are compared at all are moved once; a text's multiset is computed once a round and sent to the nodes that it is compared
with; a node that more than ``SALT`` others are compared with is sent to several tasks.

Groups are the connected components; the smallest doc_id stays (null ids last).

Cases: a null, empty or wordless text has no shingle and is its own group; a text of
fewer than three words is one shingle; rows that repeat id and text are one group of which one
row stays; texts that share an id are told apart by their hash; an empty table gives an
empty result. Ids are integers. Extra columns, also of clashing names, aren't read by
:func:`near_duplicates` and pass through :func:`drop_near_duplicates`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.traversal import star_components
from .common import durable, own_prefix, released
from .textvec import chunks, combine, mix64, segment_ids, words

SHINGLE = 3
BANDS, ROWS = 36, 4
REGISTERS = BANDS * ROWS
THRESHOLD = 0.5
CHUNK = 3_000_000
GOLDEN = np.uint64(0x9E3779B97F4A7C15)
LOW48 = np.uint64(2**48 - 1)
SLOTS = 2**20
SALT = 10_000


def shingles(texts: pa.Array, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text index, 48-bit shingle hash, multiplicity), sorted by text and hash, for up to 65,536 texts."""
    h, bounds = words(texts)
    n = np.diff(bounds)
    owner = segment_ids(bounds)
    if len(h) == 0:
        return (np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64))
    s = h
    for j in range(1, k):
        s = combine(s[: len(h) - j] if len(s) > len(h) - j else s, h[j:])
    start = np.arange(len(s))
    whole = start + k <= bounds[1:][owner[: len(s)]]
    doc, val = owner[: len(s)][whole], s[whole]
    short = np.flatnonzero((n > 0) & (n < k))
    if len(short):
        own = h[bounds[short]]
        for j in range(1, k - 1):
            more = n[short] > j
            own[more] = combine(own[more], h[bounds[short][more] + j])
        doc, val = np.concatenate((doc, short)), np.concatenate((val, mix64(own ^ GOLDEN)))
    key = np.sort((doc.astype(np.uint64) << np.uint64(48)) | (val >> np.uint64(16)))
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    count = np.diff(np.concatenate((first, [len(key)])))
    key = key[first]
    return (key >> np.uint64(48)).astype(np.int64), key & LOW48, count


def bag_minhash(doc: np.ndarray, shingle: np.ndarray, count: np.ndarray, n_docs: int, m: int = REGISTERS) -> np.ndarray:
    """Registers (n_docs, m) as float times; infinite for a document without shingles."""
    sig = np.full(n_docs * m, np.inf)
    # one process for each dyadic interval (lo, lo + rate] that begins below the weight
    d, seed, rate, room = [doc], [mix64(shingle)], [np.ones(len(doc))], [np.ones(len(doc), np.int64)]
    lo = 1
    over = np.flatnonzero(count > lo)
    while len(over):
        d.append(doc[over])
        seed.append(mix64(shingle[over] + np.uint64(int(GOLDEN) * lo % 2**64)))
        rate.append(np.full(len(over), float(lo)))
        room.append(np.minimum(count[over] - lo, lo))
        lo *= 2
        over = over[count[over] > lo]
    d, seed, rate, room = (np.concatenate(x) for x in (d, seed, rate, room))
    time = np.zeros(len(d))  # sums of exponential numbers before division by the rate, so that they don't depend on the steps
    step = 0
    bound = np.full(n_docs, np.inf)
    while len(d):
        r = int(min(64, max(1, 100_000 // len(d)))) if step else 1
        at = (np.arange(step, step + r, dtype=np.uint64) + np.uint64(1)) * GOLDEN
        x = mix64(seed[:, None] + at[None, :])
        sums = np.cumsum(np.column_stack((time, -np.log(((x >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53))), axis=1)[:, 1:]
        t = sums / rate[:, None]
        y = mix64(x)
        reg = (y % np.uint64(m)).astype(np.int64)
        ok = t <= bound[d][:, None]
        if rate.max() > 1:  # position within the interval, by its halvings
            place = (((y >> np.uint64(20)) & np.uint64(2**40 - 1)).astype(np.float64) * 2.0**-40 * rate[:, None]).astype(np.int64)
            ok &= place < room[:, None]
        rows, cols = np.nonzero(ok)
        np.minimum.at(sig, d[rows] * m + reg[rows, cols], t[rows, cols])
        bound = sig.reshape(n_docs, m).max(axis=1)
        time = sums[:, -1]
        live = time / rate <= bound[d]
        d, seed, rate, room, time = d[live], seed[live], rate[live], room[live], time[live]
        step += r
    return sig.reshape(n_docs, m)


def band_hashes(sig: np.ndarray) -> np.ndarray:
    bits = sig.view(np.uint64).reshape(len(sig), BANDS, ROWS)
    h = np.broadcast_to(mix64(np.arange(BANDS, dtype=np.uint64)), (len(sig), BANDS)).copy()
    for j in range(ROWS):
        h = combine(h, bits[:, :, j])
    return h


def _digests(doc: np.ndarray, shingle: np.ndarray, count: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray]:
    out = np.zeros((2, n_docs), np.uint64)
    if len(doc):
        first = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1])))
        for row, seed in enumerate((GOLDEN, ~GOLDEN)):
            out[row, doc[first]] = np.add.reduceat(mix64(shingle ^ seed) * count.astype(np.uint64), first)
    return mix64(out[0]).view(np.int64), mix64(out[1]).view(np.int64)


def _small(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    for part in chunks(batch, "text", CHUNK):
        for i in range(0, part.num_rows, 60_000):
            yield part.slice(i, 60_000)


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in _small(batch):
            doc, sh, count = shingles(part.column("text"))
            n = part.num_rows
            none = np.ones(n, bool)
            none[doc] = False
            bands = band_hashes(bag_minhash(doc, sh, count, n))
            d1, d2 = (pa.array(d, mask=none) for d in _digests(doc, sh, count, n))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, bands.size + 1, BANDS, dtype=np.int32)), pa.array(bands.ravel().view(np.int64)))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("tag"), d1, d2, lists], names=["doc_id", "tag", "d1", "d2", "bands"])


def _pack(doc: np.ndarray, sh: np.ndarray, count: np.ndarray, n_docs: int) -> list[bytes]:
    """A text's multiset: 48 bits of hash and 16 of multiplicity each; higher multiplicities take entries more, of the hash's next values."""
    big = count > 0xFFFF
    entry = (sh << np.uint64(16)) | np.minimum(count, 0xFFFF).astype(np.uint64)
    at = np.searchsorted(doc, np.arange(n_docs + 1))
    out = [entry[a:b].tobytes() for a, b in zip(at[:-1], at[1:])]
    for i in np.flatnonzero(big):
        extra = []
        left, j = int(count[i]) - 0xFFFF, 1
        while left > 0:
            extra.append((((int(sh[i]) + j) % 2**48) << 16) | min(left, 0xFFFF))
            left, j = left - 0xFFFF, j + 1
        d = int(doc[i])
        out[d] = np.sort(np.concatenate((np.frombuffer(out[d], np.uint64), np.array(extra, np.uint64)))).tobytes()
    return out


def overlap(a: bytes, b: bytes) -> float:
    """Weighted Jaccard similarity of two packed multisets."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    low = np.uint64(0xFFFF)
    cx, cy = (x & low).astype(np.int64), (y & low).astype(np.int64)
    _, i, j = np.intersect1d(x >> np.uint64(16), y >> np.uint64(16), assume_unique=True, return_indices=True)
    both = int(np.minimum(cx[i], cy[j]).sum())
    total = int(cx.sum() + cy.sum()) - both
    return both / total if total else 0.0


def _send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in _small(batch):
            blobs = pa.array(_pack(*shingles(part.column("text")), part.num_rows), pa.binary())
            to = part.column("to")
            row = pa.array(np.repeat(np.arange(part.num_rows), np.diff(to.offsets.to_numpy())))
            step = 2_000
            flat = to.flatten()
            hub, salt = flat.field("hub"), flat.field("salt")
            for i in range(0, len(row), step):
                r = row.slice(i, step)
                yield pa.RecordBatch.from_arrays([hub.slice(i, step), salt.slice(i, step), part.column("node").take(r), blobs.take(r)], names=["hub", "salt", "node", "blob"])


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by hub and salt, the hub's own first."""
    hub, own = None, b""
    for batch in batches:
        a, b = [], []
        for h, n, blob in zip(batch.column("hub").to_pylist(), batch.column("node").to_pylist(), batch.column("blob")):
            if h == n:
                hub, own = h, blob.as_py()
            elif h == hub and overlap(own, blob.as_py()) >= THRESHOLD:
                a.append(h)
                b.append(n)
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def verify(pairs: DataFrame, held: DataFrame, salt: int = SALT) -> DataFrame:
    """Of distinct node pairs (a < b) those whose multisets overlap by THRESHOLD; ``held`` has (node, text), one row for each node."""
    parts = pairs.groupBy(F.col("a").alias("hub")).agg(F.ceil(F.count(F.lit(1)) / F.lit(salt)).cast("int").alias("parts"))
    others = pairs.join(parts, F.col("a") == F.col("hub")).select(F.col("b").alias("node"), "hub", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("salt"))
    own = parts.select(F.col("hub").alias("node"), "hub", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("salt"))
    to = others.union(own).groupBy("node").agg(F.collect_list(F.struct("hub", "salt")).alias("to"))
    sent = held.join(to.hint("merge"), "node").mapInArrow(released(_send), "hub bigint, salt int, node bigint, blob binary").repartition("hub", "salt")
    return sent.sortWithinPartitions("hub", "salt", F.col("hub") != F.col("node")).mapInArrow(released(_compare), "a bigint, b bigint").distinct()


def _slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n = np.zeros(SLOTS, np.int64)
    for batch in batches:
        for part in _small(batch):
            n += np.bincount((shingles(part.column("text"))[1] % np.uint64(SLOTS)).astype(np.int64), minlength=SLOTS)
    used = np.flatnonzero(n)
    yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(n[used])], names=["slot", "n"])


def prefixes(texts: pa.Array, order: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text index, hash of an occurrence of a shingle, number of occurrences in the text) of the occurrences that any text of similarity THRESHOLD shares one of."""
    doc, sh, count = shingles(texts)
    rank = np.lexsort((sh, order[(sh % np.uint64(SLOTS)).astype(np.int64)], doc))
    doc, sh, count = doc[rank], sh[rank], count[rank]
    nth = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
    doc, sh = np.repeat(doc, count), np.repeat(sh, count)
    size = np.bincount(doc, minlength=len(texts))
    place = np.arange(len(doc)) - (np.cumsum(size) - size)[doc]
    first = place < size[doc] - np.ceil(THRESHOLD * size[doc]) + 1
    return doc[first], mix64(sh[first] + nth[first].astype(np.uint64) * GOLDEN), size[doc[first]]


def sharing_rare(rows: DataFrame, held: DataFrame) -> DataFrame:
    """Pairs (a < b) of ``rows`` (node, label, buckets) of unlike labels that share a bucket and an occurrence of their prefixes."""
    spark = rows.sparkSession
    found = durable(held.join(rows.hint("merge"), "node"))
    order = np.zeros(SLOTS, np.int64)
    for r in found.select("text").mapInArrow(released(_slots), "slot bigint, n bigint").groupBy("slot").agg(F.sum("n").alias("n")).toLocalIterator():  # at most SLOTS rows
        order[r["slot"]] = r["n"]
    sent = spark.sparkContext.broadcast(order)  # eight megabytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _small(batch):
                doc, item, size = prefixes(part.column("text"), sent.value)
                for i in range(0, len(doc), 50_000):
                    row = pa.array(doc[i : i + 50_000])
                    of_row = [part.column(c).take(row) for c in ("node", "label", "buckets")]
                    yield pa.RecordBatch.from_arrays([*of_row, pa.array(item[i : i + 50_000].view(np.int64)), pa.array(size[i : i + 50_000])], names=["node", "label", "buckets", "item", "size"])

    x = found.mapInArrow(released(run), "node bigint, label bigint, buckets array<bigint>, item bigint, size bigint")
    y = x.select(*(F.col(c).alias(f"y_{c}") for c in x.columns))
    alike = (F.least("size", "y_size") >= THRESHOLD * F.greatest("size", "y_size")) & F.arrays_overlap("buckets", "y_buckets")
    pairs = x.join(y, (F.col("item") == F.col("y_item")) & (F.col("node") < F.col("y_node")) & (F.col("label") != F.col("y_label")) & alike)
    return pairs.select(F.col("node").alias("a"), F.col("y_node").alias("b")).distinct()


def _grouped(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, tag, group), one row for each document; group is null where a text has no shingles."""
    texts = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.xxhash64(text_col).alias("tag"), F.col(text_col).alias("text"))
    signed = durable(texts.mapInArrow(released(_sign), "doc_id bigint, tag bigint, d1 bigint, d2 bigint, bands array<bigint>"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tag", "bands"))
    reps = signed.where("d1 is not null").groupBy("d1", "d2").agg(first.alias("f"))
    reps = durable(reps.select("d1", "d2", F.monotonically_increasing_id().alias("node"), "f.doc_id", "f.tag", "f.bands"))
    each = reps.select("node", F.explode("bands").alias("bucket"))
    shared = durable(each.groupBy(F.col("bucket").alias("s")).agg(F.min("node").alias("hub"), F.count(F.lit(1)).alias("n")).where("n > 1").select("s", "hub"))
    buckets = durable(each.join(shared, F.col("bucket") == F.col("s")).select("bucket", "node", "hub"))
    tried = durable(buckets.where("node <> hub").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct())
    # The texts of nodes that are compared with any other move once; all rounds read them from there.
    at = reps.select("node", F.col("doc_id").alias("n_id"), F.col("tag").alias("n_tag")).join(buckets.select("node").distinct(), "node", "left_semi")
    of_node = texts.join(at.hint("merge"), F.col("doc_id").eqNullSafe(F.col("n_id")) & (F.col("tag") == F.col("n_tag"))).select("node", "text")
    held = durable(of_node.dropDuplicates(["node"]))
    good = durable(verify(tried, held))
    label = durable(star_components(good))
    placed = buckets.join(label, "node", "left").select("bucket", "node", F.coalesce("label", "node").alias("label"))
    open_ = durable(placed.groupBy(F.col("bucket").alias("s")).agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("s"))
    unlike = durable(placed.join(open_, F.col("bucket") == F.col("s")).groupBy("node", "label").agg(F.collect_list("bucket").alias("buckets")))
    rest = durable(sharing_rare(unlike, held).join(tried, ["a", "b"], "left_anti"))
    if not rest.isEmpty():
        label = durable(star_components(good.union(verify(rest, held))))
    named = reps.select("d1", "d2", "node").join(label, "node", "left").select(F.col("d1").alias("n1"), F.col("d2").alias("n2"), F.coalesce("label", "node").alias("group"))
    return durable(signed.select("doc_id", "tag", "d1", "d2").join(named, (F.col("d1") == F.col("n1")) & (F.col("d2") == F.col("n2")), "left").select("doc_id", "tag", "group"))


def _placed(g: DataFrame) -> DataFrame:
    """(doc_id, tag, group, group_id, best) of the rows of groups of more than one row; ``best`` marks rows of the id and text that stays."""
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tag")).alias("f")
    groups = durable(g.where("group is not null").groupBy(F.col("group").alias("b_group")).agg(F.count(F.lit(1)).alias("n"), best).where("n > 1").select("b_group", F.col("f.doc_id").alias("group_id"), F.col("f.tag").alias("b_tag")))
    is_best = F.col("doc_id").eqNullSafe(F.col("group_id")) & (F.col("tag") == F.col("b_tag"))
    return g.join(groups, F.col("group") == F.col("b_group"), "left").select("doc_id", "tag", "group", "group_id", F.when(F.col("b_group").isNotNull(), is_best).alias("best"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, group_id, is_duplicate), one row for each document; group_id is the document that stays."""
    rows = _placed(_grouped(docs, id_col, text_col))
    # of rows that repeat the id and the text that stay one stays: these alone meet in a window
    twin = F.row_number().over(Window.partitionBy("group").orderBy(F.lit(1))) > 1
    return (
        rows.where("best is null").select("doc_id", F.col("doc_id").alias("group_id"), F.lit(False).alias("is_duplicate"))
        .union(rows.where("not best").select("doc_id", "group_id", F.lit(True)))
        .union(rows.where("best").select("doc_id", "group_id", twin))
    )


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents without those that :func:`near_duplicates` marks, columns unchanged."""
    rows = _placed(_grouped(docs, id_col, text_col))
    own = own_prefix(docs.columns)
    keys = [F.col("doc_id").alias(f"{own}id"), F.col("tag").alias(f"{own}tag")]
    gone = durable(rows.where("not best").select(*keys).distinct())
    twins = durable(rows.where("best").groupBy("doc_id", "tag").count().where("count > 1").select(*keys))
    same = F.col(id_col).cast("bigint").eqNullSafe(F.col(f"{own}id")) & (F.xxhash64(text_col) == F.col(f"{own}tag"))
    kept = docs.join(gone, same, "left_anti")
    if twins.isEmpty():
        return kept
    rank = F.row_number().over(Window.partitionBy(f"{own}id", f"{own}tag").orderBy(F.lit(1)))
    one = kept.join(twins, same).withColumn(f"{own}rank", rank).where(F.col(f"{own}rank") == 1).drop(f"{own}rank", f"{own}id", f"{own}tag")
    return kept.join(twins, same, "left_anti").union(one)
