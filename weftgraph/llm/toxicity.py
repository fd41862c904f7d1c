"""Toxicity: a lexicon trie intersected with Levenshtein automata, scored in context.

The lexicon has whole terms, matched up to an edit distance that grows with their
length (``edits``; a swap of neighbouring letters is one edit, and the first letter
may be replaced or swapped but not left out), and stems, matched exactly at the
start of a word, or with one edit if they have ``STEM_EDIT`` letters and such words are rare in the clean
documents of the fit (:func:`_fit`). Terms and stems form one trie; the product of the trie with the
Levenshtein automata is determinised once on the driver to a table of states times
character classes. Workers run that table over all words of a batch at once with
NumPy. Characters are folded first: case, digits and signs that stand for letters,
letters repeated more than twice and, for terms but not for stems, accents. A letter
beyond the Latin blocks is a class of its own if the lexicon has it.

Each hit starts from 1 for an exact match and less for each edit, least where one edit gives an ordinary
word (``ORDINARY``). Its context, a window of
``CONTEXT`` characters on either side, multiplies that: a hit between
quotation marks or near a reporting word (it is mentioned rather than used) counts
less, one near a second-person pronoun or another hit counts more. A document is
toxic if its hits sum to ``THRESHOLD``; long documents get no allowance.

Stems are learned from ``labels`` (:func:`fit_stems`): word beginnings that set the toxic documents of a
language apart by a likelihood-ratio test, at the least number k of occurrences that few clean documents
reach; a hit of such a stem weighs 1 / k. Near copies count once. The fit reads at most ``max_labelled``
labelled rows, a documented bound; the scoring covers every document in whole.

Cases: a null or empty text has no hits and score 0; repeated rows give repeated rows; labels that
are null, contradict each other (any toxic label counts) or have no document are
harmless; without labels or with an empty table the built-in terms alone are used.
Extra columns, also of clashing names, aren't read by :func:`toxicity` and pass
through :func:`drop_toxic`. A text of any length is scored in whole. Ids are integers.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, released
from .textvec import chunks

TERMS = ("idiot", "moron", "loser", "clown", "scum", "trash", "stupid", "pathetic", "worthless", "disgusting")
THRESHOLD = 1.0
CONTEXT = 60
EDIT_WEIGHT = (1.0, 0.8, 0.5)  # in second-person context one edit reaches THRESHOLD
ORDINARY_WEIGHT = 0.7
#: Words of the covered languages that are one edit away from a term.
ORDINARY = frozenset(
    "idiom moran moroni boron marron loner looser closer lower lover loses losel loper laser poser loose lose louer loger leser doser "
    "loved loper hoser moser crown clowne clow blown flown crash brash thrash trasse apathetic bathetic".split()
)
QUOTED, REPORTED, ADDRESSED, CROWDED = 0.3, 0.5, 1.25, 1.25
MAX_LABELLED = 20_000
CLEAN_SHARE = (0.02, 0.1, 0.1, 0.1)
MOST_OCCURRENCES = len(CLEAN_SHARE)
SKETCH, ALIKE, COMMON = 32, 0.25, 50
STEM = (4, 12)
STEM_EDIT = 6
CHUNK = 4_000_000
#: Characters that are classified at once.
PIECE = 2_000_000
GAP = re.compile("[ \\t\\r\\n]")
SCHEMA = "doc_id bigint, hits int, score double, toxic boolean, terms array<string>"

OPEN_QUOTE = re.compile(r'["“”„«»]')
REPORTING = re.compile(r"\b(?:said|says|called|calls|wrote|writes|quoted?|quotes|word|term|insult|slur|meaning|defined?|definition)\b")
SECOND_PERSON = re.compile(r"\b(?:you|your|yours|you're|u|ur|du|dich|dir|ihr|tu|te|toi|vous|usted|ustedes)\b")

LEET = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"}
OTHER = 27
_TABLE = 0x250


def _classes() -> tuple[np.ndarray, list[int]]:
    """Class of each code point below _TABLE (0 separates words, 1 to 26 are a to z), and the class of each class's bare letter."""
    out, bare, seen = np.zeros(_TABLE, dtype=np.uint8), list(range(OTHER + 1)), {}
    for cp in range(_TABLE):
        ch = LEET.get(chr(cp), chr(cp).lower()[:1])
        base = unicodedata.normalize("NFKD", ch)[0]
        if "a" <= ch <= "z":
            out[cp] = ord(ch) - 96
        elif ch.isalnum() and "a" <= base <= "z" and len(bare) < 255:
            if ch not in seen:
                seen[ch] = len(bare)
                bare.append(ord(base) - 96)
            out[cp] = seen[ch]
        elif ch.isalnum():
            out[cp] = OTHER
    return out, bare


CLASS, BARE = _classes()


def far_letters(words: Iterable[str]) -> np.ndarray:
    """The letters of the words that CLASS doesn't have, in lower case and in order."""
    return np.array(sorted({ord(c) for w in words for c in w.lower() if ord(c) >= _TABLE and c.isalnum()}), np.uint32)


def classes(cps: np.ndarray, far: np.ndarray = np.zeros(0, np.uint32)) -> np.ndarray:
    """The class of each code point; a letter of ``far`` has the one after the bare classes, by its place there."""
    out = CLASS[np.minimum(cps, _TABLE - 1)].astype(np.uint16)
    away = cps >= _TABLE
    if away.any():
        x = cps[away]
        got = np.where(((x >= 0x2000) & (x < 0x2070)) | ((x >= 0x3000) & (x < 0x3040)) | (x == 0xFEFF), 0, OTHER)
        for i, c in enumerate(far.tolist()):
            got[(x == c) | (x == ord(chr(c).upper()[:1]))] = len(BARE) + i
        out[away] = got
    return out


def runs(cps: np.ndarray, cls: np.ndarray) -> np.ndarray:
    """Marks a letter that comes after two of its kind; letters of class OTHER are of one kind only if they are the same."""
    out = np.zeros(len(cls), bool)
    same = (cls[1:] == cls[:-1]) & (cls[1:] > 0) & ((cls[1:] != OTHER) | (cps[1:] == cps[:-1]))
    out[2:] = same[1:] & same[:-1]
    return out


def fold(word: str, far: np.ndarray | None = None) -> list[int]:
    """The classes of a word's letters, as a text's are taken."""
    cps = np.frombuffer(word.encode("utf-32-le", "surrogatepass"), "<u4")
    cls = classes(cps, far_letters([word]) if far is None else far)
    return [c for c in cls[~runs(cps, cls)].tolist() if c]


def edits(term: str | list[int]) -> int:
    return 0 if len(term) < 5 else 1 if len(term) < 10 else 2


def stem_edits(stem: str | list[int]) -> int:
    """Shorter stems get no edit: in a beginning of a word too many other words are that near."""
    return 0 if len(stem) < STEM_EDIT else 1


@dataclass
class Automaton:
    """step[state, class] is the next state, 0 the dead one; word[state] and stem[state] are the match (1 + term index) there, or 0, of word_edits[state] and stem_edits[state]; weight is by term."""

    terms: list[str]
    step: np.ndarray
    word: np.ndarray
    word_edits: np.ndarray
    stem: np.ndarray
    stem_edits: np.ndarray
    weight: np.ndarray
    far: np.ndarray


Stems = tuple[str, ...] | dict[str, float]  # a dict has the weight of each stem's hits


def build(terms: tuple[str, ...] = TERMS, stems: Stems = (), exact: frozenset[str] = frozenset()) -> Automaton:
    """``exact`` has the stems that get no edits whatever their length."""
    far = far_letters([*terms, *stems])
    bare = BARE + list(range(len(BARE), len(BARE) + len(far)))
    names = [fold(t, far) for t in terms] + [fold(s, far) for s in stems]
    allowance = [edits(x) for x in names[: len(terms)]] + [0 if s in exact else stem_edits(x) for s, x in zip(stems, names[len(terms) :])]
    # node 0 is the root of the terms, node 1 that of the stems
    kids: list[dict[int, int]] = [{}, {}]
    end_term, end_stem = [0, 0], [0, 0]
    fuzzy = [0, 0]  # most edits of any term below
    stemmed = [False, True]
    for i, name in enumerate(names):
        of_stem = i >= len(terms)
        allowed = allowance[i]
        at = int(of_stem)
        fuzzy[at] = max(fuzzy[at], allowed)
        for c in name if of_stem else [bare[c] for c in name]:
            if c not in kids[at]:
                kids[at][c] = len(kids)
                for x, v in ((kids, {}), (end_term, 0), (end_stem, 0), (fuzzy, 0), (stemmed, of_stem)):
                    x.append(v)
            at = kids[at][c]
            fuzzy[at] = max(fuzzy[at], allowed)
        if of_stem:
            end_stem[at] = i + 1
        else:
            end_term[at] = i + 1
    limit = {i + 1: a for i, a in enumerate(allowance)}
    accented = {c for node, k in enumerate(kids) if stemmed[node] for c in k}

    def close(items: dict[tuple, int]) -> frozenset:
        """With deletions; items map (node, pending class) to the fewest edits, pending 0 for none."""
        todo = list(items.items())
        while todo:
            (node, pending), e = todo.pop()
            if pending or node < 2 or items[(node, pending)] < e:  # a first letter isn't left out
                continue
            for k in kids[node].values():
                if e + 1 <= fuzzy[k] and items.get((k, 0), 9) > e + 1:
                    items[(k, 0)] = e + 1
                    todo.append(((k, 0), e + 1))
        return frozenset((n, p, e) for (n, p), e in items.items())

    start = close({(0, 0): 0, (1, 0): 0})
    index: dict[frozenset, int] = {frozenset(): 0, start: 1}
    queue, rows = [start], [np.zeros(len(bare), np.int32)]
    while queue:
        state = queue.pop(0)
        row = np.zeros(len(bare), np.int32)
        alike: dict[tuple[int, int], int] = {}  # letters that no stem has differ by their bare letter alone
        for c in range(1, len(bare)):
            kind = (bare[c], c if c in accented else 0)
            if kind in alike:
                row[c] = alike[kind]
                continue
            nxt: dict[tuple, int] = {}

            def put(node: int, pending: int, e: int, nxt=nxt) -> None:
                if e <= fuzzy[node] and nxt.get((node, pending), 9) > e:
                    nxt[(node, pending)] = e

            b = bare[c]
            for node, pending, e in state:
                x = c if stemmed[node] else b
                if pending:  # the second letter of a swap: node is where the swapped pair leads
                    if pending == x:
                        put(node, 0, e)
                    continue
                put(node, 0, e + 1)  # an inserted letter
                for k, child in kids[node].items():
                    if k == x:
                        put(child, 0, e)
                    else:
                        put(child, 0, e + 1)
                        if x in kids[child]:
                            put(kids[child][x], k, e + 1)
            new = close(nxt)
            if new not in index:
                index[new] = len(index)
                queue.append(new)
            row[c] = alike[kind] = index[new]
        rows.append(row)
    n = len(index)
    word, cost, stem, stem_cost = (np.zeros(n, np.int32) for _ in range(4))
    for state, i in index.items():
        best = min(((e, end_term[node]) for node, pending, e in state if not pending and end_term[node] and e <= limit[end_term[node]]), default=None)
        if best:
            cost[i], word[i] = best
        best = min(((e, -end_stem[node]) for node, pending, e in state if not pending and end_stem[node] and e <= limit[end_stem[node]]), default=None)
        if best:
            stem_cost[i], stem[i] = best[0], -best[1]
    weight = np.array([1.0] * len(terms) + [stems[s] if isinstance(stems, dict) else 1.0 for s in stems])
    return Automaton([*terms, *stems], np.stack(rows), word, cost, stem, stem_cost, weight, far)


def find(auto: Automaton, cls: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, term index, edits) of each matching word of an array of classes that ends with a separator; of several matches the one that weighs most."""
    is_word = cls > 0
    at = np.flatnonzero(is_word & ~np.concatenate(([False], is_word[:-1])))
    origin, state = at, np.ones(len(at), np.int32)
    best, best_cost, most = np.zeros(len(at), np.int32), np.zeros(len(at), np.int32), np.zeros(len(at))
    weight, by_edits = np.concatenate(([0.0], auto.weight)), np.array(EDIT_WEIGHT)
    hits: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def better(which: np.ndarray, match: np.ndarray, cost: np.ndarray) -> None:
        value = weight[match] * by_edits[cost]
        take = which & (value > most)
        best[take], best_cost[take], most[take] = match[take], cost[take], value[take]

    while len(at):
        c = cls[at]
        over = c == 0
        better(over, auto.word[state], auto.word_edits[state])
        state = auto.step[state, c]
        better(~over, auto.stem[state], auto.stem_edits[state])
        live = (state > 0) & ~over
        done = ~live & (best > 0)
        if done.any():
            hits.append((origin[done], best[done] - 1, best_cost[done]))
        at, origin, state = at[live] + 1, origin[live], state[live]
        best, best_cost, most = best[live], best_cost[live], most[live]
    if not hits:
        return (np.zeros(0, np.int64),) * 3
    start, term, cost = (np.concatenate(x) for x in zip(*hits))
    order = np.argsort(start, kind="stable")
    return start[order], term[order], cost[order]


def context_score(text: str, begin: int, cost: int, near: int) -> float:
    """Score of the hit at ``begin``; ``near`` is the number of other hits in its window."""
    left = text[max(0, begin - CONTEXT) : begin].lower()
    right = text[begin : begin + CONTEXT].lower()
    score = EDIT_WEIGHT[cost]
    if cost == 1 and (word := re.match(r"\w+", right)) and word[0] in ORDINARY:
        score = ORDINARY_WEIGHT
    line_l, line_r = left.rpartition("\n")[2], right.partition("\n")[0]
    quoted = len(OPEN_QUOTE.findall(line_l)) % 2 == 1 and OPEN_QUOTE.search(line_r)
    if quoted:
        score *= QUOTED
    elif REPORTING.search(left):
        score *= REPORTED
    elif SECOND_PERSON.search(left) or SECOND_PERSON.search(right):
        score *= ADDRESSED
    if near and not quoted:
        score *= CROWDED
    return score


def _matches(auto: Automaton, texts: list[str], piece: int = PIECE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What :func:`find` has for the texts, each of them and one separator after the other, a piece between blanks at a time."""
    joined = "\n".join(texts) + "\n"
    found, at = [], 0
    while at < len(joined):
        gap = GAP.search(joined, at + piece)
        end = gap.end() if gap else len(joined)
        cps = np.frombuffer(joined[at:end].encode("utf-32-le", "surrogatepass"), "<u4")
        cls = classes(cps, auto.far)
        keep = np.flatnonzero(~runs(cps, cls))
        start, term, cost = find(auto, cls[keep])
        found.append((keep[start] + at, term, cost))
        at = end
    return tuple(np.concatenate(x) for x in zip(*found))


def score_texts(auto: Automaton, texts: list[str]) -> list[list[tuple[int, int, float]]]:
    """For each text its hits as (begin, term index, score)."""
    start, term, cost = _matches(auto, texts)
    first = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts])))
    out: list[list[tuple[int, int, float]]] = [[] for _ in texts]
    owner = np.searchsorted(first, start, side="right") - 1
    for d in np.unique(owner).tolist():
        mine = owner == d if len(texts) < 2 else slice(*np.searchsorted(owner, [d, d + 1]))
        begin = start[mine] - first[d]
        near = np.searchsorted(begin, begin + CONTEXT, side="right") - np.searchsorted(begin, begin - CONTEXT) - 1
        out[d] = [(b, t, float(auto.weight[t]) * context_score(texts[d], b, c, n)) for b, t, c, n in zip(begin.tolist(), term[mine].tolist(), cost[mine].tolist(), near.tolist())]
    return out


def _stems(text: str) -> dict[str, int]:
    """How often each word beginning occurs."""
    shortest, longest = STEM
    out: dict[str, int] = {}
    for w, c in Counter(re.findall(r"\w+", text.lower())).items():
        for n in range(shortest, min(longest, len(w)) + 1):
            out[w[:n]] = out.get(w[:n], 0) + c
    return out


def _sketch(text: str) -> np.ndarray:
    """The ``SKETCH`` smallest hashes of a text's runs of three words."""
    words = re.findall(r"\w+", text.lower())
    runs = {" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))}
    return np.unique(np.array([_hash(r) for r in runs], np.int64))[:SKETCH]


def near_copies(sketches: dict[int, np.ndarray]) -> dict[int, int]:
    """A group for each text: that of the earlier leader with which it shares the most of its sketch, ``ALIKE`` at least, else its own."""
    leaders: dict[int, list[int]] = {}
    group: dict[int, int] = {}
    for key in sorted(sketches):
        own = sketches[key].tolist()
        shared = Counter(k for v in own if len(leaders.get(v, ())) <= COMMON for k in leaders.get(v, ()))
        top = max(shared, key=lambda k: (shared[k], -k), default=None)
        if top is not None and shared[top] >= ALIKE * min(len(own), len(sketches[top])):
            group[key] = top
            continue
        group[key] = key
        for v in own:
            leaders.setdefault(v, []).append(key)
    return group


def likelihood_ratio(a: int, b: int, n_a: int, n_b: int) -> float:
    """2 ln of the likelihood ratio of a of n_a against b of n_b, 0 unless the first share is the larger."""
    if not n_a or not n_b or a * n_b <= b * n_a:
        return 0.0
    n, k = n_a + n_b, a + b
    parts = ((a, k * n_a / n), (b, k * n_b / n), (n_a - a, (n - k) * n_a / n), (n_b - b, (n - k) * n_b / n))
    return 2 * sum(o * math.log(o / e) for o, e in parts if o > 0)


def fit_stems(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, terms: tuple[str, ...] = TERMS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> dict[str, float]:
    """The stems of :func:`_fit` and the weight of their hits."""
    return _fit(docs, labels, max_labelled, terms, id_col, text_col, lang_col)[0]


def _fit(docs: DataFrame, labels: DataFrame, max_labelled: int, terms: tuple[str, ...], id_col: str, text_col: str, lang_col: str = "lang") -> tuple[dict[str, float], frozenset[str]]:
    """Word beginnings that set toxic documents apart in a sample of at most ``max_labelled`` labelled rows, with the weight of their hits; which of these get no edits.

    Documents are counted by language (where ``docs`` has such a column) and near copies once. A stem's k is the
    least number of occurrences, up to ``MOST_OCCURRENCES``, for which the likelihood ratio of the
    documents that have so many is above 2 ln of the number of stems tried, and of all languages' such
    documents the clean ones are at most the share ``CLEAN_SHARE`` has for k of the toxic ones. The same
    share bounds the clean documents with k edited hits of a stem that gets edits; a stem
    that begins with another one gets none.
    """
    marked = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    marked = marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    lang = F.col(lang_col).cast("string") if lang_col in docs.columns else F.lit(None).cast("string")
    have = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.coalesce(lang, F.lit("")).alias("lang")).where("text is not null")
    sample = have.join(F.broadcast(marked), "doc_id")  # at most max_labelled rows of 12 bytes
    sample = durable(sample.select("text", "lang", "toxic", F.xxhash64("text").alias("key")))

    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(x["lang"], x["toxic"], x["key"], len(_stems(x["text"])) if x["toxic"] == 1 else 0, _sketch(x["text"]).tobytes()) for x in batch.to_pylist()]
            yield pa.RecordBatch.from_pylist([dict(zip(("lang", "toxic", "key", "tried", "sketch"), r)) for r in rows], schema=SKETCHES)

    rows = sample.mapInArrow(released(sketched), "lang string, toxic int, key bigint, tried int, sketch binary").collect()  # at most max_labelled rows of 300 bytes
    group = near_copies({r["key"]: np.frombuffer(r["sketch"], np.int64) for r in rows})
    size = Counter((lang, toxic) for lang, toxic, _ in {(r["lang"], int(r["toxic"] == 1), group[r["key"]]) for r in rows})
    needed = 2 * math.log(max(2, sum(r["tried"] for r in rows)))
    least = {}  # toxic documents that a stem needs if it is in no clean one
    for name, toxic in size:
        n_a, n_b = size[(name, 1)], size[(name, 0)]
        if toxic and (enough := next((a for a in range(2, n_a + 1) if likelihood_ratio(a, 0, n_a, n_b) >= needed), None)):
            least[name] = enough
    if not least:
        return {}, frozenset()

    def counted(toxic: bool, wanted: frozenset[str] | None = None) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out: list[tuple] = []
                for x in batch.to_pylist():
                    found = _stems(x["text"])
                    some = found if wanted is None else found.keys() & wanted
                    out += [(s, x["lang"], group[x["key"]], min(found[s], MOST_OCCURRENCES)) for s in some]
                columns = zip(*out) if out else [()] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, COUNTS)], schema=COUNTS)

        of = sample.where("toxic = 1" if toxic else "toxic <> 1").select("text", "lang", "key")
        each = of.mapInArrow(released(run), "stem string, lang string, copies bigint, n int").groupBy("stem", "lang", "copies").agg(F.max("n").alias("n"))
        return each.groupBy("stem", "lang").agg(*(F.count_if(F.col("n") >= k).alias(f"n{k}") for k in range(1, MOST_OCCURRENCES + 1)))

    enough = F.create_map(*(F.lit(x) for pair in least.items() for x in pair))
    support = {(r[0], r[1]): r[2:] for r in counted(True).where(F.col("n1") >= enough[F.col("lang")]).collect()}
    clean = {(r[0], r[1]): r[2:] for r in counted(False, frozenset(s for s, _ in support)).collect()} if support else {}
    of_all: dict[str, np.ndarray] = {}
    for counts, row in ((support, 0), (clean, 1)):
        for (s, _), n in counts.items():
            of_all.setdefault(s, np.zeros((2, MOST_OCCURRENCES), np.int64))[row] += n
    good: dict[str, tuple[int, int]] = {}  # k, and the toxic documents with k occurrences
    none = (0,) * MOST_OCCURRENCES
    for (s, name), n in support.items():
        c = clean.get((s, name), none)
        for k in range(MOST_OCCURRENCES):
            if of_all[s][1][k] <= CLEAN_SHARE[k] * of_all[s][0][k] and likelihood_ratio(n[k], c[k], size[(name, 1)], size[(name, 0)]) >= needed:
                good[s] = min(good.get(s, (9, 0)), (k + 1, int(of_all[s][0][k])))
                break
    chosen: dict[str, int] = {}

    def covered(s: str) -> bool:
        return any(chosen.get(s[:n], 9) <= good[s][0] for n in range(1, len(s) + 1))

    for s in sorted(good, key=lambda s: (len(s), s)):
        if covered(s) or any(t.startswith(s) or s.startswith(t) for t in terms):
            continue
        while True:  # the longest beginning that loses no support to speak of
            longer = [x for x in good if len(x) == len(s) + 1 and x.startswith(s) and good[x][0] == good[s][0] and good[x][1] >= 0.95 * good[s][1]]
            if not longer:
                break
            s = max(longer, key=lambda x: (good[x][1], x))
        if not covered(s):
            chosen[s] = good[s][0]
    weights = {s: 1 / k for s, k in chosen.items()}
    exact = {s for s in chosen if any(s[:n] in chosen for n in range(1, len(s)))}
    if any(s not in exact and stem_edits(fold(s)) for s in chosen):
        auto = build(terms, weights, frozenset(exact))

        def edited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out: list[tuple] = []
                for x in batch.to_pylist():
                    _, term, cost = _matches(auto, [x["text"]])
                    out += [(auto.terms[t], "", group[x["key"]], n) for t, n in Counter(term[cost > 0].tolist()).items() if t >= len(terms)]
                columns = zip(*out) if out else [()] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, COUNTS)], schema=COUNTS)

        each = sample.where("toxic <> 1").select("text", "key").mapInArrow(released(edited), "stem string, lang string, copies bigint, n int").groupBy("stem", "copies").agg(F.max("n").alias("n"))
        needs = F.create_map(*(F.lit(x) for pair in chosen.items() for x in pair))
        near = dict(each.where(F.col("n") >= needs[F.col("stem")]).groupBy("stem").count().collect())
        exact |= {s for s, n in near.items() if n > CLEAN_SHARE[chosen[s] - 1] * good[s][1]}
    return weights, frozenset(exact)


SKETCHES = pa.schema([("lang", pa.string()), ("toxic", pa.int32()), ("key", pa.int64()), ("tried", pa.int32()), ("sketch", pa.binary())])
COUNTS = pa.schema([("stem", pa.string()), ("lang", pa.string()), ("copies", pa.int64()), ("n", pa.int32())])


def learn_stems(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, terms: tuple[str, ...] = TERMS, id_col: str = "doc_id", text_col: str = "text") -> tuple[str, ...]:
    """The stems of :func:`fit_stems`."""
    return tuple(fit_stems(docs, labels, max_labelled, terms, id_col, text_col))


def _hash(word: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass")) >> 1


def _shared(docs: DataFrame, labels: DataFrame | None, stems: Stems | None, terms: tuple[str, ...], id_col: str, text_col: str):
    exact: frozenset[str] = frozenset()
    if stems is None:
        stems, exact = _fit(docs, labels, MAX_LABELLED, terms, id_col, text_col) if labels is not None else ((), frozenset())
    return docs.sparkSession.sparkContext.broadcast(build(terms, stems, exact))  # the lexicon's automaton, of the lexicon's size


def _pieces(batch: pa.RecordBatch, column: str) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    for part in chunks(batch, column, CHUNK):
        yield part, pc.fill_null(part.column(column), "").to_pylist()


def toxicity(docs: DataFrame, labels: DataFrame | None = None, stems: Stems | None = None, terms: tuple[str, ...] = TERMS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, hits, score, toxic, terms), one row for each document; no shuffle of documents."""
    auto = _shared(docs, labels, stems, terms, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = auto.value
        for batch in batches:
            for part, texts in _pieces(batch, "text"):
                hits = score_texts(a, texts)
                score = [round(sum(h[2] for h in x), 4) for x in hits]
                names = [sorted({a.terms[h[1]] for h in x}) for x in hits]
                arrays = [part.column("doc_id"), pa.array([len(x) for x in hits], pa.int32()), pa.array(score, pa.float64()), pa.array([s >= THRESHOLD for s in score], pa.bool_()), pa.array(names, pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "hits", "score", "toxic", "terms"])

    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(released(run), SCHEMA)


def drop_toxic(docs: DataFrame, labels: DataFrame | None = None, stems: Stems | None = None, terms: tuple[str, ...] = TERMS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that :func:`toxicity` doesn't call toxic, columns unchanged."""
    auto = _shared(docs, labels, stems, terms, id_col, text_col)

    names = [f"c{i}" for i in range(len(docs.columns))]
    column = names[docs.columns.index(text_col)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = auto.value
        for batch in batches:
            for part, texts in _pieces(batch, column):
                clean = [round(sum(h[2] for h in x), 4) < THRESHOLD for x in score_texts(a, texts)]
                yield part.filter(pa.array(clean, pa.bool_()))

    plain = docs.toDF(*names)  # mapInArrow can't take every name that a column may have
    return plain.mapInArrow(released(run), plain.schema).toDF(*docs.columns)
