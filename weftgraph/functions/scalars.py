"""Scalar functions over columns, all of built-in expressions, so that they stay in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANKS = " \t\n\r\f\x0b"
#: Names that repeat across packages by convention.
COMMON_NAMES = tuple("Close Create Delete Error Find Get Init List New Open Read Search Set String Update Write init main run start".split())
SEMANTIC_EDGES = tuple("implements_pattern inferred_depends rationale_for shared_concern similar_to".split())
BUILTIN_TYPES = tuple(
    "any bool byte complex128 complex64 error float32 float64 int int16 int32 int64 int8 rune string uint uint16 uint32 uint64 uint8 uintptr".split()
)
_ID_SIGNS = '/\\:*?"<>| '
_DOC_ID_SIGNS = "/\\ -."
_COMPACT = "^(constant|func|method|struct|interface|type|var|pkg|file)_"


def _trim(c: Column) -> Column:
    return F.btrim(c, F.lit(BLANKS))


def simplify_type(c: Column) -> Column:
    """A type's base name: one leading ``*``, then one ``[]`` and any qualifier go, and usual spellings become one."""
    base = F.regexp_replace(F.regexp_replace(_trim(c), r"^\*", ""), r"^\[\]", "")
    base = F.substring_index(base, ".", -1)
    low = F.lower(base)
    return (
        F.when(low.isin("context", "ctx"), "Context")
        .when(low.isin("error", "err"), "error")
        .when(low.isin("string", "str"), "string")
        .when(low.isin("int", "int32", "int64"), "int")
        .when(low == "bool", "bool")
        .otherwise(base)
    )


def normalize_signature(sig: Column) -> Column:
    """``(T1,T2)->R`` of a function signature; ``''`` where there is nothing to compare.

    Parameters lie between the first ``(`` and the last ``)``; of each the last word is its type.
    """
    s = F.regexp_replace(sig, "^func ", "")
    begin = F.instr(s, F.lit("("))
    back = F.instr(F.reverse(s), F.lit(")"))
    end = F.length(s) - back + 1
    params = s.substr(begin + 1, end - begin - 1)
    words = F.filter(F.transform(F.split(params, ","), _trim), lambda p: p != "")
    types = F.transform(words, lambda p: simplify_type(F.element_at(F.split(p, r"\s+"), -1)))
    result = simplify_type(s.substr(end + 1, F.length(s)))
    found = (begin > 0) & (back > 0) & (end > begin) & ((F.size(types) > 0) | (result != ""))
    return F.when(found, F.concat(F.lit("("), F.array_join(types, ","), F.lit(")->"), result)).otherwise("")


def is_common_name(c: Column) -> Column:
    return c.isin(*COMMON_NAMES)


def make_id(prefix: Column | str, c: Column) -> Column:
    """An id of a prefix and a name, whose signs that file systems dislike become ``_``."""
    return F.concat(F.lit(prefix) if isinstance(prefix, str) else prefix, F.translate(c, _ID_SIGNS, "_" * len(_ID_SIGNS)))


def sanitize_doc_id(c: Column) -> Column:
    return F.lower(F.translate(c, _DOC_ID_SIGNS, "_" * len(_DOC_ID_SIGNS)))


def compact_id(c: Column) -> Column:
    return F.regexp_replace(c, _COMPACT, "")


def cypher_string(c: Column) -> Column:
    for raw, escaped in (("\\", "\\\\"), ("'", "\\'"), ("\n", "\\n"), ("\r", "\\r")):
        c = F.replace(c, F.lit(raw), F.lit(escaped))
    return c


def cypher_key(c: Column) -> Column:
    return F.regexp_replace(c, "[^A-Za-z0-9_]", "_")


def cypher_label(c: Column) -> Column:
    """``method_call`` becomes ``MethodCall``."""
    joined = F.array_join(F.transform(F.split(c, "_"), lambda p: F.concat(F.upper(F.substring(p, 1, 1)), p.substr(F.lit(2), F.length(p)))), "")
    return F.when(joined == "", "Node").when(joined.rlike("^[0-9]"), F.concat(F.lit("N"), joined)).otherwise(joined)


def slugify(c: Column) -> Column:
    return F.regexp_replace(F.translate(F.lower(c), " _", "--"), "[^a-z0-9-]", "")


def vault_name(c: Column) -> Column:
    """A file name for a note."""
    return F.translate(c, '/\\:*?"<>|', "_" * 9)


def estimate_tokens(text: Column) -> Column:
    """Three halves of the words and half of the punctuation, each rounded down; ``_`` counts in both."""
    words, marks = F.regexp_count(text, F.lit(r"[\p{L}\p{Nd}_]+")), F.regexp_count(text, F.lit(r"\p{P}"))
    return F.coalesce((F.floor(1.5 * words) + F.floor(marks / 2)).cast("bigint"), F.lit(0).cast("bigint"))


def label_tokens(label: Column) -> Column:
    """Tokens of a label, whose words end at ``_ - . /``; 0 for an empty one."""
    words = 1 + F.length(label) - F.length(F.translate(label, "_-./", ""))
    return F.when(F.coalesce(label, F.lit("")) == "", F.lit(0)).otherwise(F.floor(1.5 * words)).cast("bigint")


def format_bytes(c: Column) -> Column:
    unit = F.when(c < 1024, F.concat(c.cast("string"), F.lit(" B")))
    for i, sign in enumerate("KMGTP"):
        unit = unit.when(c < 1024.0 ** (i + 2), F.format_string(f"%.1f {sign}B", c / 1024.0 ** (i + 1)))
    return unit.otherwise(F.format_string("%.1f EB", c / 1024.0**6))


def format_number(c: Column) -> Column:
    """Thousands as K, millions as M, with one decimal."""
    return F.when(c < 1000, c.cast("string")).when(c < 1_000_000, F.format_string("%.1fK", c / 1000.0)).otherwise(F.format_string("%.1fM", c / 1_000_000.0))


def join_max(items: Column, most: int) -> Column:
    """``a, b and c``; of more than ``most`` items the first ones, joined by commas alone."""
    n = F.size(items)
    head = F.array_join(F.slice(items, F.lit(1), F.greatest(n - 1, F.lit(0))), ", ")
    whole = F.when(n == 0, "").when(n == 1, F.get(items, F.lit(0))).otherwise(F.concat(head, F.lit(" and "), F.element_at(items, -1)))
    return F.when(n > most, F.array_join(F.slice(items, 1, most), ", ")).otherwise(whole)


def label_or_id(label: Column, node_id: Column) -> Column:
    return F.coalesce(F.nullif(label, F.lit("")), node_id)


def content_hash(c: Column) -> Column:
    return F.sha2(c, 256)


def cache_key(path: Column) -> Column:
    """The first 16 bytes of the path's SHA-256, in hexadecimal."""
    return F.substring(F.sha2(path, 256), 1, 32)


def classify_doc(path: Column) -> Column:
    """What kind of document a path names; the first rule that fits decides: by the whole name, by folder, by a part of the name."""
    low = F.lower(F.regexp_replace(path, r"\\\\", "/"))
    base = F.substring_index(low, "/", -1)
    folder = F.when(low.contains("/"), low.substr(F.lit(1), F.length(low) - F.length(base) - 1)).otherwise(".")
    return (
        F.when(base.isin("readme", "readme.md"), "readme").when(base.isin("changelog", "changelog.md"), "changelog").when(base == "contributing.md", "contributing")
        .when(base.isin("license", "license.md"), "license").when(folder.rlike("docs|documentation"), "documentation").when(base.rlike("spec|rfc"), "specification")
        .when(base.rlike("design|architecture"), "architecture").when(base.contains("api"), "api_reference").otherwise("general")
    )


def normalize_extension(c: Column) -> Column:
    low = F.lower(c)
    return F.when((low == "") | low.startswith("."), low).otherwise(F.concat(F.lit("."), low))


def is_semantic_edge(c: Column) -> Column:
    return c.isin(*SEMANTIC_EDGES)


def is_builtin_type(c: Column) -> Column:
    return c.isin(*BUILTIN_TYPES)


def is_standard_package(path: Column) -> Column:
    """Import paths of a standard library have no dot in their first element."""
    return ~F.substring_index(path, "/", 1).contains(".")


def edge_key(src: Column, dst: Column, kind: Column) -> Column:
    return F.concat_ws("|", src, dst, kind)


def repo_name(url: Column) -> Column:
    """The last element of a repository's address, without ``.git``."""
    return F.regexp_replace(F.substring_index(F.regexp_replace(url, "/+$", ""), "/", -1), r"\.git$", "")


def strip_fence(text: Column) -> Column:
    """The JSON of an answer: its fenced block of kind json, else its first fenced block, else all of it."""
    fenced = F.regexp_extract(text, r"(?s)```json[ \t]*\r?\n(.*?)```", 1)
    other = F.regexp_extract(text, r"(?s)```[a-z]*[ \t]*\r?\n(.*?)```", 1)
    return _trim(F.when(fenced != "", fenced).when(other != "", other).otherwise(text))
