"""Chat formatting by schema fingerprints.

Records come as JSON objects of unlike layouts. The nested field paths of a record
that hold a value (array elements as ``[]``) are sorted and hashed; that schema
fingerprint selects a declarative mapping, which turns the record into canonical
turns (conv_id, turn, role, content, layout, fingerprint). A worker resolves each
fingerprint once: of the mappings whose required paths the record has, the one
with the most required paths wins, the first declared among equals; the number
of distinct fingerprints, not of records, decides the matching effort.

A mapping is a list of steps. ``("field", path, role)`` makes a turn of one field;
``("join", [paths], role)`` of several, joined by a blank line; ``("each", path,
role_key, text_key)`` of each element of an array of objects; ``("alternate", path)``
of each string of an array, user and assistant in turn.

Cases: a record that isn't a JSON object, or that no mapping fits, gives one row of
role and content null and layout ``unknown``, so that nothing vanishes silently;
a null or empty content makes no turn, and a record all of whose contents are empty
gives one row of layout ``empty``; roles are compared without case and unknown roles
are kept in lower case; a null role is ``user``. Turns are numbered from 0 within
their record, flat turns by their own number, which may be written as a string or with a fraction of zero, and else is 0.
Repeated records give repeated rows. Extra fields don't hinder a mapping, but change the fingerprint.
Of a content in parts each string, and each object's text, is a line; an object without a text is
written as JSON. An element of a message array that isn't an object is a turn of the user. Dots,
brackets and line feeds of a key are escaped, so that a key can't pass for a path. Nesting of any depth that the
JSON parser reads is followed; a deeper record is ``unknown``.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "conv_id string, turn bigint, role string, content string, layout string, fingerprint string"
ROLES = {
    "user": "user", "human": "user", "prompter": "user", "question": "user", "instruction": "user",
    "assistant": "assistant", "gpt": "assistant", "bot": "assistant", "model": "assistant", "chatgpt": "assistant", "ai": "assistant",
    "system": "system", "developer": "system", "tool": "tool", "function": "tool",
}
IDS = ("conv_id", "conversation_id", "id", "uuid")
EMPTY = "empty"
UNKNOWN = "unknown"


@dataclass(frozen=True)
class Mapping:
    name: str
    required: frozenset[str]
    steps: tuple[tuple, ...]


def _m(name: str, required: str, *steps: tuple) -> Mapping:
    return Mapping(name, frozenset(required.split()), steps)


MAPPINGS: tuple[Mapping, ...] = (
    _m("messages", "messages[].role messages[].content", ("each", "messages", "role", "content")),
    _m("messages_parts", "messages[].role messages[].content[].text", ("each", "messages", "role", "content")),
    _m("sharegpt", "conversations[].from conversations[].value", ("each", "conversations", "from", "value")),
    _m("instruction_input", "instruction input output", ("field", "system", "system"), ("join", ["instruction", "input"], "user"), ("field", "output", "assistant")),
    _m("instruction", "instruction output", ("field", "system", "system"), ("field", "instruction", "user"), ("field", "output", "assistant")),
    _m("instruction_response", "instruction response", ("field", "system", "system"), ("join", ["instruction", "context"], "user"), ("field", "response", "assistant")),
    _m("prompt_response", "prompt response", ("field", "system", "system"), ("field", "prompt", "user"), ("field", "response", "assistant")),
    _m("prompt_completion", "prompt completion", ("field", "system", "system"), ("field", "prompt", "user"), ("field", "completion", "assistant")),
    _m("question_answer", "question answer", ("field", "system", "system"), ("join", ["context", "question"], "user"), ("field", "answer", "assistant")),
    _m("nested_chat", "data.prompt.text data.reply.text", ("field", "data.prompt.text", "user"), ("field", "data.reply.text", "assistant")),
    _m("dialogue", "dialogue[]", ("alternate", "dialogue")),
    _m("flat_turn", "turn text", ("flat", "turn", "role", "text")),
)


def _key(k: str) -> str:
    return re.sub(r"([.\[\]\\])", r"\\\1", k).replace("\n", "\\n")


def paths(value, at: str = "") -> set[str]:
    """The paths of a record that hold a value; nulls hold none, nor do empty arrays and objects."""
    found: set[str] = set()
    stack = [(value, at)]
    while stack:
        v, p = stack.pop()
        if isinstance(v, dict):
            stack += [(x, f"{p}.{_key(k)}" if p else _key(k)) for k, x in v.items()]
        elif isinstance(v, list):
            stack += [(x, p + "[]") for x in v]
        elif v is not None:
            found.add(p)
    return found


def fingerprint(found: set[str]) -> str:
    return hashlib.md5("\n".join(sorted(found)).encode("utf-8", "surrogatepass")).hexdigest()


def select_mapping(found: set[str], mappings: tuple[Mapping, ...] = MAPPINGS) -> Mapping | None:
    fit = [m for m in mappings if m.required <= found]
    return max(fit, key=lambda m: len(m.required), default=None)


def _at(record, path: str):
    for k in path.split("."):
        record = record.get(k) if isinstance(record, dict) else None
    return record


def _array(v) -> list:
    return v if isinstance(v, list) else []


def _json(value) -> str:
    """Compact JSON, however deep."""
    out: list[str] = []
    stack: list[tuple[bool, object]] = [(False, value)]  # with True for what is written as it is
    while stack:
        done, v = stack.pop()
        if done:
            out.append(v)
        elif isinstance(v, dict):
            parts = [p for k, x in v.items() for p in ((True, ","), (True, json.dumps(k, ensure_ascii=False) + ":"), (False, x))]
            stack += [(True, "}"), *reversed(parts[1:]), (True, "{")]
        elif isinstance(v, list):
            parts = [p for x in v for p in ((True, ","), (False, x))]
            stack += [(True, "]"), *reversed(parts[1:]), (True, "[")]
        else:
            out.append(json.dumps(v, ensure_ascii=False))
    return "".join(out)


def _text(value) -> str:
    parts: list[str] = []
    stack = [value]
    while stack:
        v = stack.pop()
        if isinstance(v, str):
            parts.append(v)
        elif isinstance(v, list):
            stack += reversed(v)
        elif isinstance(v, dict) and "text" in v:
            stack.append(v["text"])
        elif v is not None:
            parts.append(_json(v))
    text = "\n".join(p for p in parts if p)
    return text if text.isascii() else text.encode("utf-8", "replace").decode()  # JSON may escape half a surrogate pair


def _number(v) -> int:
    """A turn's own number; 0 for what isn't a whole number of 64 bits."""
    try:
        x = float(v) if isinstance(v, str) else v
        n = 0 if isinstance(x, bool) else int(x)
        return n if n == x and abs(n) < 2**63 else 0
    except (TypeError, ValueError, OverflowError):
        return 0


def _role(v) -> str:
    v = _text(v).strip().lower() if isinstance(v, str) else ""
    return ROLES.get(v, v) or "user"


def turns(record: dict, mapping: Mapping) -> list[tuple[int, str, str]]:
    out: list[tuple[int | None, str, str]] = []
    for kind, *args in mapping.steps:
        if kind == "field":
            out.append((None, args[1], _text(_at(record, args[0]))))
        elif kind == "join":
            out.append((None, args[1], "\n\n".join(x for x in (_text(_at(record, p)) for p in args[0]) if x)))
        elif kind == "each":
            for x in _array(_at(record, args[0])):
                out.append((None, _role(x.get(args[1])), _text(x.get(args[2]))) if isinstance(x, dict) else (None, "user", _text(x)))
        elif kind == "alternate":
            for i, x in enumerate(_array(_at(record, args[0]))):
                out.append((None, ("user", "assistant")[i % 2], _text(x)))
        elif kind == "flat":
            out.append((_number(record.get(args[0])), _role(record.get(args[1])), _text(record.get(args[2]))))
    kept = [t for t in out if t[2]]
    return [(i if n is None else n, r, c) for i, (n, r, c) in enumerate(kept)]


def canonical(text: str | None, memo: dict[str, Mapping | None], mappings: tuple[Mapping, ...] = MAPPINGS) -> list[tuple]:
    """The rows of one record. ``memo`` keeps the mapping of each fingerprint seen."""
    try:
        record = json.loads(text) if text else None
    except (ValueError, RecursionError):
        record = None
    if not isinstance(record, dict):
        return [(None, 0, None, None, UNKNOWN, None)]
    found = paths(record)
    print_ = fingerprint(found)
    if print_ not in memo:
        memo[print_] = select_mapping(found, mappings)
    mapping = memo[print_]
    conv = next((_text(record[k]) for k in IDS if record.get(k) is not None), None)
    if mapping is None:
        return [(conv, 0, None, None, UNKNOWN, print_)]
    rows = [(conv, n, r, c, mapping.name, print_) for n, r, c in turns(record, mapping)]
    return rows or [(conv, 0, None, None, EMPTY, print_)]


def to_turns(records: DataFrame, json_col: str = "json", mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """Canonical turns of a table of JSON records; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[str, Mapping | None] = {}
        types = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string()]
        names = ["conv_id", "turn", "role", "content", "layout", "fingerprint"]
        for batch in batches:
            rows = [r for x in batch.column(0) for r in canonical(x.as_py(), memo, mappings)]
            columns = list(zip(*rows)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

    return records.select(F.col(json_col).cast("string").alias("json")).mapInArrow(run, SCHEMA)


def table_to_turns(df: DataFrame) -> DataFrame:
    """Canonical turns of a table whose rows are records, whatever its columns."""
    return to_turns(df.select(F.to_json(F.struct(*(F.col(f"`{c}`") for c in df.columns))).alias("json")))
