"""What all extractors share: scanning text with its comments and strings masked, ids, and the registry."""

from __future__ import annotations

import bisect
import re
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Protocol

_UNSAFE = str.maketrans({c: "_" for c in '/\\:*?"<>| '})


@dataclass
class Extraction:
    """Rows of nodes (id, type, label, attrs) and edges (src, dst, type, confidence, confidence_score, attrs)."""

    nodes: list[tuple] = field(default_factory=list)
    edges: list[tuple] = field(default_factory=list)

    def node(self, id_: str, kind: str, label: str, /, **attrs: str) -> str:
        self.nodes.append((id_, kind, label, {k: v for k, v in attrs.items() if v}))
        return id_

    def edge(self, src: str, dst: str, kind: str, confidence: str = "EXTRACTED", score: float = 0.0, /, **attrs: str) -> None:
        self.edges.append((src, dst, kind, confidence, score, {k: v for k, v in attrs.items() if v}))


class Extractor(Protocol):
    """Turns one file into rows. ``can_extract`` may look at the content, for extensions that several formats share."""

    language: str
    extensions: tuple[str, ...]

    def can_extract(self, path: str, text: str) -> bool: ...

    def extract(self, path: str, text: str) -> Extraction: ...

    def framework(self, path: str, text: str) -> str: ...


def make_id(language: str, kind: str, name: str) -> str:
    return f"{language}_{kind}_{name.translate(_UNSAFE)}"


def masked(text: str, quotes: str = "\"'", raw: str = "", line: str = "//", block: bool = True) -> str:
    """The text with the contents of comments and strings blanked, at equal positions."""
    out, i, n = list(text), 0, len(text)

    def blank(a: int, b: int) -> None:
        for k in range(a, min(b, n)):
            if out[k] != "\n":
                out[k] = " "

    while i < n:
        c = text[i]
        if line and text.startswith(line, i):
            end = text.find("\n", i)
            end = n if end < 0 else end
            blank(i, end)
        elif block and text.startswith("/*", i):
            end = text.find("*/", i + 2)
            end = n if end < 0 else end + 2
            blank(i, end)
        elif c in raw:
            end = text.find(c, i + 1)
            end = n if end < 0 else end + 1
            blank(i + 1, end - 1)
        elif c in quotes:
            end = i + 1
            while end < n and text[end] not in (c, "\n"):
                end += 2 if text[end] == "\\" else 1
            end = min(end + 1, n)
            blank(i + 1, end - 1)
        else:
            i += 1
            continue
        i = end
    return "".join(out)


def closing(text: str, at: int, pair: str = "{}") -> int:
    """The position of the bracket that closes the one at ``at``; the end of the text if none does."""
    depth = 0
    for i in range(at, len(text)):
        if text[i] == pair[0]:
            depth += 1
        elif text[i] == pair[1]:
            depth -= 1
            if depth == 0:
                return i
    return len(text)


def split_top(text: str, sep: str = ",") -> list[str]:
    """Parts between separators that lie outside brackets."""
    parts, depth, start = [], 0, 0
    for i, c in enumerate(text):
        if c in "([{<":
            depth += 1
        elif c in ")]}>":
            depth -= 1
        elif c == sep and depth == 0:
            parts.append(text[start:i])
            start = i + 1
    return [p.strip() for p in (*parts, text[start:]) if p.strip()]


class Lines:
    """Line and column of a position."""

    def __init__(self, text: str):
        self.starts = [0, *(m.end() for m in re.finditer("\n", text))]

    def at(self, path: str, pos: int) -> str:
        i = bisect.bisect_right(self.starts, pos) - 1
        return f"{path}:{i + 1}:{pos - self.starts[i] + 1}"


CALL = re.compile(r"(?<![\w.)\]])((?:[A-Za-z_$][\w$]*\s*\??\.\s*)*[A-Za-z_$][\w$]*)\s*\(")


def calls(body: str, offset: int, keywords: frozenset[str]) -> list[tuple[str, int]]:
    """(callee as written, position) of each call in a masked body."""
    out = []
    for m in CALL.finditer(body):
        name = re.sub(r"\s+", "", m[1])
        if name.split(".")[-1] not in keywords and name not in keywords:
            out.append((name, offset + m.start(1)))
    return out


DEFAULT, THICK, CUSTOM = 0, 10, 100


class Registry:
    """Extractors by extension and language. Of several the highest priority wins, of equals the later one."""

    def __init__(self) -> None:
        self._by_extension: dict[str, tuple[int, Callable[[], Extractor]]] = {}
        self._by_language: dict[str, tuple[int, Callable[[], Extractor]]] = {}

    def register(self, make: Callable[[], Extractor], priority: int = DEFAULT) -> None:
        one = make()
        for ext in one.extensions:
            if priority >= self._by_extension.get(_dotted(ext), (priority,))[0]:
                self._by_extension[_dotted(ext)] = (priority, make)
        if priority >= self._by_language.get(one.language, (priority,))[0]:
            self._by_language[one.language] = (priority, make)

    def get(self, extension: str) -> Extractor | None:
        found = self._by_extension.get(_dotted(extension))
        return found[1]() if found else None

    def get_by_path(self, path: str) -> Extractor | None:
        name = path.replace("\\", "/").rpartition("/")[2]
        return self.get(name[name.rindex(".") :]) if "." in name else None

    def get_by_language(self, language: str) -> Extractor | None:
        found = self._by_language.get(language)
        return found[1]() if found else None

    def languages(self) -> list[str]:
        return sorted(self._by_language)

    def extensions(self) -> list[str]:
        return sorted(self._by_extension)

    def can_extract(self, path: str, text: str = "") -> bool:
        one = self.get_by_path(path)
        return one is not None and one.can_extract(path, text)


def _dotted(ext: str) -> str:
    low = ext.lower()
    return low if not low or low.startswith(".") else "." + low


def default_registry() -> Registry:
    from . import golang, java, markdown, swift, systemspec, typescript

    r = Registry()
    for make in (golang.Go, java.Java, typescript.TypeScript, swift.Swift, markdown.Markdown, systemspec.SystemSpec):
        r.register(make)
    return r
