"""Go: packages, imports, functions and methods with their signatures, types, fields, constants, variables and calls.

By syntax alone: types aren't resolved, so a call of ``x.f`` leads to an id of that text.
"""

from __future__ import annotations

import re

from ...functions.scalars import BUILTIN_TYPES
from .base import Extraction, Lines, calls, closing, make_id, masked, split_top

_KEYWORDS = frozenset("func if for switch select return go defer case range map chan struct interface type var const else".split())
_FUNC = re.compile(r"^func\s+(?:\(\s*(?:\w+\s+)?\*?\s*(\w+)(?:\[[^\]]*\])?\s*\)\s*)?(\w+)\s*(?:\[[^\]]*\]\s*)?\(", re.M)
_TYPE = re.compile(r"^(?:type[ \t]+|[ \t]+)(\w+)(?:\[[^\]\n]*\])?[ \t]+(=[ \t]*)?(struct|interface)?\b", re.M)
_FRAMEWORKS = {"gin-gonic/gin": "gin", "labstack/echo": "echo", "gofiber/fiber": "fiber", "gorilla/mux": "gorilla", "go-chi/chi": "chi", "net/http": "net/http", "google.golang.org/grpc": "grpc"}


def base_type(text: str) -> str:
    """The name that a type expression is about; ``map``, ``chan`` and ``func`` for those."""
    t = text.strip().lstrip("*").strip()
    while t.startswith("["):
        t = t[closing(t, 0, "[]") + 1 :].strip().lstrip("*").strip()
    m = re.match(r"(map|chan|func|interface|struct)\b", t)
    return m[1] if m else re.split(r"[\[{(\s]", t, maxsplit=1)[0]


class Go:
    language = "go"
    extensions = (".go",)

    def can_extract(self, path: str, text: str) -> bool:
        return path.endswith(".go")

    def framework(self, path: str, text: str) -> str:
        return next((name for part, name in _FRAMEWORKS.items() if f'"{part}' in text or f"/{part}" in text), "")

    def extract(self, path: str, text: str) -> Extraction:
        out, lines, code = Extraction(), Lines(text), masked(text, raw="`")
        m = re.search(r"^package\s+(\w+)", code, re.M)
        package = m[1] if m else ""
        at = {"package": package, "source_file": path, "language": "go"}
        file = out.node(make_id("go", "file", path), "file", path.rpartition("/")[2], path=path, package=package, language="go")
        if package:
            out.edge(file, out.node(make_id("go", "pkg", package), "package", package, language="go"), "contains")
        for name in self._imports(text, code):
            target = out.node(make_id("go", "pkg", name), "package", name.rpartition("/")[2], import_path=name, external="true", language="go")
            out.edge(file, target, "imports")
        for m in _FUNC.finditer(code):
            receiver, name = m[1], m[2]
            end_args = closing(code, m.end() - 1, "()")
            brace = self._body(code, end_args + 1)
            signature = re.sub(r"\s+", " ", text[m.start() : brace if brace >= 0 else self._line_end(code, end_args)]).strip()
            kind = "method" if receiver else "function"
            own = make_id("go", "method", f"{receiver}.{name}") if receiver else make_id("go", "func", f"{path}.{name}")
            out.node(own, kind, name, **at, source_location=lines.at(path, m.start()), signature=signature, receiver=receiver or "", doc=self._doc(text, m.start()))
            out.edge(file, own, "contains")
            if receiver:
                out.edge(own, make_id("go", "type", receiver), "method_of")
            if brace >= 0:
                for callee, pos in calls(code[brace : closing(code, brace)], brace, _KEYWORDS):
                    where = {"source_location": lines.at(path, pos), "callee_name": callee}
                    out.edge(own, make_id("go", "call", callee) if "." in callee else make_id("go", "func", f"{path}.{callee}"), "calls", **where)
        self._types(out, file, path, text, code, lines, at)
        self._values(out, file, path, code, lines, at)
        return out

    @staticmethod
    def _imports(text: str, code: str) -> list[str]:
        found = []
        for m in re.finditer(r"^import\s*(\()?", code, re.M):
            end = closing(code, m.end() - 1, "()") if m[1] else Go._line_end(code, m.end())
            found += re.findall(r'"([^"\n]+)"', re.sub(r"//[^\n]*", "", text[m.end() : end]))
        return found

    @staticmethod
    def _line_end(code: str, pos: int) -> int:
        end = code.find("\n", pos)
        return len(code) if end < 0 else end

    @staticmethod
    def _body(code: str, pos: int) -> int:
        """The brace that opens a function's body; result types may hold braces of their own."""
        while True:
            m = re.compile(r"[{\n]").search(code, pos)
            if not m or m[0] == "\n":
                return -1
            if re.search(r"\b(?:interface|struct)\s*$", code[pos : m.start()]):
                pos = closing(code, m.start()) + 1
                continue
            return m.start()

    @staticmethod
    def _doc(text: str, pos: int) -> str:
        doc = []
        for line in reversed(text[:pos].splitlines()):
            if not line.startswith("//"):
                break
            doc.append(line[2:].strip())
        return " ".join(reversed(doc))

    def _types(self, out: Extraction, file: str, path: str, text: str, code: str, lines: Lines, at: dict) -> None:
        for name, kind, pos, brace in self._declared(code):
            own = make_id("go", "type", name)
            out.node(own, kind, name, **at, source_location=lines.at(path, pos), doc=self._doc(text, text.rfind("\n", 0, pos) + 1))
            out.edge(file, own, "contains")
            if brace < 0:
                continue
            for line in code[brace + 1 : closing(code, brace)].splitlines():
                line = re.sub(r"`.*$", "", line).strip().rstrip(";")
                if not line or line in "{}":
                    continue
                if kind == "interface":
                    m = re.match(r"(\w+)\s*\(", line)
                    if m:
                        method = out.node(make_id("go", "method", f"{own}.{m[1]}"), "method", m[1], **at, interface=name, signature=line)
                        out.edge(own, method, "contains")
                    elif re.fullmatch(r"[\w.]+", line):
                        out.edge(own, make_id("go", "type", line), "extends")
                elif re.fullmatch(r"\*?[\w.]+(?:\[.*\])?", line):
                    out.edge(own, make_id("go", "type", base_type(line)), "extends")
                else:
                    m = re.match(r"((?:\w+\s*,\s*)*\w+)\s+(.+)", line)
                    target = base_type(m[2]) if m else ""
                    if target and target not in BUILTIN_TYPES:
                        for _ in m[1].split(","):
                            out.edge(own, make_id("go", "type", target), "references", kind="field_type")

    @staticmethod
    def _declared(code: str) -> list[tuple[str, str, int, int]]:
        found = []
        groups = [(m.end(), closing(code, m.end() - 1, "()")) for m in re.finditer(r"^type\s*\(", code, re.M)]
        for m in _TYPE.finditer(code):
            grouped = not m[0].startswith("type")
            if grouped and not any(a <= m.start() < b and code[a : m.start()].count("{") == code[a : m.start()].count("}") for a, b in groups):
                continue
            kind = m[3] or "type"
            brace = code.find("{", m.end()) if m[3] else -1
            found.append((m[1], kind, m.start(1), brace))
        return found

    @staticmethod
    def _values(out: Extraction, file: str, path: str, code: str, lines: Lines, at: dict) -> None:
        for m in re.finditer(r"^(const|var)\s*(\()?", code, re.M):
            kind = "constant" if m[1] == "const" else "variable"
            end = closing(code, m.end() - 1, "()") if m[2] else Go._line_end(code, m.end())
            depth = 0
            for line in re.finditer(r"[^\n]+", code[m.end() : end]):
                names = re.match(r"\s*((?:\w+\s*,\s*)*\w+)", line[0]) if depth == 0 else None
                depth += sum(line[0].count(c) for c in "({[") - sum(line[0].count(c) for c in ")}]")
                for name in split_top(names[1]) if names else ():
                    if name != "_":
                        own = out.node(make_id("go", kind, f"{path}.{name}"), kind, name, **at, source_location=lines.at(path, m.end() + line.start() + line[0].index(name)))
                        out.edge(file, own, "contains")
