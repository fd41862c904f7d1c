"""TypeScript and JavaScript: imports, classes, interfaces, type aliases, functions, methods and calls."""

from __future__ import annotations

import re

from .base import Extraction, Lines, calls, closing, make_id, masked, split_top

_KEYWORDS = frozenset("if for while switch catch return function super typeof await import new constructor".split())
_CLASS = re.compile(r"\bclass\s+(\w+)(?:<[^{]*?>)?([^{]*)\{")
_METHOD = re.compile(r"^[ \t]*(?:(?:public|private|protected|static|async|readonly|override|abstract|get|set)\s+)*([\w$#]+)\s*(?:<[^>(]*>)?\(", re.M)
_FUNCTION = re.compile(r"\bfunction\s*\*?\s*([\w$]+)\s*(?:<[^>(]*>)?\(|\b(?:const|let|var)\s+([\w$]+)\s*(?::[^=]+)?=\s*(?:async\s*)?(?:\([^()]*(?:\([^()]*\)[^()]*)*\)\s*(?::[^={]+)?|[\w$]+\s*)=>")


class TypeScript:
    language = "typescript"
    extensions = (".ts", ".tsx", ".js", ".jsx")

    def can_extract(self, path: str, text: str) -> bool:
        return path.lower().endswith(self.extensions)

    def framework(self, path: str, text: str) -> str:
        return ""

    def extract(self, path: str, text: str) -> Extraction:
        out, lines, code = Extraction(), Lines(text), masked(text, raw="`")
        at = {"source_file": path, "language": "typescript"}
        file = out.node(make_id("ts", "file", path), "file", path.rpartition("/")[2], path=path, language="typescript")
        for m in re.finditer(r"^\s*import\b[^;\n]*?(?:\{[^}]*\}[^;\n]*?)?[\"']([^\"'\n]*)[\"']", text, re.M):
            if code[m.start() : m.end()].lstrip().startswith("import"):
                out.edge(file, out.node(make_id("ts", "module", m[1]), "module", m[1], path=m[1], language="typescript"), "imports")
        inside: list[tuple[int, int]] = []
        for m in _CLASS.finditer(code):
            own = out.node(make_id("ts", "class", m[1]), "class", m[1], **at, source_location=lines.at(path, m.start()))
            out.edge(file, own, "contains")
            up = re.search(r"\bextends\s+([\w$.]+)", m[2])
            if up:
                out.edge(own, make_id("ts", "class", up[1]), "extends")
            of = re.search(r"\bimplements\s+(.+)", m[2], re.S)
            for i in split_top(of[1]) if of else ():
                out.edge(own, make_id("ts", "interface", re.sub(r"<.*", "", i).strip()), "implements")
            end = closing(code, m.end() - 1)
            inside.append((m.end(), end))
            self._methods(out, own, m[1], path, text, code, lines, at, m.end(), end)
        for m in re.finditer(r"\binterface\s+(\w+)[^{;]*\{", code):
            out.edge(file, out.node(make_id("ts", "interface", m[1]), "interface", m[1], **at, source_location=lines.at(path, m.start())), "contains")
        for m in re.finditer(r"^\s*(?:export\s+)?(?:declare\s+)?type\s+(\w+)\s*(?:<[^=]*>)?\s*=", code, re.M):
            out.edge(file, out.node(make_id("ts", "type", m[1]), "type", m[1], **at, source_location=lines.at(path, m.start(1))), "contains")
        for m in _FUNCTION.finditer(code):
            name = m[1] or m[2]
            own = make_id("ts", "func", f"{path}.{name}")
            after = closing(code, m.end() - 1, "()") if m[1] else m.end()
            brace = re.compile(r"[{;\n]").search(code, after)
            signature = re.sub(r"\s+", " ", text[m.start() : brace.start() if brace else len(text)]).strip()
            out.node(own, "function", name, **at, source_location=lines.at(path, m.start()), signature=signature)
            out.edge(file, own, "contains")
            if brace and brace[0] == "{":
                self._calls(out, own, path, code, lines, brace.start())
        return out

    def _methods(self, out: Extraction, owner: str, name: str, path: str, text: str, code: str, lines: Lines, at: dict, start: int, end: int) -> None:
        pos = start
        while m := _METHOD.search(code, pos, end):
            args = closing(code, m.end() - 1, "()")
            brace = re.compile(r"[{;]").search(code, args)
            if m[1] in _KEYWORDS - {"constructor"} or not brace or brace.start() > end:
                pos = m.end()
                continue
            own = make_id("ts", "method", f"{owner}.{m[1]}")
            signature = re.sub(r"\s+", " ", text[m.start(1) : brace.start()]).strip()
            out.node(own, "method", m[1], **at, **{"class": name}, source_location=lines.at(path, m.start(1)), signature=signature)
            out.edge(owner, own, "contains")
            if brace[0] == "{":
                self._calls(out, own, path, code, lines, brace.start())
                pos = closing(code, brace.start())
            else:
                pos = brace.end()

    @staticmethod
    def _calls(out: Extraction, own: str, path: str, code: str, lines: Lines, brace: int) -> None:
        for callee, pos in calls(code[brace : closing(code, brace)], brace, _KEYWORDS):
            out.edge(own, make_id("ts", "call", callee), "calls", source_location=lines.at(path, pos), callee_name=callee)
