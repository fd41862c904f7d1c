"""Swift: imports, classes, structs, protocols, enums, extensions, functions, methods and calls."""

from __future__ import annotations

import re

from .base import Extraction, Lines, calls, closing, make_id, masked, split_top

_KEYWORDS = frozenset("if guard for while switch catch return func init super repeat".split())
_TYPE = re.compile(r"\b(class|struct|protocol|enum|extension|actor)\s+(?!func\b|var\b|let\b)([\w.]+)(?:<[^{]*?>)?\s*(?::([^{]*))?\{")
_FUNC = re.compile(r"\b(?:func\s+([\w`]+|[-+*/=<>!&|^%~?.]+)|(init)[?!]?)\s*(?:<[^>(]*>)?\(")


class Swift:
    language = "swift"
    extensions = (".swift",)

    def can_extract(self, path: str, text: str) -> bool:
        return path.endswith(".swift")

    def framework(self, path: str, text: str) -> str:
        return ""

    def extract(self, path: str, text: str) -> Extraction:
        out, lines, code = Extraction(), Lines(text), masked(text, quotes='"')
        at = {"source_file": path, "language": "swift"}
        file = out.node(make_id("swift", "file", path), "file", path.rpartition("/")[2], path=path, language="swift")
        for m in re.finditer(r"^\s*(?:@\w+\s+)*import\s+(?:(?:class|struct|enum|protocol|func)\s+)?(\w+)", code, re.M):
            out.edge(file, out.node(make_id("swift", "module", m[1]), "module", m[1], language="swift"), "imports")
        owners: list[tuple[int, int, str]] = []
        for m in _TYPE.finditer(code):
            word, name = m[1], m[2]
            end = closing(code, m.end() - 1)
            where = lines.at(path, m.start())
            if word == "extension":
                own = out.node(make_id("swift", "extension", f"{name}_{path}"), "extension", name, **at, source_location=where, extends=name)
                out.edge(own, make_id("swift", "class", name), "extends")
            else:
                kind = {"protocol": "interface", "actor": "class"}.get(word, word)
                own = out.node(make_id("swift", "class" if word == "actor" else word, name), kind, name, **at, source_location=where, kind="protocol" if word == "protocol" else "")
            out.edge(file, own, "contains")
            for up in split_top(re.sub(r"\bwhere\b.*", "", m[3] or "", flags=re.S)):
                out.edge(own, make_id("swift", "protocol", re.sub(r"<.*", "", up).strip()), "implements")
            owners.append((m.end(), end, own))
        bodies: list[tuple[int, int]] = []
        for m in _FUNC.finditer(code):
            if any(a <= m.start() < b for a, b in bodies):  # functions within functions are not visited
                continue
            holder = max((o for o in owners if o[0] <= m.start() < o[1]), default=None)
            name = (m[1] or m[2]).strip("`")
            args = closing(code, m.end() - 1, "()")
            brace = re.compile(r"[{\n]").search(code, args)
            signature = re.sub(r"\s+", " ", text[m.start() : brace.start() if brace else len(text)]).strip()
            if holder:
                own = out.node(make_id("swift", "method", f"{holder[2]}.{name}"), "method", name, **at, source_location=lines.at(path, m.start()), signature=signature, parent_type=holder[2])
            elif m[1]:
                own = out.node(make_id("swift", "func", f"{path}.{name}"), "function", name, **at, source_location=lines.at(path, m.start()), signature=signature)
            else:
                continue
            out.edge(holder[2] if holder else file, own, "contains")
            if brace and brace[0] == "{":
                end = closing(code, brace.start())
                bodies.append((brace.start(), end))
                for callee, pos in calls(code[brace.start() : end], brace.start(), _KEYWORDS):
                    out.edge(own, make_id("swift", "call", callee), "calls", source_location=lines.at(path, pos), callee_name=callee)
        return out
