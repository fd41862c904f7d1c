"""Java: packages, imports, classes, interfaces, enums, methods, calls, and the annotations that wire an application."""

from __future__ import annotations

import re

from .base import Extraction, Lines, calls, closing, make_id, masked, split_top

_KEYWORDS = frozenset("if for while switch catch synchronized return new super this try assert throw".split())
LAYERS = {
    "Component": "component", "Configuration": "configuration", "Controller": "controller", "ControllerAdvice": "controller", "Document": "domain", "Entity": "domain", "Repository": "repository",
    "RestController": "controller", "Service": "service",
}
INJECTED = frozenset(("Autowired", "Inject", "Resource", "Value"))
ROUTES = frozenset(f"{verb}Mapping" for verb in ("Delete", "Get", "Patch", "Post", "Put", "Request"))
_NOTE = r"(?:@(?!interface)[\w.]+(?:\s*\([^()]*(?:\([^()]*\)[^()]*)*\))?\s*)*"
_MODS = r"(?:(?:public|protected|private|static|final|abstract|sealed|non-sealed|strictfp|default|synchronized|native|transient|volatile)\s+)*"
_TYPE = re.compile(rf"({_NOTE}){_MODS}\b(class|interface|enum|record)\s+(\w+)(?:<[^{{]*?>)?([^{{;]*)\{{")
_METHOD = re.compile(rf"({_NOTE}){_MODS}(?:<[^>]+>\s*)?([\w.<>\[\], ?]+?\s+)?(\w+)\s*\(")
_FIELD = re.compile(rf"({_NOTE}){_MODS}([\w.]+(?:<[^;=]*>)?(?:\[\])*)\s+(\w+)\s*(?:=|;)")


def _names(notes: str) -> list[str]:
    return [n.rpartition(".")[2] for n in re.findall(r"@([\w.]+)", re.sub(r"\([^()]*(?:\([^()]*\)[^()]*)*\)", "", notes))]


def _bare(name: str) -> str:
    return re.sub(r"<.*", "", name, flags=re.S).strip().rpartition(".")[2]


class Java:
    language = "java"
    extensions = (".java",)

    def can_extract(self, path: str, text: str) -> bool:
        return path.endswith(".java")

    def framework(self, path: str, text: str) -> str:
        return "spring" if "org.springframework" in text else ""

    def extract(self, path: str, text: str) -> Extraction:
        out, lines, code = Extraction(), Lines(text), masked(text)
        m = re.search(r"^\s*package\s+([\w.]+)\s*;", code, re.M)
        package = m[1] if m else ""
        at = {"package": package, "source_file": path, "language": "java"}
        file = out.node(make_id("java", "file", path), "file", path.rpartition("/")[2], path=path, package=package, language="java")
        if package:
            out.edge(file, out.node(make_id("java", "pkg", package), "package", package, language="java"), "contains")
        for m in re.finditer(r"^\s*import\s+(?:static\s+)?([\w.]+(?:\.\*)?)\s*;", code, re.M):
            target = out.node(make_id("java", "pkg", m[1]), "package", m[1].rpartition(".")[2], import_path=m[1], external="true", language="java")
            out.edge(file, target, "imports")
        pos = 0
        while m := _TYPE.search(code, pos):  # types within types are not visited
            brace = m.end() - 1
            pos = closing(code, brace) + 1
            self._type(out, file, path, text, code, lines, at, m, brace, pos - 1)
        return out

    def _type(self, out: Extraction, file: str, path: str, text: str, code: str, lines: Lines, at: dict, m: re.Match, brace: int, end: int) -> None:
        word, name, tail = m[2], m[3], m[4]
        kind = {"record": "class"}.get(word, word)
        notes = _names(m[1])
        own = make_id("java", kind, name)
        layer = next((LAYERS[n] for n in notes if n in LAYERS), "") if kind == "class" else ""
        out.node(own, kind, name, **at, source_location=lines.at(path, m.start(2)), annotations=",".join(notes), layer=layer)
        out.edge(file, own, "contains")
        if kind == "class":
            for n in notes:
                out.edge(own, out.node(make_id("java", "annotation", n), "annotation", n, language="java"), "annotated_with")
            up = re.search(r"\bextends\s+([\w.]+(?:<[^{]*?>)?)", tail)
            if up:
                out.edge(own, make_id("java", "class", _bare(up[1])), "extends")
            of = re.search(r"\bimplements\s+(.+)", tail, re.S)
            for i in split_top(of[1]) if of else ():
                out.edge(own, make_id("java", "interface", _bare(i)), "implements")
        if kind == "enum":
            return
        for a, head in self._members(code, brace, end):
            stop = a + len(head)
            has_args = _METHOD.match(head.lstrip())
            if re.search(r"\b(?:class|interface|enum|record)\s+\w+", head):
                continue
            lead = len(head) - len(head.lstrip())
            if has_args and "=" not in head[: lead + has_args.end()].replace(has_args[1], "") and has_args[3] not in _KEYWORDS:
                self._method(out, own, name, path, text, code, lines, at, a + lead, has_args, stop)
            elif kind == "class" and (f := _FIELD.match(head.lstrip() + ";")):
                wired = [n for n in _names(f[1])]
                if INJECTED & set(wired):
                    out.edge(own, make_id("java", "class", _bare(f[2])), "injects", injection_type=",".join(wired))

    @staticmethod
    def _members(code: str, brace: int, end: int) -> list[tuple[int, str]]:
        """(position, text up to its ``;`` or ``{``) of each member of a type's body."""
        found, start, i = [], brace + 1, brace + 1
        while i < end:
            if code[i] == "(":
                i = closing(code, i, "()")
            elif code[i] in ";{":
                found.append((start, code[start:i]))
                if code[i] == "{":
                    i = closing(code, i)
                start = i + 1
            i += 1
        return found

    @staticmethod
    def _method(out: Extraction, owner: str, type_name: str, path: str, text: str, code: str, lines: Lines, at: dict, pos: int, m: re.Match, stop: int) -> None:
        name, notes = m[3], _names(m[1])
        own = make_id("java", "method", f"{owner}.{name}")
        signature = re.sub(r"\s+", " ", text[pos + len(m[1]) : stop]).strip()
        route = ""
        raw = text[pos : pos + len(m[1])]
        for n in notes:
            if n in ROUTES:
                said = re.search(rf'@{n}\s*\([^)"]*"([^"]*)"', raw)
                route = said[1] if said and said[1] else "/" + n.removesuffix("Mapping").lower()
                break
        out.node(own, "method", name, **at, **{"class": type_name}, source_location=lines.at(path, pos + m.start(3)), signature=signature, annotations=",".join(notes), route=route)
        out.edge(owner, own, "contains")
        if route:
            out.edge(own, out.node(make_id("java", "route", route), "route", route, language="java"), "handles_route")
        for n in notes:
            out.edge(own, make_id("java", "annotation", n), "annotated_with")
        if stop < len(code) and code[stop] == "{":
            for callee, at_pos in calls(code[stop : closing(code, stop)], stop, _KEYWORDS):
                last = callee.rpartition(".")[2]
                out.edge(own, make_id("java", "call", last), "calls", source_location=lines.at(path, at_pos), callee_name=last)
