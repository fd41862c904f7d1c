"""Documents: a node for the file and for each heading, and guesses at the code that a section is about."""

from __future__ import annotations

import re

from .base import Extraction

_SAFE = str.maketrans({c: "_" for c in "/\\ -."})
_HEADING = re.compile(r"(#{1,6})\s+(.+)")
_FENCE = re.compile(r"```(\w*)")
_INLINE = re.compile(r"`([A-Z][a-zA-Z0-9]*)(?:\.([A-Z][a-zA-Z0-9]*))?`")


def _id(kind: str, name: str) -> str:
    return f"doc_{kind}_{name.translate(_SAFE).lower()}"


def doc_type(path: str) -> str:
    """See :func:`weftgraph.functions.scalars.classify_doc`, of which this is the form for one string."""
    low = path.lower().replace("\\", "/")
    folder, _, base = low.rpartition("/")
    stem = base.removesuffix(".md")
    if base in (stem, stem + ".md") and stem in ("readme", "changelog", "license") or base == "contributing.md":
        return stem
    if "docs" in folder or "documentation" in folder:
        return "documentation"
    for parts, kind in ((("spec", "rfc"), "specification"), (("design", "architecture"), "architecture"), (("api",), "api_reference")):
        if any(p in base for p in parts):
            return kind
    return "general"


class Markdown:
    language = "markdown"
    extensions = (".md", ".markdown", ".txt", ".rst")

    def can_extract(self, path: str, text: str) -> bool:
        return path.lower().endswith(self.extensions)

    def framework(self, path: str, text: str) -> str:
        return ""

    def extract(self, path: str, text: str) -> Extraction:
        out = Extraction()
        file = out.node(_id("file", path), "file", path.rpartition("/")[2], path=path, language="markdown", doc_type=doc_type(path))
        for level, title, refs in self.sections(text):
            own = out.node(_id("concept", f"{path}_{title}"), "concept", title, source_file=path, level=str(level), language="markdown")
            out.edge(file, own, "contains")
            for target, kind, reason in refs:
                out.edge(own, target, kind, "INFERRED", 0.7, reason=reason, source="doc_extraction")
        return out

    @staticmethod
    def sections(text: str) -> list[tuple[int, str, list[tuple[str, str, str]]]]:
        """(level, title, references) of each heading. Text before the first one is left out; fenced lines join the section's prose."""
        found, refs, buffer = [], None, []
        fenced, language = False, ""

        def finish() -> None:
            if refs is not None:
                seen = dict.fromkeys(m.groups() for m in _INLINE.finditer("\n".join(buffer)))
                refs.extend((f"method_{t}.{m}" if m else f"type_{t}", "documents", "named in the text") for t, m in seen)

        for line in text.split("\n"):
            if f := _FENCE.match(line):
                if fenced and refs is not None and language in ("go", "golang"):
                    code = "\n".join(buffer)
                    refs.extend((f"func_{n}", "describes", "function in a code block") for n in re.findall(r"\bfunc\s+(\w+)\s*\(", code))
                    refs.extend((f"type_{n}", "describes", "type in a code block") for n in re.findall(r"\btype\s+(\w+)\s+", code))
                fenced, language = not fenced, "" if fenced else f[1]
            elif not fenced and (h := _HEADING.fullmatch(line)):
                finish()
                refs, buffer = [], []
                found.append((len(h[1]), h[2].strip(), refs))
            else:
                buffer.append(line)
        finish()
        return found
