"""Handing files that have no inferred edges yet to an outside model: chunks of paths, and the text that asks for edges."""

from __future__ import annotations

import json
from collections.abc import Sequence

from ..functions.scalars import SEMANTIC_EDGES

CHUNK = 25


def select(paths: Sequence[str], only: str = "") -> list[str]:
    """The paths that equal ``only`` or end with it; all for none."""
    return [p for p in paths if not only or p == only or p.endswith("/" + only.lstrip("/"))]


def chunks(paths: Sequence[str], size: int = CHUNK) -> list[list[str]]:
    """Runs of ``size`` paths in order, the last one short."""
    if size <= 0:
        raise ValueError("size must be positive")
    return [list(paths[i : i + size]) for i in range(0, len(paths), size)]


def prompt(paths: Sequence[str], index: int, total: int, root: str) -> str:
    shape = {"nodes": [], "edges": [{"from": "id", "to": "id", "type": SEMANTIC_EDGES[0], "confidence": "INFERRED", "confidence_score": 0.8, "reason": "one sentence"}]}
    listed = "\n".join(f"* {p}" for p in paths)
    return f"""Part {index + 1} of {total}. Read these files below {root}:

{listed}

Find relations between their definitions that the syntax doesn't show. Kinds: {", ".join(SEMANTIC_EDGES)}.
Mark a relation INFERRED with a score above 0.5, or AMBIGUOUS if you doubt it; never EXTRACTED. Answer with JSON alone, in this form:

{json.dumps(shape, indent=1)}
"""


def prompts(paths: Sequence[str], root: str, size: int = CHUNK) -> list[str]:
    parts = chunks(paths, size)
    return [prompt(p, i, len(parts), root) for i, p in enumerate(parts)]
