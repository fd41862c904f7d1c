"""A compact text form of a graph: nodes and edges in tables by type, one row a line.

Rows are rendered by column expressions and written by all executors, so that the size of the graph doesn't
matter; :func:`render` makes one string for a graph that fits on the driver.
"""

from __future__ import annotations

import gzip
import json
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import compact_id
from ..model import EXTRACTED, Graph, attr


def node_rows(nodes: DataFrame, no_extra: bool = False, compact: bool = False) -> DataFrame:
    """(type, id, label, package, file); null where there is nothing to say. ``compact`` shortens ids and implies ``no_extra``."""
    extra = (lambda c: F.lit(None).cast("string")) if no_extra or compact else (lambda c: F.nullif(attr(c), F.lit("")))
    label = F.when((F.col("label") != "") & (F.col("label") != F.col("id")), F.col("label"))
    own = compact_id(F.col("id")) if compact else F.col("id")
    return nodes.select("type", own.alias("id"), label.alias("label"), extra("package").alias("package"), extra("source_file").alias("file"))


def edge_rows(edges: DataFrame, no_extra: bool = False, compact: bool = False) -> DataFrame:
    """(type, from, to, confidence, confidence_score); the confidence only where it isn't EXTRACTED."""
    said = F.lit(False) if no_extra or compact else ~F.col("confidence").isin("", EXTRACTED)
    short = compact_id if compact else (lambda c: c)
    return edges.select(
        "type", short(F.col("src")).alias("from"), short(F.col("dst")).alias("to"), F.when(said, F.col("confidence")).alias("confidence"),
        F.when(said & (F.col("confidence_score") > 0), F.col("confidence_score")).alias("confidence_score"),
    )


def _cell(c: Column) -> Column:
    text = c.cast("string")
    plain = text.rlike(r"^[^\s,:\"\[\]{}#-][^,:\"\n\r\[\]{}]*$") & ~text.rlike(r"\s$|^(true|false|null)$|^[0-9.]")
    quoted = F.concat(F.lit('"'), F.replace(F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n")), F.lit('"'))
    return F.coalesce(F.when(plain | c.isNull(), text).otherwise(quoted), F.lit(""))


def lines(g: Graph, no_extra: bool = False, compact: bool = False) -> DataFrame:
    """(section, type, line): section 1 nodes by id, section 2 edges by (from, to)."""
    n, e = node_rows(g.nodes, no_extra, compact), edge_rows(g.edges, no_extra, compact)

    def render(df: DataFrame, section: int, columns: list[str], key: Column) -> DataFrame:
        return df.select(F.lit(section).alias("section"), "type", key.alias("key"), F.concat_ws(",", *(_cell(F.col(c)) for c in columns)).alias("line"))

    nodes = render(n, 1, ["id", "label", "package", "file"], F.array("id"))
    return nodes.union(render(e, 2, ["from", "to", "confidence", "confidence_score"], F.array("from", "to")))


def write(g: Graph, path: str, gzipped: bool = False, no_extra: bool = False, compact: bool = False) -> None:
    """One folder for each section and type, its lines in order over its files."""
    df = lines(g, no_extra, compact).repartitionByRange("section", "type", "key").sortWithinPartitions("section", "type", "key")
    df.select("section", "type", "line").write.mode("overwrite").partitionBy("section", "type").option("compression", "gzip" if gzipped else "none").text(path)


def render(g: Graph, no_extra: bool = False, compact: bool = False) -> str:
    """The whole graph as one string, for graphs of report size."""
    rows = lines(g, no_extra, compact).orderBy("section", "type", "key").collect()
    out, at = [], None
    for section, title, fields in ((1, "nodes", "id,label,package,file"), (2, "edges", "from,to,confidence,confidence_score")):
        own = [r for r in rows if r["section"] == section]
        if section == 1:
            out += ["stats:", f"  nodes: {len(own)}", f"  edges: {len(rows) - len(own)}"]
        out.append(f"{title}:")
        for r in own:
            if (section, r["type"]) != at:
                at = (section, r["type"])
                out.append(f"  {r['type']}[{sum(x['type'] == r['type'] for x in own)}]{{{fields}}}:")
            out.append("    " + r["line"])
    return "\n".join(out) + "\n"


def write_gzipped(path: str, content: str) -> None:
    with gzip.open(path, "wt", encoding="utf-8") as f:
        f.write(content)


def format_value(value: object, form: str = "toon", indent: int = 0) -> str:
    """Any nested value as ``toon``, ``json`` or ``yaml`` text."""
    if form == "json":
        return json.dumps(value, indent=2, ensure_ascii=False)
    if form not in ("toon", "yaml"):
        raise ValueError(f"unknown format: {form}")
    pad = "  " * indent
    if isinstance(value, dict):
        return "\n".join(f"{pad}{k}: {_scalar(v)}" if not isinstance(v, (dict, list)) else f"{pad}{k}:\n{format_value(v, form, indent + 1)}" if v else f"{pad}{k}: {'{}' if isinstance(v, dict) else '[]'}" for k, v in value.items())
    if isinstance(value, list):
        return "\n".join(f"{pad}- {_scalar(v)}" if not isinstance(v, (dict, list)) else f"{pad}-\n{format_value(v, form, indent + 1)}" for v in value)
    return pad + _scalar(value)


def _scalar(v: object) -> str:
    if v is None:
        return "null"
    if isinstance(v, bool):
        return str(v).lower()
    if isinstance(v, str) and (not re.fullmatch(r"[\w./<>()@+-][\w ./<>()@+-]*", v) or v in ("true", "false", "null") or re.fullmatch(r"[0-9.eE+-]+", v) or v != v.strip()):
        return json.dumps(v, ensure_ascii=False)
    return str(v)
