"""A vault of linked notes: an index, a note for each community and one for each hub."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import label_or_id, vault_name
from ..model import Graph
from ..operators.aggregates import god_nodes, topk_per_group
from ..operators.communities import cohesion, community_members


def pages(g: Graph, communities: DataFrame, top: int = 20, min_degree: int = 3) -> DataFrame:
    """(page, name, n): the notes that a vault has; n is a hub's degree or a community's size."""
    hubs = god_nodes(g, top, exclude_types=()).where(F.col("degree") >= min_degree)
    own = communities.groupBy("community_id").agg(F.count(F.lit(1)).alias("n")).select(F.lit("community"), F.concat(F.lit("community-"), F.col("community_id").cast("string")), "n")
    return hubs.select(F.lit("hub").alias("page"), vault_name(F.col("id")).alias("name"), F.col("degree").alias("n")).union(own)


def notes(g: Graph, communities: DataFrame, top: int = 20, min_degree: int = 3, members: int = 50) -> DataFrame:
    """(path, content) of each note. A community shows its ``members`` best connected members of each type and its size."""
    hubs = god_nodes(g, top, exclude_types=()).where(F.col("degree") >= min_degree).withColumn("name", vault_name(F.col("id")))
    near = g.edges.select(F.col("src").alias("id"), F.lit("to").alias("way"), F.col("dst").alias("other"), F.col("type").alias("kind")).union(g.edges.select("dst", F.lit("from"), "src", "type"))
    near = near.join(hubs.select("id"), "id", "left_semi").join(g.nodes.select(F.col("id").alias("other"), "label"), "other", "left")
    near = near.withColumn("line", F.concat(F.lit("- "), F.col("kind"), F.lit(" "), F.col("way"), F.lit(" [["), vault_name(F.col("other")), F.lit("|"), label_or_id(F.col("label"), F.col("other")), F.lit("]]")))
    links = topk_per_group(near, "id", 500, "way", "kind", "other").groupBy("id").agg(F.array_sort(F.collect_list("line")).alias("lines"))
    hub = hubs.join(links, "id", "left").select(
        F.concat(F.lit("nodes/"), "name", F.lit(".md")).alias("path"),
        F.concat(F.lit("# "), F.col("label"), F.lit("\n\n"), F.col("type"), F.lit(", "), F.col("degree").cast("string"), F.lit(" edges\n\n"), F.array_join(F.coalesce("lines", F.array().cast("array<string>")), "\n"), F.lit("\n")).alias("content"),
    )
    m = community_members(g, communities, members)
    line = F.concat(F.lit("- "), F.col("type"), F.lit(": [["), vault_name(F.col("id")), F.lit("]] ("), F.col("degree").cast("string"), F.lit(")"))
    lists = m.groupBy("community_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("type", "rank", line.alias("l")))), lambda x: x["l"]), "\n").alias("text"))
    c = cohesion(g.edges, communities).join(lists, "community_id", "left")
    own = c.select(
        F.concat(F.lit("communities/community-"), F.col("community_id").cast("string"), F.lit(".md")),
        F.concat(F.lit("# Community "), F.col("community_id").cast("string"), F.lit("\n\n"), F.col("size").cast("string"), F.lit(" members, cohesion "), F.format_string("%.2f", "cohesion"), F.lit("\n\n"), F.coalesce("text", F.lit("")), F.lit("\n")),
    )
    return hub.union(own)


def write(g: Graph, communities: DataFrame, folder: str, **options) -> int:
    """Writes the notes and an index on the driver's disk: a vault has as many files as hubs and communities."""
    root, links = Path(folder), []
    for r in notes(g, communities, **options).orderBy("path").toLocalIterator():
        path = root / r["path"]
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(r["content"], encoding="utf-8")
        links.append(f"- [[{r['path'][:-3]}]]")
    root.mkdir(parents=True, exist_ok=True)
    (root / "index.md").write_text("# Graph\n\n" + "\n".join(links) + "\n", encoding="utf-8")
    return len(links)
