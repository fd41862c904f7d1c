"""The property graph: two relations, and the conventions that all operators share.

``nodes(id, type, label, attrs)`` and ``edges(src, dst, type, confidence,
confidence_score, attrs)``. An attribute that is missing reads as ``''`` and a score
that is missing as 0; edges may point at ids without a node row, so every join
chooses its kind on purpose. Where an order is needed and the data give none, ids
break ties.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NODE_SCHEMA = "id string, type string, label string, attrs map<string,string>"
EDGE_SCHEMA = "src string, dst string, type string, confidence string, confidence_score double, attrs map<string,string>"
COMMUNITY_SCHEMA = "node_id string, community_id int"

EXTRACTED, INFERRED, AMBIGUOUS = "EXTRACTED", "INFERRED", "AMBIGUOUS"
CONFIDENCES = (EXTRACTED, INFERRED, AMBIGUOUS)
STRUCTURAL_EDGES = ("contains", "imports")
CODE_DOC_EDGES = ("describes", "documents", "explains", "rationale_for")
DEPENDENCY_EDGES = ("calls", "imports", "uses")
CODE_NODES = ("function", "method")


def attr(name: str, of: str = "attrs") -> Column:
    """An attribute, ``''`` where it is missing."""
    return F.coalesce(F.col(of)[name], F.lit(""))


def no_attrs() -> Column:
    return F.create_map().cast("map<string,string>")


@dataclass(frozen=True)
class Graph:
    nodes: DataFrame
    edges: DataFrame

    def distinct(self) -> Graph:
        """One row for each node id and each (src, dst, type); which of several rows stays isn't defined."""
        return Graph(self.nodes.dropDuplicates(["id"]), self.edges.dropDuplicates(["src", "dst", "type"]))

    def where_type(self, *edge_types: str) -> DataFrame:
        return self.edges.where(F.col("type").isin(*edge_types)) if edge_types else self.edges
