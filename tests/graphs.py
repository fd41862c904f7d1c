"""Small literal graphs."""

from weftgraph.model import EDGE_SCHEMA, NODE_SCHEMA, Graph


def graph(spark, nodes, edges):
    """nodes: (id, type[, label[, attrs]]); edges: (src, dst, type[, confidence[, score]])"""
    n = [(x[0], x[1], x[2] if len(x) > 2 else x[0], x[3] if len(x) > 3 else {}) for x in nodes]
    e = [(x[0], x[1], x[2], x[3] if len(x) > 3 else "EXTRACTED", float(x[4]) if len(x) > 4 else 0.0, {}) for x in edges]
    return Graph(spark.createDataFrame(n, NODE_SCHEMA), spark.createDataFrame(e, EDGE_SCHEMA))


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)
