"""Graphs made from ordinary tables, in the vocabulary that the operators know.

Each projection has a Spark form and the same thing as SQL common table expressions, which
the oracles of :mod:`weftgraph.plans` begin with. In SQL the attributes are plain
columns, ``''`` where a node has none, and ``n_attrs`` counts them.

* commerce: regions, nations, customers, suppliers, parts and orders as packages, files,
  structs, interfaces, functions and methods;
* events: users and event types, with a call from each event to its user's next;
* corpus: documents as nodes;
* code: a code-like graph with labels and signatures that the detectors look for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..model import EXTRACTED, Graph, no_attrs


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _node(df: DataFrame, prefix: str, key: str, kind: str, label: Column, **attrs: Column) -> DataFrame:
    pairs = [x for k, v in attrs.items() for x in (F.lit(k), v.cast("string"))]
    bag = F.create_map(*pairs) if pairs else no_attrs()
    return df.select(_id(prefix, key).alias("id"), F.lit(kind).alias("type"), label.cast("string").alias("label"), bag.alias("attrs"))


def _id(prefix: str, key: str) -> Column:
    return F.concat(F.lit(f"{prefix}:"), F.col(key).cast("string"))


def _edge(df: DataFrame, src: Column, dst: Column, kind: str, confidence: Column | None = None, score: Column | None = None) -> DataFrame:
    return df.select(
        src.alias("src"), dst.alias("dst"), F.lit(kind).alias("type"), (F.lit(EXTRACTED) if confidence is None else confidence).alias("confidence"),
        (F.lit(0.0) if score is None else score).cast("double").alias("confidence_score"), no_attrs().alias("attrs"),
    )


def spread(df: DataFrame, *keys: str, rows: int = 250_000) -> DataFrame:
    """``df`` by hash of ``keys`` in as many partitions as it takes for about ``rows`` rows each; a file of Parquet tells its number of rows.

    Tasks that group by these keys then hold a bounded part whatever the table's size, where splits of files and partitions that are
    joined by their compressed size hold millions of rows.
    """
    n, cores = df.count(), df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(max(1, -(-n // rows), min(cores, n // 20_000)), *keys)


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


#: (l_orderkey, l_linenumber) repeats; this order of lineitem has no ties.
LINE_ORDER = ("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_returnflag", "l_discount")


def commerce_nodes(spark: SparkSession, sf_dir: str, without_pending: bool = False, orders_where: str | None = None) -> DataFrame:
    """``without_pending`` leaves out the node rows of orders of status P, so that edges dangle; ``orders_where`` takes a snapshot."""
    region, nation, customer, supplier, part, orders = (read(spark, sf_dir, t) for t in ("region", "nation", "customer", "supplier", "part", "orders"))
    of_nation = nation.select(F.col("n_nationkey").alias("k"), "n_name")
    c = customer.join(of_nation, F.col("c_nationkey") == F.col("k"))
    s = supplier.join(of_nation, F.col("s_nationkey") == F.col("k"))
    n = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    signature = F.concat(F.lit("func "), F.col("p_name"), F.lit("(size int, kind "), F.col("p_type"), F.lit(") "), F.col("p_brand"))
    if without_pending:
        orders = orders.where("o_orderstatus <> 'P'")
    if orders_where:
        orders = orders.where(orders_where)
    return _union(
        [
            _node(region, "region", "r_regionkey", "package", F.col("r_name")),
            _node(n, "nation", "n_nationkey", "file", F.col("n_name"), package=F.col("r_name"), path=F.col("n_name")),
            _node(c, "customer", "c_custkey", "struct", F.col("c_name"), package=F.col("n_name"), source_file=F.col("c_mktsegment")),
            _node(s, "supplier", "s_suppkey", "interface", F.col("s_name"), package=F.col("n_name"), source_file=F.col("n_name")),
            _node(part, "part", "p_partkey", "function", F.col("p_name"), package=F.col("p_brand"), source_file=F.col("p_type"), signature=signature, doc=F.col("p_name")),
            _node(orders, "order", "o_orderkey", "method", F.concat(F.lit("order_"), F.col("o_orderkey").cast("string")), package=F.col("o_orderpriority"), source_file=F.col("o_orderstatus")),
        ]
    )


def commerce_edges(spark: SparkSession, sf_dir: str, orders_where: str | None = None) -> DataFrame:
    """Contains, calls, uses, references and imports; already distinct by (src, dst, type). What grows is spread by number of rows, so that a task that goes on to group it holds a bounded part."""
    nation, customer, supplier, orders, line = (read(spark, sf_dir, t) for t in ("nation", "customer", "supplier", "orders", "lineitem"))
    of_orders = line
    if orders_where:
        orders = orders.where(orders_where)
        of_orders = line.join(orders.select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey", "left_semi")
    uses = spread(of_orders, "l_orderkey", "l_partkey").groupBy("l_orderkey", "l_partkey").agg(F.min(F.struct(*LINE_ORDER)).alias("x"))
    flag = F.col("x.l_returnflag")
    confidence = F.when(flag == "N", EXTRACTED).when(flag == "R", "INFERRED").otherwise("AMBIGUOUS")
    score = F.when(flag == "N", 0.0).otherwise(F.round(1 - 5 * F.col("x.l_discount"), 2))
    return _union(
        [
            _edge(nation, _id("region", "n_regionkey"), _id("nation", "n_nationkey"), "contains"),
            _edge(spread(customer.select("c_nationkey", "c_custkey"), "c_custkey"), _id("nation", "c_nationkey"), _id("customer", "c_custkey"), "contains"),
            _edge(supplier, _id("nation", "s_nationkey"), _id("supplier", "s_suppkey"), "contains"),
            _edge(spread(orders.select("o_custkey", "o_orderkey"), "o_orderkey"), _id("customer", "o_custkey"), _id("order", "o_orderkey"), "calls"),
            _edge(uses, _id("order", "l_orderkey"), _id("part", "l_partkey"), "uses", confidence, score),
            _edge(spread(line.select("l_partkey", "l_suppkey"), "l_partkey", "l_suppkey").distinct(), _id("part", "l_partkey"), _id("supplier", "l_suppkey"), "references"),
            _edge(supplier, _id("supplier", "s_suppkey"), _id("nation", "s_nationkey"), "imports"),
        ]
    )


def commerce(spark: SparkSession, sf_dir: str, without_pending: bool = False, orders_where: str | None = None) -> Graph:
    return Graph(commerce_nodes(spark, sf_dir, without_pending, orders_where), commerce_edges(spark, sf_dir, orders_where))


def commerce_semantic(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of an inferred batch with ``ordinal``: repeated keys, keys that the graph has already, and invalid rows."""
    supplier, part, line = (read(spark, sf_dir, t) for t in ("supplier", "part", "lineitem"))
    nodes = _union(
        [
            supplier.select(_id("supplier", "s_suppkey").alias("id"), F.lit("concept").alias("type"), F.col("s_name").alias("label"), no_attrs().alias("attrs"), F.col("s_suppkey").alias("ordinal")),
            part.select(F.concat(F.lit("concept:"), F.col("p_type")).alias("id"), F.lit("concept").alias("type"), F.col("p_name").alias("label"), no_attrs().alias("attrs"), F.col("p_partkey").alias("ordinal")),
        ]
    )
    depends = line.select("l_orderkey", "l_suppkey", "l_linenumber").distinct()
    confidence = F.when(F.col("l_orderkey") % 3 == 0, "AMBIGUOUS").when(F.col("l_orderkey") % 3 == 1, "INFERRED").otherwise("EXTRACTED")
    edges = depends.select(
        _id("order", "l_orderkey").alias("src"), _id("supplier", "l_suppkey").alias("dst"), F.lit("inferred_depends").alias("type"), confidence.alias("confidence"),
        (F.col("l_linenumber") / F.lit(5.0)).alias("confidence_score"), F.lit("same line").alias("reason"), F.col("l_linenumber").alias("ordinal"),
    )
    again = line.select("l_orderkey", "l_partkey").distinct().select(
        _id("order", "l_orderkey").alias("src"), _id("part", "l_partkey").alias("dst"), F.lit("uses").alias("type"), F.lit("INFERRED").alias("confidence"),
        F.lit(0.5).alias("confidence_score"), F.lit("again").alias("reason"), F.lit(0).alias("ordinal"),
    )
    return nodes, edges.unionByName(again)


def commerce_communities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(node_id, community_id): a given partition. Nations, customers and suppliers are in their region's community, parts go by size and orders by customer; five in all."""
    region, nation, customer, supplier, part, orders = (read(spark, sf_dir, t) for t in ("region", "nation", "customer", "supplier", "part", "orders"))
    of_nation = nation.select(F.col("n_nationkey").alias("k"), F.col("n_regionkey").cast("int").alias("community_id"))
    return _union(
        [
            region.select(_id("region", "r_regionkey").alias("node_id"), F.col("r_regionkey").cast("int").alias("community_id")),
            nation.select(_id("nation", "n_nationkey").alias("node_id"), F.col("n_regionkey").cast("int").alias("community_id")),
            customer.join(of_nation, F.col("c_nationkey") == F.col("k")).select(_id("customer", "c_custkey").alias("node_id"), "community_id"),
            supplier.join(of_nation, F.col("s_nationkey") == F.col("k")).select(_id("supplier", "s_suppkey").alias("node_id"), "community_id"),
            part.select(_id("part", "p_partkey").alias("node_id"), (F.col("p_size") % 5).cast("int").alias("community_id")),
            orders.select(_id("order", "o_orderkey").alias("node_id"), (F.col("o_custkey") % 5).cast("int").alias("community_id")),
        ]
    )


COMMERCE_SQL = """
p1_use AS (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_partkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_returnflag, l_discount) AS rn
  FROM lineitem),
all_nodes AS (
  SELECT 'region:' || r_regionkey AS id, 'package' AS type, r_name AS label, '' AS package, '' AS source_file, '' AS signature, '' AS doc, 0 AS n_attrs, '' AS status FROM region
  UNION ALL SELECT 'nation:' || n_nationkey, 'file', n_name, r_name, '', '', '', 2, '' FROM nation JOIN region ON n_regionkey = r_regionkey
  UNION ALL SELECT 'customer:' || c_custkey, 'struct', c_name, n_name, c_mktsegment, '', '', 2, '' FROM customer JOIN nation ON c_nationkey = n_nationkey
  UNION ALL SELECT 'supplier:' || s_suppkey, 'interface', s_name, n_name, n_name, '', '', 2, '' FROM supplier JOIN nation ON s_nationkey = n_nationkey
  UNION ALL SELECT 'part:' || p_partkey, 'function', p_name, p_brand, p_type, 'func ' || p_name || '(size int, kind ' || p_type || ') ' || p_brand, p_name, 4, '' FROM part
  UNION ALL SELECT 'order:' || o_orderkey, 'method', 'order_' || o_orderkey, o_orderpriority, o_orderstatus, '', '', 2, o_orderstatus FROM orders),
nodes AS (SELECT * FROM all_nodes {pending}),
edges AS (
  SELECT 'region:' || n_regionkey AS src, 'nation:' || n_nationkey AS dst, 'contains' AS type, 'EXTRACTED' AS confidence, 0.0::DOUBLE AS score FROM nation
  UNION ALL SELECT 'nation:' || c_nationkey, 'customer:' || c_custkey, 'contains', 'EXTRACTED', 0.0 FROM customer
  UNION ALL SELECT 'nation:' || s_nationkey, 'supplier:' || s_suppkey, 'contains', 'EXTRACTED', 0.0 FROM supplier
  UNION ALL SELECT 'customer:' || o_custkey, 'order:' || o_orderkey, 'calls', 'EXTRACTED', 0.0 FROM orders
  UNION ALL SELECT 'order:' || l_orderkey, 'part:' || l_partkey, 'uses',
      CASE l_returnflag WHEN 'N' THEN 'EXTRACTED' WHEN 'R' THEN 'INFERRED' ELSE 'AMBIGUOUS' END,
      CASE l_returnflag WHEN 'N' THEN 0.0::DOUBLE ELSE round(1 - 5 * l_discount, 2) END FROM p1_use WHERE rn = 1
  UNION ALL SELECT 'part:' || l_partkey, 'supplier:' || l_suppkey, 'references', 'EXTRACTED', 0.0 FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem)
  UNION ALL SELECT 'supplier:' || s_suppkey, 'nation:' || s_nationkey, 'imports', 'EXTRACTED', 0.0 FROM supplier),
communities AS (
  SELECT 'region:' || r_regionkey AS node_id, r_regionkey::INTEGER AS community_id FROM region
  UNION ALL SELECT 'nation:' || n_nationkey, n_regionkey::INTEGER FROM nation
  UNION ALL SELECT 'customer:' || c_custkey, n_regionkey::INTEGER FROM customer JOIN nation ON c_nationkey = n_nationkey
  UNION ALL SELECT 'supplier:' || s_suppkey, n_regionkey::INTEGER FROM supplier JOIN nation ON s_nationkey = n_nationkey
  UNION ALL SELECT 'part:' || p_partkey, (p_size % 5)::INTEGER FROM part
  UNION ALL SELECT 'order:' || o_orderkey, (o_custkey % 5)::INTEGER FROM orders)
"""


SEMANTIC_SQL = """
sem_nodes AS (
  SELECT 'supplier:' || s_suppkey AS id, 'concept' AS type, s_name AS label, s_suppkey AS ordinal FROM supplier
  UNION ALL SELECT 'concept:' || p_type, 'concept', p_name, p_partkey FROM part),
sem_edges AS (
  SELECT DISTINCT 'order:' || l_orderkey AS src, 'supplier:' || l_suppkey AS dst, 'inferred_depends' AS type,
    CASE l_orderkey % 3 WHEN 0 THEN 'AMBIGUOUS' WHEN 1 THEN 'INFERRED' ELSE 'EXTRACTED' END AS confidence, l_linenumber / 5.0::DOUBLE AS score, l_linenumber AS ordinal FROM lineitem
  UNION ALL SELECT DISTINCT 'order:' || l_orderkey, 'part:' || l_partkey, 'uses', 'INFERRED', 0.5, 0 FROM lineitem)
"""


def events(spark: SparkSession, sf_dir: str) -> Graph:
    """Event types that call one another in each user's order of events, and users that use them."""
    e = read(spark, sf_dir, "events")
    step = e.withColumn("next", F.lead("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))).where("next is not null")
    nodes = _union(
        [
            _node(e.select("event_type").distinct(), "event", "event_type", "function", F.col("event_type")),
            _node(e.select("user_id").distinct(), "user", "user_id", "struct", F.concat(F.lit("user_"), F.col("user_id").cast("string"))),
        ]
    )
    edges = _union(
        [
            _edge(step.select("event_type", "next").distinct(), _id("event", "event_type"), _id("event", "next"), "calls"),
            _edge(e.select("user_id", "event_type").distinct(), _id("user", "user_id"), _id("event", "event_type"), "uses"),
        ]
    )
    return Graph(nodes, edges)


EVENTS_SQL = """
p2_step AS (SELECT event_type, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS next FROM events),
nodes AS (
  SELECT DISTINCT 'event:' || event_type AS id, 'function' AS type, event_type AS label, '' AS package, '' AS source_file, '' AS signature, '' AS doc FROM events
  UNION ALL SELECT DISTINCT 'user:' || user_id, 'struct', 'user_' || user_id, '', '', '', '' FROM events),
edges AS (
  SELECT DISTINCT 'event:' || event_type AS src, 'event:' || next AS dst, 'calls' AS type, 'EXTRACTED' AS confidence, 0.0::DOUBLE AS score FROM p2_step WHERE next IS NOT NULL
  UNION ALL SELECT DISTINCT 'user:' || user_id, 'event:' || event_type, 'uses', 'EXTRACTED', 0.0 FROM events)
"""


def corpus(spark: SparkSession, sf_dir: str) -> Graph:
    d = read(spark, sf_dir, "documents")
    nodes = d.select(
        _id("doc", "doc_id").alias("id"), F.col("lang").alias("type"), F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("label"),
        F.create_map(F.lit("doc"), F.col("text"), F.lit("package"), F.col("source")).alias("attrs"),
    )
    return Graph(nodes, d.sparkSession.createDataFrame([], "src string, dst string, type string, confidence string, confidence_score double, attrs map<string,string>"))


CORPUS_SQL = """
nodes AS (SELECT 'doc:' || doc_id AS id, lang AS type, 'doc_' || doc_id AS label, source AS package, '' AS source_file, '' AS signature, text AS doc FROM documents)
"""


_LABELS = ("NewClient", "handleRequest", "serveRoute", "parseValue", "main", "GetItem", "TestFoo", "initHandler")
_SIGNATURES = (
    "func NewClient(opts Options) *Client", "func handleRequest(w http.ResponseWriter, r *http.Request)", "func serveRoute(ctx context.Context) error", "func parseValue(s string) (int, error)",
    "", "func GetItem(id int64) *Item", "func TestFoo(t *testing.T)", "func initHandler(c *gin.Context)",
)
_STRUCTS = ("OrderRepository", "ConfigBuilder", "Options", "Session")
_VARIABLES = ("defaultClient", "globalState", "counter", "instancePool", "limit")
_PACKAGES = ("api/http", "service/core", "repo/store", "util")


def _pick(values: tuple[str, ...], key: str) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (F.col(key) % len(values) + 1).cast("int"))


def code(spark: SparkSession, sf_dir: str) -> Graph:
    part, supplier, nation, line = (read(spark, sf_dir, t) for t in ("part", "supplier", "nation", "lineitem"))
    nodes = _union(
        [
            _node(part, "part", "p_partkey", "function", _pick(_LABELS, "p_partkey"), signature=_pick(_SIGNATURES, "p_partkey"), package=_pick(_PACKAGES, "p_size"), source_file=F.col("p_brand")),
            _node(supplier, "supplier", "s_suppkey", "struct", _pick(_STRUCTS, "s_suppkey"), package=_pick(_PACKAGES, "s_nationkey")),
            _node(nation, "nation", "n_nationkey", "variable", _pick(_VARIABLES, "n_nationkey"), package=F.lit("util")),
        ]
    )
    in_order = Window.partitionBy("l_orderkey").orderBy(*LINE_ORDER)
    step = spread(line, "l_orderkey").withColumn("next", F.lead("l_partkey").over(in_order)).where("next % 8 not in (3, 7)").select("l_partkey", "next").distinct()
    count = supplier.agg(F.count(F.lit(1)).alias("n"))  # one row
    made = part.where("p_partkey % 8 = 0").crossJoin(count).withColumn("to", F.col("p_partkey") % F.col("n"))
    edges = _union(
        [
            _edge(spread(line.where("l_partkey % 8 < 4"), "l_suppkey", "l_partkey").select("l_suppkey", "l_partkey").distinct(), _id("supplier", "l_suppkey"), _id("part", "l_partkey"), "has_method"),
            _edge(step, _id("part", "l_partkey"), _id("part", "next"), "calls"),
            _edge(part.withColumn("to", F.col("p_partkey") % 25), _id("part", "p_partkey"), _id("nation", "to"), "uses"),
            _edge(made, _id("part", "p_partkey"), _id("supplier", "to"), "returns"),
        ]
    )
    return Graph(nodes, edges)


def _sql_list(values: tuple[str, ...]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


CODE_SQL = f"""
p6_step AS (
  SELECT l_partkey, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_returnflag, l_discount) AS next FROM lineitem),
nodes AS (
  SELECT 'part:' || p_partkey AS id, 'function' AS type, ({_sql_list(_LABELS)})[p_partkey % 8 + 1] AS label, ({_sql_list(_PACKAGES)})[p_size % 4 + 1] AS package,
    p_brand AS source_file, ({_sql_list(_SIGNATURES)})[p_partkey % 8 + 1] AS signature, '' AS doc, 3 AS n_attrs FROM part
  UNION ALL SELECT 'supplier:' || s_suppkey, 'struct', ({_sql_list(_STRUCTS)})[s_suppkey % 4 + 1], ({_sql_list(_PACKAGES)})[s_nationkey % 4 + 1], '', '', '', 1 FROM supplier
  UNION ALL SELECT 'nation:' || n_nationkey, 'variable', ({_sql_list(_VARIABLES)})[n_nationkey % 5 + 1], 'util', '', '', '', 1 FROM nation),
edges AS (
  SELECT DISTINCT 'supplier:' || l_suppkey AS src, 'part:' || l_partkey AS dst, 'has_method' AS type, 'EXTRACTED' AS confidence, 0.0::DOUBLE AS score FROM lineitem WHERE l_partkey % 8 < 4
  UNION ALL SELECT DISTINCT 'part:' || l_partkey, 'part:' || next, 'calls', 'EXTRACTED', 0.0 FROM p6_step WHERE next % 8 NOT IN (3, 7)
  UNION ALL SELECT 'part:' || p_partkey, 'nation:' || (p_partkey % 25), 'uses', 'EXTRACTED', 0.0 FROM part
  UNION ALL SELECT 'part:' || p_partkey, 'supplier:' || (p_partkey % (SELECT count(*) FROM supplier)), 'returns', 'EXTRACTED', 0.0 FROM part WHERE p_partkey % 8 = 0)
"""
