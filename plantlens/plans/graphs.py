"""Queries of graph operators over whole tables. SQL gives the same by recursion."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plantlens.operators import graph
from plantlens.registry import Registry, table

REGISTRY = Registry()
query = REGISTRY.query

_EDGES = "e AS (SELECT DISTINCT l_partkey AS a, -1 - l_suppkey AS b FROM lineitem), w AS (SELECT a, b FROM e UNION SELECT b, a FROM e)"


def supply_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part to supplier (as a negative number) of all lines, an edge for each line."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("a"), (-1 - F.col("l_suppkey")).alias("b"))


def supply_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Its different edges."""
    return supply_lines(spark, sf_dir).distinct()


@query(f"""
    WITH RECURSIVE {_EDGES}, r(node, hops) USING KEY (node) AS (SELECT DISTINCT b, 0 FROM e WHERE b > -4
        UNION SELECT w.b, min(r.hops) + 1 FROM r JOIN w ON r.node = w.a WHERE NOT EXISTS (SELECT 1 FROM recurring.r AS x WHERE x.node = w.b) GROUP BY w.b)
    SELECT node, hops::INTEGER AS hops FROM r""")
def bfs_hops(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = supply_lines(spark, sf_dir)
    return graph.bfs_hops(edges, edges.where("b > -4").select(F.col("b").alias("node")))


@query(f"""
    WITH RECURSIVE {_EDGES}, r(node, label) USING KEY (node) AS (SELECT DISTINCT a, a FROM w
        UNION SELECT w.b, min(r.label) FROM r JOIN w ON r.node = w.a JOIN recurring.r AS x ON x.node = w.b WHERE r.label < x.label GROUP BY w.b)
    SELECT node, label AS component FROM r""")
def components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.components(supply_edges(spark, sf_dir))


def org_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Region to nation to customer to order, and a short cut from region to customer."""
    nation, customer, orders = (table(spark, sf_dir, t) for t in ("nation", "customer", "orders"))
    name = lambda kind, c: F.concat(F.lit(kind), F.col(c).cast("string"))
    edges = nation.select(name("r", "n_regionkey").alias("a"), name("n", "n_nationkey").alias("b"))
    edges = edges.union(customer.select(name("n", "c_nationkey"), name("c", "c_custkey")))
    edges = edges.union(customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(name("r", "n_regionkey"), name("c", "c_custkey")))
    return edges.union(orders.select(name("c", "o_custkey"), name("o", "o_orderkey")))


_ORG = """e AS (SELECT concat('r', n_regionkey) AS a, concat('n', n_nationkey) AS b FROM nation UNION ALL SELECT concat('n', c_nationkey), concat('c', c_custkey) FROM customer
    UNION ALL SELECT concat('r', n_regionkey), concat('c', c_custkey) FROM customer JOIN nation ON c_nationkey = n_nationkey UNION ALL SELECT concat('c', o_custkey), concat('o', o_orderkey) FROM orders)"""


@query(f"""
    WITH RECURSIVE {_ORG}, r AS (SELECT a AS node, 0 AS layer FROM e UNION SELECT e.b, r.layer + 1 FROM r JOIN e ON r.node = e.a)
    SELECT node, max(layer)::INTEGER AS layer FROM r GROUP BY node""")
def layering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.longest_path_layers(org_edges(spark, sf_dir))


@query(f"""
    WITH RECURSIVE {_ORG}, r AS (SELECT 'r2' AS node, 0 AS depth UNION SELECT e.b, r.depth + 1 FROM r JOIN e ON r.node = e.a)
    SELECT node, min(depth)::INTEGER AS depth FROM r GROUP BY node""")
def reachable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.reachable(org_edges(spark, sf_dir), spark.createDataFrame([("r2",)], "node string"))


@query("""
    WITH n AS (SELECT c_custkey AS node FROM customer), e AS (SELECT -1 - o_orderkey AS a, o_custkey AS b FROM orders)
    SELECT 'MISSING_TARGET' AS issue, b AS node FROM (SELECT DISTINCT b FROM e) WHERE NOT EXISTS (SELECT 1 FROM n WHERE node = b)
    UNION ALL SELECT 'ORPHAN', node FROM n WHERE NOT EXISTS (SELECT 1 FROM e WHERE a = node OR b = node)
    UNION ALL SELECT 'SHARED', b FROM e GROUP BY b HAVING count(DISTINCT a) > 1""")
def orphans_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All customers, and an edge from each order (as a negative number) to its customer."""
    nodes = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("node"))
    return graph.integrity(nodes, table(spark, sf_dir, "orders").select((-1 - F.col("o_orderkey")).alias("a"), F.col("o_custkey").alias("b")))


_CYCLES = """
    WITH RECURSIVE o AS (SELECT DISTINCT o_custkey AS a, o_orderkey AS b FROM orders), e AS (SELECT a, b FROM o WHERE a IN (SELECT b FROM o) AND b IN (SELECT a FROM o)),
    r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a), scc AS (SELECT x.a AS node, min(x.b) AS component FROM r x JOIN r y ON x.a = y.b AND x.b = y.a GROUP BY x.a),"""
_FEEDBACK = f"""{_CYCLES}
    p AS (SELECT o.a, o.b, s.component AS ca, t.component AS cb FROM o JOIN scc t ON t.node = o.b LEFT JOIN scc s ON s.node = o.a), entry AS (SELECT DISTINCT b AS node, cb AS component FROM p WHERE ca IS DISTINCT FROM cb),
    d(node, depth) USING KEY (node) AS (SELECT node, 0 FROM entry UNION ALL SELECT DISTINCT component, 0 FROM scc WHERE component NOT IN (SELECT component FROM entry)
        UNION SELECT p.b, min(d.depth) + 1 FROM d JOIN p ON d.node = p.a AND p.ca = p.cb WHERE NOT EXISTS (SELECT 1 FROM recurring.d AS x WHERE x.node = p.b) GROUP BY p.b),
    f AS (SELECT p.a, p.b FROM p JOIN d x ON x.node = p.a JOIN d y ON y.node = p.b WHERE p.ca = p.cb AND (y.depth, y.node) <= (x.depth, x.node))"""


def order_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An edge from customer to order for each order; the node ids are the keys themselves."""
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("a"), F.col("o_orderkey").alias("b"))


@query(f"{_CYCLES} q AS (SELECT 1) SELECT node FROM scc")
def cycle_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.cycle_nodes(order_edges(spark, sf_dir))


@query(f"{_CYCLES} q AS (SELECT 1) SELECT node, component FROM scc")
def strong_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.strong_components(order_edges(spark, sf_dir))


@query(f"{_FEEDBACK} SELECT a, b FROM f")
def feedback_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.feedback_edges(order_edges(spark, sf_dir))


@query(f"""{_FEEDBACK}, g AS (SELECT a, b FROM o WHERE (a, b) NOT IN (SELECT (a, b) FROM f)), l AS (SELECT a AS node, 0 AS layer FROM o UNION SELECT b, 0 FROM o UNION SELECT g.b, l.layer + 1 FROM l JOIN g ON l.node = g.a)
    SELECT node, max(layer)::INTEGER AS layer FROM l GROUP BY node""")
def layers_of_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.layers_with_feedback(order_edges(spark, sf_dir))[0]


@query("""
    WITH RECURSIVE p AS (SELECT o_orderkey AS node, max(o_custkey) AS parent FROM orders WHERE o_custkey <> o_orderkey GROUP BY 1), d AS (SELECT node, node AS root, 0 AS depth FROM p WHERE parent NOT IN (SELECT node FROM p)
        UNION ALL SELECT p.node, d.root, d.depth + 1 FROM d JOIN p ON p.parent = d.node)
    SELECT p.node, d.depth::BIGINT AS depth, d.root FROM p LEFT JOIN d ON p.node = d.node""")
def group_depths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders are groups, whose parent is the order of their customer's number."""
    return graph.depths(order_edges(spark, sf_dir).where("a <> b").groupBy(F.col("b").alias("node")).agg(F.max("a").alias("parent")))
