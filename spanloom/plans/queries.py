"""Queries over diagrams and arrays derived from the tables, and the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import arrays
from ..functions.finite import FiniteFunction, Labels
from ..functions.ragged import Ragged
from ..functions.lineage import cut, indexed, stored
from ..operators import components, functor, traverse
from ..operators.diagram import Diagram
from ..sources import io
from . import fixtures
from .fixtures import LINE_ORDER, table
from .rewrite import Optic
from .term import Term

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


LINES = f"SELECT *, row_number() OVER (ORDER BY {', '.join(LINE_ORDER)}) - 1 AS line FROM lineitem"
#: The wires of ``trade``: (edge, side, pos, node).
TRADE = f"""
WITH li AS ({LINES}),
nodes AS (SELECT r_regionkey * 10::BIGINT + 0 AS node, 'r' AS label FROM region UNION ALL SELECT n_nationkey * 10::BIGINT + 1, 'n' FROM nation UNION ALL SELECT c_custkey * 10 + 2, 'c' FROM customer
  UNION ALL SELECT s_suppkey * 10 + 3, 's' FROM supplier UNION ALL SELECT p_partkey * 10 + 4, 'p' FROM part UNION ALL SELECT o_orderkey * 10 + 5, 'o' FROM orders UNION ALL SELECT line * 10 + 6, 'l' FROM li),
edges AS (SELECT node AS edge, label FROM nodes WHERE label NOT IN ('r', 'p')),
inc AS (SELECT edge, 't' AS side, 0 AS pos, edge AS node FROM edges
  UNION ALL SELECT n_nationkey * 10 + 1, 's', 0, n_regionkey * 10 FROM nation UNION ALL SELECT c_custkey * 10 + 2, 's', 0, c_nationkey * 10 + 1 FROM customer
  UNION ALL SELECT s_suppkey * 10 + 3, 's', 0, s_nationkey * 10 + 1 FROM supplier UNION ALL SELECT o_orderkey * 10 + 5, 's', 0, o_custkey * 10 + 2 FROM orders
  UNION ALL SELECT line * 10 + 6, 's', 0, l_orderkey * 10 + 5 FROM li UNION ALL SELECT line * 10 + 6, 's', 1, l_partkey * 10 + 4 FROM li UNION ALL SELECT line * 10 + 6, 's', 2, l_suppkey * 10 + 3 FROM li)
"""


def parts_of_orders(spark: SparkSession, sf_dir: str) -> Ragged:
    """For every order, by key, the parts of its lines; ``seg`` and values count from 0."""
    o = indexed(table(spark, sf_dir, "orders").select("o_orderkey"), ["o_orderkey"], "seg")
    n = table(spark, sf_dir, "part").agg(F.max("p_partkey")).first()[0] + 1
    x = fixtures.lines(spark, sf_dir).join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    from pyspark.sql import Window as W

    x = x.withColumn("pos", (F.row_number().over(W.partitionBy("seg").orderBy("line")) - 1).cast("long"))
    return Ragged(x.select("seg", "pos", F.col("l_partkey").alias("v")), o.count(), n)


PARTS = f"""
WITH li AS ({LINES}), o AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS seg FROM orders),
x AS (SELECT seg, row_number() OVER (PARTITION BY seg ORDER BY line) - 1 AS pos, l_partkey AS v FROM li JOIN o ON l_orderkey = o_orderkey)
"""


def sizes_of_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(i, v): lines of each order, by key."""
    o = indexed(table(spark, sf_dir, "orders").select("o_orderkey"), ["o_orderkey"])
    n = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"))
    return cut(o.join(n, F.col("o_orderkey") == F.col("l_orderkey"), "left").select("i", F.coalesce("n", F.lit(0)).alias("v")))


SIZES = "WITH s AS (SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS i, (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey) AS v FROM orders)\n"


def event_array(spark: SparkSession, sf_dir: str, value: str) -> DataFrame:
    e = indexed(table(spark, sf_dir, "events"), ["event_id"])
    return e.select("i", F.expr(value).cast("long").alias("v"))


EVENTS = "WITH e AS (SELECT *, row_number() OVER (ORDER BY event_id) - 1 AS i, CAST(round(value * 100) AS BIGINT) AS cents FROM events)\n"
CENTS = "round(value * 100)"


# Layers and adjacency


@query(TRADE + "SELECT edge, CAST(CASE label WHEN 'n' THEN 0 WHEN 'o' THEN 2 WHEN 'l' THEN 3 ELSE 1 END AS BIGINT) AS layer, FALSE AS stuck FROM edges")
def layer_trade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traverse.layers(fixtures.trade(spark, sf_dir)).drop("gid")


@query(TRADE + "SELECT layer, count(*) AS n FROM (SELECT CAST(CASE label WHEN 'n' THEN 0 WHEN 'o' THEN 2 WHEN 'l' THEN 3 ELSE 1 END AS BIGINT) AS layer FROM edges) GROUP BY 1")
def layer_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traverse.layers(fixtures.trade(spark, sf_dir)).groupBy("layer").agg(F.count("*").alias("n"))


@query("SELECT user_id AS gid, row_number() OVER w - 1 AS edge, row_number() OVER w - 1 AS layer, FALSE AS stuck FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def layer_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traverse.layers_of_small(fixtures.chain(spark, sf_dir))


@query(TRADE + "SELECT node AS v, CAST(CASE label WHEN 'n' THEN 1 WHEN 'c' THEN 2 WHEN 's' THEN 2 WHEN 'o' THEN 3 WHEN 'l' THEN 4 ELSE 0 END AS BIGINT) AS layer, FALSE AS stuck FROM nodes")
def kahn_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = fixtures.trade(spark, sf_dir)
    return traverse.kahn(d.nodes.select("gid", F.col("node").alias("v")), traverse.node_adjacency(d)).drop("gid")


@query(TRADE + "SELECT a.edge AS src, b.edge AS dst, count(*) AS n FROM inc a JOIN inc b ON a.node = b.node AND a.side = 't' AND b.side = 's' GROUP BY 1, 2")
def op_adjacency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traverse.op_adjacency(fixtures.trade(spark, sf_dir)).groupBy("src", "dst").agg(F.count("*").alias("n"))


@query(TRADE + "SELECT a.node AS src, b.node AS dst, count(*) AS n FROM inc a JOIN inc b ON a.edge = b.edge AND a.side = 's' AND b.side = 't' GROUP BY 1, 2")
def node_adjacency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traverse.node_adjacency(fixtures.trade(spark, sf_dir)).groupBy("src", "dst").agg(F.count("*").alias("n"))


for _side, _name in (("t", "in_degree"), ("s", "out_degree")):

    def _degree(spark: SparkSession, sf_dir: str, side: str = _side) -> DataFrame:
        return fixtures.trade(spark, sf_dir).degrees(side).drop("gid")

    _degree.__name__ = _name
    query(TRADE + f"SELECT node, count(edge) AS degree FROM nodes LEFT JOIN (SELECT * FROM inc WHERE side = '{_side}') USING (node) GROUP BY 1")(_degree)


@query(TRADE + ", d AS (SELECT node, count(*) FILTER (side = 't') AS m, count(*) FILTER (side = 's') AS u FROM nodes LEFT JOIN inc USING (node) GROUP BY 1) SELECT node, m = 1 AND u = 1 AS monogamous FROM d")
def monogamous_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.trade(spark, sf_dir).monogamous_nodes().drop("gid")


@query("SELECT DISTINCT user_id AS gid, TRUE AS monogamous FROM events")
def monogamous_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.chain(spark, sf_dir).is_monogamous()


@query(TRADE + "SELECT edge, label, list_aggregate(list(l ORDER BY pos) FILTER (side = 's'), 'string_agg', ',') AS src, list_aggregate(list(l ORDER BY pos) FILTER (side = 't'), 'string_agg', ',') AS tgt FROM edges JOIN (SELECT inc.*, nodes.label AS l FROM inc JOIN nodes USING (node)) USING (edge) GROUP BY 1, 2")
def operation_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.trade(spark, sf_dir).operations().select("edge", "label", F.array_join("src_types", ",").alias("src"), F.array_join("tgt_types", ",").alias("tgt"))


# Arrays


@query(SIZES + "SELECT l_partkey AS i, count(*) AS v FROM lineitem GROUP BY 1 UNION ALL SELECT range, 0 FROM range((SELECT max(l_partkey) + 10 FROM lineitem)) WHERE range NOT IN (SELECT l_partkey FROM lineitem)")
def bincount_dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = fixtures.lines(spark, sf_dir).select(F.col("line").alias("i"), F.col("l_partkey").alias("v"))
    return arrays.bincount(a, arrays.maximum(a) + 10)


@query("SELECT l_partkey AS v, count(*) AS n, row_number() OVER (ORDER BY l_partkey) - 1 AS i FROM lineitem GROUP BY 1")
def sparse_bincount(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = fixtures.lines(spark, sf_dir).select(F.col("line").alias("i"), F.col("l_partkey").alias("v"))
    keys, counts = arrays.sparse_bincount(a)
    return keys.join(counts.withColumnRenamed("v", "n"), "i")


@query(SIZES + ", x AS (SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS i, (SELECT coalesce(sum(CAST(round(l_extendedprice * 100) AS BIGINT)), 0) FROM lineitem WHERE l_orderkey = o_orderkey) AS v FROM orders) SELECT i, CAST(v AS BIGINT) AS v FROM x")
def segmented_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = [*LINE_ORDER, "l_extendedprice"]
    known = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey", "left_semi")
    x = indexed(known.select(*order), order).select("i", F.round(F.col("l_extendedprice") * 100).cast("long").alias("v"))
    return arrays.segmented_sum(sizes_of_orders(spark, sf_dir), x)


@query(SIZES + ", x AS (SELECT i, unnest(range(v)) AS v FROM s) SELECT row_number() OVER (ORDER BY i, v) - 1 AS i, v FROM x")
def segmented_arange(spark: SparkSession, sf_dir: str) -> DataFrame:
    return arrays.segmented_arange(sizes_of_orders(spark, sf_dir))


@query(SIZES + ", x AS (SELECT i, unnest(range(v)) AS k FROM s) SELECT row_number() OVER (ORDER BY i, k) - 1 AS i, i * 7 % 11 AS v FROM x")
def repeat(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = sizes_of_orders(spark, sf_dir)
    return arrays.repeat(k, k.select("i", (F.col("i") * 7 % 11).alias("v")))


@query(SIZES + "SELECT i, CAST(coalesce(sum(v) OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS v FROM s UNION ALL SELECT count(*), CAST(sum(v) AS BIGINT) FROM s")
def cumulative_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return arrays.cumulative_sum(sizes_of_orders(spark, sf_dir))


@query(SIZES + "SELECT row_number() OVER (ORDER BY v, i) - 1 AS i, i AS v FROM s")
def argsort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return arrays.argsort(sizes_of_orders(spark, sf_dir))


@query(EVENTS + "SELECT row_number() OVER (ORDER BY user_id, i) - 1 AS i, cents AS v FROM e")
def sort_by(spark: SparkSession, sf_dir: str) -> DataFrame:
    return arrays.sort_by(event_array(spark, sf_dir, CENTS), event_array(spark, sf_dir, "user_id"))


@query(EVENTS + "SELECT a.i, b.cents AS v FROM e a JOIN e b ON b.i = (a.i * 7 + 3) % (SELECT count(*) FROM e)")
def gather(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = cut(event_array(spark, sf_dir, CENTS))
    return arrays.gather(a, spread(spark, a.count(), 7, 3).table)


LAST = ", w AS (SELECT user_id AS k, arg_max(cents, i) AS v FROM e GROUP BY 1)"


@query(EVENTS + LAST + "SELECT range AS i, coalesce(w.v, (SELECT cents FROM e WHERE i = 0)) AS v FROM range((SELECT max(user_id) + 5 FROM e)) LEFT JOIN w ON k = range")
def scatter_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    idx = event_array(spark, sf_dir, "user_id")
    return arrays.scatter(event_array(spark, sf_dir, CENTS), idx, arrays.maximum(idx) + 5)


@query(EVENTS + LAST + "SELECT e.i, coalesce(w.v, e.cents) AS v FROM e LEFT JOIN w ON w.k = e.i")
def scatter_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = cut(event_array(spark, sf_dir, CENTS))
    return arrays.scatter_assign(x, event_array(spark, sf_dir, "user_id"), x)


@query(EVENTS + ", w AS (SELECT user_id AS k, sum(cents) AS s FROM e GROUP BY 1) SELECT e.i, CAST(e.cents - coalesce(w.s, 0) AS BIGINT) AS v FROM e LEFT JOIN w ON w.k = e.i")
def scatter_sub_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = cut(event_array(spark, sf_dir, CENTS))
    return arrays.scatter_sub_assign(x, event_array(spark, sf_dir, "user_id"), x)


@query(EVENTS + "SELECT row_number() OVER (ORDER BY i) - 1 AS i, i AS v FROM e WHERE cents % 7 = 0")
def zero(spark: SparkSession, sf_dir: str) -> DataFrame:
    return arrays.zero(event_array(spark, sf_dir, f"{CENTS} % 7"))


@query(EVENTS + "SELECT i, cents // 9 AS q, cents % 9 AS r FROM e")
def quot_rem(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, r = arrays.quot_rem(event_array(spark, sf_dir, CENTS), 9)
    return q.withColumnRenamed("v", "q").join(r.withColumnRenamed("v", "r"), "i")


@query("SELECT range AS i, (range % 3) * (SELECT count(*) FROM customer) + range // 3 AS v FROM range((SELECT 3 * count(*) FROM customer))")
def transpose(spark: SparkSession, sf_dir: str) -> DataFrame:
    return FiniteFunction.transpose(spark, 3, table(spark, sf_dir, "customer").count()).table


def spread(spark: SparkSession, n: int, factor: int = 7, shift: int = 0) -> FiniteFunction:
    """i to (i * factor + shift) % n on all of 0 to n - 1: a permutation, unless ``factor`` divides n."""
    return FiniteFunction(spark.range(n).select(F.col("id").alias("i"), ((F.col("id") * factor + shift) % n).alias("v")), n, n)


@query(SIZES + ", f AS (SELECT i, CAST(coalesce(sum(v) OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS a, v AS n FROM s), x AS (SELECT y.i, f.a, unnest(range(f.n)) AS p FROM (SELECT i, (i * 5 + 1) % (SELECT count(*) FROM s) AS k FROM s) y JOIN f ON f.i = y.k) SELECT row_number() OVER (ORDER BY i, p) - 1 AS i, a + p AS v FROM x")
def injections(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = sizes_of_orders(spark, sf_dir)
    sizes = FiniteFunction(s, s.count(), 0)
    return sizes.injections(spread(spark, sizes.source, 5, 1)).table


# Ragged relations


@query(PARTS + "SELECT v AS seg, row_number() OVER (PARTITION BY v ORDER BY seg, pos) - 1 AS pos, seg AS v FROM x")
def converse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parts_of_orders(spark, sf_dir).converse().table


@query(PARTS + ", c AS (SELECT v AS seg, row_number() OVER (PARTITION BY v ORDER BY seg, pos) - 1 AS pos, seg AS v FROM x), y AS (SELECT x.seg, x.pos AS p, c.pos AS q, c.v FROM x JOIN c ON x.v = c.seg) SELECT seg, row_number() OVER (PARTITION BY seg ORDER BY p, q) - 1 AS pos, v FROM y")
def flatmap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders that share a part, for every order."""
    r = parts_of_orders(spark, sf_dir)
    r = Ragged(stored(r.table, "parts"), r.n, r.target)
    return r.flatmap(r.converse()).table


@query(PARTS + "SELECT i AS seg, pos, v FROM x JOIN (SELECT seg AS i, seg * 7 % (SELECT count(*) FROM o) AS k FROM o) y ON x.seg = y.k")
def map_indexes(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = parts_of_orders(spark, sf_dir)
    return r.map_indexes(spread(spark, r.n)).table


@query(PARTS + ", k AS (SELECT o_custkey AS seg, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS p, row_number() OVER (ORDER BY o_custkey, o_orderkey) - 1 AS g FROM orders), y AS (SELECT k.seg, k.p, x.pos AS q, x.v FROM k JOIN x ON x.seg = k.g) SELECT seg, row_number() OVER (PARTITION BY seg ORDER BY p, q) - 1 AS pos, v FROM y")
def flatmap_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As many orders as each customer has, one after another, run together."""
    from pyspark.sql import Window as W

    o = table(spark, sf_dir, "orders")
    n = table(spark, sf_dir, "customer").agg(F.max("c_custkey")).first()[0] + 1
    outer = Ragged(o.select(F.col("o_custkey").alias("seg"), (F.row_number().over(W.partitionBy("o_custkey").orderBy("o_orderkey")) - 1).cast("long").alias("pos"), F.col("o_orderkey").alias("v")), n)
    return outer.flatmap_sources(parts_of_orders(spark, sf_dir)).table


@query(PARTS + "SELECT seg, pos, p_name AS v FROM x JOIN part ON p_partkey = v")
def map_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = parts_of_orders(spark, sf_dir)
    return r.map_labels(Labels(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("i"), F.col("p_name").alias("v")), r.target)).table


@query(PARTS + "SELECT v, count(*) AS n FROM x GROUP BY 1")
def relative_indegree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each part is in an order, all orders taken, in another order."""
    r = parts_of_orders(spark, sf_dir)
    keys, counts = r.sparse_relative_indegree(spread(spark, r.n))
    return keys.join(counts.withColumnRenamed("v", "n"), "i").select("v", "n")


# Components and quotients

BLOCKS = "WITH e AS (SELECT *, row_number() OVER (ORDER BY event_id) - 1 AS node FROM events), b AS (SELECT node, user_id, min(node) OVER (PARTITION BY user_id, CAST(ts AS DATE)) AS first FROM e)\n"


@query(BLOCKS + "SELECT node, dense_rank() OVER (ORDER BY first) - 1 AS component FROM b")
def coequalizer_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.blocks(spark, sf_dir).coequalizer().drop("gid")


@query(BLOCKS + "SELECT DISTINCT dense_rank() OVER (ORDER BY first) - 1 AS node, user_id AS label FROM b")
def quotient_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.blocks(spark, sf_dir).quotiented()[0].nodes.drop("gid")


PLACE = 10**15


@query(f"""WITH p AS (SELECT c_custkey::BIGINT AS id, n_regionkey AS r FROM customer JOIN nation ON n_nationkey = c_nationkey UNION ALL SELECT n_nationkey + {PLACE}, n_regionkey FROM nation
UNION ALL SELECT DISTINCT n_regionkey + {2 * PLACE}, n_regionkey FROM nation) SELECT CAST(id AS BIGINT) AS id, CAST(min(id) OVER (PARTITION BY r) AS BIGINT) AS root FROM p""")
def components_of_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers, nations and regions, joined as they belong together; ids of kinds stay apart at any number of customers."""
    a = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("long").alias("a"), (F.col("c_nationkey").cast("long") + PLACE).alias("b"))
    b = table(spark, sf_dir, "nation").select((F.col("n_nationkey").cast("long") + PLACE).alias("a"), (F.col("n_regionkey").cast("long") + 2 * PLACE).alias("b"))
    return components.least_members(a.unionByName(b))


# Combination: chains of users, diagram by diagram

PATHS = "WITH e AS (SELECT user_id AS gid, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS edge, event_type AS label FROM events), n AS (SELECT gid, count(*) AS n FROM e GROUP BY 1)\n"


@query(PATHS + "SELECT gid, edge, label, edge AS src, edge + 1 AS tgt FROM e UNION ALL SELECT gid, edge + n, label, edge + n + 1, edge + n + 2 FROM e JOIN n USING (gid)")
def tensor_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = fixtures.chain(spark, sf_dir)
    return (d | d).nested().select("gid", "edge", "label", F.col("sources")[0].alias("src"), F.col("targets")[0].alias("tgt"))


@query(PATHS + "SELECT gid, edge, label, edge AS src, edge + 1 AS tgt FROM e UNION ALL SELECT gid, edge + n, label, edge + n, edge + n + 1 FROM e JOIN n USING (gid)")
def compose_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = fixtures.chain(spark, sf_dir)
    return (d >> d).strict().nested().select("gid", "edge", "label", F.col("sources")[0].alias("src"), F.col("targets")[0].alias("tgt"))


@query(PATHS + "SELECT gid, side, CAST(0 AS BIGINT) AS pos, CASE side WHEN 't' THEN 0 ELSE n END AS node FROM n, (VALUES ('s'), ('t')) v(side)")
def dagger_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.chain(spark, sf_dir).dagger().interface


@query(PATHS + "SELECT gid, 's' AS side, range AS pos, CASE WHEN range <= n THEN range + n + 1 ELSE range - n - 1 END AS node FROM n, range(2 * n + 2) UNION ALL SELECT gid, 't', range, range FROM n, range(2 * n + 2)")
def twist_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = fixtures.chain(spark, sf_dir).nodes
    return Diagram.twist(nodes, nodes).interface


@query("SELECT o_custkey AS gid, CAST(0 AS BIGINT) AS node, 'w' AS label, count(*) AS uses FROM orders GROUP BY 1")
def forget_vars(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = functor.forget(fixtures.star(spark, sf_dir), F.col("label") == "Copy")
    return d.nodes.join(d.degrees("s"), ["gid", "node"]).select("gid", "node", "label", F.col("degree").alias("uses"))


# Deletion and convexity


@query(PATHS + "SELECT gid, row_number() OVER (PARTITION BY gid ORDER BY edge) - 1 AS edge, label, edge AS src FROM e WHERE edge % 3 <> 1")
def delete_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = fixtures.chain(spark, sf_dir)
    return d.delete_edges(d.edges.where("edge % 3 = 1").select("gid", "edge")).nested().select("gid", "edge", "label", F.col("sources")[0].alias("src"))


@query(PATHS + "SELECT gid, edge, 's' AS side, CAST(0 AS BIGINT) AS pos, edge - edge // 4 AS node FROM e WHERE edge % 4 <> 3 UNION ALL SELECT gid, edge, 't', CAST(0 AS BIGINT), edge + 1 - (edge + 1) // 4 FROM e WHERE (edge + 1) % 4 <> 3")
def delete_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = fixtures.chain(spark, sf_dir)
    return d.delete_nodes(d.nodes.where("node % 4 = 3").select("gid", "node")).incidence


@query(PATHS + "SELECT gid, n < 61 AS convex FROM n")
def convex_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each chain the first sixty operations and the last, with their nodes: a convex part if there is no other between."""
    d = fixtures.chain(spark, sf_dir)
    last = d.edges.groupBy("gid").agg(F.max("edge").alias("last"))
    x = d.edges.join(last, "gid").where("edge < 59 OR edge = last").select("gid", "edge", F.col("edge").alias("to"))
    w = d.incidence.join(x, ["gid", "edge"]).select("gid", "node", F.col("node").alias("to")).distinct()
    return traverse.is_convex(d, w, x)


# Evaluation


@query(PATHS.replace("event_type AS label", "CAST(round(value * 100) AS BIGINT) AS cents") + "SELECT gid, CAST(0 AS BIGINT) AS pos, CAST(sum(cents) AS BIGINT) AS value FROM e GROUP BY 1")
def eval_chain_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event adds its cents to what runs along the chain."""
    from pyspark.sql import Window as W

    e = table(spark, sf_dir, "events")
    cents = e.select(F.col("user_id").alias("gid"), (F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")) - 1).cast("long").alias("edge"), F.round(F.col("value") * 100).cast("long").alias("label"))
    d = fixtures.chain(spark, sf_dir)
    d = Diagram(d.nodes, cents, d.incidence, d.interface, d.quotient)
    start = d.sizes().select("gid", F.lit(0).cast("long").alias("pos"), F.lit(0).cast("long").alias("value"))
    return traverse.evaluate_small(d, start, lambda label, args: [args[0] + label], 0, "long")


def polynomial(label: Column, args: Column) -> Column:
    """Add, Mul, Copy, Zero, One and Discard over whole numbers."""
    none = F.array().cast("array<bigint>")
    return F.when(label == "Add", F.array(args[0] + args[1])).when(label == "Mul", F.array(args[0] * args[1])).when(label == "Copy", F.array(args[0], args[0])).when(label == "Zero", F.array(F.lit(0).cast("long"))).when(label == "One", F.array(F.lit(1).cast("long"))).otherwise(none)


def square_plus_one() -> Term:
    n = "n"
    copy, mul, add, one = Term.singleton("Copy", [n], [n, n]), Term.singleton("Mul", [n, n], [n]), Term.singleton("Add", [n, n], [n]), Term.singleton("One", [], [n])
    return (((copy >> mul) | one) >> add).strict()


def many(term: Term, gids: DataFrame) -> Diagram:
    """A copy of a small term for each ``gid``."""
    d = Diagram.from_terms(gids.sparkSession, {0: term})

    def spread(df: DataFrame) -> DataFrame:
        rest = [f for f in df.schema if f.name != "gid"]
        rows = [F.struct(*[F.lit(r[f.name]).cast(f.dataType).alias(f.name) for f in rest]) for r in df.collect()]
        if not rows:
            return df.limit(0)
        return gids.select("gid", F.explode(F.array(*rows)).alias("r")).select("gid", "r.*")

    return Diagram(*[spread(t) for t in (d.nodes, d.edges, d.incidence, d.interface, d.quotient)])


@query("SELECT c_custkey AS gid, CAST(0 AS BIGINT) AS pos, c_nationkey::BIGINT * c_nationkey + 1 AS value FROM customer")
def eval_polynomial(spark: SparkSession, sf_dir: str) -> DataFrame:
    """x * x + 1 for each customer, in a diagram of its own."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("long").alias("gid"), F.lit(0).cast("long").alias("pos"), F.col("c_nationkey").cast("long").alias("value"))
    return traverse.evaluate(many(square_plus_one(), c.select("gid")), c, polynomial, F.lit(0))


# Rewriting


def expand_click(label: str, source: list, target: list) -> Term:
    """A click is two steps, all else stays."""
    if label != "click":
        return Term.singleton(label, source, target)
    return Term.singleton("down", source, ["w"]) >> Term.singleton("up", ["w"], target)


CLICKS = PATHS + ", x AS (SELECT *, edge + coalesce(sum(CAST(label = 'click' AS INT)) OVER (PARTITION BY gid ORDER BY edge ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS at FROM e)\n"


@query((CLICKS + "SELECT gid, CAST(at AS BIGINT) AS edge, CASE label WHEN 'click' THEN 'down' ELSE label END AS label FROM x UNION ALL SELECT gid, CAST(at + 1 AS BIGINT), 'up' FROM x WHERE label = 'click'").replace(" at", " place").replace("(at", "(place"))
def functor_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    return functor.map_arrow(fixtures.chain(spark, sf_dir), lambda label: F.array(label), expand_click).edges


@query(PATHS + "SELECT gid, range // 2 AS node, CAST(range % 2 AS INT) AS k, range AS out FROM n, range(2 * n + 2)")
def functor_witness(spark: SparkSession, sf_dir: str) -> DataFrame:
    double = lambda label, s, t: Term.singleton(label, s * 2, t * 2)
    return functor.map_diagram(fixtures.chain(spark, sf_dir), lambda label: F.array(label, label), double)[1]


REVERSE = Optic(lambda x: [x], lambda x: [f"d{x}"], lambda f, s, t: Term.singleton(f, s, t), lambda f, s, t: Term.singleton(f"R{f}", [f"d{x}" for x in t], [f"d{x}" for x in s]), lambda f, s, t: [])


@query(PATHS + "SELECT gid, 's' AS side, v.pos, CASE v.pos WHEN 0 THEN 'w' ELSE 'dw' END AS label FROM n, (VALUES (0::BIGINT), (1::BIGINT)) v(pos) UNION ALL SELECT gid, 't', v.pos, CASE v.pos WHEN 0 THEN 'w' ELSE 'dw' END FROM n, (VALUES (0::BIGINT), (1::BIGINT)) v(pos)")
def optic_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chains with a wire back beside each wire, adapted: both ends have what goes in first."""
    d = fixtures.chain(spark, sf_dir)
    fwd, rev = lambda x: F.array(x), lambda x: F.array(F.concat(F.lit("d"), x))
    image = functor.map_arrow(d, lambda x: F.concat(fwd(x), rev(x)), REVERSE.map_operation)
    a = functor.adapt(image, d, fwd, rev)
    return a.interface.join(a.nodes, ["gid", "node"]).select("gid", "side", "pos", "label")


# Sources and sinks


@query(PATHS + "SELECT gid, edge, label, edge AS src, edge + 1 AS tgt FROM e")
def json_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = io.from_json(io.to_json(fixtures.chain(spark, sf_dir)))
    return d.nested().select("gid", "edge", "label", F.col("sources")[0].alias("src"), F.col("targets")[0].alias("tgt"))
