"""Queries that build, check, relabel, combine and rewrite diagrams over whole tables, and the same in SQL."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lineage
from ..functions.finite import Labels
from ..functions.lineage import by_key, cut, indexed
from ..functions.ragged import Ragged
from ..operators import functor, traverse
from ..operators.diagram import Diagram, Operations
from ..sources import io
from ..streaming import append
from . import fixtures
from .algebra import tagged
from .fixtures import table
from .queries import PATHS, REVERSE, TRADE, expand_click, many, query
from .rewrite import Functor, identity_functor, interleave_blocks, partial_dagger
from .term import Builder, Signature, Term, Var, build
from .term import forget as forget_term

PLACES = """WITH c AS (SELECT c_nationkey::BIGINT AS gid, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS k, c_mktsegment AS label FROM customer),
s AS (SELECT s_nationkey::BIGINT AS gid, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1 AS k, s_name AS label FROM supplier WHERE s_nationkey IN (SELECT c_nationkey FROM customer)),
n AS (SELECT c.gid, count(*) AS c, (SELECT count(*) FROM s WHERE s.gid = c.gid) AS s FROM c GROUP BY 1)
"""


def numbered(spark: SparkSession, sf_dir: str, name: str, nation: str, key: str, label: str) -> DataFrame:
    """(gid, k, seq, label): rows of a table by nation, in the order of their keys."""
    t = table(spark, sf_dir, name).select(F.col(nation).cast("long").alias("gid"), F.col(key).alias("seq"), F.col(label).alias("label"))
    return cut(indexed(t, ["seq"], "k", ("gid",)))


def wired(d: Diagram) -> DataFrame:
    """(gid, edge, label, sources, targets), lists as text."""
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c)
    return d.nested().select("gid", "edge", "label", text("sources"), text("targets"))


# Building


def grown(spark: SparkSession, sf_dir: str) -> Diagram:
    """For each nation its customers as nodes; then suppliers as nodes, an operation to each from the first customer, one of each customer on nodes of its own, and a further leg of each of the former."""
    c = numbered(spark, sf_dir, "customer", "c_nationkey", "c_custkey", "c_mktsegment")
    s = numbered(spark, sf_dir, "supplier", "s_nationkey", "s_suppkey", "s_name").join(c.select("gid").distinct(), "gid", "left_semi")
    d = Diagram.discrete(c.select("gid", F.col("k").alias("node"), "label"))
    d, places = d.new_nodes(s.select("gid", "seq", "label"))
    first = F.array(F.lit(0).cast("long"))
    d, served = d.new_edges(places.select("gid", "seq", F.lit("serve").alias("label"), first.alias("sources"), F.array("node").alias("targets")))
    d, _ = d.new_operations(c.select("gid", "seq", F.lit("buy").alias("label"), F.array(F.lit("money"), F.lit("wish")).alias("src_types"), F.array(F.lit("goods")).alias("tgt_types")))
    leg = lambda side: served.select("gid", "seq", "edge", F.lit(side).alias("side"), F.lit("bill").alias("label"))
    return d.new_legs(leg("t"))[0].new_legs(leg("s"))[0]


@query(
    PLACES + "SELECT gid, k AS edge, 'serve' AS label, '0,' || (c + s + 3 * c + s + k) AS sources, (c + k) || ',' || (c + s + 3 * c + k) AS targets FROM s JOIN n USING (gid)\n"
    "UNION ALL SELECT gid, s + k, 'buy', (c + s + 3 * k) || ',' || (c + s + 3 * k + 1), CAST(c + s + 3 * k + 2 AS VARCHAR) FROM c JOIN n USING (gid)"
)
def build_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wired(grown(spark, sf_dir))


@query(
    PLACES + "SELECT gid, k AS node, label FROM c UNION ALL SELECT gid, c + k, label FROM s JOIN n USING (gid) UNION ALL SELECT gid, c + s + 3 * k + j, ['money', 'wish', 'goods'][j + 1] FROM c JOIN n USING (gid), range(3) r(j)\n"
    "UNION ALL SELECT gid, c + s + 3 * c + j * s + k, 'bill' FROM s JOIN n USING (gid), range(2) r(j)"
)
def build_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grown(spark, sf_dir).nodes


ORDER_LINES = "WITH l AS (SELECT o_orderkey AS gid, o_orderstatus AS label, (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey) AS n FROM orders)\n"


def order_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(gid, label, src_types, tgt_types): for each order an operation from its lines to one thing."""
    n = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").cast("int").alias("n"))
    o = table(spark, sf_dir, "orders").join(n, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return o.select(F.col("o_orderkey").alias("gid"), F.col("o_orderstatus").alias("label"), F.array_repeat(F.lit("line"), F.coalesce("n", F.lit(0))).alias("src_types"), F.array("o_orderpriority").alias("tgt_types"))


@query(ORDER_LINES + "SELECT gid, 's' AS side, unnest(range(n)) AS pos, unnest(range(n)) AS node FROM l UNION ALL SELECT gid, 't', 0, n FROM l")
def singletons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both boundaries of a diagram of one operation for each order."""
    return Diagram.singletons(order_operations(spark, sf_dir)).interface


@query(ORDER_LINES + "SELECT gid, 's' AS side, unnest(range(n)) AS pos, 'line' AS label FROM l UNION ALL SELECT gid, 't', 0, o_orderpriority FROM l JOIN orders ON o_orderkey = gid")
def boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of both boundaries, and an operation's wires: a singleton's boundary is its wires."""
    d = Diagram.singletons(order_operations(spark, sf_dir))
    return d.boundary("s").withColumn("side", F.lit("s")).unionByName(d.boundary("t").withColumn("side", F.lit("t")))


BATCH = ORDER_LINES.rstrip("\n") + ", b AS (SELECT row_number() OVER (ORDER BY gid) - 1 AS edge, label, n, CAST(sum(n) OVER (ORDER BY gid) - n AS BIGINT) AS place, CAST(sum(n) OVER () AS BIGINT) AS total FROM l)\n"


def batch(spark: SparkSession, sf_dir: str) -> Operations:
    """The operations of orders as columns."""
    o = cut(indexed(order_operations(spark, sf_dir), ["gid"], "edge"))
    n = o.count()
    lists = lambda c: Ragged(o.select(F.col("edge").alias("seg"), F.posexplode(c).alias("pos", "v")), n)
    return Operations.new(Labels(o.select(F.col("edge").alias("i"), F.col("label").alias("v")), n), lists("src_types"), lists("tgt_types"))


@query(BATCH + "SELECT edge, 's' AS side, unnest(range(n)) AS pos, place + unnest(range(n)) AS node FROM b UNION ALL SELECT edge, 't', 0, total + edge FROM b")
def tensor_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All operations side by side: nodes of all sources first, then of all targets."""
    return batch(spark, sf_dir).tensor().incidence.drop("gid")


@query(BATCH + "SELECT label, n AS sources, count(*) AS n FROM b GROUP BY 1, 2 UNION ALL SELECT 'single', 2, 1 UNION ALL SELECT 'uneven', 0, 0")
def operation_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operations read one by one; a batch of one; and columns of different lengths, which are none."""
    b, found = batch(spark, sf_dir), {}
    for label, source, _ in b:
        found[label, len(source)] = found.get((label, len(source)), 0) + 1
    rows = [(x, k, n) for (x, k), n in found.items()]
    (alone,) = Operations.singleton(spark, "single", Labels.of(spark, ["a", "b"]), Labels.of(spark, ["c"]))
    uneven = Operations.new(Labels(b.labels.table, b.labels.n - 1), b.sources, b.targets)
    return spark.createDataFrame([*rows, (alone[0], len(alone[1]), len(alone[2])), ("uneven", 0, 0 if uneven is None else 1)], "label string, sources long, n long")


@query(
    PLACES + "SELECT 'identity' AS kind, gid, unnest(['s', 't']) AS side, k AS pos, k AS node FROM c UNION ALL SELECT 'spider', gid, 's', k, c - 1 - k FROM c JOIN n USING (gid) UNION ALL SELECT 'spider', gid, 't', 0, 0 FROM n\n"
    "UNION ALL SELECT 'half', gid, 's', k, c - 1 - k FROM c JOIN n USING (gid) UNION ALL SELECT 'half', gid, 't', k, k FROM c"
)
def wires_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers of each nation as wires, straight and turned round; legs that end nowhere make no diagram, and an empty diagram adds no rows."""
    c = numbered(spark, sf_dir, "customer", "c_nationkey", "c_custkey", "c_mktsegment")
    nodes = cut(c.select("gid", F.col("k").alias("node"), "label"))
    n = nodes.groupBy("gid").agg(F.count("*").alias("n"))
    turned = nodes.join(n, "gid").select("gid", F.lit("s").alias("side"), F.col("node").alias("pos"), (F.col("n") - 1 - F.col("node")).alias("node"))
    ends = n.select("gid", F.lit("t").alias("side"), F.lit(0).cast("long").alias("pos"), F.lit(0).cast("long").alias("node"))
    lost = Diagram.spider(nodes, turned.withColumn("node", F.col("node") + 1))
    parts = {"identity": Diagram.identity(nodes), "spider": Diagram.spider(nodes, turned.unionByName(ends)), "half": Diagram.half_spider(nodes, turned.drop("side")), "empty": Diagram.empty(spark)}
    if lost is not None:
        parts["lost"] = lost
    return tagged(spark, **{k: d.interface for k, d in parts.items()})


# Checks

LAST = PATHS.rstrip("\n") + ", z AS (SELECT e.gid, e.label AS last, n FROM e JOIN n ON e.gid = n.gid AND edge = n - 1)\n"


def last_events(d: Diagram) -> DataFrame:
    """(gid, last, n): the label of each chain's last operation, and how many there are."""
    return d.edges.groupBy("gid").agg(F.max_by("label", "edge").alias("last"), F.count("*").alias("n"))


@query(LAST + "SELECT gid, last <> 'click' AS acyclic FROM z")
def acyclic_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chains, of which those that end in a click lead back to their first node."""
    d = fixtures.chain(spark, sf_dir)
    last = last_events(d).where("last = 'click'")
    back = last.select("gid", F.col("n").alias("edge"), F.lit("back").alias("label"))
    legs = last.select("gid", F.col("n").alias("edge"), F.explode(F.array(F.struct(F.lit("s").alias("side"), F.col("n").alias("node")), F.struct(F.lit("t").alias("side"), F.lit(0).cast("long").alias("node")))).alias("w")).select("gid", "edge", "w.side", F.lit(0).cast("long").alias("pos"), "w.node")
    return traverse.is_acyclic(replace(d, edges=d.edges.unionByName(back), incidence=d.incidence.unionByName(legs)), small=True)


@query(LAST + "SELECT gid, CASE last WHEN 'click' THEN 'TargetsSet' WHEN 'view' THEN 'CospanSourceType' WHEN 'error' THEN 'SourcesCount' WHEN 'purchase' THEN 'CospanTargetType' ELSE 'SourcesSet' END AS problem FROM z")
def problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chains broken in ways that their last event decides, and what is found first."""
    d = fixtures.chain(spark, sf_dir)
    last = cut(last_events(d))
    at = lambda df: df.join(last, "gid")
    far = F.col("node") + 10**6
    inner = at(d.incidence).withColumn("node", F.when((F.col("last") == "click") & (F.col("side") == "t"), far).when(~F.col("last").isin("click", "view", "error", "purchase") & (F.col("side") == "s"), far).otherwise(F.col("node")))
    inner = inner.withColumn("edge", F.when(F.col("last") == "error", F.col("edge") + 1).otherwise(F.col("edge")))
    outer = at(d.interface).withColumn("node", F.when((F.col("last") == "view") & (F.col("side") == "s") | (F.col("last") == "purchase") & (F.col("side") == "t"), far).otherwise(F.col("node")))
    return replace(d, incidence=inner.select(d.incidence.columns), interface=outer.select(d.interface.columns)).problems()


@query("SELECT unnest(['chain strict', 'chain discrete', 'blocks strict', 'blocks discrete', 'valid']) AS kind, unnest([TRUE, FALSE, FALSE, TRUE, TRUE]) AS ok")
def diagram_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, b = fixtures.chain(spark, sf_dir), fixtures.blocks(spark, sf_dir)
    rows = [("chain strict", d.is_strict()), ("chain discrete", d.is_discrete()), ("blocks strict", b.is_strict()), ("blocks discrete", b.is_discrete()), ("valid", d.validate() is d)]
    return spark.createDataFrame(rows, "kind string, ok boolean")


@query(LAST + "SELECT gid, CASE last WHEN 'click' THEN 'TypeMismatchW' WHEN 'view' THEN 'NotNaturalW' WHEN 'error' THEN 'TypeMismatchX' WHEN 'purchase' THEN 'NotNaturalX' ELSE 'NotNaturalS' END AS problem FROM z")
def morphism_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Maps of chains onto themselves, spoiled in ways that their last event decides."""
    d = fixtures.chain(spark, sf_dir)
    last = cut(last_events(d))
    at = lambda df: df.join(last, "gid", "left")
    is_ = lambda *x: F.coalesce(F.col("last").isin(*x), F.lit(False))
    other = F.col("last").isNotNull() & ~is_("click", "view", "error", "purchase")
    w = at(d.nodes).select("gid", "node", F.when(is_("click") & (F.col("node") == 0), 10**6).when(other, F.col("n") - F.col("node")).otherwise(F.col("node")).alias("to"))
    x = at(d.edges).select("gid", "edge", F.when(is_("error") & (F.col("edge") == 0), 10**6).otherwise(F.col("edge")).alias("to"))
    onto = replace(d, nodes=at(d.nodes).withColumn("label", F.when(is_("view"), "v").otherwise(F.col("label"))).select("gid", "node", "label"), edges=at(d.edges).withColumn("label", F.when(is_("purchase"), "?").otherwise(F.col("label"))).select("gid", "edge", "label"))
    return traverse.morphism_problem(d, onto, w, x)


@query(LAST + "SELECT gid, last <> 'click' AS mono FROM z")
def monomorphisms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Maps of chains, of which those that end in a click send all nodes to the first."""
    d = fixtures.chain(spark, sf_dir)
    last = last_events(d)
    w = d.nodes.join(last, "gid").select("gid", "node", F.when(F.col("last") == "click", 0).otherwise(F.col("node")).alias("to"))
    return traverse.is_monomorphism(w, d.edges.select("gid", "edge", F.col("edge").alias("to")))


@query(TRADE + "SELECT node AS v FROM nodes WHERE label <> 'p'")
def reachable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All that regions lead to."""
    d = fixtures.trade(spark, sf_dir)
    regions = d.nodes.where("label = 'r'").select("gid", F.col("node").alias("v"))
    return traverse.reachable(cut(traverse.node_adjacency(d)), regions).drop("gid")


@query(TRADE + ", l AS (SELECT edge, CAST(CASE label WHEN 'n' THEN 0 WHEN 'o' THEN 2 WHEN 'l' THEN 3 ELSE 1 END AS BIGINT) AS layer FROM edges) SELECT layer, row_number() OVER (PARTITION BY layer ORDER BY edge) - 1 AS pos, edge FROM l")
def layered_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traverse.layered_operations(fixtures.trade(spark, sf_dir)).drop("gid")


# Relabelling and deletion


@query(
    PATHS + "SELECT 'map edges' AS kind, gid, edge AS id, upper(label) AS label FROM e UNION ALL SELECT 'map nodes', gid, unnest(range(n + 1)), 'w!' FROM n UNION ALL SELECT 'with edges', gid, edge, label || ' ' || edge FROM e\n"
    "UNION ALL SELECT 'with nodes', gid, unnest(range(n + 1)), CAST(n + 1 AS VARCHAR) FROM n"
)
def relabelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels one by one, and all labels at once, which fails if it loses any."""
    d = fixtures.chain(spark, sf_dir)
    count = lambda df: df.join(df.groupBy("gid").agg(F.count("*").cast("string").alias("c")), "gid").withColumn("label", F.col("c"))
    ids = lambda df: df.toDF("gid", "id", "label")
    parts = {
        "map edges": ids(d.map_edges(F.upper).edges), "map nodes": ids(d.map_nodes(lambda x: F.concat(x, F.lit("!"))).nodes),
        "with edges": ids(d.with_edges(lambda e: e.withColumn("label", F.concat_ws(" ", "label", F.col("edge").cast("string")))).edges), "with nodes": ids(d.with_nodes(count).nodes),
    }
    for name, lost in (("lost edges", d.with_edges(lambda e: e.where("edge > 0"))), ("lost nodes", d.with_nodes(lambda n: n.where("node > 0")))):
        if lost is not None:
            parts[name] = ids(lost.edges)
    return tagged(spark, **parts)


@query(PATHS + "SELECT gid, range AS node, CASE WHEN range % 4 = 3 THEN NULL ELSE range - (range + 1) // 4 END AS new FROM n, range(n + 1)")
def delete_witness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the nodes go when every fourth is deleted."""
    d = fixtures.chain(spark, sf_dir)
    return d.delete_nodes_witness(d.nodes.where("node % 4 = 3").select("gid", "node"))[1]


# Combination


@query(
    PATHS + "SELECT 'coproduct' AS kind, gid, side, CAST(0 AS BIGINT) AS pos, CASE side WHEN 's' THEN 0 ELSE n END AS node FROM n, (VALUES ('s'), ('t')) v(side) UNION ALL SELECT 'append', gid, side, 0, n + 1 + CASE side WHEN 's' THEN 0 ELSE n END FROM n, (VALUES ('s'), ('t')) v(side)\n"
    "UNION ALL SELECT 'nodes', gid, 's', range, range FROM n, range(2 * n + 2) UNION ALL SELECT 'in place', gid, 't', j, n + j * (n + 1) FROM n, range(2) r(j)"
)
def side_by_side(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chains beside themselves: boundaries of the sum, where the boundaries of what is appended are, its nodes, and the tensor in place."""
    d = fixtures.chain(spark, sf_dir)
    both, legs = d.append(d)
    nodes = both.nodes.select("gid", F.lit("s").alias("side"), F.col("node").alias("pos"), "node")
    grown_ = d
    grown_ |= d
    summed = d
    summed += d
    return tagged(spark, coproduct=summed.interface, append=legs, nodes=nodes).unionByName(grown_.interface.where("side = 't'").withColumn("kind", F.lit("in place")))


@query(PATHS + "SELECT 'first' AS kind, count(*) AS n FROM n UNION ALL SELECT 'lax', CAST(sum(n) AS BIGINT) FROM n UNION ALL SELECT 'strict', 0")
def uneven_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chains whose ends carry other labels than their beginnings: composed only if labels are left pending, where each has one conflict."""
    d = fixtures.chain(spark, sf_dir)
    end = last_events(d).select("gid", F.col("n").alias("node"), F.lit(True).alias("end"))
    odd = replace(d, nodes=d.nodes.join(end, ["gid", "node"], "left").select("gid", "node", F.when(F.col("end"), "x").otherwise(F.col("label")).alias("label")))
    lax = odd.lax_compose(d)
    labels = lax.quotient.join(lax.nodes.select("gid", F.col("node").alias("a"), F.col("label").alias("la")), ["gid", "a"]).join(lax.nodes.select("gid", F.col("node").alias("b"), F.col("label").alias("lb")), ["gid", "b"])
    rows = [("first", labels.where("la <> lb").count()), ("lax", lax.edges.count() // 2), ("strict", 0 if odd.compose(d) is None else 1)]
    return spark.createDataFrame(rows, "kind string, n long")


# Variables

X, Y = "x", "y"


def arithmetic() -> Signature:
    """All operators on one type."""
    binary = lambda op: lambda a, b: (op, a)
    return Signature("Copy", {s: binary(s) for s in ("+", "-", "*", "/", "&", "|", "^", "<<", ">>")} | {"neg": lambda a: ("neg", a), "~": lambda a: ("~", a)})


def formula(b: Builder) -> tuple[list[Var], list[Var]]:
    """From x and y to four values that use every operator, and a pair's quotient and remainder by an operation of two results."""
    x, y = b.var("n"), b.var("n")
    q, r = b.operation([x, y + (x ^ x)], ["n", "n"], "divmod")
    return [x, y], [(x + y) * (x - y), -((x & y) | (x ^ y)), ~x + (x << y), (x >> y) / y, q, r]


def calculator(label: str, args: list) -> list:
    """Whole numbers as in SQL: a quotient is cut off towards 0, a remainder has the sign of the dividend, and of nothing comes nothing."""
    if None in args:
        return [None] * (2 if label == "divmod" else 1)
    x, y = args[0], args[-1]
    if label in ("/", "divmod"):
        q = abs(x) // abs(y) * (1 if (x < 0) == (y < 0) else -1)
        return [q, x - q * y] if label == "divmod" else [q]
    return [SIMPLE[label](x, y)]


SIMPLE = {
    "+": lambda x, y: x + y, "-": lambda x, y: x - y, "*": lambda x, y: x * y, "&": lambda x, y: x & y, "|": lambda x, y: x | y, "^": lambda x, y: x ^ y,
    "<<": lambda x, y: x << y, ">>": lambda x, y: x >> y, "neg": lambda x, _: -x, "~": lambda x, _: ~x,
}


@query(
    "WITH c AS (SELECT c_custkey AS gid, c_nationkey::BIGINT AS x, (c_custkey % 5 + 1)::BIGINT AS y FROM customer)\n"
    "SELECT gid, unnest(range(6)) AS pos, unnest([(x + y) * (x - y), -((x & y) | xor(x, y)), (-x - 1) + (x << y), (x >> y) // y, x // y, x % y]) AS value FROM c"
)
def variables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A formula written with variables, its variables forgotten, evaluated for each customer in a diagram of its own."""
    term = forget_term(build(arithmetic(), formula), "Copy")
    y = F.pmod("c_custkey", F.lit(5)) + 1
    c = by_key(table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("long").alias("gid"), F.array(F.col("c_nationkey").cast("long"), y.cast("long")).alias("xy")), "gid")
    inputs = c.select("gid", F.posexplode("xy").alias("pos", "value")).withColumn("pos", F.col("pos").cast("long"))
    return traverse.evaluate_small(many(term, c.select("gid").distinct()), inputs, calculator, 0, "long")


@query("WITH n AS (SELECT o_custkey AS gid, count(*) AS n FROM orders GROUP BY 1) SELECT gid, n > 1 AS stays, CASE WHEN n > 1 THEN n + 1 ELSE 1 END AS nodes FROM n")
def forget_monogamous(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the variables of ``forget_vars`` only those that are used once go."""
    d = functor.forget(fixtures.star(spark, sf_dir), F.col("label") == "Copy", monogamous=True)
    stays = d.edges.groupBy("gid").agg((F.count_if(F.col("label") == "Copy") > 0).alias("stays"))
    return d.nodes.groupBy("gid").agg(F.count("*").alias("nodes")).join(stays, "gid")


# Rewriting


@query(PATHS + ", k AS (SELECT gid, edge, label, edge + coalesce(sum(CAST(label = 'click' AS INT)) OVER (PARTITION BY gid ORDER BY edge ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS place FROM e) SELECT gid, CAST(place AS BIGINT) AS edge, CASE label WHEN 'click' THEN 'down' ELSE label END AS label FROM k UNION ALL SELECT gid, CAST(place + 1 AS BIGINT), 'up' FROM k WHERE label = 'click'")
def functor_of_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As ``functor_expand``, by a functor whose rules are plain functions of labels, lifted to diagrams."""
    return functor.apply_functor(fixtures.chain(spark, sf_dir), Functor(lambda x: [x], expand_click)).edges


@query(PATHS + "SELECT gid, edge, label, CAST(edge AS VARCHAR) AS sources, CAST(edge + 1 AS VARCHAR) AS targets FROM e")
def functor_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wired(functor.apply_functor(fixtures.chain(spark, sf_dir), identity_functor()))


@query(
    PATHS + "SELECT gid, 2 * edge AS edge, label, CAST(2 * edge AS VARCHAR) AS sources, CAST(2 * edge + 2 AS VARCHAR) AS targets FROM e UNION ALL SELECT gid, 2 * edge + 1, 'R' || label, CAST(2 * edge + 3 AS VARCHAR), CAST(2 * edge + 1 AS VARCHAR) FROM e\n"
    "UNION ALL SELECT gid, -1, 'ends', '0,' || (2 * n + 1), (2 * n) || ',1' FROM n"
)
def optic_wiring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chains with a way back beside each way, inside and, adapted, at their ends."""
    d = fixtures.chain(spark, sf_dir)
    fwd, rev = lambda x: F.array(x), lambda x: F.array(F.concat(F.lit("d"), x))
    a = functor.adapt(functor.map_arrow(d, lambda x: F.concat(fwd(x), rev(x)), REVERSE.map_operation), d, fwd, rev)
    side = lambda s: F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("side") == s, F.struct("pos", "node")))), lambda x: x["node"].cast("string")), ",")
    ends = a.interface.groupBy("gid").agg(side("s").alias("sources"), side("t").alias("targets")).select("gid", F.lit(-1).cast("long").alias("edge"), F.lit("ends").alias("label"), "sources", "targets")
    return wired(a).unionByName(ends)


def regional(spark: SparkSession, sf_dir: str) -> dict[int, Term]:
    """A term for each region: its nations, one after another, as operations between regions."""
    out: dict[int, Term] = {}
    for r in table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).orderBy("n_regionkey", "n_nationkey").collect():
        step = Term.singleton(r["n_name"], [r["r_name"]], [r["r_name"]])
        out[r["r_regionkey"]] = out[r["r_regionkey"]] >> step if r["r_regionkey"] in out else step
    return {k: t.strict() for k, t in out.items()}


REGIONAL = "WITH x AS (SELECT n_regionkey::BIGINT AS gid, r_name AS r, n_name AS label, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS k, count(*) OVER (PARTITION BY n_regionkey) AS n FROM nation JOIN region ON r_regionkey = n_regionkey), g AS (SELECT DISTINCT gid, r, n FROM x)\n"


@query(REGIONAL + "SELECT 'pending' AS kind, gid, CAST(2 * (n + 1) + 4 * n AS BIGINT) AS nodes, CAST(4 * n AS BIGINT) AS pairs, n AS edges FROM g UNION ALL SELECT 'strict', gid, 2 * (n + 1), 0, n FROM g UNION ALL SELECT 'lax input', gid, 0, 0, 0 FROM g UNION ALL SELECT 'objects', gid, 2 * (n + 1), 0, 0 FROM g UNION ALL SELECT 'batch', gid, 4 * n, 0, n FROM g")
def functor_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms of regions with every wire doubled: the image with its identifications pending, strict, of a term that has some itself (none), of the labels, and of the operations side by side."""
    double = Functor(lambda x: [x, x], lambda label, s, t: Term.singleton(label, s * 2, t * 2))
    rows = []
    for gid, t in regional(spark, sf_dir).items():
        pending, strict = double.try_map_arrow(t), double.map_arrow(t)
        lax = t.copy()
        lax.unify(0, 1)
        batch_ = double.map_operations(list(t.operations()))
        rows += [("pending", gid, len(pending.nodes), len(pending.quotient_pairs), len(pending.edges)), ("strict", gid, len(strict.nodes), len(strict.quotient_pairs), len(strict.edges))]
        rows += [("lax input", gid, 0, 0, 0 if double.try_map_arrow(lax) is None else 1), ("objects", gid, sum(map(len, double.map_objects(t))), 0, 0), ("batch", gid, len(batch_.nodes), 0, len(batch_.edges))]
    return spark.createDataFrame(rows, "kind string, gid long, nodes long, pairs long, edges long")


@query(
    REGIONAL + "SELECT 'adapted' AS kind, gid, r || ',d' || r AS source, r || ',d' || r AS target FROM g UNION ALL SELECT 'arrow', gid, r || ',d' || r, r || ',d' || r FROM g\n"
    "UNION ALL SELECT 'blocks', gid, repeat(r || ',', CAST(n AS INT)) || repeat('d' || r || ',', CAST(n AS INT)), repeat(r || ',d' || r || ',', CAST(n AS INT)) FROM g UNION ALL SELECT 'bent', gid, r || ',' || r, '' FROM g"
)
def optic_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types at the ends of the optic's image of each region's term, adapted and as it is, of blocks taken in turns, and of a term with one end bent round."""
    rows = []
    for gid, t in regional(spark, sf_dir).items():
        a, m = REVERSE.map_adapted(t), REVERSE.map_arrow(t)
        each = [[x] for x in t.nodes[: len(t.edges)]]
        turns = interleave_blocks(each, [REVERSE.rev_object(x[0]) for x in each])
        bent = partial_dagger(t, 1, 0)
        text = lambda xs, end="": ",".join(xs) + end
        rows += [("adapted", gid, text(a.source()), text(a.target())), ("arrow", gid, text(m.source()), text(m.target()))]
        rows += [("blocks", gid, text(turns.source(), ","), text(turns.target(), ",")), ("bent", gid, text(bent.source()), text(bent.target()))]
    return spark.createDataFrame(rows, "kind string, gid long, source string, target string")


# Sources and sinks


@query(PATHS + "SELECT gid, edge, label, CAST(edge AS VARCHAR) AS sources, CAST(edge + 1 AS VARCHAR) AS targets FROM e")
def parquet_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = lineage.fresh(spark, "chains")
    io.write_parquet(fixtures.chain(spark, sf_dir), path)
    return wired(io.read_parquet(spark, path))


@query(
    PATHS + "SELECT gid, 'digraph {' || chr(10) || (SELECT string_agg('n' || range || ' [shape=point, xlabel=\"w\"];', chr(10) ORDER BY range) FROM range(n.n + 1)) || chr(10) || string_agg('e' || edge || ' [shape=box, label=\"' || label || '\"];', chr(10) ORDER BY edge) || chr(10)\n"
    "|| string_agg('n' || edge || ' -> e' || edge || ' [headlabel=\"0\"];', chr(10) ORDER BY edge) || chr(10) || string_agg('e' || edge || ' -> n' || (edge + 1) || ' [taillabel=\"0\"];', chr(10) ORDER BY edge) || chr(10) || '}' AS dot FROM e JOIN n USING (gid) GROUP BY gid, n.n"
)
def dot_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return io.to_dot(fixtures.chain(spark, sf_dir))


@query(
    "WITH o AS (SELECT o_custkey AS gid, o_orderkey, o_orderstatus AS label, CASE WHEN o_orderdate < TIMESTAMP '1998-01-01' THEN 0 ELSE 1 END AS epoch FROM orders)\n"
    "SELECT gid, row_number() OVER (PARTITION BY gid ORDER BY epoch, o_orderkey) - 1 AS edge, label FROM o"
)
def appended_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of each customer as operations that arrive in two batches, the second of which comes twice."""
    path = lineage.fresh(spark, "appended")
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("gid"), F.col("o_orderkey").alias("edge_key"), F.col("o_orderstatus").alias("label"), F.array(F.lit("a")).alias("src_types"), F.array(F.lit("b")).alias("tgt_types"), (F.col("o_orderdate") < F.lit("1998-01-01").cast("timestamp")).alias("early"))
    for epoch, part in ((0, o.where("early")), (1, o.where("NOT early")), (1, o.where("NOT early"))):
        append.append_batch(part.drop("early"), epoch, path)
    return append.read(spark, path).edges
