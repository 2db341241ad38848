"""Queries of arrays, finite functions, labels and ragged relations over whole tables, and the same in SQL.

A query may carry several operators; its column ``kind`` says which one a row is of.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import arrays
from ..functions.finite import FiniteFunction, Labels, compose
from ..functions.lineage import cut, indexed
from ..functions.ragged import Ragged, converse_iter
from ..operators import components, functor
from .fixtures import table
from .queries import CENTS, EVENTS, PARTS, SIZES, event_array, parts_of_orders, query, sizes_of_orders, spread


def tagged(spark: SparkSession, **parts: DataFrame) -> DataFrame:
    """All ``parts``, each with its name as ``kind``."""
    return reduce(DataFrame.unionByName, [df.withColumn("kind", F.lit(k)) for k, df in parts.items()])


def one(spark: SparkSession, value, kind: str = "long") -> DataFrame:
    return spark.range(1).select(F.col("id").alias("i"), F.lit(value).cast(kind).alias("v"))


def keyed(spark: SparkSession, sf_dir: str, name: str, key: str, value: str, kind: str = "long") -> DataFrame:
    """(i, v): a column of a table, by its key."""
    t = table(spark, sf_dir, name)
    return cut(indexed(t.select(key, F.col(value).cast(kind).alias("v_")), [key]).select("i", F.col("v_").alias("v")))


NATIONS = "c AS (SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS i, c_nationkey::BIGINT AS v FROM customer)"
SUPPLIERS = "s AS (SELECT row_number() OVER (ORDER BY s_suppkey) - 1 AS i, s_nationkey::BIGINT AS v FROM supplier)"
REGIONS = "n AS (SELECT row_number() OVER (ORDER BY n_nationkey) - 1 AS i, n_regionkey::BIGINT AS v FROM nation)"


# Arrays


@query("SELECT 'arange' AS kind, range AS i, range + 5 AS v FROM range((SELECT count(*) FROM events)) UNION ALL SELECT 'fill', range, 7 FROM range((SELECT count(*) FROM customer)) UNION ALL SELECT 'slice', range, range * range FROM range(6)")
def array_make(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``arange``, ``fill``, an array from a list, and an empty one, which adds no rows."""
    n, m = table(spark, sf_dir, "events").count(), table(spark, sf_dir, "customer").count()
    return tagged(spark, arange=arrays.arange(spark, 5, n + 5), fill=arrays.fill(spark, 7, m).withColumn("v", F.col("v").cast("long")), slice=arrays.array(spark, [k * k for k in range(6)]), empty=arrays.empty(spark))


@query(
    EVENTS.rstrip("\n") + f", {NATIONS}, n AS (SELECT count(*) AS n FROM e)\n"
    "SELECT 'get' AS kind, CAST(0 AS BIGINT) AS i, cents AS v FROM e, n WHERE i = n - 1 UNION ALL SELECT 'range', i - n // 4, cents FROM e, n WHERE i >= n // 4 AND i < n // 2\n"
    "UNION ALL SELECT 'set', e.i, coalesce(c.v, e.cents) FROM e CROSS JOIN n LEFT JOIN c ON c.i = e.i - n // 3 UNION ALL SELECT 'concat', i, cents FROM e UNION ALL SELECT 'concat', i + n, v FROM c, n\n"
    "UNION ALL SELECT 'length', 0, n FROM n UNION ALL SELECT 'sum', 0, CAST(sum(cents) AS BIGINT) FROM e UNION ALL SELECT 'max', 0, max(cents) FROM e UNION ALL SELECT 'empty', 0, 1"
)
def array_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elements, slices, slices replaced, arrays joined, length, sum, maximum, and whether the slice of nothing is empty."""
    a, c = cut(event_array(spark, sf_dir, CENTS)), keyed(spark, sf_dir, "customer", "c_custkey", "c_nationkey")
    n = arrays.length(a)
    return tagged(
        spark, get=one(spark, arrays.get(a, n - 1)), range=arrays.get_range(a, n // 4, n // 2), set=arrays.set_range(a, n // 3, c), concat=arrays.concatenate(a, c),
        length=one(spark, n), sum=one(spark, arrays.total(a)), max=one(spark, arrays.maximum(a)), empty=one(spark, int(arrays.is_empty(arrays.get_range(a, 3, 3)) and not arrays.is_empty(a))),
    )


@query(
    EVENTS + "SELECT 'add' AS kind, i, cents + user_id AS v FROM e UNION ALL SELECT 'plus', i, cents + 11 FROM e UNION ALL SELECT 'sub', i, user_id - cents FROM e UNION ALL SELECT 'muladd', i, cents * 13 + user_id FROM e\n"
    "UNION ALL SELECT 'assign', i, CASE WHEN i IN (SELECT user_id FROM e) THEN -1 ELSE cents END FROM e"
)
def array_arithmetic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums of arrays and with a number, differences, which may be negative, products with a number, and a constant at all places that are named."""
    a, u = cut(event_array(spark, sf_dir, CENTS)), cut(event_array(spark, sf_dir, "user_id"))
    return tagged(spark, add=arrays.add(a, u), plus=arrays.add(a, 11), sub=arrays.sub(u, a), muladd=arrays.mul_constant_add(a, 13, u), assign=arrays.scatter_assign_constant(a, u, -1))


@query(
    EVENTS.rstrip("\n") + ", flags AS (SELECT range AS u, CASE WHEN (SELECT count(*) FROM e WHERE user_id = range) % 3 = 1 THEN 1 ELSE 0 END AS f FROM range((SELECT max(user_id) + 1 FROM events)))\n"
    "SELECT 'filter' AS kind, row_number() OVER (ORDER BY i) - 1 AS i, cents AS v FROM e WHERE event_type = 'click' UNION ALL SELECT 'dense', row_number() OVER (ORDER BY i) - 1, user_id FROM e JOIN flags ON u = user_id WHERE f = 1\n"
    "UNION ALL SELECT 'unvisited', row_number() OVER (ORDER BY i) - 1, user_id FROM e JOIN flags ON u = user_id WHERE f = 0"
)
def array_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By a flag for each element, and by flags that the values point to, set and not set."""
    a, u = cut(event_array(spark, sf_dir, CENTS)), cut(event_array(spark, sf_dir, "user_id"))
    click = event_array(spark, sf_dir, "CASE WHEN event_type = 'click' THEN 1 ELSE 0 END")
    counts = arrays.bincount(u, arrays.maximum(u) + 1)
    flags = cut(counts.select("i", F.when(F.col("v") % 3 == 1, 1).otherwise(0).cast("long").alias("v")))
    return tagged(spark, filter=arrays.filter_by(a, click), dense=arrays.filter_by_dense(u, flags), unvisited=arrays.filter_unvisited(flags, u))


@query("SELECT l_orderkey AS i, count(DISTINCT l_returnflag) + count(DISTINCT l_linestatus) - count(DISTINCT CASE WHEN l_linestatus IN (SELECT l_returnflag FROM lineitem x WHERE x.l_orderkey = l.l_orderkey) THEN l_linestatus END) = 1 AS v FROM lineitem l GROUP BY 1")
def equal_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of which all lines have one flag, which is their status too."""
    lists = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list("l_returnflag").alias("a"), F.collect_list("l_linestatus").alias("b"))
    return lists.select(F.col("l_orderkey").alias("i"), arrays.all_elements_equal(F.col("a"), F.col("b")).alias("v"))


@query(EVENTS + ", f AS (SELECT user_id, row_number() OVER (ORDER BY min(i)) - 1 AS v FROM e GROUP BY 1) SELECT e.i, f.v FROM e JOIN f USING (user_id)")
def to_dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users by their first appearance."""
    return components.to_dense(event_array(spark, sf_dir, "user_id * 1000 + 17"))[0]


# Finite functions


def customers(spark: SparkSession, sf_dir: str) -> FiniteFunction:
    return FiniteFunction.new(keyed(spark, sf_dir, "customer", "c_custkey", "c_nationkey"), table(spark, sf_dir, "nation").count())


def suppliers(spark: SparkSession, sf_dir: str) -> FiniteFunction:
    return FiniteFunction.new(keyed(spark, sf_dir, "supplier", "s_suppkey", "s_nationkey"), table(spark, sf_dir, "nation").count())


def nations(spark: SparkSession, sf_dir: str) -> FiniteFunction:
    return FiniteFunction.new(keyed(spark, sf_dir, "nation", "n_nationkey", "n_regionkey"), table(spark, sf_dir, "region").count())


def finite(spark: SparkSession, sf_dir: str) -> dict[str, FiniteFunction]:
    """Functions made of those from customers and suppliers to nations and on to regions."""
    c, s, n = customers(spark, sf_dir), suppliers(spark, sf_dir), nations(spark, sf_dir)
    unit = FiniteFunction.unit()
    return {
        "compose": c >> n, "coproduct": c + s, "tensor": c | n, "identity": FiniteFunction.identity(spark, c.source), "terminal": FiniteFunction.terminal(spark, s.source), "constant": FiniteFunction.constant(spark, c.source, 3, 4),
        "initial": FiniteFunction.initial(spark, n.source), "inj0": FiniteFunction.inj0(spark, c.source, s.source), "inj1": FiniteFunction.inj1(spark, c.source, s.source), "inject0": c.inject0(9), "inject1": c.inject1(9),
        "twist": FiniteFunction.twist(spark, c.source, s.source), "unit": FiniteFunction.identity(spark, unit), "sums": n.cumulative_sum(),
    }


@query(
    f"WITH {NATIONS}, {SUPPLIERS}, {REGIONS}, k AS (SELECT (SELECT count(*) FROM c) AS c, (SELECT count(*) FROM s) AS s)\n"
    "SELECT 'compose' AS kind, c.i, n.v FROM c JOIN n ON n.i = c.v UNION ALL SELECT 'coproduct', i, v FROM c UNION ALL SELECT 'coproduct', i + k.c, v FROM s, k UNION ALL SELECT 'tensor', i, v FROM c UNION ALL SELECT 'tensor', i + k.c, v + (SELECT count(*) FROM n) FROM n, k\n"
    "UNION ALL SELECT 'identity', i, i FROM c UNION ALL SELECT 'terminal', i, 0 FROM s UNION ALL SELECT 'constant', i, 3 FROM c UNION ALL SELECT 'inj0', i, i FROM c UNION ALL SELECT 'inj1', i, i + k.c FROM s, k\n"
    "UNION ALL SELECT 'inject0', i, v FROM c UNION ALL SELECT 'inject1', i, v + 9 FROM c UNION ALL SELECT 'twist', i, i + k.s FROM c, k UNION ALL SELECT 'twist', i + k.c, i FROM s, k\n"
    "UNION ALL SELECT 'sums', i, CAST(coalesce(sum(v) OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) FROM n"
)
def finite_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tagged(spark, **{k: f.table for k, f in finite(spark, sf_dir).items()})


@query(
    "WITH k AS (SELECT (SELECT count(*) FROM customer) AS c, (SELECT count(*) FROM supplier) AS s, (SELECT count(*) FROM nation) AS n, (SELECT count(*) FROM region) AS r, (SELECT CAST(sum(n_regionkey) AS BIGINT) FROM nation) AS t)\n"
    "SELECT unnest(['compose', 'coproduct', 'tensor', 'identity', 'terminal', 'constant', 'initial', 'inj0', 'inj1', 'inject0', 'inject1', 'twist', 'unit', 'sums']) AS kind,\n"
    "unnest([c, c + s, c + n, c, s, c, 0, c, s, c, c, c + s, 0, n]) AS source, unnest([r, n, n + r, c, 1, 8, n, c + s, c + s, n + 9, n + 9, c + s, 0, t]) AS target FROM k"
)
def finite_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Domains and codomains."""
    return spark.createDataFrame([(k, f.source, f.target) for k, f in finite(spark, sf_dir).items()], "kind string, source long, target long")


@query(
    "SELECT unnest(['fits', 'too large', 'empty', 'identity', 'nations', 'compose', 'coproduct', 'coequalizer']) AS kind,\n"
    "unnest([TRUE, FALSE, TRUE, TRUE, (SELECT count(DISTINCT c_nationkey) = count(*) FROM customer), FALSE, FALSE, FALSE]) AS ok"
)
def finite_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether tables are functions into a set, whether functions are one to one, and what does not go together."""
    c, s, n = customers(spark, sf_dir), suppliers(spark, sf_dir), nations(spark, sf_dir)
    rows = [
        ("fits", FiniteFunction.new(c.table, c.target) is not None), ("too large", FiniteFunction.new(c.table, arrays.maximum(c.table)) is not None), ("empty", FiniteFunction.new(arrays.empty(spark), 0) is not None),
        ("identity", FiniteFunction.identity(spark, c.source).is_injective()), ("nations", c.is_injective()), ("compose", c >> s is not None), ("coproduct", c + n is not None), ("coequalizer", c.coequalizer(s) is not None),
    ]
    return spark.createDataFrame(rows, "kind string, ok boolean")


@query(
    "WITH p AS (SELECT row_number() OVER (ORDER BY n_nationkey) - 1 AS i, n_name AS v FROM nation), " + NATIONS + ", r AS (SELECT row_number() OVER (ORDER BY r_regionkey) - 1 AS i, r_name AS v FROM region), k AS (SELECT count(*) AS n FROM nation)\n"
    "SELECT 'labels' AS kind, c.i, p.v FROM c JOIN p ON p.i = c.v UNION ALL SELECT 'compose', c.i, p.v FROM c JOIN p ON p.i = c.v UNION ALL SELECT 'coproduct', i, v FROM p UNION ALL SELECT 'coproduct', i + n, v FROM r, k UNION ALL SELECT 'singleton', 0, 'alone'\n"
    "UNION ALL SELECT 'zero', 0, 'true' UNION ALL SELECT 'identity', 0, 'none'"
)
def labels_algebra(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels behind a function, by both ways to compose, joined, of one, and none at all."""
    c = customers(spark, sf_dir)
    p, r = (Labels(keyed(spark, sf_dir, t, k, v, "string"), table(spark, sf_dir, t).count()) for t, k, v in (("nation", "n_nationkey", "n_name"), ("region", "r_regionkey", "r_name")))
    none = Labels.of(spark, [])
    return tagged(
        spark, labels=c.compose_labels(p).table, compose=compose(c, p).table, coproduct=(p + r).table, singleton=Labels.singleton(spark, "alone").table,
        zero=one(spark, str(none.is_zero() and not p.is_zero()).lower(), "string"), identity=one(spark, "none" if compose(c, None) is None else "some", "string"),
    )


# Ragged relations


@query(
    PARTS.rstrip("\n") + ", k AS (SELECT count(*) AS n, (SELECT max(p_partkey) + 1 FROM part) AS m FROM o), y AS (SELECT seg, pos, v, row_number() OVER (ORDER BY seg, pos) - 1 AS place FROM x)\n"
    "SELECT 'values' AS kind, seg, pos, v * 3 % m AS v FROM x, k UNION ALL SELECT 'coproduct', seg, pos, v FROM x UNION ALL SELECT 'coproduct', seg + n, pos, v FROM x, k UNION ALL SELECT 'tensor', seg, pos, v FROM x UNION ALL SELECT 'tensor', seg + n, pos, v + m FROM x, k\n"
    "UNION ALL SELECT 'singleton', 0, place, v FROM y UNION ALL SELECT 'elements', place, 0, v FROM y UNION ALL SELECT 'new', seg, pos, v FROM x\n"
    "UNION ALL SELECT 'indexed', 0, row_number() OVER (ORDER BY q.i, x.pos) - 1, x.v FROM x JOIN (SELECT seg AS i, seg * 7 % n AS g FROM o, k) q ON q.g = x.seg"
)
def ragged_algebra(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of orders: values mapped, relations joined and side by side, all values as one segment and as segments of one, taken apart into sizes and values and put together, and read in another order."""
    r = parts_of_orders(spark, sf_dir)
    r = Ragged(cut(r.table), r.n, r.target)
    values = cut(r.values())
    long = lambda df: df.select(F.lit(0).cast("long").alias("seg"), F.col("i").alias("pos"), "v")
    made = Ragged.new(r.sizes(), values, r.target)
    return tagged(
        spark, values=r.map_values(spread(spark, r.target, 3)).table, coproduct=(r + r).table, tensor=(r | r).table, singleton=Ragged.singleton(values, r.target).table,
        elements=Ragged.elements(values, values.count(), r.target).table, new=made.table, indexed=long(r.indexed_values(spread(spark, r.n))), initial=Ragged.initial(spark, 5).table,
    )


@query(PARTS + "SELECT unnest(['valid', 'sizes', 'values', 'coproduct', 'initial', 'gap']) AS kind, unnest([TRUE, FALSE, FALSE, FALSE, TRUE, FALSE]) AS ok")
def ragged_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which tables are relations, and what does not go together."""
    r = parts_of_orders(spark, sf_dir)
    r = Ragged(cut(r.table), r.n, r.target)
    rows = [
        ("valid", r.is_valid()), ("sizes", Ragged.new(arrays.add(r.sizes(), 1), r.values()) is not None), ("values", r.map_values(spread(spark, r.target + 1)) is not None),
        ("coproduct", r + Ragged(r.table, r.n, r.target + 1) is not None), ("initial", Ragged.initial(spark, 5).is_empty()), ("gap", Ragged(r.table.withColumn("pos", F.col("pos") * 2), r.n, r.target).is_valid()),
    ]
    return spark.createDataFrame(rows, "kind string, ok boolean")


@query("SELECT o_custkey AS seg, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS total, arg_min(o_orderkey, o_orderkey) AS first FROM orders GROUP BY 1 UNION ALL SELECT range, 0, 0, NULL FROM range((SELECT max(c_custkey) + 1 FROM customer)) WHERE range NOT IN (SELECT o_custkey FROM orders)")
def segment_iteration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The orders of each customer, read one segment after another, empty ones too."""
    n = table(spark, sf_dir, "customer").agg(F.max("c_custkey")).first()[0] + 1
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("seg"), F.col("o_orderkey").alias("v"))
    r = Ragged(indexed(o, ["v"], "pos", ("seg",)), n)
    return spark.createDataFrame([(i, len(x), sum(x), x[0] if x else None) for i, x in enumerate(r.lists())], "seg long, n long, total long, first long")


@query(
    PARTS.rstrip("\n") + ", k AS (SELECT max(p_partkey) + 1 AS m FROM part), f AS (SELECT seg FROM o JOIN orders USING (o_orderkey) WHERE o_orderstatus = 'F')\n"
    "SELECT 'all' AS kind, range AS i, (SELECT count(*) FROM x WHERE x.v = range) AS v FROM range((SELECT m FROM k)) UNION ALL SELECT 'some', range, (SELECT count(*) FROM x JOIN f USING (seg) WHERE x.v = range) FROM range((SELECT m FROM k))\n"
    "UNION ALL SELECT DISTINCT 'next', v, 1 FROM x JOIN f USING (seg)"
)
def relation_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each part is ordered, in all orders and in those that are finished, and the parts of the latter."""
    r = parts_of_orders(spark, sf_dir)
    r = Ragged(cut(r.table), r.n, r.target)
    o = indexed(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), ["o_orderkey"], "v")
    f = cut(indexed(o.where("o_orderstatus = 'F'").select("v"), ["v"]).select("i", "v"))
    ones = r.successors(f.select("v")).select(F.col("v").alias("i"), F.lit(1).cast("long").alias("v"))
    return tagged(spark, all=r.indegree(), some=r.relative_indegree(FiniteFunction(f, f.count(), r.n)), next=ones)


@query("SELECT range AS i, (SELECT count(*) FROM customer WHERE c_nationkey = range) AS n, (SELECT min(x) FROM (SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS x, c_nationkey FROM customer) WHERE c_nationkey = range) AS first FROM range((SELECT count(*) FROM nation))")
def classes_of_nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The customers of each nation, one nation after another."""
    return spark.createDataFrame([(i, len(x), x[0] if x else None) for i, x in enumerate(converse_iter(customers(spark, sf_dir)))], "i long, n long, first long")


@query(
    f"WITH {NATIONS}, {SUPPLIERS}, z AS (SELECT range AS g, (SELECT count(*) FROM c WHERE v = range) AS n FROM range((SELECT count(*) FROM nation))), a AS (SELECT g, n, CAST(coalesce(sum(n) OVER (ORDER BY g ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS place FROM z),\n"
    "x AS (SELECT s.i, place, unnest(range(n)) AS p FROM s JOIN a ON a.g = s.v) SELECT row_number() OVER (ORDER BY i, p) - 1 AS i, place + p AS v FROM x"
)
def half_spider_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The map from suppliers to nations, where a nation's image is all its customers."""
    c, s = customers(spark, sf_dir), suppliers(spark, sf_dir)
    sizes = arrays.bincount(c.table, c.target)
    return functor.map_half_spider(FiniteFunction(cut(sizes), c.target, 0), s).table
