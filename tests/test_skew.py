"""One segment, list, hub or kind that holds nearly all rows."""

import pytest
from pyspark.sql import functions as F

from spanloom.functions import arrays as a
from spanloom.functions import lineage
from spanloom.functions.finite import FiniteFunction
from spanloom.functions.ragged import Ragged
from spanloom.operators import functor, traverse
from spanloom.operators.diagram import Diagram
from spanloom.plans.rewrite import Functor
from spanloom.plans.term import Term

BIG = 30_000


@pytest.fixture(autouse=True)
def short_runs(monkeypatch):
    monkeypatch.setattr(lineage, "RUN", 1000)
    monkeypatch.setattr(lineage, "HOT", 8)


def test_one_very_long_segment(spark):
    sizes = a.array(spark, [2, BIG, 0, 3])
    assert a.segmented_arange(sizes).agg(F.count("*"), F.max("i"), F.sum("v")).first()[:] == (BIG + 5, BIG + 4, 1 + BIG * (BIG - 1) // 2 + 3)
    long = a.repeat(sizes, a.array(spark, [7, 8, 9, 1]))
    assert [tuple(r) for r in long.groupBy("v").agg(F.min("i"), F.count("*")).orderBy("v").collect()] == [(1, BIG + 2, 3), (7, 0, 2), (8, 2, BIG)]
    assert a.values(a.segmented_sum(sizes, long)) == [14, 8 * BIG, 0, 3]
    with pytest.raises(Exception, match="add up"):
        a.segmented_sum(a.array(spark, [BIG * 2]), long).collect()
    picks = FiniteFunction.of(spark, [1, 3, 1], 4)
    out = FiniteFunction(sizes, 4, 0).injections(picks)
    assert out.source == 2 * BIG + 3 and out.table.agg(F.max("i"), F.sum("v")).first()[:] == (2 * BIG + 2, 2 * (BIG * 2 + BIG * (BIG - 1) // 2) + 3 * (BIG + 2) + 3)


def test_one_value_in_very_many_lists(spark):
    table = spark.range(BIG).select(F.col("id").alias("seg"), F.lit(0).cast("long").alias("pos"), F.when(F.col("id") % 1000 == 0, 1).otherwise(0).cast("long").alias("v"))
    r = Ragged(table, BIG, 3)
    back = r.converse()
    assert back.is_valid() and a.values(back.sizes()) == [BIG - 30, 30, 0]
    assert back.flatmap(r).table.groupBy("seg", "v").count().orderBy("seg").collect()[0][:] == (0, 0, BIG - 30)


def test_looked_up_keys(spark):
    rows = spark.range(BIG).select("id", F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id") % 5000).alias("key"), F.lit("x").alias("n"))
    table = rows.groupBy("key").agg(F.count("*").alias("m"), F.min("id").alias("first")).where("key % 2 <> 0")
    for how, n in (("inner", rows.where("key % 2 <> 0").count()), ("left", BIG)):
        got = lineage.looked_up(rows, table, "key", "m", how)
        assert got.columns == ["id", "key", "n", "m", "first"] and got.count() == n
        assert got.where("first IS NOT NULL").exceptAll(rows.join(table, "key").select(got.columns)).isEmpty()


def hub(spark, n):
    """A node that ``n`` operations read, each writing a node of its own, and one operation that makes it."""
    ops = spark.range(n + 1).select(F.lit(0).cast("long").alias("gid"), F.col("id").alias("edge"))
    nodes = spark.range(n + 2).select(F.lit(0).cast("long").alias("gid"), F.col("id").alias("node"), F.lit("w").alias("label"))
    zero = F.lit(0).cast("long").alias("pos")
    reads = ops.select("gid", "edge", F.lit("s").alias("side"), zero, F.when(F.col("edge") == 0, 0).otherwise(1).cast("long").alias("node"))
    writes = ops.select("gid", "edge", F.lit("t").alias("side"), zero, (F.col("edge") + 1).alias("node"))
    face = nodes.select("gid", F.when(F.col("node") == 0, "s").otherwise("t").alias("side"), F.greatest(F.col("node") - 1, F.lit(0)).alias("pos"), "node")
    base = Diagram.empty(spark)
    return Diagram(nodes, ops.withColumn("label", F.lit("inc")), reads.unionByName(writes), face, base.quotient)


def test_hub(spark):
    d = hub(spark, 3000)
    assert [tuple(r) for r in traverse.layers(d).groupBy("layer", "stuck").count().orderBy("layer").collect()] == [(0, False, 1), (1, False, 3000)]
    assert traverse.layered_operations(d).agg(F.count("*"), F.max("pos")).first()[:] == (3001, 2999)
    start = spark.createDataFrame([(0, 0, 5)], "gid long, pos long, value long")
    out = traverse.evaluate(d, start, lambda label, args: F.array(args[0] + 1), F.lit(0)).groupBy("value").count().orderBy("value").collect()
    assert [tuple(r) for r in out] == [(6, 1), (7, 3000)]
    assert traverse.reachable(traverse.node_adjacency(d), spark.createDataFrame([(0, 1)], "gid long, v long")).count() == 3001
    w, x = d.nodes.where("node IN (0, 2)").select("gid", "node", F.col("node").alias("to")), d.edges.limit(0).select("gid", "edge", F.col("edge").alias("to"))
    assert not traverse.is_convex(d, w, x).first()["convex"]


def test_several_makers_of_one_node(spark):
    t = Term(nodes=["w"] * 4, edges=["a", "b", "c"], adjacency=[([], [0]), ([1], [0]), ([0], [2])], sources=[1], targets=[2])
    d = Diagram.from_terms(spark, {0: t, 1: Term(nodes=["w"] * 2, edges=["a", "b", "c"], adjacency=[([1], [0]), ([], [0]), ([0], [1])])})
    got = {(r.gid, r.edge): (r.layer, r.stuck) for r in traverse.layers(d).collect()}
    assert got == {(0, 0): (0, False), (0, 1): (0, False), (0, 2): (1, False), (1, 0): (0, True), (1, 1): (0, False), (1, 2): (0, True)}


def test_functor_of_very_many_kinds(spark):
    """Labels with values make a kind of every operation; the rule is asked on the workers."""
    n = 12_000
    ops = spark.range(n).select(F.lit(0).cast("long").alias("gid"), F.col("id").alias("edge"), F.struct(F.lit("add").alias("op"), F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id")).alias("k")).alias("label"), F.array(F.lit("w")).alias("src_types"), F.array(F.lit("w")).alias("tgt_types"))
    d = Diagram.from_operations(ops)
    double = Functor(lambda x: [x, x + "'"], lambda label, s, t: Term.singleton(f"{label['op']} {label['k']}", [y for x in s for y in (x, x + "'")], [y for x in t for y in (x, x + "'")]))
    image = functor.apply_functor(d, double, edge_kind="string")
    assert image.edges.count() == n and image.nodes.count() == 4 * n
    assert image.edges.where("edge IN (3, 11999)").orderBy("edge").select("label").collect() == [("add -1",), ("add 11999",)]
    assert image.operations().select(F.concat_ws(",", F.concat("src_types", "tgt_types"))).distinct().collect() == [("w,w',w,w'",)]


def test_flatmap_keeps_what_goes_in_and_not_what_comes_out(spark):
    """One list of 4000 values stands in for each of 250: a million rows, none of which is kept."""
    import pathlib

    from spanloom.functions.lineage import run_dir

    size = lambda: sum(f.stat().st_size for f in pathlib.Path(run_dir(spark).removeprefix("file:")).rglob("*") if f.is_file())
    kept = lambda: size() + sum(f.stat().st_size for f in pathlib.Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file:")).rglob("part-*") if f.is_file())
    outer = Ragged(spark.range(250).selectExpr("id % 2 AS seg", "id div 2 AS pos", "0L AS v"), 2, 1)
    inner = Ragged(spark.range(4000).selectExpr("0L AS seg", "id AS pos", "id AS v"), 1, 4000)
    before = kept()
    out = outer.flatmap(inner).table
    assert kept() - before < 1e6
    assert out.where("pos % 4000 <> v OR pos >= 500000").isEmpty() and out.distinct().count() == 1_000_000


def test_kahn_keeps_pairs_once_and_stops_when_all_are_placed(spark):
    """Rounds are written only while a vertex is left, and pairs that occur twice count twice."""
    import pathlib

    from spanloom.functions.lineage import run_dir

    made = lambda what: len(list(pathlib.Path(run_dir(spark).removeprefix("file:")).glob(f"{what}-*")))
    before = made("round")
    v = spark.range(4).selectExpr("0L AS gid", "id AS v")
    pairs = spark.createDataFrame([(0, 0, 1), (0, 0, 1), (0, 1, 2), (0, 0, 3), (0, 2, 3)], "gid long, src long, dst long")
    out = sorted((r["v"], r["layer"], r["stuck"]) for r in traverse.kahn(v, pairs).collect())
    assert out == [(0, 0, False), (1, 1, False), (2, 2, False), (3, 3, False)]
    assert made("round") - before == 3
