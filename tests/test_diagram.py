"""Distributed diagrams against terms on the driver, over collections of random ones, and literal cases."""

import random

import pytest
from pyspark.sql import functions as F

from spanloom.operators import functor, traverse
from spanloom.operators.components import LabelConflict
from spanloom.operators.diagram import Diagram, InvalidDiagram
from spanloom.plans.queries import polynomial
from spanloom.plans.term import Term, forget
from spanloom.sources import io
from spanloom.streaming import append

from .random_terms import dag, term


def batch(seed, n=12):
    rng = random.Random(seed)
    f = {g: term(rng) for g in range(n)}
    h = {g: term(rng, f[g].target()) for g in range(n)}
    return f, h


def trim(terms):
    return {g: t for g, t in terms.items() if t != Term()}


def test_combination(spark):
    f, h = batch(1)
    a, b = Diagram.from_terms(spark, f), Diagram.from_terms(spark, h)
    assert a.terms() == trim(f)
    assert (a | b).terms() == trim({g: f[g] | h[g] for g in f})
    assert (a + b).terms() == trim({g: f[g] + h[g] for g in f})
    assert a.dagger().terms() == trim({g: t.dagger() for g, t in f.items()})
    lax = a >> b
    assert lax.terms() == trim({g: f[g] >> h[g] for g in f})
    strict = lax.strict()
    assert strict.terms() == trim({g: (f[g] >> h[g]).strict() for g in f})
    assert (strict >> b.dagger()) is None or all(strict.terms()[g].target() == h[g].target() for g in strict.terms())
    joined, legs = a.append(b)
    copies = {g: t.copy() for g, t in f.items()}
    where = {g: copies[g].append(h[g]) for g in f}
    assert joined.terms() == trim(copies)
    assert sorted((r.gid, r.side, r.pos, r.node) for r in legs.collect()) == sorted((g, s, p, x) for g, w in where.items() for s, xs in zip("st", w) for p, x in enumerate(xs))


def test_lax_errors(spark):
    f, g = Term.singleton("F", ["A"], ["B"]), Term.singleton("G", ["C"], ["A"])
    a, b = (Diagram.from_terms(spark, {0: t}) for t in (f, g))
    assert a >> b is None and a.lax_compose(Diagram.from_terms(spark, {0: g | g})) is None
    with pytest.raises(LabelConflict):
        a.lax_compose(b).strict()
    for broken, name in ((Term(nodes=["x"], edges=["e"], adjacency=[([1], [])]), "SourcesSet"), (Term(nodes=["x"], edges=["e"], adjacency=[([0], [3])]), "TargetsSet"), (Term(nodes=["x"], sources=[2]), "CospanSourceType"), (Term(nodes=["x"], targets=[2]), "CospanTargetType")):
        with pytest.raises(InvalidDiagram, match=name):
            Diagram.from_terms(spark, {4: broken}).validate()
        with pytest.raises(ValueError, match=name):
            broken.validate()


def test_deletion_and_types(spark):
    f, _ = batch(2)
    rng = random.Random(3)
    d = Diagram.from_terms(spark, f)
    nodes = {g: sorted(rng.sample(range(len(t.nodes)), len(t.nodes) // 2)) for g, t in f.items()}
    edges = {g: sorted(rng.sample(range(len(t.edges)), len(t.edges) // 2)) for g, t in f.items()}
    rows = lambda x, kind: spark.createDataFrame([(g, i) for g, v in x.items() for i in v], f"gid bigint, {kind} bigint")
    assert d.delete_nodes(rows(nodes, "node")).terms() == trim({g: t.delete_nodes(nodes[g]) for g, t in f.items()})
    assert d.delete_edges(rows(edges, "edge")).terms() == trim({g: t.delete_edges(edges[g]) for g, t in f.items()})
    with pytest.raises(IndexError):
        d.delete_nodes(rows({0: [99]}, "node"))
    got = {(r.gid, r.edge): (r.label, r.src_types, r.tgt_types) for r in d.operations().collect()}
    assert got == {(g, i): o for g, t in f.items() for i, o in enumerate(t.operations())}
    ops = {g: list(t.operations()) for g, t in f.items() if t.edges}
    frame = spark.createDataFrame([(g, i, *o) for g, x in ops.items() for i, o in enumerate(x)], "gid bigint, edge bigint, label string, src_types array<string>, tgt_types array<string>")
    assert Diagram.from_operations(frame).terms() == {g: Term.tensor_operations(x) for g, x in ops.items()}
    assert d.map_nodes(F.upper).terms() == trim({g: t.map_nodes(str.upper) for g, t in f.items()})
    assert d.with_edges(lambda df: df.where("edge > 0")) is None or not any(t.edges for t in f.values())


def test_layers(spark):
    f, _ = batch(4, 25)
    d = Diagram.from_terms(spark, f)
    expected = {(g, e): (l, s) for g, t in f.items() for e, (l, s) in enumerate(zip(*t.layers()))}
    for got in (traverse.layers(d), traverse.layers_of_small(d)):
        assert {(r.gid, r.edge): (r.layer, r.stuck) for r in got.collect()} == expected
    direct = traverse.kahn(d.edges.select("gid", F.col("edge").alias("v")), traverse.op_adjacency(d))
    assert {(r.gid, r.v): (r.layer, r.stuck) for r in direct.collect()} == expected
    acyclic = {r.gid: r.acyclic for r in traverse.is_acyclic(d).collect()}
    assert acyclic == {g: not any(t.layers()[1]) for g, t in trim(f).items()}


def test_monogamy(spark):
    cases = [(Term.singleton("f", ["a"], ["b"]), True), (Term(nodes=["a"], sources=[0, 0], targets=[0]), False), (Term(nodes=["a", "b"], edges=["f"], adjacency=[([0], [1])], sources=[0, 1], targets=[1]), False), (Term.identity(["a"]), True), (Term.twist(["a"], ["b"]), True), (Term(nodes=["a"]), False)]
    got = {r.gid: r.monogamous for r in Diagram.from_terms(spark, {g: t for g, (t, _) in enumerate(cases)}).is_monogamous().collect()}
    assert got == {g: m for g, (_, m) in enumerate(cases)}


def maps(spark, w, x):
    return spark.createDataFrame([(0, a, b) for a, b in w], "gid bigint, node bigint, to bigint"), spark.createDataFrame([(0, a, b) for a, b in x], "gid bigint, edge bigint, to bigint")


def test_convex(spark):
    g = Diagram.from_terms(spark, {0: Term(nodes=["n"] * 3, edges=["e"] * 3, adjacency=[([0], [1]), ([1], [2]), ([0], [2])])})
    for w, x, convex in (([(0, 0), (1, 1), (2, 2)], [(0, 0), (1, 1)], False), ([(0, 0), (1, 1), (2, 2)], [(0, 0), (1, 1), (2, 2)], True), ([(0, 0), (1, 1)], [(0, 0)], True), ([(0, 0), (1, 0)], [], False)):
        assert [r.convex for r in traverse.is_convex(g, *maps(spark, w, x)).collect()] == [convex]


def test_morphisms(spark):
    of = lambda nodes, label="e", adj=([0], [1]): Diagram.from_terms(spark, {0: Term(nodes=nodes, edges=[label], adjacency=[adj])})
    d, both = of(["a", "b"]), maps(spark, [(0, 0), (1, 1)], [(0, 0)])
    problem = lambda t, m=both: [r.problem for r in traverse.morphism_problem(d, t, *m).collect()]
    assert problem(d) == []
    assert problem(of(["a", "c"])) == ["NotNaturalW"] and problem(of(["a", "b"], "f")) == ["NotNaturalX"]
    assert problem(of(["a", "b"], adj=([1], [1]))) == ["NotNaturalS"] and problem(of(["a", "b"], adj=([0], [0]))) == ["NotNaturalT"]
    assert problem(d, maps(spark, [(0, 0)], [(0, 0)])) == ["TypeMismatchW"] and problem(d, maps(spark, [(0, 0), (1, 1)], [])) == ["TypeMismatchX"]


PY = {"Add": lambda x, y: [x + y], "Mul": lambda x, y: [x * y], "Copy": lambda x: [x, x], "One": lambda: [1], "Zero": lambda: [0], "Discard": lambda x: []}


def test_eval(spark):
    rng = random.Random(5)
    terms = {g: dag(rng) for g in range(10)}
    inputs = {g: [rng.randrange(-3, 4) for _ in range(3)] for g in terms}
    frame = spark.createDataFrame([(g, i, v) for g, x in inputs.items() for i, v in enumerate(x)], "gid bigint, pos bigint, value bigint")
    d = Diagram.from_terms(spark, terms)
    apply = lambda label, args: PY[label](*args)
    expected = {(g, i): v for g, t in terms.items() for i, v in enumerate(t.eval(inputs[g], apply))}
    for got in (traverse.evaluate(d, frame, polynomial, F.lit(0)), traverse.evaluate_small(d, frame, apply, 0, "long")):
        assert {(r.gid, r.pos): r.value for r in got.collect()} == expected
    ring = Diagram.from_terms(spark, {0: Term(nodes=["n"], edges=["Copy"], adjacency=[([0], [0, 0])])})
    assert traverse.evaluate(ring, frame.limit(0), polynomial, F.lit(0)) is None


def test_functor_and_forget(spark):
    from spanloom.plans.rewrite import Functor

    f, _ = batch(6)
    d = Diagram.from_terms(spark, f)
    image, witness = functor.map_diagram(d, lambda x: F.array(x, x), _twice)
    mine = {g: Functor(lambda x: [x, x], _twice).map_arrow_witness(t) for g, t in f.items()}
    assert image.strict().terms() == trim({g: m[0].strict() for g, m in mine.items()})
    assert {(r.gid, r.node, r.k): r.out for r in witness.collect()} == {(g, n, k): o for g, m in mine.items() for n, w in enumerate(m[1]) for k, o in enumerate(w)}
    for one in (False, True):
        assert functor.forget(d, F.col("label") == "F", one).terms() == trim({g: forget(t, "F", one) for g, t in f.items()})


def _twice(op, s, t):
    both = lambda xs: [y for x in xs for y in (x, x)]
    return Term.singleton(op, both(s), both(t)) if op != "F" else Term.singleton(op, both(s), ["z"]) >> Term.singleton("back", ["z"], both(t))


def test_sources(spark, tmp_path):
    f, h = batch(7)
    lax = {g: f[g] >> h[g] for g in f}
    d = Diagram.from_terms(spark, lax)
    rows = io.to_json(d)
    assert {r.gid: Term.from_json(r.json) for r in rows.collect()} == trim(lax)
    assert io.from_json(rows).terms() == trim(lax)
    io.write_parquet(d, str(tmp_path / "d"))
    assert io.read_parquet(spark, str(tmp_path / "d")).terms() == trim(lax)
    dot = {r.gid: r.dot for r in io.to_dot(d).collect()}
    assert all(sorted(dot[g].split("\n")[1:-1]) == sorted(x.strip() for x in lax[g].to_dot().split("\n")[1:-1] if "dotted" not in x) for g in dot)


def test_stream(spark, tmp_path):
    schema = "gid bigint, edge_key bigint, label string, src_types array<string>, tgt_types array<string>"
    for i, rows in enumerate([[(0, 1, "f", ["a"], ["b"]), (1, 1, "g", [], ["a"])], [(0, 2, "h", ["b"], [])]]):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(str(tmp_path / "in"))
        append.append_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    got = append.read(spark, str(tmp_path / "out")).terms()
    assert (got[0].nodes, got[0].edges, got[0].adjacency) == (["a", "b", "b"], ["f", "h"], [([0], [1]), ([2], [])])
    assert got[1].adjacency == [([], [0])]
    append.append_batch(spark.createDataFrame([(0, 2, "h", ["b"], [])], schema), 1, str(tmp_path / "out"))
    assert append.read(spark, str(tmp_path / "out")).terms() == got
