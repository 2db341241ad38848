"""Images of many diagrams: those that fit a task are made in one pass, with two tables kept, and are the same as by joins and by terms."""

import os
import random

import pytest

from spanloom.functions import lineage
from spanloom.operators import functor, images
from spanloom.operators.components import LabelConflict
from spanloom.operators.diagram import Diagram, InvalidDiagram
from spanloom.plans import fixtures
from spanloom.plans.queries import expand_click
from spanloom.plans.rewrite import Functor
from spanloom.plans.term import Term

from . import random_terms


def crossed(label: str, source: list, target: list) -> Term:
    """One operation for F; for G all wires go on by one node where both sides are alike; two side by side for H."""
    if label == "G" and len(set(source + target)) == 1:
        return Term(nodes=[source[0] if source else target[0]] if source or target else [], sources=[0] * len(source), targets=[0] * len(target))
    return Term.singleton(label, source, []) | Term.singleton(label.lower(), [], target) if label == "H" else Term.singleton(label, source, target)


DOUBLE = Functor(lambda x: {"a": ["a", "b"], "b": [], "c": ["c"]}[x], lambda f, s, t: crossed(f, *[[y for x in xs for y in {"a": "ab", "b": "", "c": "c"}[x]] for xs in (s, t)]))


def flat(term: Term) -> tuple:
    return term.nodes, term.edges, [tuple(map(list, x)) for x in term.adjacency], list(term.sources), list(term.targets)


@pytest.mark.parametrize("small", [12, 1 << 16])
def test_images_of_small_and_large_diagrams(spark, monkeypatch, small):
    monkeypatch.setattr(functor, "SMALL", small)
    rng = random.Random(small)
    terms = {}
    while len(terms) < 12:
        t = random_terms.term(rng, n=9, ops=7)
        if t.nodes or t.edges:
            if len(t.nodes) > 1 and t.nodes[0] == t.nodes[1]:
                t.unify(0, 1)
            try:
                flat(DOUBLE.map_arrow(t))
            except LabelConflict:
                continue
            terms[len(terms) * 3] = t
    got = functor.apply_functor(Diagram.from_terms(spark, terms), DOUBLE).terms()
    for g, t in terms.items():
        assert flat(got.get(g, Term())) == flat(DOUBLE.map_arrow(t)), g


def test_batches_end_within_diagrams(spark, monkeypatch):
    d = fixtures.chain(spark, "/root/testdata/sf0.001")
    f = Functor(lambda x: [x], expand_click)
    want = [sorted(map(tuple, t.collect())) for t in functor._large_images(d, f, "string", "string")._tables()]
    was = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    monkeypatch.setattr(images, "MANY", 50)
    monkeypatch.setattr(images, "KINDS", 3)
    try:
        got = [sorted(map(tuple, t.collect())) for t in functor._small_images(images.gathered(d), f, "string", "string")._tables()]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", was)
    assert got == want and want[1]


def test_two_tables_are_kept(spark):
    at = lineage.run_dir(spark).removeprefix("file:")
    os.makedirs(at, exist_ok=True)
    before = set(os.listdir(at))
    functor.apply_functor(fixtures.chain(spark, "/root/testdata/sf0.001"), Functor(lambda x: [x], expand_click))
    assert sorted(x.split("-")[0] for x in set(os.listdir(at)) - before) == ["gathered", "images"]


@pytest.mark.parametrize("small", [0, 1 << 16])
def test_what_is_wrong_is_named(spark, monkeypatch, small):
    monkeypatch.setattr(functor, "SMALL", small)
    same = Functor(lambda x: [x], Term.singleton)
    odd = Diagram.from_terms(spark, {2: Term(nodes=["a"], edges=["f"], adjacency=[([0], [1])]), 4: Term(nodes=["a"], sources=[1])})
    with pytest.raises(InvalidDiagram, match="TargetsSet in diagram 2"):
        functor.apply_functor(odd, same)
    f = Diagram.from_terms(spark, {1: Term.singleton("f", ["a"], ["b"]), 7: Term.singleton("f", ["c", "a"], ["b"])})
    with pytest.raises(LabelConflict, match="node 1 of diagram 7"):
        functor.apply_functor(f, Functor(lambda x: [x], lambda g, s, t: Term.singleton(g, s[:-1] + ["b"], t) if len(s) > 1 else Term.singleton(g, s, t)))
    with pytest.raises(Exception, match="does not have the wires of its types"):
        functor.apply_functor(f, Functor(lambda x: [x], lambda g, s, t: Term.singleton(g, s[1:], t))).edges.collect()
