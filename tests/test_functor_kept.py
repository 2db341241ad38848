"""What a functor needs on the way is kept as compressed tables, computed once."""

import os

from spanloom.functions import lineage
from spanloom.operators import functor
from spanloom.operators.diagram import Diagram
from spanloom.plans import fixtures
from spanloom.plans.queries import expand_click
from spanloom.plans.rewrite import Functor, identity_functor
from spanloom.plans.term import Term


def checkpoints(spark):
    return {os.path.join(at, d) for at, dirs, _ in os.walk(lineage.shared_dir(spark).removeprefix("file:")) for d in dirs if d.startswith("rdd-")}


def test_no_image_is_checkpointed(spark):
    before = checkpoints(spark)
    d = fixtures.chain(spark, "/root/testdata/sf0.001")
    same = functor.apply_functor(d, identity_functor())
    assert checkpoints(spark) == before
    assert sorted(map(tuple, same.incidence.collect())) == sorted(map(tuple, d.incidence.collect()))
    split = functor.apply_functor(d, Functor(lambda x: [x], expand_click))
    assert checkpoints(spark) == before
    clicks = d.edges.where("label = 'click'").count()
    assert split.edges.count() == d.edges.count() + clicks and split.edges.where("label = 'up'").count() == clicks


def test_identifications_that_wait_are_kept(spark):
    t = Term.singleton("f", ["a"], ["b"]) | Term.singleton("g", ["b"], ["c"])
    t.unify(1, 2)
    d = Diagram.from_terms(spark, {0: t}).kept()
    assert [tuple(r)[2:] for r in d.quotient.collect()] == [(1, 2)] and d.strict().nodes.count() == 3
