import random

from spanloom.operators.components import least_members, quotient_map
from spanloom.plans.term import dense_components


def test_random_and_long_chains(spark):
    rng = random.Random(5)
    edges = [(g, rng.randrange(100), rng.randrange(100)) for g in range(3) for _ in range(50)] + [(1, 1000 + i, 1001 + i) for i in range(40)] + [(2, 500, 500 + i) for i in range(30)]
    frame = spark.createDataFrame(edges, "gid bigint, a bigint, b bigint")
    got = {(r.gid, r.id): r.root for r in least_members(frame, ("gid",)).collect()}
    for g in range(3):
        mine = [(a, b) for h, a, b in edges if h == g]
        q, _ = dense_components(1100, mine)
        first = {c: q.index(c) for c in set(q)}
        linked = {x for a, b in mine if a != b for x in (a, b)}
        assert {i: r for (h, i), r in got.items() if h == g} == {i: first[q[i]] for i in linked}
    nodes = spark.range(1100).selectExpr("0 as gid", "id").selectExpr("cast(gid as bigint) gid", "id")
    numbered = {r.id: r.component for r in quotient_map(nodes, frame.where("gid = 0"), ("gid",)).collect()}
    assert [numbered[i] for i in range(1100)] == dense_components(1100, [(a, b) for h, a, b in edges if h == 0])[0]


def test_empty(spark):
    assert least_members(spark.createDataFrame([], "a bigint, b bigint")).count() == 0
