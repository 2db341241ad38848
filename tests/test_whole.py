"""Queries over all rows against plain Python over sf0.001."""

import itertools
from collections import Counter

import pyarrow.parquet as pq

from spanloom.plans import queries
from spanloom.plans.fixtures import LINE_ORDER

DIR = "/root/testdata/sf0.001"


def rows(name, *columns):
    t = pq.read_table(f"{DIR}/{name}.parquet", columns=list(columns)).to_pydict()
    return list(zip(*(t[c] for c in columns), strict=True))


def run(spark, name):
    return sorted(tuple(r) for r in queries.QUERIES[name](spark, DIR).collect())


def test_kahn_nodes(spark):
    kinds = [("region", "r_regionkey", 0, 0), ("nation", "n_nationkey", 1, 1), ("customer", "c_custkey", 2, 2), ("supplier", "s_suppkey", 3, 2), ("part", "p_partkey", 4, 0), ("orders", "o_orderkey", 5, 3)]
    expected = [(key * 10 + place, layer, False) for table, column, place, layer in kinds for (key,) in rows(table, column)]
    lines = len(rows("lineitem", "l_orderkey"))
    assert lines > 5000
    assert run(spark, "kahn_nodes") == sorted(expected + [(i * 10 + 6, 4, False) for i in range(lines)])


def parts_of_orders():
    """For each order, by key, the parts of its lines, in their order."""
    place = {k: i for i, (k,) in enumerate(sorted(rows("orders", "o_orderkey")))}
    out = [[] for _ in place]
    columns = [*LINE_ORDER, *(c for c in ("l_orderkey", "l_partkey") if c not in LINE_ORDER)]
    for r in sorted(rows("lineitem", *columns)):
        r = dict(zip(columns, r, strict=True))
        if r["l_orderkey"] in place:
            out[place[r["l_orderkey"]]].append(r["l_partkey"])
    return out


def listed(lists):
    return sorted((seg, pos, v) for seg, x in enumerate(lists) for pos, v in enumerate(x))


def test_ragged_queries_over_all_rows(spark):
    parts = parts_of_orders()
    n = len(parts)
    assert n > 1000
    orders = {}
    for seg, x in enumerate(parts):
        for v in x:
            orders.setdefault(v, []).append(seg)
    assert run(spark, "flatmap") == listed([[o for v in x for o in orders[v]] for x in parts])
    assert run(spark, "map_indexes") == listed([parts[i * 7 % n] for i in range(n)])
    counts = Counter(v for i in range(n) for v in parts[i * 7 % n])
    assert run(spark, "relative_indegree") == sorted(counts.items())


def test_injections(spark):
    sizes = [len(x) for x in parts_of_orders()]
    starts = [0, *itertools.accumulate(sizes)]
    picks = [(i * 5 + 1) % len(sizes) for i in range(len(sizes))]
    assert run(spark, "injections") == list(enumerate(starts[k] + p for k in picks for p in range(sizes[k])))


def test_components_of_places(spark):
    joined = {n + queries.PLACE: r + 2 * queries.PLACE for n, r in rows("nation", "n_nationkey", "n_regionkey")}
    groups = {}
    for region in joined.values():
        groups.setdefault(region, {region})
    for nation, region in joined.items():
        groups[region].add(nation)
    for c, nation in rows("customer", "c_custkey", "c_nationkey"):
        groups[joined[nation + queries.PLACE]].add(c)
    assert run(spark, "components_of_places") == sorted((i, min(g)) for g in groups.values() for i in g)
