"""Small cases of arrays, finite functions and ragged relations; numbering and the last write are fixed by the operators' meaning."""

import pytest

from spanloom.functions import arrays as a
from spanloom.functions.finite import FiniteFunction, Labels, compose
from spanloom.functions.ragged import Ragged, converse_iter
from spanloom.operators.components import connected_components, to_dense


def test_arrays(spark):
    x = lambda *v: a.array(spark, list(v))
    assert a.values(a.segmented_sum(x(3, 0, 1, 2, 0), x(5, -2, 4, 9, 1, 1))) == [7, 0, 9, 2, 0]
    assert a.values(a.scatter_assign_constant(x(0, 1, 2, 3, 4, 5), x(0, 2, 4), 10)) == [10, 1, 10, 3, 10, 5]
    assert a.values(a.zero(x(0, 1, 0, 2, 0, 3))) == [0, 2, 4]
    assert a.values(a.bincount(x(0, 3, 1, 3, 0, 3, 3), 4)) == [2, 1, 0, 4]
    assert a.values(a.bincount(a.empty(spark), 3)) == [0, 0, 0]
    assert a.values(a.scatter(x(0, 2, 1, 2), x(2, 1, 0, 2), 3)) == [1, 2, 2]
    assert a.values(a.scatter(x(7, 5), x(3, 3), 5)) == [7, 7, 7, 5, 7]
    assert a.values(a.cumulative_sum(x(1, 2, 3, 4))) == [0, 1, 3, 6, 10]
    assert a.values(a.repeat(x(0, 3, 1, 2), x(9, 4, 4, 1))) == [4, 4, 4, 4, 1, 1]
    assert a.values(a.segmented_arange(x(0, 4, 1, 0, 2))) == [0, 1, 2, 3, 0, 0, 1]
    assert a.values(a.argsort(x(5, 5, -1, 8, 0))) == [2, 4, 0, 1, 3]
    assert [a.values(y) for y in a.quot_rem(x(0, 1, 2, 3, 4, 5), 3)] == [[0, 0, 0, 1, 1, 1], [0, 1, 2, 0, 1, 2]]
    assert a.values(a.sort_by(x(6, 7, 8, 9, 3), x(2, 0, 2, 1, 0))) == [7, 3, 9, 6, 8]
    assert a.values(a.filter_by(x(5, 6, 7), x(1, 0, 1))) == [5, 7]
    assert a.values(a.mul_constant_add(x(1, 2), 10, x(3, 4))) == [13, 24]
    assert a.values(a.set_range(x(1, 2, 3, 4), 1, x(8, 9))) == [1, 8, 9, 4]
    assert a.values(a.get_range(x(1, 2, 3, 4), 1, 3)) == [2, 3] and a.get(x(4, 5), 1) == 5
    assert a.values(a.sub(x(1, 2), x(3, 1))) == [-2, 1]
    for broken in (lambda: a.gather(x(1), x(1)).collect(), lambda: a.bincount(x(5), 3).collect(), lambda: a.add(x(1), x(1, 2)).collect(), lambda: a.get_range(x(1), 0, 2)):
        with pytest.raises(Exception, match="range|differ|0, 2"):
            broken()


def test_equal_elements(spark):
    rows = [(["a"], ["a", "a"], True), ([], ["a", "b"], False), ([], [], True), ([None], [None], True), (["a"], [None], False)]
    df = spark.createDataFrame(rows, "a array<string>, b array<string>, e boolean")
    assert [r[0] for r in df.select(a.all_elements_equal(df["a"], df["b"])).collect()] == [r[2] for r in rows]


def test_components(spark):
    q, k = connected_components(a.array(spark, [0, 1, 3]), a.array(spark, [1, 2, 4]), 5)
    assert (a.values(q), k) == ([0, 0, 0, 1, 1], 2)
    d, k = to_dense(a.array(spark, [0, 2, 5, 5, 7]))
    assert (a.values(d), k) == ([0, 1, 2, 2, 3], 4)
    f, g = (FiniteFunction.of(spark, v, 7) for v in ([0] * 10, [0] * 9 + [1]))
    c = f.coequalizer(g)
    assert (a.values(c.table), c.target) == ([0, 0, 1, 2, 3, 4, 5], 6)
    assert a.values(c.coequalizer_universal(Labels.of(spark, list("aabcdef"))).table) == list("abcdef")
    assert c.coequalizer_universal(Labels.of(spark, list("abbcdef"))) is None


def test_finite_functions(spark):
    of = lambda v, t: FiniteFunction.of(spark, v, t)
    assert of([3], 3) is None and of([], 0).source == 0
    s = of([3, 0, 1, 4], 5).cumulative_sum()
    assert (a.values(s.table), s.target) == ([0, 3, 3, 4], 8)
    assert a.values(FiniteFunction.inj1(spark, 3, 5).table) == [3, 4, 5, 6, 7]
    assert a.values((of([1, 0], 2) >> of([5, 6], 9)).table) == [6, 5] and of([1], 3) >> of([1], 3) is None
    assert a.values((of([1], 2) | of([0], 2)).table) == [1, 2]
    t = FiniteFunction.twist(spark, 2, 3)
    assert a.values((t >> FiniteFunction.twist(spark, 3, 2)).table) == [0, 1, 2, 3, 4]
    p = FiniteFunction.transpose(spark, 2, 3)
    assert a.values((p >> FiniteFunction.transpose(spark, 3, 2)).table) == list(range(6))
    assert of([0, 1], 2).is_injective() and not of([1, 1], 2).is_injective()
    assert a.values(of([2, 0, 3], 9).injections(of([2, 0], 3)).table) == [2, 3, 4, 0, 1]
    assert a.values(compose(of([1, 1], 2), Labels.of(spark, ["x", "y"])).table) == ["y", "y"]


def test_ragged(spark):
    r = Ragged.new(a.array(spark, [2, 0, 2]), a.array(spark, [4, 4, 0, 1]), 5)
    assert list(r.converse().lists()) == [[2], [2], [], [], [0, 0]] and r.is_valid()
    assert Ragged.new(a.array(spark, [2]), a.array(spark, [1]), 5) is None
    assert list(r.flatmap(r.converse()).lists()) == [[0, 0, 0, 0], [], [2, 2]]
    assert list(Ragged.of(spark, [[0, 1], [2]], 3).flatmap_sources(Ragged.of(spark, [[1], [], [2, 3]], 4)).lists()) == [[1], [2, 3]]
    assert list((r | r).lists())[3:] == [[9, 9], [], [5, 6]] and list((r + r).lists())[3:] == [[4, 4], [], [0, 1]]
    assert a.values(r.indegree()) == [1, 1, 0, 0, 2] and a.values(r.sizes()) == [2, 0, 2]
    assert list(converse_iter(FiniteFunction.of(spark, [1, 0, 1], 3))) == [[1], [0, 2], []]
    f = FiniteFunction.of(spark, [2, 2, 0], 3)
    assert list(r.map_indexes(f).lists()) == [[0, 1], [0, 1], [4, 4]] and a.values(r.indexed_values(f)) == [0, 1, 0, 1, 4, 4]
    assert list(r.map_labels(Labels.of(spark, list("abcde"))).lists()) == [["e", "e"], [], ["a", "b"]]
