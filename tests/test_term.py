"""Terms on the driver: literal cases and laws."""

import random

import pytest

from spanloom.operators.components import LabelConflict
from spanloom.plans.rewrite import Functor, Optic, identity_functor, interleave_blocks, partial_dagger
from spanloom.plans.term import Builder, Signature, Term, build, dense_components, forget

from .random_terms import term


def test_components():
    assert dense_components(5, [(0, 1), (1, 2), (3, 4)]) == ([0, 0, 0, 1, 1], 2)
    assert dense_components(7, [(0, 0)] * 9 + [(0, 1)]) == ([0, 0, 1, 2, 3, 4, 5], 6)


def test_lax_compose():
    f, g = Term.singleton("F", ["A"], ["B"]), Term.singleton("G", ["C"], ["A"])
    assert f.compose(g) is None
    h = f.lax_compose(g)
    assert (h.sources, h.targets, h.quotient_pairs) == ([0], [3], [(1, 2)])
    with pytest.raises(LabelConflict):
        h.quotient()
    assert h.nodes == ["A", "B", "C", "A"]


def test_delete():
    t = Term(nodes=list("abcde"), edges=["op", "end"], adjacency=[([4, 2, 2, 0], [1, 3]), ([3], [])], quotient_pairs=[(4, 1), (0, 3), (2, 4)])
    out, witness = t.delete_nodes_witness([2, 0])
    assert (out.nodes, out.adjacency, out.quotient_pairs, witness) == (list("bde"), [([2], [0, 1]), ([1], [])], [(2, 0)], [None, 0, None, 1, 2])
    four = Term(nodes=["n"], edges=list("wxyz"), adjacency=[([0], []), ([], [0]), ([], []), ([0], [0])])
    kept = four.delete_edges([2, 0, 2])
    assert (kept.edges, kept.adjacency) == (["x", "z"], [([], [0]), ([0], [0])])
    for broken in (lambda: four.delete_edges([4]), lambda: t.delete_nodes([5])):
        with pytest.raises(IndexError):
            broken()


def test_layers():
    step, merge = Term.singleton("step", ["w"], ["w"]), Term.singleton("merge", ["w", "w", "w"], ["w"])
    assert ((step >> step | step | step) >> merge >> step).strict().layers()[0] == [0, 1, 0, 0, 2, 3]
    cycle = Term(nodes=["w"] * 5, edges=["free", "in", "round", "back", "behind"], adjacency=[([], [0]), ([0], [1]), ([1, 3], [2]), ([2], [3]), ([3], [4])])
    assert cycle.layers() == ([0, 1, 0, 0, 0], [False, False, True, True, True])


def test_eval():
    def apply(label, args):
        return {"Copy": lambda x: [x, x], "Mul": lambda x, y: [x * y], "One": lambda: [1], "Add": lambda x, y: [x + y]}[label](*args)

    n = "n"
    square = (Term.singleton("Copy", [n], [n, n]) >> Term.singleton("Mul", [n, n], [n])).strict()
    assert square.eval([3], apply) == [9] and (square | square).eval([3, 4], apply) == [9, 16]
    one = Term.singleton("One", [], [n])
    assert ((one | one) >> Term.singleton("Add", [n, n], [n])).strict().eval([], apply) == [2]
    with pytest.raises(ValueError):
        square.eval([], apply)


def test_json():
    text = '{"sources": [1, 0, 1], "targets": [2, 2], "hypergraph": {"nodes": [{"Range": {"from": 3, "to": 9}}, "Text", "Text"], "edges": [{"Read": 7}, "Join"], "adjacency": [{"sources": [0], "targets": [1]}, {"sources": [1, 1, 0], "targets": [2]}], "quotient": [[], []]}}'
    assert Term.from_json(text).to_json() == text
    lax = Term.singleton("f", ["a"], ["b"])
    lax.new_node("a")
    lax.unify(0, 2)
    assert Term.from_json(lax.to_json()) == lax
    assert "n0 -> e0" in lax.to_dot()


def test_category_laws():
    rng = random.Random(1)
    for _ in range(200):
        f = term(rng)
        g = term(rng, f.target())
        h = term(rng, g.target())
        fg = f >> g
        assert (fg >> h).strict() == (f >> (g >> h)).strict()
        same = lambda a, b: (a.source(), a.target(), sorted(a.nodes), sorted(a.edges)) == (b.source(), b.target(), sorted(b.nodes), sorted(b.edges))
        assert same((Term.identity(f.source()) >> f).strict(), f) and same((f >> Term.identity(f.target())).strict(), f)
        assert fg.strict().source() == f.source() and fg.strict().target() == g.target()
        assert same(((f | f) >> (g | g)).strict(), ((f >> g) | (f >> g)).strict())
        assert f.dagger().dagger() == f
        assert (f | Term()) == f == (Term() | f)
        one, two = f.copy(), f.copy()
        one.tensor_assign(g)
        two.coproduct_assign(g)
        assert one == f | g and two == f + g
    t = Term.twist(["a"], ["b", "c"])
    assert (t.source(), t.target()) == (["a", "b", "c"], ["b", "c", "a"]) and t.nodes == ["b", "c", "a"]
    assert Term.spider([3], [], ["a"]) is None


def test_functor():
    rng = random.Random(2)
    minus = Functor(lambda x: [x], lambda op, s, t: (Term.identity(s[:1]) | Term.singleton("Neg", s[1:], s[1:])) >> Term.singleton("Add", s, t) if op == "Sub" else Term.singleton(op, s, t))
    out, witness = minus.map_arrow_witness(Term.singleton("Sub", ["n", "n"], ["n"]))
    assert sorted(out.strict().edges) == ["Add", "Neg"] and [len(w) for w in witness] == [1, 1, 1]
    assert [out.sources, out.targets] == [[0, 1], [2]]
    for _ in range(100):
        f = term(rng)
        g = term(rng, f.target())
        assert sorted(identity_functor().map_arrow(f).edges) == sorted(f.edges)
        both, apart = minus.map_arrow((f >> g)), (minus.map_arrow(f) >> minus.map_arrow(g)).strict()
        assert (both.source(), both.target(), sorted(both.edges)) == (apart.source(), apart.target(), sorted(apart.edges))
    lax = Term(nodes=["a", "a"], quotient_pairs=[(0, 1)])
    assert minus.try_map_arrow(lax) is None


def test_optic():
    dagger = Optic(lambda x: [x], lambda x: [x], lambda f, s, t: Term.singleton(f, s, t), lambda f, s, t: Term.singleton(f"{f}'", t, s), lambda f, s, t: [])
    out = dagger.map_arrow(Term.singleton("F", ["A", "B"], ["C"]))
    assert (out.source(), out.target()) == (["A", "A", "B", "B"], ["C", "C"])
    r = Optic(lambda x: [x], lambda x: [f"d{x}"], lambda f, s, t: Term.singleton(f, s, [*t, "M"]), lambda f, s, t: Term.singleton(f"R{f}", ["M", *[f"d{x}" for x in t]], [f"d{x}" for x in s]), lambda f, s, t: ["M"])
    adapted = r.map_adapted(Term.singleton("F", ["A", "B"], ["C"]))
    assert (adapted.source(), adapted.target()) == (["A", "B", "dC"], ["C", "dA", "dB"])
    assert adapted.layers()[0] == [0, 1]
    mixed = interleave_blocks([["a"], ["b", "c"]], [["x"], []])
    assert (mixed.source(), mixed.target()) == (["a", "b", "c", "x"], ["a", "x", "b", "c"])
    bent = partial_dagger(Term.singleton("F", ["A", "B"], ["C", "D"]), 1, 1)
    assert (bent.source(), bent.target()) == (["A", "D"], ["C", "B"])


SIGNATURE = Signature("Copy", {"+": lambda a, b: ("Add", a), "*": lambda a, b: ("Mul", a), "-": lambda a, b: ("Sub", a), "neg": lambda a: ("Neg", a), "^": lambda a, b: ("Xor", a), "~": lambda a: ("Not", a), "&": lambda a, b: ("And", a), "|": lambda a, b: ("Or", a), "<<": lambda a, b: ("Shl", a), ">>": lambda a, b: ("Shr", a), "/": lambda a, b: ("Div", a)})


def test_variables():
    def f(b: Builder):
        x, y = b.var("n"), b.var("n")
        return [x, y], [(x + y) * x - -y, ~(x ^ y) & (x | y), (x << y) >> y, x / y]

    t = build(SIGNATURE, f)
    out = forget(t, "Copy")
    assert (len(out.sources), len(out.targets)) == (2, 4) and "Copy" not in out.edges
    values = {"Add": lambda x, y: x + y, "Mul": lambda x, y: x * y, "Sub": lambda x, y: x - y, "Neg": lambda x: -x, "Xor": lambda x, y: x ^ y, "Not": lambda x: ~x, "And": lambda x, y: x & y, "Or": lambda x, y: x | y, "Shl": lambda x, y: x << y, "Shr": lambda x, y: x >> y, "Div": lambda x, y: x / y}
    assert out.eval([6, 3], lambda op, args: [values[op](*args)]) == [57, ~(6 ^ 3) & (6 | 3), 6, 2]
    leaked = Builder(SIGNATURE).var("n")
    with pytest.raises(ValueError):
        build(SIGNATURE, lambda b: ([leaked], []))


def test_forget():
    lone = Term()
    lone.new_edge("Copy", ([], []))
    assert forget(lone, "Copy").edges == []
    odd = Term(nodes=["a", "b"], edges=["Copy"], adjacency=[([], [0, 1])])
    assert forget(odd, "Copy") == odd
    wide = Term(nodes=["a"] * 3, edges=["Copy"], adjacency=[([0], [1, 2])])
    assert forget(wide, "Copy").nodes == ["a"] and forget(wide, "Copy", monogamous=True) == wide
