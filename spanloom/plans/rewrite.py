"""Structure-preserving rewrites of terms: functors, and optics with their adapted form."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from .term import Label, Term


@dataclass
class Functor:
    """``map_object``: label to labels. ``map_operation``: (label, source types, target types) to a term between the mapped types."""

    map_object: Callable[[Label], list[Label]]
    map_operation: Callable[[Label, list[Label], list[Label]], Term]

    def map_objects(self, term: Term) -> list[list[Label]]:
        return [list(self.map_object(x)) for x in term.nodes]

    def map_operations(self, operations: list[tuple[Label, list[Label], list[Label]]]) -> Term:
        out = Term()
        for op in operations:
            out = out | self.map_operation(*op)
        return out

    def map_arrow_witness(self, term: Term) -> tuple[Term, list[list[int]]] | None:
        """The image, its identifications pending, and the nodes of each node's image; None if the term has pending ones itself."""
        if not term.is_strict():
            return None
        objects = self.map_objects(term)
        out, places = Term(), []
        for labels in objects:
            places.append([out.new_node(x) for x in labels])
        wires = lambda xs: [k for x in xs for k in places[x]]
        for op, (s, t) in zip(term.operations(), term.adjacency, strict=True):
            legs = out.append(self.map_operation(*op))
            for mine, theirs in ((wires(s), legs[0]), (wires(t), legs[1])):
                if len(mine) != len(theirs):
                    raise ValueError(f"the image of {op[0]!r} has {len(theirs)} wires for {len(mine)}")
                for a, b in zip(theirs, mine, strict=True):
                    out.unify(a, b)
        out.sources, out.targets = wires(term.sources), wires(term.targets)
        return out, places

    def try_map_arrow(self, term: Term) -> Term | None:
        got = self.map_arrow_witness(term)
        return got and got[0]

    def map_arrow(self, term: Term) -> Term:
        """The strict image of a term, whose own identifications are applied first."""
        return self.map_arrow_witness(term.strict())[0].strict()


def identity_functor() -> Functor:
    return Functor(lambda x: [x], Term.singleton)


@dataclass
class Optic:
    """Forward and reverse rules and residuals.

    ``fwd_operation`` goes FA to FB and the residual, ``rev_operation`` from the residual and RB to RA.
    """

    fwd_object: Callable[[Label], list[Label]]
    rev_object: Callable[[Label], list[Label]]
    fwd_operation: Callable[[Label, list[Label], list[Label]], Term]
    rev_operation: Callable[[Label, list[Label], list[Label]], Term]
    residual: Callable[[Label, list[Label], list[Label]], list[Label]]

    def map_object(self, label: Label) -> list[Label]:
        return [*self.fwd_object(label), *self.rev_object(label)]

    def map_operation(self, label: Label, source: list[Label], target: list[Label]) -> Term:
        """The lens of one operation: forward and reverse joined at the residual, wires that run back bent, types interleaved."""
        out = Term()
        fs, ft = out.append(self.fwd_operation(label, source, target))
        rs, rt = out.append(self.rev_operation(label, source, target))
        m = len(self.residual(label, source, target))
        n = len(ft) - m
        for a, b in zip(ft[n:], rs[:m], strict=True):
            out.unify(a, b)
        out.sources = _interleave(fs, rt, source, self)
        out.targets = _interleave(ft[:n], rs[m:], target, self)
        return out

    def functor(self) -> Functor:
        return Functor(self.map_object, self.map_operation)

    def map_arrow(self, term: Term) -> Term:
        return self.functor().map_arrow(term)

    def adapt(self, image: Term, source: list[Label], target: list[Label]) -> Term:
        """An image between interleaved types as a term from FA and RB to FB and RA."""
        (fa, ra), (fb, rb) = _split(image.sources, source, self), _split(image.targets, target, self)
        out = image.copy()
        out.sources, out.targets = fa + rb, fb + ra
        return out

    def map_adapted(self, term: Term) -> Term:
        return self.adapt(self.map_arrow(term), term.source(), term.target())


def _interleave(forward: list[int], back: list[int], types: list[Label], optic: Optic) -> list[int]:
    out, i, j = [], 0, 0
    for x in types:
        a, b = len(optic.fwd_object(x)), len(optic.rev_object(x))
        out += forward[i : i + a] + back[j : j + b]
        i, j = i + a, j + b
    if (i, j) != (len(forward), len(back)):
        raise ValueError("a rule's term does not have the wires of its types")
    return out


def _split(wires: list[int], types: list[Label], optic: Optic) -> tuple[list[int], list[int]]:
    forward, back, i = [], [], 0
    for x in types:
        a, b = len(optic.fwd_object(x)), len(optic.rev_object(x))
        forward += wires[i : i + a]
        back += wires[i + a : i + a + b]
        i += a + b
    return forward, back


def interleave_blocks(a: list[list[Label]], b: list[list[Label]]) -> Term:
    """The wiring from all blocks of ``a``, then all of ``b``, to the blocks in turns."""
    if len(a) != len(b):
        raise ValueError("not as many blocks")
    left, right, at = [], [], 0
    for x in a:
        left.append(list(range(at, at + len(x))))
        at += len(x)
    for x in b:
        right.append(list(range(at, at + len(x))))
        at += len(x)
    labels = [y for x in [*a, *b] for y in x]
    return Term.spider(list(range(at)), [k for x, y in zip(left, right, strict=True) for k in [*x, *y]], labels)


def partial_dagger(term: Term, n_source: int, n_target: int) -> Term:
    """Of each boundary the first so many wires stay, and the others go to the other side."""
    out = term.copy()
    out.sources, out.targets = term.sources[:n_source] + term.targets[n_target:], term.targets[:n_target] + term.sources[n_source:]
    return out
