"""Small diagrams on the driver: building, combining and rewriting by hand.

A term is lax: identifications of nodes are recorded and applied once, by ``quotient`` or ``strict``. Its
numbering, its order and its errors are those of the distributed ``Diagram``, into which terms turn.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Any

from ..operators.components import LabelConflict

Label = Any


def dense_components(n: int, pairs: list[tuple[int, int]]) -> tuple[list[int], int]:
    """Components of 0 to ``n - 1``, numbered by first appearance, and how many there are."""
    root = list(range(n))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in pairs:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    number: dict[int, int] = {}
    return [number.setdefault(find(i), len(number)) for i in range(n)], len(number)


@dataclass
class Term:
    """Labelled nodes, operations with ordered sources and targets, pending identifications, and two ordered boundaries."""

    nodes: list[Label] = field(default_factory=list)
    edges: list[Label] = field(default_factory=list)
    adjacency: list[tuple[list[int], list[int]]] = field(default_factory=list)
    quotient_pairs: list[tuple[int, int]] = field(default_factory=list)
    sources: list[int] = field(default_factory=list)
    targets: list[int] = field(default_factory=list)

    # Constructors

    @classmethod
    def empty(cls) -> Term:
        return cls()

    @classmethod
    def discrete(cls, nodes: list[Label]) -> Term:
        return cls(nodes=list(nodes))

    @classmethod
    def identity(cls, nodes: list[Label]) -> Term:
        n = list(range(len(nodes)))
        return cls(nodes=list(nodes), sources=n, targets=list(n))

    @classmethod
    def spider(cls, sources: list[int], targets: list[int], nodes: list[Label]) -> Term | None:
        """No operations; None if a leg points beyond the nodes."""
        if any(not 0 <= x < len(nodes) for x in [*sources, *targets]):
            return None
        return cls(nodes=list(nodes), sources=list(sources), targets=list(targets))

    @classmethod
    def half_spider(cls, sources: list[int], nodes: list[Label]) -> Term | None:
        return cls.spider(sources, list(range(len(nodes))), nodes)

    @classmethod
    def singleton(cls, label: Label, source_type: list[Label], target_type: list[Label]) -> Term:
        out = cls()
        _, (out.sources, out.targets) = out.new_operation(label, source_type, target_type)
        out.sources, out.targets = list(out.sources), list(out.targets)
        return out

    @classmethod
    def twist(cls, a: list[Label], b: list[Label]) -> Term:
        """Swaps two blocks of wires. The nodes stand in the order of the targets."""
        n = len(a) + len(b)
        return cls(nodes=[*b, *a], sources=[*range(len(b), n), *range(len(b))], targets=list(range(n)))

    @classmethod
    def tensor_operations(cls, operations: list[tuple[Label, list[Label], list[Label]]]) -> Term:
        """A batch of operations side by side: first the sources of all, then the targets of all."""
        out = cls(nodes=[x for _, s, _ in operations for x in s])
        at, sources = 0, []
        for _, s, _ in operations:
            sources.append(list(range(at, at + len(s))))
            at += len(s)
        out.sources = list(range(at))
        for (label, _, t), s in zip(operations, sources, strict=True):
            out.nodes += t
            out.edges.append(label)
            out.adjacency.append((s, list(range(at, at + len(t)))))
            at += len(t)
        out.targets = list(range(len(out.sources), at))
        return out

    # Building

    def new_node(self, label: Label) -> int:
        self.nodes.append(label)
        return len(self.nodes) - 1

    def new_edge(self, label: Label, interface: tuple[list[int], list[int]]) -> int:
        s, t = interface
        self.edges.append(label)
        self.adjacency.append((list(s), list(t)))
        return len(self.edges) - 1

    def new_operation(self, label: Label, source_type: list[Label], target_type: list[Label]) -> tuple[int, tuple[list[int], list[int]]]:
        s = [self.new_node(x) for x in source_type]
        t = [self.new_node(x) for x in target_type]
        return self.new_edge(label, (s, t)), (s, t)

    def add_edge_source(self, edge: int, label: Label) -> int:
        self.adjacency[edge][0].append(self.new_node(label))
        return self.adjacency[edge][0][-1]

    def add_edge_target(self, edge: int, label: Label) -> int:
        self.adjacency[edge][1].append(self.new_node(label))
        return self.adjacency[edge][1][-1]

    def unify(self, a: int, b: int) -> None:
        """Records that two nodes are one; their labels are compared when the quotient is applied."""
        self.quotient_pairs.append((a, b))

    # Reading

    def is_strict(self) -> bool:
        return not self.quotient_pairs

    def source(self) -> list[Label]:
        return [self.nodes[i] for i in self.sources]

    def target(self) -> list[Label]:
        return [self.nodes[i] for i in self.targets]

    def operations(self) -> Iterator[tuple[Label, list[Label], list[Label]]]:
        for label, (s, t) in zip(self.edges, self.adjacency, strict=True):
            yield label, [self.nodes[i] for i in s], [self.nodes[i] for i in t]

    def copy(self) -> Term:
        return Term(list(self.nodes), list(self.edges), [(list(s), list(t)) for s, t in self.adjacency], list(self.quotient_pairs), list(self.sources), list(self.targets))

    def validate(self) -> None:
        n = len(self.nodes)
        if len(self.edges) != len(self.adjacency):
            raise ValueError("SourcesCount")
        for k, name in ((0, "SourcesSet"), (1, "TargetsSet")):
            if any(not 0 <= x < n for a in self.adjacency for x in a[k]):
                raise ValueError(name)
        for leg, name in ((self.sources, "CospanSourceType"), (self.targets, "CospanTargetType")):
            if any(not 0 <= x < n for x in leg):
                raise ValueError(name)

    # Relabelling

    def map_nodes(self, f: Callable[[Label], Label]) -> Term:
        return self.with_nodes(lambda x: [f(y) for y in x])

    def map_edges(self, f: Callable[[Label], Label]) -> Term:
        return self.with_edges(lambda x: [f(y) for y in x])

    def with_nodes(self, f: Callable[[list], list]) -> Term | None:
        """All labels replaced at once; None if their number changes."""
        out, new = self.copy(), f(list(self.nodes))
        if len(new) != len(self.nodes):
            return None
        out.nodes = new
        return out

    def with_edges(self, f: Callable[[list], list]) -> Term | None:
        out, new = self.copy(), f(list(self.edges))
        if len(new) != len(self.edges):
            return None
        out.edges = new
        return out

    # Deletion

    def delete_edges(self, edges: list[int]) -> Term:
        gone = set(edges)
        if any(not 0 <= e < len(self.edges) for e in gone):
            raise IndexError("no such operation")
        out, keep = self.copy(), [i for i in range(len(self.edges)) if i not in gone]
        out.edges, out.adjacency = [self.edges[i] for i in keep], [out.adjacency[i] for i in keep]
        return out

    def delete_nodes_witness(self, nodes: list[int]) -> tuple[Term, list[int | None]]:
        """Without ``nodes``, wherever they occur; operations stay. With it where each old node went."""
        gone = set(nodes)
        if any(not 0 <= x < len(self.nodes) for x in gone):
            raise IndexError("no such node")
        number: list[int | None] = []
        kept = 0
        for i in range(len(self.nodes)):
            number.append(None if i in gone else kept)
            kept += i not in gone
        at = lambda xs: [number[x] for x in xs if number[x] is not None]
        pairs = [(number[a], number[b]) for a, b in self.quotient_pairs if number[a] is not None and number[b] is not None]
        return Term([x for i, x in enumerate(self.nodes) if i not in gone], list(self.edges), [(at(s), at(t)) for s, t in self.adjacency], pairs, at(self.sources), at(self.targets)), number

    def delete_nodes(self, nodes: list[int]) -> Term:
        return self.delete_nodes_witness(nodes)[0]

    # Combination

    def _shifted(self, other: Term) -> Term:
        n = len(self.nodes)
        move = lambda xs: [x + n for x in xs]
        return Term(self.nodes + other.nodes, self.edges + other.edges, [*((list(s), list(t)) for s, t in self.adjacency), *((move(s), move(t)) for s, t in other.adjacency)], self.quotient_pairs + [(a + n, b + n) for a, b in other.quotient_pairs], move(other.sources), move(other.targets))

    def coproduct(self, other: Term) -> Term:
        """Side by side; the boundaries are those of this term."""
        out = self._shifted(other)
        out.sources, out.targets = list(self.sources), list(self.targets)
        return out

    __add__ = coproduct

    def append(self, other: Term) -> tuple[list[int], list[int]]:
        """Takes ``other`` in, as ``coproduct``, and gives where its boundaries are now."""
        both = self._shifted(other)
        legs = both.sources, both.targets
        self.nodes, self.edges, self.adjacency, self.quotient_pairs = both.nodes, both.edges, both.adjacency, both.quotient_pairs
        return legs

    def tensor(self, other: Term) -> Term:
        out = self._shifted(other)
        out.sources, out.targets = self.sources + out.sources, self.targets + out.targets
        return out

    __or__ = tensor

    def tensor_assign(self, other: Term) -> None:
        """``tensor`` in place."""
        s, t = self.append(other)
        self.sources, self.targets = self.sources + s, self.targets + t

    def coproduct_assign(self, other: Term) -> None:
        """``coproduct`` in place."""
        self.append(other)

    def lax_compose(self, other: Term) -> Term | None:
        """One after the other, whatever the labels between; None if the numbers of wires differ."""
        if len(self.targets) != len(other.sources):
            return None
        out = self._shifted(other)
        out.quotient_pairs += list(zip(self.targets, out.sources, strict=True))
        out.sources = list(self.sources)
        return out

    def compose(self, other: Term) -> Term | None:
        """As ``lax_compose``; None if the labels between differ."""
        return self.lax_compose(other) if self.target() == other.source() else None

    __rshift__ = compose

    def dagger(self) -> Term:
        out = self.copy()
        out.sources, out.targets = out.targets, out.sources
        return out

    def quotient(self) -> tuple[Term, list[int]]:
        """The strict term, and where each node went; raises LabelConflict and leaves this term as it is."""
        q, k = dense_components(len(self.nodes), self.quotient_pairs)
        labels: list[Label] = [None] * k
        seen = [False] * k
        for i, c in enumerate(q):
            if seen[c] and labels[c] != self.nodes[i]:
                raise LabelConflict(f"{labels[c]!r} and {self.nodes[i]!r}")
            labels[c], seen[c] = self.nodes[i], True
        at = lambda xs: [q[x] for x in xs]
        return Term(labels, list(self.edges), [(at(s), at(t)) for s, t in self.adjacency], [], at(self.sources), at(self.targets)), q

    def strict(self) -> Term:
        out = self.quotient()[0]
        out.validate()
        return out

    # Layers and values

    def layers(self) -> tuple[list[int], list[bool]]:
        """The layer of each operation, and whether it is on or behind a cycle, with layer 0 then."""
        makers: dict[int, list[int]] = {}
        for e, (_, t) in enumerate(self.adjacency):
            for x in t:
                makers.setdefault(x, []).append(e)
        before = [[m for x in s for m in makers.get(x, [])] for s, _ in self.adjacency]
        after: list[list[int]] = [[] for _ in before]
        for e, b in enumerate(before):
            for m in b:
                after[m].append(e)
        need, layer, frontier, depth = [len(b) for b in before], [0] * len(before), [e for e, b in enumerate(before) if not b], 0
        done = [False] * len(before)
        while frontier:
            found = []
            for e in frontier:
                done[e], layer[e] = True, depth
                for x in after[e]:
                    need[x] -= 1
                    if need[x] == 0:
                        found.append(x)
            frontier, depth = found, depth + 1
        return layer, [not d for d in done]

    def eval(self, inputs: list, apply: Callable[[Label, list], list], default: Any = 0) -> list | None:
        """Values of the targets from those of the sources; None if there is a cycle. Later layers overwrite, within one the later operation does."""
        if len(inputs) != len(self.sources):
            raise ValueError("a value for each source is wanted")
        layer, stuck = self.layers()
        if any(stuck):
            return None
        memory = [default] * len(self.nodes)
        for i, v in zip(self.sources, inputs, strict=True):
            memory[i] = v
        for depth in range(max(layer, default=-1) + 1):
            written = []
            for e in [e for e, x in enumerate(layer) if x == depth]:
                s, t = self.adjacency[e]
                out = apply(self.edges[e], [memory[i] for i in s])
                if len(out) != len(t):
                    raise ValueError(f"{self.edges[e]!r} gave {len(out)} values for {len(t)} targets")
                written += zip(t, out, strict=True)
            for i, v in written:
                memory[i] = v
        return [memory[i] for i in self.targets]

    # JSON

    def to_json(self) -> str:
        left, right = [a for a, _ in self.quotient_pairs], [b for _, b in self.quotient_pairs]
        graph = {"nodes": self.nodes, "edges": self.edges, "adjacency": [{"sources": s, "targets": t} for s, t in self.adjacency], "quotient": [left, right]}
        return json.dumps({"sources": self.sources, "targets": self.targets, "hypergraph": graph})

    @classmethod
    def from_json(cls, text: str) -> Term:
        data = json.loads(text)
        g = data["hypergraph"]
        return cls(g["nodes"], g["edges"], [(a["sources"], a["targets"]) for a in g["adjacency"]], list(zip(*g["quotient"], strict=True)) if g["quotient"][0] else [], data["sources"], data["targets"])

    def to_dot(self) -> str:
        """Graphviz text: nodes as points, operations as boxes, numbered ports."""
        lines = ["digraph {"] + [f'  n{i} [shape=point, xlabel={json.dumps(str(x))}];' for i, x in enumerate(self.nodes)] + [f"  e{i} [shape=box, label={json.dumps(str(x))}];" for i, x in enumerate(self.edges)]
        for i, (s, t) in enumerate(self.adjacency):
            lines += [f'  n{x} -> e{i} [headlabel="{k}"];' for k, x in enumerate(s)] + [f'  e{i} -> n{x} [taillabel="{k}"];' for k, x in enumerate(t)]
        lines += [f"  n{a} -> n{b} [style=dotted, dir=none];" for a, b in self.quotient_pairs]
        return "\n".join([*lines, "}"])


# Variables


@dataclass
class Signature:
    """How variables are written: the label of the operations that stand for them, and what operators mean.

    ``operators`` maps a symbol such as "+" to a function of the argument labels that gives (operation, result label).
    """

    var: Label = "Copy"
    operators: dict[str, Callable[..., tuple[Label, Label]]] = field(default_factory=dict)


class Var:
    """A wire that may be used any number of times: an operation with a leg for its definition and one for each use."""

    def __init__(self, builder: Builder, label: Label):
        self.builder, self.label = builder, label
        self.edge = builder.term.new_edge(builder.signature.var, ([], []))

    def new_source(self) -> int:
        return self.builder.term.add_edge_source(self.edge, self.label)

    def new_target(self) -> int:
        return self.builder.term.add_edge_target(self.edge, self.label)

    def _apply(self, symbol: str, *others: Var) -> Var:
        op, result = self.builder.signature.operators[symbol](self.label, *[o.label for o in others])
        return self.builder.fn_operation([self, *others], result, op)


def _binary(symbol: str):
    return lambda self, other: self._apply(symbol, other)


for _name, _symbol in {"add": "+", "sub": "-", "mul": "*", "truediv": "/", "and": "&", "or": "|", "xor": "^", "lshift": "<<", "rshift": ">>"}.items():
    setattr(Var, f"__{_name}__", _binary(_symbol))
Var.__neg__ = lambda self: self._apply("neg")  # type: ignore[attr-defined]
Var.__invert__ = lambda self: self._apply("~")  # type: ignore[attr-defined]


class Builder:
    def __init__(self, signature: Signature):
        self.signature, self.term, self.open = signature, Term(), True

    def var(self, label: Label) -> Var:
        return Var(self, label)

    def operation(self, args: list[Var], result_types: list[Label], op: Label) -> list[Var]:
        """An operation on variables; a new variable for each result."""
        if not self.open or any(a.builder is not self for a in args):
            raise ValueError("a variable is used outside of its term")
        s = [a.new_target() for a in args]
        results = [self.var(x) for x in result_types]
        self.term.new_edge(op, (s, [r.new_source() for r in results]))
        return results

    def fn_operation(self, args: list[Var], result_type: Label, op: Label) -> Var:
        return self.operation(args, [result_type], op)[0]


def build(signature: Signature, f: Callable[[Builder], tuple[list[Var], list[Var]]]) -> Term:
    """The term of a function that gives its source and its target variables; those may not be used afterwards."""
    b = Builder(signature)
    sources, targets = f(b)
    if any(v.builder is not b for v in [*sources, *targets]):
        raise ValueError("a variable belongs to another term")
    b.term.sources, b.term.targets = [v.new_source() for v in sources], [v.new_target() for v in targets]
    b.open = False
    return b.term


def forget(term: Term, var: Label, monogamous: bool = False) -> Term:
    """Without the operations labelled ``var``: all legs of each become one node, one without legs vanishes.

    One whose legs have different labels stays. With ``monogamous`` only those with one source and one target go.
    """
    strict = term.strict()
    gone, out = [], strict.copy()
    for e, (label, (s, t)) in enumerate(zip(strict.edges, strict.adjacency, strict=True)):
        legs = s + t
        if label == var and all(strict.nodes[x] == strict.nodes[legs[0]] for x in legs) and (not monogamous or (len(s), len(t)) == (1, 1)):
            gone.append(e)
            for x in legs[1:]:
                out.unify(legs[0], x)
    return out.delete_edges(gone).strict()
