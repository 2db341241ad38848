"""Random terms for law tests."""

import random

from spanloom.plans.term import Term


def term(rng: random.Random, source=None, labels="abc", n=6, ops=4) -> Term:
    """Nodes, operations on any of them, and boundaries; with ``source`` its first nodes have these labels and are the sources."""
    t = Term(nodes=[*(source or []), *[rng.choice(labels) for _ in range(rng.randrange(n))]])
    some = lambda k: [rng.randrange(len(t.nodes)) for _ in range(rng.randrange(k))] if t.nodes else []
    for _ in range(rng.randrange(ops)):
        t.new_edge(rng.choice("FGH"), (some(4), some(4)))
    t.sources = list(range(len(source))) if source is not None else some(4)
    t.targets = some(4)
    return t


def dag(rng: random.Random, n=8, ops=8) -> Term:
    """Operations of whole numbers that read earlier nodes and write later ones."""
    t = Term(nodes=["n"] * 3, sources=[0, 1, 2])
    for _ in range(rng.randrange(1, ops)):
        label, m, k = rng.choice([("Add", 2, 1), ("Mul", 2, 1), ("Copy", 1, 2), ("One", 0, 1), ("Zero", 0, 1), ("Discard", 1, 0)])
        s = [rng.randrange(len(t.nodes)) for _ in range(m)]
        t.new_edge(label, (s, [t.new_node("n") for _ in range(k)]))
    t.targets = [rng.randrange(len(t.nodes)) for _ in range(4)]
    return t
