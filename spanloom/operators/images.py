"""Images of many diagrams under a functor of terms, one task a diagram, as arrays over all diagrams of a batch."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.lineage import by_key
from ..plans.rewrite import Functor
from .diagram import QUOTIENT, Diagram

#: Rows that are taken at once, and kinds of operations that a task remembers.
MANY, KINDS = 1 << 15, 1 << 16
PROBLEMS = ("SourcesCount", "SourcesSet", "TargetsSet", "CospanSourceType", "CospanTargetType")
CLASH = "LabelConflict"
NODE, EDGE, WIRE, FACE = range(4)


def plain(value, kind: T.DataType):
    """A value from Arrow as ``collect`` gives it: structs are rows."""
    if value is None:
        return None
    if isinstance(kind, T.StructType):
        return T.Row(**{f.name: plain(value[f.name], f.dataType) for f in kind})
    if isinstance(kind, T.ArrayType):
        return [plain(x, kind.elementType) for x in value]
    return value


def frozen(x):
    """A key that is the same for labels that Spark takes for the same."""
    if isinstance(x, dict):
        return tuple((k, frozen(v)) for k, v in x.items())
    if isinstance(x, (list, tuple)):
        return tuple(map(frozen, x))
    return ("nan",) if x != x else x


class Coded:
    """Labels of one type, numbered as they come."""

    def __init__(self, kind: T.DataType):
        self.kind, self.arrow = kind, to_arrow_schema(T.StructType([T.StructField("x", kind)])).field("x").type
        self.number: dict = {}
        self.values: list = []

    def code(self, x) -> int:
        key = frozen(x)
        if key not in self.number:
            self.number[key] = len(self.values)
            self.values.append(x)
        return self.number[key]

    def made(self, xs: list) -> list[int]:
        """Numbers of labels that a rule gave, as their column will have them."""
        return [self.code(x) for x in pa.array(list(xs), type=self.arrow).to_pylist()]

    def codes(self, column: pa.Array) -> np.ndarray:
        if pa.types.is_nested(column.type):
            return np.array([self.code(plain(x, self.kind)) for x in column.to_pylist()], dtype=np.int64)
        own = column.dictionary_encode("encode")
        return np.array([self.code(x) for x in own.dictionary.to_pylist()], dtype=np.int64)[own.indices.to_numpy()]

    def column(self, codes: np.ndarray) -> pa.Array:
        return pa.array(self.values, type=self.arrow).take(pa.array(codes))


class Lists:
    """Lists of whole numbers, or of tuples of ``width``, that are added one by one and read as arrays."""

    def __init__(self, width: int = 0):
        self.shape, self.flat, self.lengths, self.read = (-1, width) if width else (-1,), [], [], None

    def add(self, xs: list) -> None:
        self.flat += xs
        self.lengths.append(len(xs))
        self.read = None

    def arrays(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All values, where each list begins, and how long it is."""
        if self.read is None:
            n = np.array(self.lengths, dtype=np.int64)
            self.read = np.array(self.flat, dtype=np.int64).reshape(self.shape), before(n), n
        return self.read


def before(n: np.ndarray) -> np.ndarray:
    """The sum of all that stands before each."""
    return np.cumsum(n) - n


def run(starts: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The ``n`` places from each start on, one after another."""
    return np.repeat(starts - before(n), n) + np.arange(n.sum())


def summed(at: np.ndarray, n: np.ndarray, size: int) -> np.ndarray:
    """The sum of ``n`` for each of ``at``, which ascends."""
    ends = np.concatenate([[0], np.cumsum(n)])
    return ends[np.searchsorted(at, np.arange(size), "right")] - ends[np.searchsorted(at, np.arange(size), "left")]


def least_members(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The least place that each of ``n`` is joined to by pairs of ``a`` and ``b``: roots hook onto lesser ones, which leaves half of them at most."""
    root = np.arange(n)
    while a.size:
        a, b = root[a], root[b]
        apart = a != b
        a, b = a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root[root] != root).any():
            root = root[root]
    return root


def found(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where ``wanted`` stand in ``keys``, which ascend, and whether they do."""
    at = np.minimum(np.searchsorted(keys, wanted), max(len(keys) - 1, 0))
    return at, (keys[at] == wanted if len(keys) else np.zeros(len(wanted), dtype=bool))


class Imager:
    """Asks the rules for what it has not met yet, and makes images of whole batches from what they said."""

    def __init__(self, functor: Functor, labels: tuple[T.DataType, T.DataType], kinds: tuple[T.DataType, T.DataType]):
        self.functor = functor
        self.nodes_in, self.edges_in, self.nodes_out, self.edges_out = map(Coded, (*labels, *kinds))
        self.known: dict[tuple, int] = {}
        self.objects, self.nodes, self.edges, self.legs, self.wires = Lists(), Lists(), Lists(), Lists(), Lists(4)
        self.sources: list[int] = []

    def ask(self, label: int, source: list[int], target: list[int]) -> None:
        of = self.nodes_in.values
        t = self.functor.map_operation(self.edges_in.values[label], [of[c] for c in source], [of[c] for c in target]).strict()
        self.nodes.add(self.nodes_out.made(t.nodes))
        self.edges.add(self.edges_out.made(t.edges))
        self.legs.add([*t.sources, *t.targets])
        self.sources.append(len(t.sources))
        self.wires.add([(e, side, pos, x) for e, legs in enumerate(t.adjacency) for side in (0, 1) for pos, x in enumerate(legs[side])])

    def kinds(self, label: np.ndarray, n: np.ndarray, n_s: np.ndarray, legs: np.ndarray) -> np.ndarray:
        """The kind of each operation, by its label and those of its ``n`` legs, of which the first ``n_s`` are sources."""
        text, ends = legs.astype(np.int64).tobytes(), (np.cumsum(n) * 8).tolist()
        keys = [(k, s, text[a:b]) for k, s, a, b in zip(label.tolist(), n_s.tolist(), [0, *ends], ends)]
        for key in keys:
            if key not in self.known:
                types = np.frombuffer(key[2], dtype=np.int64).tolist()
                self.ask(key[0], types[: key[1]], types[key[1] :])
                self.known[key] = len(self.known)
        return np.array([self.known[k] for k in keys], dtype=np.int64)

    def packed(self, batch: pa.Table, first: np.ndarray, schema: pa.Schema) -> pa.RecordBatch:
        """A row for each diagram of ``batch``, whose rows are sorted; they begin at ``first``."""
        n = len(first)
        gid = batch.column("gid").combine_chunks().take(pa.array(first))
        whole = lambda c: batch.column(c).combine_chunks().fill_null(0).to_numpy()
        kind, edge, node = whole("kind"), whole("edge"), whole("node")
        sides = batch.column("side").combine_chunks().fill_null("s").to_numpy(zero_copy_only=False)
        t = sides == "t"
        if not (t | (sides == "s")).all():
            raise ValueError("a side is neither s nor t")
        g = np.repeat(np.arange(n), np.diff([*first, batch.num_rows]))
        at_n, at_e, at_w, at_f = (np.flatnonzero(kind == k) for k in (NODE, EDGE, WIRE, FACE))
        label = lambda at, c, codes: codes.codes(batch.column(c).combine_chunks().take(pa.array(at)))
        gn, ge, gw, gf = g[at_n], g[at_e], g[at_w], g[at_f]

        def lookup(values: np.ndarray, keys: np.ndarray, *wanted: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
            ranks, size = np.unique(values, return_inverse=True)[1], len(values) + 1
            of = lambda at: g[at] * size + ranks[at]
            return [found(of(keys), of(w)) for w in wanted]

        ((op, has_op),) = lookup(edge, at_e, at_w)
        (end, has_end), (leg, has_leg) = lookup(node, at_n, at_w, at_f)
        problem = np.full(n, len(PROBLEMS))
        np.minimum.at(problem, gw[~has_op], 0)
        np.minimum.at(problem, gw[~has_end], 1 + t[at_w][~has_end])
        np.minimum.at(problem, gf[~has_leg], 3 + t[at_f][~has_leg])
        if (odd := np.flatnonzero(problem < len(PROBLEMS))).size:
            return self.wrong(gid, odd, [PROBLEMS[p] for p in problem[odd]], schema)

        name = label(at_n, "node_label", self.nodes_in)
        for x in self.nodes_in.values[len(self.objects.lengths) :]:
            self.objects.add(self.nodes_out.made(self.functor.map_object(x)))
        source = ~t[at_w]
        n_s = np.bincount(op[source], minlength=len(at_e))
        made = self.kinds(label(at_e, "edge_label", self.edges_in), np.bincount(op, minlength=len(at_e)), n_s, name[end])

        # the images of a diagram's nodes come first, then those of its operations, each in order
        o_flat, o_from, o_n = self.objects.arrays()
        n_flat, n_from, n_n = self.nodes.arrays()
        size, more = o_n[name], n_n[made]
        size_g, more_g = summed(gn, size, n), summed(ge, more, n)
        base = before(size_g + more_g)
        place = base[gn] + before(size) - before(size_g)[gn]
        n_at = (base + size_g)[ge] + before(more) - before(more_g)[ge]
        names = np.empty((size_g + more_g).sum(), dtype=np.int64)
        names[run(place, size)] = o_flat[run(o_from[name], size)]
        names[run(n_at, more)] = n_flat[run(n_from[made], more)]

        l_flat, l_from, l_n = self.legs.arrays()
        wide = size[end]
        if (summed(op, wide, len(at_e)) != l_n[made]).any() or (summed(op[source], wide[source], len(at_e)) != np.array(self.sources, dtype=np.int64)[made]).any():
            raise ValueError("an operation's image does not have the wires of its types")
        root = least_members(l_flat[run(l_from[made], l_n[made])] + np.repeat(n_at, l_n[made]), run(place[end], wide), len(names))
        if (apart := np.flatnonzero(names != names[root])).size:
            of = np.searchsorted(base, apart, "right") - 1
            odd, one = np.unique(of, return_index=True)
            is_root = np.concatenate([[0], np.cumsum(root == np.arange(len(root)))])
            return self.wrong(gid, odd, [f"{CLASH} {k}" for k in is_root[root[apart[one]]] - is_root[base[odd]]], schema)

        least = root == np.arange(len(root))
        count = np.concatenate([[0], np.cumsum(least)])
        ahead, nodes_g = count[base], count[base + size_g + more_g] - count[base]
        to = lambda x: count[root[x]]
        e_flat, e_from, e_n = self.edges.arrays()
        edges, edges_g = e_n[made], summed(ge, e_n[made], n)
        e_at = before(edges) - before(edges_g)[ge]
        w_flat, w_from, w_n = self.wires.arrays()
        wires = w_n[made]
        w = w_flat[run(w_from[made], wires)]
        face = size[leg]
        f_node, f_g, f_t = run(place[leg], face), np.repeat(gf, face), np.repeat(t[at_f], face)
        f_key = 2 * f_g + f_t
        text = pa.array(["s", "t"])
        struct = lambda i, *columns: pa.StructArray.from_arrays([pa.array(c) if isinstance(c, np.ndarray) else c for c in columns], fields=list(schema.field(i).type.value_type))
        columns = [
            (self.nodes_out.column(names[least]), nodes_g),
            (self.edges_out.column(e_flat[run(e_from[made], edges)]), edges_g),
            (struct(4, w[:, 0] + np.repeat(e_at, wires), text.take(pa.array(w[:, 1])), w[:, 2], to(w[:, 3] + np.repeat(n_at, wires)) - np.repeat(ahead[ge], wires)), summed(ge, wires, n)),
            (struct(5, text.take(pa.array(f_t.astype(np.int64))), np.arange(len(f_key)) - np.searchsorted(f_key, f_key), to(f_node) - ahead[f_g]), summed(gf, face, n)),
        ]
        lists = [pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(k)]), type=pa.int32()), x, type=schema.field(i).type) for i, (x, k) in enumerate(columns, 2)]
        return pa.RecordBatch.from_arrays([gid, pa.nulls(n, pa.string()), *lists], schema=schema)

    @staticmethod
    def wrong(gid: pa.Array, odd: np.ndarray, problems: list[str], schema: pa.Schema) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([gid.take(pa.array(odd)), pa.array(problems, type=pa.string()), *[pa.nulls(len(odd), schema.field(i).type) for i in range(2, len(schema))]], schema=schema)


def gathered(d: Diagram) -> DataFrame:
    """The tables of strict diagrams as one, (gid, kind, edge, side, pos, node, node_label, edge_label)."""
    kinds = {"edge": "long", "side": "string", "pos": "long", "node": "long", "node_label": d.nodes.schema["label"].dataType, "edge_label": d.edges.schema["label"].dataType}

    def rows(kind: int, df: DataFrame, **renamed: str) -> DataFrame:
        own = {c: renamed.get(c, c) for c in kinds}
        return df.select("gid", F.lit(kind).alias("kind"), *[(F.col(own[c]) if own[c] in df.columns else F.lit(None)).cast(k).alias(c) for c, k in kinds.items()])

    parts = [rows(NODE, d.nodes, node_label="label"), rows(EDGE, d.edges, edge_label="label"), rows(WIRE, d.incidence), rows(FACE, d.interface)]
    return reduce(DataFrame.unionByName, parts)


def scattered(rows: DataFrame) -> Diagram:
    """The diagrams that ``gathered`` took together."""
    of = lambda kind, *columns: rows.where(F.col("kind") == kind).select("gid", *columns)
    labelled = lambda kind, key: of(kind, key, F.col(f"{key}_label").alias("label"))
    return Diagram(labelled(NODE, "node"), labelled(EDGE, "edge"), of(WIRE, "edge", "side", "pos", "node"), of(FACE, "side", "pos", "node"), rows.sparkSession.createDataFrame([], QUOTIENT))


def images(rows: DataFrame, functor: Functor, node_kind: str, edge_kind: str) -> DataFrame:
    """(gid, problem, nodes, edges, wires, face): the strict image of each of the diagrams in ``rows``, as ``gathered``, its tables as arrays; or what is wrong with it."""
    kinds = [T.StructType.fromDDL(f"x {k}")["x"].dataType for k in (node_kind, edge_kind)]
    labels = rows.schema["node_label"].dataType, rows.schema["edge_label"].dataType
    out = T.StructType([rows.schema["gid"], *T.StructType.fromDDL(f"problem string, nodes array<{node_kind}>, edges array<{edge_kind}>, wires array<struct<edge: bigint, side: string, pos: bigint, node: bigint>>, face array<struct<side: string, pos: bigint, node: bigint>>")])
    schema = to_arrow_schema(out)

    def begins(t: pa.Table) -> np.ndarray:
        gid = t.column("gid").combine_chunks()
        value, null = gid.fill_null(0).to_numpy(), gid.is_null().to_numpy(zero_copy_only=False)
        return np.concatenate([[0], 1 + np.flatnonzero((value[1:] != value[:-1]) | (null[1:] != null[:-1]))])

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        imager, held, n = Imager(functor, labels, kinds), [], 0

        def take(t: pa.Table, first: np.ndarray) -> pa.RecordBatch:
            nonlocal imager
            if len(imager.known) + len(imager.nodes_in.values) > KINDS:
                imager = Imager(functor, labels, kinds)
            return imager.packed(t, first, schema)

        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= MANY:
                t = pa.Table.from_batches(held)
                first = begins(t)
                # the last diagram may go on
                if len(first) > 1:
                    yield take(t.slice(0, first[-1]), first[:-1])
                held, n = t.slice(first[-1]).to_batches(), t.num_rows - int(first[-1])
        if n:
            t = pa.Table.from_batches(held)
            yield take(t, begins(t))

    return by_key(rows, "gid").sortWithinPartitions("gid", "kind", "edge", "side", "pos", "node").mapInArrow(mapped, out)


def unpacked(found: DataFrame) -> Diagram:
    """The diagrams of ``images``."""
    labelled = lambda c, key: found.select("gid", F.posexplode(c).alias(key, "label")).withColumn(key, F.col(key).cast("long"))
    rows = lambda c: found.select("gid", F.explode(c).alias("x")).select("gid", "x.*")
    return Diagram(labelled("nodes", "node"), labelled("edges", "edge"), rows("wires"), rows("face"), found.sparkSession.createDataFrame([], QUOTIENT))
