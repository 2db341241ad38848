"""Collections of diagrams as DataFrames.

Every table leads with ``gid``, so one plan handles one large diagram or millions of small ones:

- nodes (gid, node, label), edges (gid, edge, label), ids dense from 0 in each diagram
- incidence (gid, edge, side, pos, node): the ordered sources 's' and targets 't' of operations
- interface (gid, side, pos, node): the two ordered boundaries
- quotient (gid, seq, a, b): identifications of nodes that are pending; none in a strict diagram

Combining keeps identifications pending, so a chain of compositions needs one pass over components.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.finite import Labels
from ..functions.lineage import cut, dealt, indexed, stored
from ..functions.ragged import Ragged
from ..plans.term import Term
from .components import LabelConflict, push_labels, quotient_map

NODES, EDGES = "gid bigint, node bigint, label {}", "gid bigint, edge bigint, label {}"
INCIDENCE = "gid bigint, edge bigint, side string, pos bigint, node bigint"
INTERFACE = "gid bigint, side string, pos bigint, node bigint"
QUOTIENT = "gid bigint, seq bigint, a bigint, b bigint"


class InvalidDiagram(ValueError):
    """Named by what is wrong: SourcesCount, SourcesSet, TargetsSet, CospanSourceType, CospanTargetType."""


def _shift(df: DataFrame, by: DataFrame, **columns: str) -> DataFrame:
    """``df`` with each of ``columns`` moved up by the size of its ``gid`` that is named."""
    sizes = by.withColumnRenamed("gid", "g_")
    out = df.join(dealt(sizes), F.col("gid") == F.col("g_"), "left")
    return out.withColumns({c: (F.col(c) + F.coalesce(F.col(n), F.lit(0))).cast("long") for c, n in columns.items()}).select(*df.columns)


@dataclass(frozen=True)
class Operations:
    """A batch of operations by columns: a label, a list of source types and one of target types for each."""

    labels: Labels
    sources: Ragged
    targets: Ragged

    @staticmethod
    def new(labels: Labels, sources: Ragged, targets: Ragged) -> Operations | None:
        """None if the three are not of one length."""
        return Operations(labels, sources, targets) if labels.n == sources.n == targets.n else None

    @staticmethod
    def singleton(spark: SparkSession, label, source: Labels, target: Labels) -> Operations:
        return Operations(Labels.singleton(spark, label), Ragged.singleton(source.table), Ragged.singleton(target.table))

    def __len__(self) -> int:
        return self.labels.n

    def rows(self) -> DataFrame:
        """(edge, label, src_types, tgt_types), in the order of ``edge`` when sorted."""
        lists = lambda r, name: r.table.groupBy(F.col("seg").alias("edge")).agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "v"))), lambda x: x["v"]).alias(name))
        out = self.labels.table.select(F.col("i").alias("edge"), F.col("v").alias("label"))
        for r, name in ((self.sources, "src_types"), (self.targets, "tgt_types")):
            out = out.join(lists(r, name), "edge", "left")
            out = out.withColumn(name, F.coalesce(name, F.array().cast(out.schema[name].dataType)))
        return out

    def __iter__(self):
        for r in self.rows().orderBy("edge").toLocalIterator():
            yield r["label"], list(r["src_types"]), list(r["tgt_types"])

    def tensor(self) -> Diagram:
        """All side by side, as one diagram."""
        return Diagram.from_operations(self.rows().withColumn("gid", F.lit(0).cast("long")))


@dataclass(frozen=True)
class Diagram:
    nodes: DataFrame
    edges: DataFrame
    incidence: DataFrame
    interface: DataFrame
    quotient: DataFrame

    # Sources

    @staticmethod
    def empty(spark: SparkSession, node_kind: str = "string", edge_kind: str = "string") -> Diagram:
        return Diagram(*[spark.createDataFrame([], s) for s in (NODES.format(node_kind), EDGES.format(edge_kind), INCIDENCE, INTERFACE, QUOTIENT)])

    @staticmethod
    def from_terms(spark: SparkSession, terms: dict[int, Term], node_kind: str = "string", edge_kind: str = "string") -> Diagram:
        nodes = [(g, i, x) for g, t in terms.items() for i, x in enumerate(t.nodes)]
        edges = [(g, i, x) for g, t in terms.items() for i, x in enumerate(t.edges)]
        incidence = [(g, e, side, p, n) for g, t in terms.items() for e, legs in enumerate(t.adjacency) for side, xs in zip("st", legs, strict=True) for p, n in enumerate(xs)]
        interface = [(g, side, p, n) for g, t in terms.items() for side, xs in (("s", t.sources), ("t", t.targets)) for p, n in enumerate(xs)]
        quotient = [(g, i, a, b) for g, t in terms.items() for i, (a, b) in enumerate(t.quotient_pairs)]
        f = spark.createDataFrame
        return Diagram(f(nodes, NODES.format(node_kind)), f(edges, EDGES.format(edge_kind)), f(incidence, INCIDENCE), f(interface, INTERFACE), f(quotient, QUOTIENT))

    @staticmethod
    def from_operations(operations: DataFrame) -> Diagram:
        """A batch (gid, edge, label, src_types, tgt_types) side by side, each operation on nodes of its own: all sources, then all targets."""
        spark = operations.sparkSession
        legs = operations.select("gid", "edge", F.lit("s").alias("side"), F.posexplode("src_types").alias("pos", "label")).unionByName(operations.select("gid", "edge", F.lit("t").alias("side"), F.posexplode("tgt_types").alias("pos", "label")))
        placed = cut(indexed(legs, ["side", "edge", "pos"], "node", ("gid",)))
        wires = indexed(placed.select("gid", "side", "node"), ["node"], "pos", ("gid", "side"))
        return Diagram(placed.select("gid", "node", "label"), operations.select("gid", "edge", "label"), placed.select("gid", "edge", "side", F.col("pos").cast("long").alias("pos"), "node"), wires.select("gid", "side", "pos", "node"), spark.createDataFrame([], QUOTIENT))

    @staticmethod
    def discrete(nodes: DataFrame) -> Diagram:
        """Only nodes (gid, node, label)."""
        return replace(Diagram.empty(nodes.sparkSession), nodes=nodes.select("gid", "node", "label"))

    @staticmethod
    def singletons(operations: DataFrame) -> Diagram:
        """A diagram of one operation, on nodes of its own, for each row (gid, label, src_types, tgt_types)."""
        return Diagram.from_operations(operations.select("gid", F.lit(0).cast("long").alias("edge"), "label", "src_types", "tgt_types"))

    @staticmethod
    def identity(nodes: DataFrame) -> Diagram:
        """Only wires: each node is a source and a target."""
        spark = nodes.sparkSession
        both = nodes.select("gid", F.explode(F.array(F.lit("s"), F.lit("t"))).alias("side"), F.col("node").alias("pos"), "node")
        return replace(Diagram.empty(spark), nodes=nodes, interface=both)

    @staticmethod
    def spider(nodes: DataFrame, legs: DataFrame) -> Diagram | None:
        """Only wires with any ``legs`` (gid, side, pos, node); None if one is not a node."""
        lost = legs.join(nodes, ["gid", "node"], "left_anti")
        return replace(Diagram.empty(nodes.sparkSession), nodes=nodes, interface=legs) if lost.isEmpty() else None

    @staticmethod
    def half_spider(nodes: DataFrame, legs: DataFrame) -> Diagram | None:
        """As ``spider`` with the sources ``legs`` (gid, pos, node) and every node a target."""
        targets = nodes.select("gid", F.lit("t").alias("side"), F.col("node").alias("pos"), "node")
        return Diagram.spider(nodes, legs.select("gid", F.lit("s").alias("side"), "pos", "node").unionByName(targets))

    def terms(self) -> dict[int, Term]:
        """All diagrams on the driver: for small ones."""
        out: dict[int, Term] = {}
        of = lambda g: out.setdefault(g, Term())
        for r in self.nodes.orderBy("gid", "node").collect():
            of(r["gid"]).nodes.append(r["label"])
        for r in self.edges.orderBy("gid", "edge").collect():
            of(r["gid"]).edges.append(r["label"])
            of(r["gid"]).adjacency.append(([], []))
        for r in self.incidence.orderBy("gid", "edge", "side", "pos").collect():
            of(r["gid"]).adjacency[r["edge"]]["st".index(r["side"])].append(r["node"])
        for r in self.interface.orderBy("gid", "side", "pos").collect():
            t = of(r["gid"])
            (t.sources if r["side"] == "s" else t.targets).append(r["node"])
        for r in self.quotient.orderBy("gid", "seq").collect():
            of(r["gid"]).quotient_pairs.append((r["a"], r["b"]))
        return out

    def nested(self) -> DataFrame:
        """(gid, edge, label, sources, targets): operations with their lists, as rows."""
        side = lambda s: F.transform(F.sort_array(F.collect_list(F.when(F.col("side") == s, F.struct("pos", "node")))), lambda x: x["node"])
        lists = self.incidence.groupBy("gid", "edge").agg(side("s").alias("sources"), side("t").alias("targets"))
        none = F.array().cast("array<bigint>")
        return self.edges.join(dealt(lists), ["gid", "edge"], "left").select("gid", "edge", "label", F.coalesce("sources", none).alias("sources"), F.coalesce("targets", none).alias("targets"))

    @staticmethod
    def from_nested(nodes: DataFrame, operations: DataFrame, interface: DataFrame, quotient: DataFrame | None = None) -> Diagram:
        rows = operations.select("gid", "edge", F.lit("s").alias("side"), F.posexplode("sources").alias("pos", "node")).unionByName(operations.select("gid", "edge", F.lit("t").alias("side"), F.posexplode("targets").alias("pos", "node")))
        return Diagram(nodes, operations.select("gid", "edge", "label"), rows.withColumn("pos", F.col("pos").cast("long")), interface, quotient if quotient is not None else nodes.sparkSession.createDataFrame([], QUOTIENT))

    # Reading

    def sizes(self) -> DataFrame:
        """(gid, n_nodes, n_edges, n_s, n_t, n_q) of every diagram that has any row."""
        count = lambda df, name: df.groupBy("gid").agg(F.count("*").alias(name))
        parts = [count(self.nodes, "n_nodes"), count(self.edges, "n_edges"), count(self.interface.where("side = 's'"), "n_s"), count(self.interface.where("side = 't'"), "n_t"), count(self.quotient, "n_q")]
        out = parts[0]
        for p in parts[1:]:
            out = out.join(dealt(p), "gid", "full")
        return out.fillna(0)

    def boundary(self, side: str) -> DataFrame:
        """(gid, pos, label): the labels of a boundary."""
        return self.interface.where(F.col("side") == side).join(dealt(self.nodes), ["gid", "node"]).select("gid", "pos", "label")

    def operations(self) -> DataFrame:
        """(gid, edge, label, src_types, tgt_types)."""
        types = self.incidence.join(dealt(self.nodes.withColumnRenamed("label", "type")), ["gid", "node"])
        side = lambda s: F.transform(F.sort_array(F.collect_list(F.when(F.col("side") == s, F.struct("pos", "type")))), lambda x: x["type"])
        lists = types.groupBy("gid", "edge").agg(side("s").alias("src_types"), side("t").alias("tgt_types"))
        none = F.array().cast(lists.schema["src_types"].dataType)
        return self.edges.join(dealt(lists), ["gid", "edge"], "left").select("gid", "edge", "label", F.coalesce("src_types", none).alias("src_types"), F.coalesce("tgt_types", none).alias("tgt_types"))

    def problems(self) -> DataFrame:
        """(gid, problem): the first thing that is wrong with each invalid diagram."""
        def odd(rows: DataFrame, against: DataFrame, keys: list[str], names: dict[str, tuple[int, str]]) -> DataFrame:
            of = F.when(F.col("side") == "s", F.struct(*map(F.lit, names["s"]))).otherwise(F.struct(*map(F.lit, names["t"])))
            lost = rows.where("side IN ('s', 't')").join(dealt(against), keys, "left_anti").select("gid", of.alias("p"))
            return lost.select("gid", F.col("p.col1").alias("rank"), F.col("p.col2").alias("problem"))

        found = odd(self.incidence, self.edges, ["gid", "edge"], {side: (0, "SourcesCount") for side in "st"})
        found = found.unionByName(odd(self.incidence, self.nodes, ["gid", "node"], {"s": (1, "SourcesSet"), "t": (2, "TargetsSet")}))
        found = found.unionByName(odd(self.interface, self.nodes, ["gid", "node"], {"s": (3, "CospanSourceType"), "t": (4, "CospanTargetType")}))
        return found.groupBy("gid").agg(F.min_by("problem", "rank").alias("problem"))

    def validate(self) -> Diagram:
        first = self.problems().orderBy("gid").first()
        if first:
            raise InvalidDiagram(f"{first['problem']} in diagram {first['gid']}")
        return self

    def kept(self) -> Diagram:
        """The same, each table computed once; of identifications none are kept where there are none."""
        names = ("nodes", "edges", "incidence", "interface")
        parts = {name: stored(getattr(self, name), name) for name in names}
        return replace(self, **parts, quotient=self.quotient if self.is_strict() else stored(self.quotient, "pending"))

    def is_strict(self) -> bool:
        return self.quotient.isEmpty()

    def is_discrete(self) -> bool:
        return self.edges.isEmpty()

    def degrees(self, side: str) -> DataFrame:
        """(gid, node, degree): occurrences as target ('t', in-degree) or source ('s', out-degree), zeros too."""
        counts = self.incidence.where(F.col("side") == side).groupBy("gid", "node").agg(F.count("*").alias("n"))
        return self.nodes.join(dealt(counts), ["gid", "node"], "left").select("gid", "node", F.coalesce("n", F.lit(0)).alias("degree"))

    def monogamous_nodes(self) -> DataFrame:
        """(gid, node, monogamous): whether it has one maker and one user, operations and boundaries taken together."""
        side = lambda s: F.count_if(F.col("side") == s)
        inner = self.incidence.groupBy("gid", "node").agg(side("t").alias("made"), side("s").alias("used"))
        outer = self.interface.groupBy("gid", "node").agg(side("s").alias("given"), side("t").alias("taken"))
        x = self.nodes.join(dealt(inner), ["gid", "node"], "left").join(dealt(outer), ["gid", "node"], "left").fillna(0, ["made", "used", "given", "taken"])
        return x.select("gid", "node", ((F.col("made") + F.col("given") == 1) & (F.col("used") + F.col("taken") == 1)).alias("monogamous"))

    def is_monogamous(self) -> DataFrame:
        """(gid, monogamous). A boundary that names a node twice is not; neither is a node that touches nothing."""
        return self.monogamous_nodes().groupBy("gid").agg(F.min("monogamous").alias("monogamous"))

    # Building: rows are numbered behind what is there, diagram by diagram, in the order of ``seq``

    def new_nodes(self, rows: DataFrame) -> tuple[Diagram, DataFrame]:
        """With the nodes (gid, seq, label), and (gid, seq, node): where they are."""
        made = cut(_shift(indexed(rows, ["seq"], "node", ("gid",)), cut(self.sizes()), node="n_nodes"))
        return replace(self, nodes=self.nodes.unionByName(made.select("gid", "node", "label"))), made.select("gid", "seq", "node")

    def new_edges(self, rows: DataFrame) -> tuple[Diagram, DataFrame]:
        """With the operations (gid, seq, label, sources, targets) on nodes that are there, which is not checked, and (gid, seq, edge)."""
        made = cut(_shift(indexed(rows, ["seq"], "edge", ("gid",)), cut(self.sizes()), edge="n_edges"))
        legs = lambda side, c: made.select("gid", "edge", F.lit(side).alias("side"), F.posexplode(c).alias("pos", "node"))
        wires = legs("s", "sources").unionByName(legs("t", "targets")).withColumn("pos", F.col("pos").cast("long"))
        return replace(self, edges=self.edges.unionByName(made.select("gid", "edge", "label")), incidence=self.incidence.unionByName(wires)), made.select("gid", "seq", "edge")

    def new_operations(self, rows: DataFrame) -> tuple[Diagram, DataFrame]:
        """With the operations (gid, seq, label, src_types, tgt_types) on nodes of their own, each on its sources and then its targets, and (gid, seq, edge)."""
        rows = cut(rows)
        types = rows.select("gid", F.col("seq").alias("op"), F.posexplode(F.concat("src_types", "tgt_types")).alias("k", "label"))
        grown, places = self.new_nodes(types.select("gid", F.struct("op", "k").alias("seq"), "label"))
        lists = places.groupBy("gid", F.col("seq.op").alias("seq")).agg(F.transform(F.sort_array(F.collect_list(F.struct("seq.k", "node"))), lambda x: x["node"]).alias("all"))
        none, n = F.array().cast("array<bigint>"), F.size("src_types")
        on = rows.join(lists, ["gid", "seq"], "left").withColumn("all", F.coalesce("all", none))
        return grown.new_edges(on.select("gid", "seq", "label", F.slice("all", 1, n).alias("sources"), F.slice("all", n + 1, F.size("tgt_types")).alias("targets")))

    def new_legs(self, rows: DataFrame) -> tuple[Diagram, DataFrame]:
        """With a new node (gid, seq, edge, side, label) behind the other legs of an operation's side, and (gid, seq, node)."""
        grown, places = self.new_nodes(rows.select("gid", "seq", "label"))
        have = self.incidence.groupBy("gid", "edge", "side").agg(F.count("*").alias("n"))
        legs = indexed(rows.join(places, ["gid", "seq"]), ["seq"], "pos", ("gid", "edge", "side")).join(have, ["gid", "edge", "side"], "left")
        legs = legs.select("gid", "edge", "side", (F.col("pos") + F.coalesce("n", F.lit(0))).alias("pos"), "node")
        return replace(grown, incidence=self.incidence.unionByName(legs)), places

    # Relabelling

    def map_nodes(self, f: Callable[[Column], Column]) -> Diagram:
        return replace(self, nodes=self.nodes.withColumn("label", f(F.col("label"))))

    def map_edges(self, f: Callable[[Column], Column]) -> Diagram:
        return replace(self, edges=self.edges.withColumn("label", f(F.col("label"))))

    def with_nodes(self, f: Callable[[DataFrame], DataFrame]) -> Diagram | None:
        """All labels (gid, node, label) replaced at once; None if it does not keep the nodes."""
        new = cut(f(self.nodes).select("gid", "node", "label"))
        same = new.count() == self.nodes.count() and new.join(self.nodes, ["gid", "node"], "left_anti").isEmpty()
        return replace(self, nodes=new) if same else None

    def with_edges(self, f: Callable[[DataFrame], DataFrame]) -> Diagram | None:
        new = cut(f(self.edges).select("gid", "edge", "label"))
        same = new.count() == self.edges.count() and new.join(self.edges, ["gid", "edge"], "left_anti").isEmpty()
        return replace(self, edges=new) if same else None

    # Deletion

    def delete_edges(self, gone: DataFrame) -> Diagram:
        """Without the operations ``gone`` (gid, edge); the others are numbered anew in order, nodes stay."""
        _within(gone, self.edges, ["gid", "edge"])
        kept = cut(indexed(self.edges.join(dealt(gone), ["gid", "edge"], "left_anti"), ["edge"], "new", ("gid",)))
        inc = self.incidence.join(dealt(kept.select("gid", "edge", "new")), ["gid", "edge"]).select("gid", F.col("new").alias("edge"), "side", "pos", "node")
        return replace(self, edges=kept.select("gid", F.col("new").alias("edge"), "label"), incidence=inc)

    def delete_nodes_witness(self, gone: DataFrame) -> tuple[Diagram, DataFrame]:
        """Without the nodes ``gone`` (gid, node) wherever they occur, and (gid, node, new), null for those that went; operations stay."""
        _within(gone, self.nodes, ["gid", "node"])
        kept = cut(indexed(self.nodes.join(gone, ["gid", "node"], "left_anti"), ["node"], "new", ("gid",)))
        to = kept.select("gid", "node", "new")

        def packed(rows: DataFrame, by: list[str]) -> DataFrame:
            return indexed(rows.join(to, ["gid", "node"]).withColumnRenamed("pos", "was"), ["was"], "pos", tuple(by)).withColumn("node", F.col("new"))

        pairs = self.quotient
        for c in ("a", "b"):
            pairs = pairs.join(to.select("gid", F.col("node").alias(c), F.col("new").alias(f"{c}_")), ["gid", c])
        pairs = indexed(pairs.select("gid", F.col("seq").alias("was"), F.col("a_").alias("a"), F.col("b_").alias("b")), ["was"], "seq", ("gid",)).select("gid", "seq", "a", "b")
        out = Diagram(kept.select("gid", F.col("new").alias("node"), "label"), self.edges, packed(self.incidence, ["gid", "edge", "side"]).select("gid", "edge", "side", "pos", "node"), packed(self.interface, ["gid", "side"]).select("gid", "side", "pos", "node"), pairs)
        return out, self.nodes.select("gid", "node").join(to, ["gid", "node"], "left")

    def delete_nodes(self, gone: DataFrame) -> Diagram:
        return self.delete_nodes_witness(gone)[0]

    # Combination, gid by gid

    def coproduct(self, other: Diagram) -> Diagram:
        """Side by side, with the boundaries of this one."""
        return replace(self.tensor(other), interface=self.interface)

    __add__ = coproduct

    def tensor(self, other: Diagram) -> Diagram:
        by = cut(self.sizes())
        right = other._moved(by)
        return Diagram(*[a.unionByName(b) for a, b in zip(self._tables(), right._tables(), strict=True)])

    __or__ = tensor

    def append(self, other: Diagram) -> tuple[Diagram, DataFrame]:
        """``coproduct``, and where the boundaries of ``other`` are now."""
        by = cut(self.sizes())
        return self.coproduct(other), _shift(other.interface, by, node="n_nodes")

    def _tables(self) -> tuple[DataFrame, ...]:
        return self.nodes, self.edges, self.incidence, self.interface, self.quotient

    def _moved(self, by: DataFrame) -> Diagram:
        """This diagram with its ids behind those counted in ``by``."""
        sized = by.select("gid", "n_nodes", "n_edges", "n_s", "n_t", "n_q")
        sides = [_shift(self.interface.where(F.col("side") == s), sized, node="n_nodes", pos=f"n_{s}") for s in "st"]
        return Diagram(_shift(self.nodes, sized, node="n_nodes"), _shift(self.edges, sized, edge="n_edges"), _shift(self.incidence, sized, edge="n_edges", node="n_nodes"), sides[0].unionByName(sides[1]), _shift(self.quotient, sized, seq="n_q", a="n_nodes", b="n_nodes"))

    def lax_compose(self, other: Diagram) -> Diagram | None:
        """Targets joined to the sources of ``other``, pending, whatever their labels; None if their numbers differ in a diagram."""
        by = cut(self.sizes())
        right = other._moved(by.withColumn("n_s", F.lit(0)).withColumn("n_t", F.lit(0)))
        joint = self.interface.where("side = 't'").select("gid", "pos", F.col("node").alias("a")).join(right.interface.where("side = 's'").select("gid", "pos", F.col("node").alias("b")), ["gid", "pos"], "full")
        joint = cut(joint)
        if not joint.where("a IS NULL OR b IS NULL").isEmpty():
            return None
        pairs = self.quotient.unionByName(right.quotient)
        counted = cut(pairs.groupBy("gid").agg(F.count("*").alias("n")))
        new = _shift(joint.select("gid", F.col("pos").alias("seq"), "a", "b"), counted, seq="n")
        face = self.interface.where("side = 's'").unionByName(right.interface.where("side = 't'"))
        first = [a.unionByName(b) for a, b in zip(self._tables()[:3], right._tables()[:3], strict=True)]
        return Diagram(*first, face, pairs.unionByName(new))

    def compose(self, other: Diagram) -> Diagram | None:
        """As ``lax_compose``; None if labels between differ."""
        a, b = self.boundary("t"), other.boundary("s").withColumnRenamed("label", "other").withColumn("there", F.lit(True))
        odd = a.withColumn("here", F.lit(True)).join(b, ["gid", "pos"], "full").where(F.col("here").isNull() | F.col("there").isNull() | ~F.col("label").eqNullSafe(F.col("other")))
        return self.lax_compose(other) if odd.isEmpty() else None

    __rshift__ = compose

    def dagger(self) -> Diagram:
        return replace(self, interface=self.interface.withColumn("side", F.when(F.col("side") == "s", "t").otherwise("s")))

    @staticmethod
    def twist(a: DataFrame, b: DataFrame) -> Diagram:
        """Swaps two blocks of wires (gid, node, label); nodes stand in the order of the targets."""
        spark = a.sparkSession
        count = lambda df, n: df.groupBy("gid").agg(F.count("*").alias(n))
        na, nb = cut(count(a, "na")), cut(count(b, "nb"))
        nodes = b.select("gid", "node", "label").unionByName(_shift(a, nb, node="nb"))
        sources = _shift(a.select("gid", F.lit("s").alias("side"), F.col("node").alias("pos"), "node"), nb, node="nb").unionByName(_shift(b.select("gid", F.lit("s").alias("side"), F.col("node").alias("pos"), "node"), na, pos="na"))
        targets = nodes.select("gid", F.lit("t").alias("side"), F.col("node").alias("pos"), "node")
        return replace(Diagram.empty(spark), nodes=nodes, interface=sources.unionByName(targets))

    def unify(self, pairs: DataFrame) -> Diagram:
        """Records identifications (gid, seq, a, b) behind those that are pending."""
        counted = cut(self.quotient.groupBy("gid").agg(F.count("*").alias("n")))
        return replace(self, quotient=self.quotient.unionByName(_shift(pairs, counted, seq="n").select("gid", "seq", "a", "b")))

    def coequalizer(self) -> DataFrame:
        """(gid, node, component): where the pending identifications take each node."""
        q = quotient_map(self.nodes.select("gid", F.col("node").alias("id")), self.quotient.select("gid", "a", "b"), ("gid",))
        return q.withColumnRenamed("id", "node")

    def quotiented(self) -> tuple[Diagram, DataFrame]:
        """The strict diagram, and (gid, node, component); raises LabelConflict if nodes of different labels are to be one."""
        q = stored(self.coequalizer(), "quotient")
        labels = stored(push_labels(q.withColumnRenamed("node", "id"), self.nodes.select("gid", F.col("node").alias("id"), "label"), ("gid",)), "labels")
        bad = labels.where("clash").first()
        if bad:
            raise LabelConflict(f"node {bad['component']} of diagram {bad['gid']}")
        at = lambda df: df.join(dealt(q), ["gid", "node"]).withColumn("node", F.col("component")).select(*df.columns)
        nodes = labels.select("gid", F.col("component").alias("node"), "label")
        return Diagram(nodes, self.edges, at(self.incidence), at(self.interface), self.quotient.limit(0)), q

    def strict(self) -> Diagram:
        return (self if self.is_strict() else self.quotiented()[0]).validate()


def _within(some: DataFrame, rows: DataFrame, keys: list[str]) -> None:
    if not some.join(dealt(rows), keys, "left_anti").isEmpty():
        raise IndexError(f"no such {keys[-1]}")
