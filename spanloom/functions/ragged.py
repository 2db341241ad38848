"""Ragged arrays: values ``v`` at place ``pos`` of segment ``seg``; empty segments have no rows."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import arrays
from .finite import FiniteFunction, Labels
from .lineage import indexed, prefix_sum, unfolded


@dataclass(frozen=True)
class Ragged:
    """``n`` segments; values lie below ``target``, or are labels if it is None."""

    table: DataFrame
    n: int
    target: int | None = None

    @staticmethod
    def new(sizes: DataFrame, values: DataFrame, target: int | None = None) -> Ragged | None:
        """From (i, v) sizes and values one after another; None unless the sizes add up to the number of values."""
        n, total = sizes.agg(F.count("*"), F.coalesce(F.sum("v"), F.lit(0))).first()
        if total != values.count():
            return None
        starts = prefix_sum(sizes, F.col("v"), ["i"], "s_")
        owner = unfolded(starts, F.col("v"), "pos").select(F.col("i").alias("seg"), "pos", (F.col("s_") + F.col("pos")).alias("at_"))
        return Ragged(owner.join(values, F.col("at_") == F.col("i")).select("seg", "pos", "v"), n, target)

    @staticmethod
    def of(spark: SparkSession, lists: list[list], target: int | None = None, kind: str = "bigint") -> Ragged:
        rows = [(s, p, v) for s, x in enumerate(lists) for p, v in enumerate(x)]
        return Ragged(spark.createDataFrame(rows, f"seg bigint, pos bigint, v {kind}"), len(lists), target)

    @staticmethod
    def singleton(values: DataFrame, target: int | None = None) -> Ragged:
        """One segment that holds everything."""
        return Ragged(values.select(F.lit(0).cast("long").alias("seg"), F.col("i").alias("pos"), "v"), 1, target)

    @staticmethod
    def elements(values: DataFrame, n: int, target: int | None = None) -> Ragged:
        """A segment for each element."""
        return Ragged(values.select(F.col("i").alias("seg"), F.lit(0).cast("long").alias("pos"), "v"), n, target)

    @staticmethod
    def initial(spark: SparkSession, target: int) -> Ragged:
        return Ragged.of(spark, [], target)

    def is_empty(self) -> bool:
        return self.n == 0

    def is_valid(self) -> bool:
        """Places are dense in each segment, segments are below ``n`` and values below ``target``."""
        odd = self.table.groupBy("seg").agg((F.max("pos") + 1 != F.count("*")).alias("a"), (F.countDistinct("pos") != F.count("*")).alias("b"))
        out = self.table.where((F.col("seg") >= self.n) | (F.col("seg") < 0) | (F.col("v") >= self.target if self.target is not None else F.lit(False)))
        return odd.where("a OR b").isEmpty() and out.isEmpty()

    def sizes(self) -> DataFrame:
        """(i, v) with zeros for empty segments."""
        counts = self.table.groupBy(F.col("seg").alias("k_")).agg(F.count("*").alias("n_"))
        return self.table.sparkSession.range(self.n).withColumnRenamed("id", "i").join(counts, F.col("i") == F.col("k_"), "left").select("i", F.coalesce("n_", F.lit(0)).alias("v"))

    def values(self) -> DataFrame:
        """All values in order, as an (i, v) array."""
        return indexed(self.table, ["seg", "pos"]).select("i", "v")

    def lists(self) -> Iterator[list]:
        """The segments in order, empty ones too, one at a time from the workers."""
        packed = self.table.groupBy("seg").agg(F.sort_array(F.collect_list(F.struct("pos", "v"))).alias("l"))
        at = 0
        for row in packed.orderBy("seg").toLocalIterator():
            for _ in range(at, row["seg"]):
                yield []
            yield [x["v"] for x in row["l"]]
            at = row["seg"] + 1
        for _ in range(at, self.n):
            yield []

    def map_values(self, f: FiniteFunction) -> Ragged | None:
        if self.target != f.source:
            return None
        x = self.table.join(f.table.select(F.col("i").alias("k_"), F.col("v").alias("w_")), F.col("v") == F.col("k_"))
        return Ragged(x.select("seg", "pos", F.col("w_").alias("v")), self.n, f.target)

    def map_labels(self, f: Labels) -> Ragged | None:
        if self.target != f.n:
            return None
        x = self.table.join(f.table.select(F.col("i").alias("k_"), F.col("v").alias("w_")), F.col("v") == F.col("k_"))
        return Ragged(x.select("seg", "pos", F.col("w_").alias("v")), self.n, None)

    def map_indexes(self, f: FiniteFunction) -> Ragged | None:
        """Segment i is the old segment ``f(i)``."""
        if f.target != self.n:
            return None
        x = f.table.select("i", F.col("v").alias("k_")).join(self.table, F.col("k_") == F.col("seg"))
        return Ragged(x.select(F.col("i").alias("seg"), "pos", "v"), f.source, self.target)

    def indexed_values(self, f: FiniteFunction) -> DataFrame | None:
        got = self.map_indexes(f)
        return None if got is None else got.values()

    def _packed(self, rows: DataFrame, order: list[str], n: int, target: int | None) -> Ragged:
        """Rows (seg, *order, v) with places counted anew in each segment, which may fill any number of parts."""
        return Ragged(indexed(rows, order, "pos", ("seg",)).select("seg", "pos", "v"), n, target)

    def flatmap(self, other: Ragged) -> Ragged:
        """Lists of lists run together: every value replaced by its list, order and repeats kept.

        A list begins where those before it in its segment end, so only values are numbered, and what comes out,
        which may be far more, is neither sorted nor kept.
        """
        sizes = other.table.groupBy(F.col("seg").alias("k_")).agg(F.count("*").alias("n_"))
        at = self.table.join(sizes, F.col("v") == F.col("k_")).select("seg", "pos", "v", "n_")
        at = prefix_sum(at, F.col("n_"), ["pos"], "s_", ("seg",)).select("seg", "s_", F.col("v").alias("was_"))
        inner = other.table.select(F.col("seg").alias("k_"), F.col("pos").alias("q_"), F.col("v"))
        x = at.join(inner, F.col("was_") == F.col("k_")).select("seg", (F.col("s_") + F.col("q_")).alias("pos"), "v")
        return Ragged(x, self.n, other.target)

    def flatmap_sources(self, other: Ragged) -> Ragged:
        """``other`` has a segment for each value of this; they are merged by the segments of this."""
        at = indexed(self.table.select(F.col("seg").alias("s_"), F.col("pos").alias("p_")), ["s_", "p_"], "k_")
        if at.count() != other.n:
            raise ValueError("there is not a segment for each value")
        x = at.join(other.table.select(F.col("seg").alias("o_"), F.col("pos").alias("q_"), "v"), F.col("k_") == F.col("o_"))
        return self._packed(x.select(F.col("s_").alias("seg"), "p_", "q_", "v"), ["p_", "q_"], self.n, other.target)

    def coproduct(self, other: Ragged) -> Ragged | None:
        if self.target != other.target:
            return None
        return Ragged(self.table.unionByName(other.table.withColumn("seg", F.col("seg") + self.n)), self.n + other.n, self.target)

    __add__ = coproduct

    def tensor(self, other: Ragged) -> Ragged:
        right = other.table.select((F.col("seg") + self.n).alias("seg"), "pos", (F.col("v") + self.target).alias("v"))
        return Ragged(self.table.unionByName(right), self.n + other.n, self.target + other.target)

    __or__ = tensor

    def converse(self) -> Ragged:
        """For each value below ``target`` the segments it occurs in, ascending, as often as it does."""
        x = self.table.select(F.col("v").alias("seg"), F.col("seg").alias("v"), F.col("pos").alias("p_"))
        return self._packed(x, ["v", "p_"], self.target, self.n)

    def indegree(self) -> DataFrame:
        """How often each value occurs."""
        return arrays.bincount(self.table.select(F.col("seg").alias("i"), "v"), self.target)

    def relative_indegree(self, subset: FiniteFunction) -> DataFrame:
        """As ``indegree``, of the segments of ``subset`` only, and as often as they stand in it."""
        return self.map_indexes(subset).indegree()

    def sparse_relative_indegree(self, subset: FiniteFunction) -> tuple[DataFrame, DataFrame]:
        """The values that occur in the segments of ``subset``, ascending, and how often."""
        return arrays.sparse_bincount(self.map_indexes(subset).table.select(F.col("seg").alias("i"), "v"))

    def successors(self, frontier: DataFrame) -> DataFrame:
        """(v): the distinct values of the segments in ``frontier`` (v)."""
        return self.table.join(frontier.select(F.col("v").alias("k_")).distinct(), F.col("seg") == F.col("k_"), "left_semi").select("v").distinct()


def converse_iter(f: FiniteFunction) -> Iterator[list[int]]:
    """For each value of ``f`` the places that have it, ascending."""
    return Ragged.elements(f.table, f.source, f.target).converse().lists()
