"""Finite functions: an (i, v) table with the sizes of its domain and codomain; and label arrays."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import arrays


@dataclass(frozen=True)
class FiniteFunction:
    """``table`` from 0..source into 0..target."""

    table: DataFrame
    source: int
    target: int

    @staticmethod
    def new(table: DataFrame, target: int) -> FiniteFunction | None:
        """None if a value lies beyond ``target``; an empty table goes into any."""
        n, most, least = table.agg(F.count("*"), F.max("v"), F.min("v")).first()
        return None if n and (most >= target or least < 0) else FiniteFunction(table, n, target)

    @staticmethod
    def of(spark: SparkSession, values: list[int], target: int) -> FiniteFunction | None:
        return FiniteFunction.new(arrays.array(spark, values), target)

    @staticmethod
    def _by(spark: SparkSession, n: int, value: Column, target: int) -> FiniteFunction:
        return FiniteFunction(spark.range(n).select(F.col("id").alias("i"), value.cast("long").alias("v")), n, target)

    @staticmethod
    def identity(spark: SparkSession, n: int) -> FiniteFunction:
        return FiniteFunction._by(spark, n, F.col("id"), n)

    @staticmethod
    def terminal(spark: SparkSession, n: int) -> FiniteFunction:
        return FiniteFunction._by(spark, n, F.lit(0), 1)

    @staticmethod
    def constant(spark: SparkSession, n: int, x: int, b: int) -> FiniteFunction:
        """All ``x``, into ``x + b + 1``."""
        return FiniteFunction._by(spark, n, F.lit(x), x + b + 1)

    @staticmethod
    def initial(spark: SparkSession, target: int) -> FiniteFunction:
        return FiniteFunction._by(spark, 0, F.lit(0), target)

    @staticmethod
    def unit() -> int:
        return 0

    @staticmethod
    def inj0(spark: SparkSession, a: int, b: int) -> FiniteFunction:
        return FiniteFunction._by(spark, a, F.col("id"), a + b)

    @staticmethod
    def inj1(spark: SparkSession, a: int, b: int) -> FiniteFunction:
        return FiniteFunction._by(spark, b, F.col("id") + a, a + b)

    @staticmethod
    def twist(spark: SparkSession, a: int, b: int) -> FiniteFunction:
        """The first ``a`` go behind the other ``b``."""
        return FiniteFunction._by(spark, a + b, F.when(F.col("id") < a, F.col("id") + b).otherwise(F.col("id") - a), a + b)

    @staticmethod
    def transpose(spark: SparkSession, a: int, b: int) -> FiniteFunction:
        """i to (i mod a) * b + i div a."""
        return FiniteFunction._by(spark, a * b, (F.col("id") % a) * b + F.floor(F.col("id") / a) if a else F.col("id"), a * b)

    def inject0(self, b: int) -> FiniteFunction:
        return FiniteFunction(self.table, self.source, self.target + b)

    def inject1(self, a: int) -> FiniteFunction:
        return FiniteFunction(self.table.select("i", (F.col("v") + a).alias("v")), self.source, self.target + a)

    def compose(self, other: FiniteFunction) -> FiniteFunction | None:
        if self.target != other.source:
            return None
        return FiniteFunction(arrays.gather(other.table, self.table), self.source, other.target)

    __rshift__ = compose

    def compose_labels(self, labels: Labels) -> Labels | None:
        return Labels(arrays.gather(labels.table, self.table), self.source) if self.target == labels.n else None

    def coproduct(self, other: FiniteFunction) -> FiniteFunction | None:
        if self.target != other.target:
            return None
        return FiniteFunction(arrays.concatenate(self.table, other.table, self.source), self.source + other.source, self.target)

    __add__ = coproduct

    def tensor(self, other: FiniteFunction) -> FiniteFunction:
        return self.inject0(other.target).coproduct(other.inject1(self.target))

    __or__ = tensor

    def is_injective(self) -> bool:
        return self.table.groupBy("v").count().where("count > 1").isEmpty()

    def cumulative_sum(self) -> FiniteFunction:
        """Sums of what stands before each, into their total."""
        from .lineage import prefix_sum

        return FiniteFunction(prefix_sum(self.table, F.col("v"), ["i"], "s_").select("i", F.col("s_").alias("v")), self.source, arrays.total(self.table))

    def injections(self, a: FiniteFunction) -> FiniteFunction | None:
        """This gives block sizes; each ``a(x)`` becomes the places of its block, in order."""
        if a.target != self.source:
            return None
        from .lineage import prefix_sum, unfolded

        blocks = prefix_sum(self.table, F.col("v"), ["i"], "s_").select(F.col("i").alias("b_"), F.col("v").alias("n_"), "s_")
        picked = prefix_sum(a.table.join(blocks, F.col("v") == F.col("b_")).select("i", "n_", "s_"), F.col("n_"), ["i"], "at_")
        long = unfolded(picked, F.col("n_")).select((F.col("at_") + F.col("p_")).alias("i"), (F.col("s_") + F.col("p_")).alias("v"))
        return FiniteFunction(long, arrays.total(picked.select(F.col("n_").alias("v"))), arrays.total(self.table))

    def coequalizer(self, other: FiniteFunction) -> FiniteFunction | None:
        """The quotient of the codomain by ``f(i) ~ g(i)``; None unless both have the same domain and codomain."""
        if (self.source, self.target) != (other.source, other.target):
            return None
        from ..operators.components import connected_components

        q, k = connected_components(self.table, other.table, self.target)
        return FiniteFunction(q, self.target, k)

    def coequalizer_universal(self, f: Labels | FiniteFunction) -> Labels | FiniteFunction | None:
        """``f`` on the classes of this quotient; None if a class has several values or the lengths differ."""
        n = f.n if isinstance(f, Labels) else f.source
        if n != self.source:
            return None
        from ..operators.components import push_labels
        from .lineage import cut

        got = cut(push_labels(self.table.select(F.col("i").alias("id"), F.col("v").alias("component")), f.table.select(F.col("i").alias("id"), F.col("v").alias("label"))))
        if not got.where("clash").isEmpty():
            return None
        table = got.select(F.col("component").alias("i"), F.col("label").alias("v"))
        return Labels(table, self.target) if isinstance(f, Labels) else FiniteFunction(table, self.target, f.target)


@dataclass(frozen=True)
class Labels:
    """An array of labels of any type that groups and compares."""

    table: DataFrame
    n: int

    @staticmethod
    def of(spark: SparkSession, values: list, kind: str = "string") -> Labels:
        return Labels(arrays.array(spark, values, kind), len(values))

    @staticmethod
    def singleton(spark: SparkSession, value, kind: str = "string") -> Labels:
        return Labels.of(spark, [value], kind)

    def is_zero(self) -> bool:
        return self.n == 0

    def coproduct(self, other: Labels) -> Labels:
        return Labels(arrays.concatenate(self.table, other.table, self.n), self.n + other.n)

    __add__ = coproduct


def compose(left: FiniteFunction | Labels | None, right: FiniteFunction | Labels | None) -> FiniteFunction | Labels | None:
    """Composition where labels stand on the right: a finite function goes before either, None stands for an identity on labels."""
    if left is None or right is None or isinstance(left, Labels):
        return left if right is None and left is None else None
    return left.compose_labels(right) if isinstance(right, Labels) else left.compose(right)
