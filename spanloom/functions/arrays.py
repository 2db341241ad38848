"""The array algebra on (i, v) tables: element ``v`` at index ``i`` from 0.

Order is data, so every table carries its index. An index out of range is an error where it is used.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .lineage import indexed, prefix_sum, unfolded


def array(spark: SparkSession, values: list, kind: str = "bigint") -> DataFrame:
    """A short array from the driver."""
    return spark.createDataFrame(list(enumerate(values)), f"i bigint, v {kind}")


def values(a: DataFrame) -> list:
    """All elements in order, on the driver: for short arrays."""
    return [r["v"] for r in a.orderBy("i").select("v").collect()]


def empty(spark: SparkSession, kind: str = "bigint") -> DataFrame:
    return array(spark, [], kind)


def arange(spark: SparkSession, start: int, stop: int) -> DataFrame:
    """``start`` up to ``stop``, which it does not reach."""
    if stop < start:
        raise ValueError("stop lies before start")
    return spark.range(0, stop - start).select(F.col("id").alias("i"), (F.col("id") + start).alias("v"))


def fill(spark: SparkSession, x, n: int) -> DataFrame:
    return spark.range(n).select(F.col("id").alias("i"), F.lit(x).alias("v"))


def length(a: DataFrame) -> int:
    return a.count()


def is_empty(a: DataFrame) -> bool:
    return a.isEmpty()


def get(a: DataFrame, i: int):
    row = a.where(F.col("i") == i).select("v").first()
    if row is None:
        raise IndexError(i)
    return row[0]


def get_range(a: DataFrame, start: int, stop: int) -> DataFrame:
    """The slice from ``start`` to before ``stop``, indexed from 0; out of range is an error, as bounds are not clamped."""
    if start < 0 or stop < start or stop > a.count():
        raise IndexError((start, stop))
    return a.where(F.col("i").between(start, stop - 1)).select((F.col("i") - start).alias("i"), "v")


def set_range(a: DataFrame, start: int, new: DataFrame) -> DataFrame:
    """``a`` with ``new`` from ``start`` on."""
    return scatter_assign(a, new.select("i", (F.col("i") + start).alias("v")), new)


def concatenate(a: DataFrame, b: DataFrame, n: int | None = None) -> DataFrame:
    """``a`` then ``b``; ``n``, the length of ``a``, saves a count."""
    n = a.count() if n is None else n
    return a.select("i", "v").unionByName(b.select((F.col("i") + n).alias("i"), "v"))


def checked(found: Column, what: str) -> Column:
    return F.when(found.isNull(), F.raise_error(F.lit(what))).otherwise(found)


def gather(a: DataFrame, idx: DataFrame) -> DataFrame:
    """``a[idx[i]]``; an index out of range is an error."""
    x = idx.select("i", F.col("v").alias("k_")).join(a.select(F.col("i").alias("j_"), "v"), F.col("k_") == F.col("j_"), "left")
    return x.select("i", F.when(F.col("j_").isNull(), F.raise_error(F.lit("index out of range"))).otherwise(F.col("v")).alias("v"))


def _last(idx: DataFrame, x: DataFrame) -> DataFrame:
    """(k_, w_): of the writes of ``x`` to ``idx`` the last to each place; a longer side is cut off."""
    pairs = idx.select("i", F.col("v").alias("k_")).join(x.select("i", F.col("v").alias("x_")), "i")
    return pairs.groupBy("k_").agg(F.max_by(F.struct("x_"), "i")["x_"].alias("w_"), F.lit(True).alias("hit_"))


def scatter(x: DataFrame, idx: DataFrame, n: int) -> DataFrame:
    """An array of ``n`` with ``x[i]`` at ``idx[i]``: the last write wins, untouched places take ``x[0]``; of an empty ``x`` the result is empty."""
    first = x.where("i = 0").select("v").first()
    if first is None:
        return x.select("i", "v")
    out = x.sparkSession.range(n).withColumnRenamed("id", "i").join(_last(idx, x), F.col("i") == F.col("k_"), "left")
    return out.select("i", F.when(F.col("hit_"), F.col("w_")).otherwise(F.lit(first[0])).alias("v"))


def scatter_assign(a: DataFrame, idx: DataFrame, x: DataFrame) -> DataFrame:
    """``a`` with ``x[i]`` at ``idx[i]``; the last write wins, and the longer of both is cut off."""
    return a.join(_last(idx, x), F.col("i") == F.col("k_"), "left").select("i", F.when(F.col("hit_"), F.col("w_")).otherwise(F.col("v")).alias("v"))


def scatter_assign_constant(a: DataFrame, idx: DataFrame, value) -> DataFrame:
    hit = idx.select(F.col("v").alias("k_")).distinct()
    return a.join(hit, F.col("i") == F.col("k_"), "left").select("i", F.when(F.col("k_").isNotNull(), F.lit(value)).otherwise(F.col("v")).alias("v"))


def scatter_sub_assign(a: DataFrame, idx: DataFrame, x: DataFrame) -> DataFrame:
    """``a[idx[i]] -= x[i]``; repeated indices add up."""
    sums = idx.select("i", F.col("v").alias("k_")).join(x.select("i", F.col("v").alias("x_")), "i").groupBy("k_").agg(F.sum("x_").alias("s_"))
    return a.join(sums, F.col("i") == F.col("k_"), "left").select("i", (F.col("v") - F.coalesce("s_", F.lit(0))).alias("v"))


def pointwise(a: DataFrame, b: DataFrame, f) -> DataFrame:
    """``f(a[i], b[i])`` of arrays of equal length."""
    both = a.select("i", F.col("v").alias("a_")).join(b.select(F.col("i").alias("j_"), F.col("v").alias("b_")), F.col("i") == F.col("j_"), "full")
    odd = F.col("i").isNull() | F.col("j_").isNull()
    return both.select(F.coalesce("i", "j_").alias("i"), F.when(odd, F.raise_error(F.lit("lengths differ"))).otherwise(f(F.col("a_"), F.col("b_"))).alias("v"))


def add(a: DataFrame, b: DataFrame | int) -> DataFrame:
    return a.select("i", (F.col("v") + b).alias("v")) if isinstance(b, int) else pointwise(a, b, lambda x, y: x + y)


def sub(a: DataFrame, b: DataFrame) -> DataFrame:
    """Signed: it does not wrap."""
    return pointwise(a, b, lambda x, y: x - y)


def quot_rem(a: DataFrame, d: int) -> tuple[DataFrame, DataFrame]:
    """Quotients first, then remainders."""
    if d == 0:
        raise ZeroDivisionError
    return a.select("i", F.expr(f"v div {d}").alias("v")), a.select("i", (F.col("v") % d).alias("v"))


def mul_constant_add(a: DataFrame, c: int, x: DataFrame) -> DataFrame:
    return pointwise(a, x, lambda p, q: p * c + q)


def repeat(k: DataFrame, x: DataFrame) -> DataFrame:
    """``x[i]`` ``k[i]`` times, in order. A count may be as large as the whole result."""
    both = pointwise(k, x, lambda n, v: F.struct(n.alias("n"), v.alias("x")))
    starts = prefix_sum(both, F.col("v.n"), ["i"], "s_")
    return unfolded(starts, F.col("v.n")).select((F.col("s_") + F.col("p_")).alias("i"), F.col("v.x").alias("v"))


def segmented_arange(sizes: DataFrame) -> DataFrame:
    """``0 .. n - 1`` for each size ``n``, one after another."""
    starts = prefix_sum(sizes, F.col("v"), ["i"], "s_")
    return unfolded(starts, F.col("v")).select((F.col("s_") + F.col("p_")).alias("i"), F.col("p_").alias("v"))


def cumulative_sum(a: DataFrame) -> DataFrame:
    """Sums of what stands before each element, and the total at the end."""
    n = a.count()
    total = a.agg(F.coalesce(F.sum("v"), F.lit(0)).alias("v")).select(F.lit(n).cast("long").alias("i"), F.col("v").cast("long").alias("v"))
    return prefix_sum(a, F.col("v"), ["i"], "s_").select("i", F.col("s_").alias("v")).unionByName(total)


def segmented_sum(sizes: DataFrame, x: DataFrame) -> DataFrame:
    """The sum of each segment of ``x``, of which ``sizes`` gives the lengths; of an empty one 0.

    The sums of all that stands before each segment's end and its start are subtracted, so a segment of any
    length costs two rows.
    """
    starts = prefix_sum(sizes, F.col("v"), ["i"], "s_")
    end = F.struct((F.col("s_") + F.col("v")).alias("at_"), F.lit(1).alias("sign_"))
    ends = starts.select(F.col("i").alias("seg_"), F.explode(F.array(end, F.struct(F.col("s_").alias("at_"), F.lit(-1).alias("sign_")))).alias("e_"))
    # an end is one of the places of x or the one behind the last, of which the sum is the whole
    before = cumulative_sum(x).select(F.col("i").alias("j_"), F.col("v").alias("b_"))
    sums = ends.join(before, F.col("e_.at_") == F.col("j_"), "left").groupBy("seg_").agg(F.sum(F.col("e_.sign_") * F.col("b_")).alias("t_"), F.count("j_").alias("n_"))
    wrong = F.raise_error(F.lit("sizes do not add up to the length"))
    return sums.select(F.col("seg_").alias("i"), F.when(F.col("n_") < 2, wrong).otherwise(F.col("t_")).cast("long").alias("v"))


def argsort(a: DataFrame) -> DataFrame:
    """The stable sorting permutation."""
    return indexed(a.select(F.col("i").alias("o_"), "v"), ["v", "o_"], "i").select("i", F.col("o_").alias("v"))


def sort_by(a: DataFrame, key: DataFrame) -> DataFrame:
    return gather(a, argsort(key))


def bincount(a: DataFrame, size: int) -> DataFrame:
    """Counts of the values 0 to ``size - 1``, zeros too; a value beyond is an error."""
    counts = a.groupBy(F.col("v").alias("k_")).agg(F.count("*").alias("n_"))
    out = a.sparkSession.range(size).withColumnRenamed("id", "i").join(counts, F.col("i") == F.col("k_"), "full")
    return out.select(checked(F.col("i"), "value out of range").alias("i"), F.coalesce("n_", F.lit(0)).cast("long").alias("v"))


def sparse_bincount(a: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The distinct values, ascending, and their counts."""
    counts = indexed(a.groupBy("v").agg(F.count("*").alias("n_")), ["v"])
    return counts.select("i", "v"), counts.select("i", F.col("n_").alias("v"))


def zero(a: DataFrame) -> DataFrame:
    """Where ``a`` is 0, ascending."""
    return indexed(a.where("v = 0").select(F.col("i").alias("v")), ["v"]).select("i", "v")


def maximum(a: DataFrame) -> int | None:
    return a.agg(F.max("v")).first()[0]


def total(a: DataFrame) -> int:
    return a.agg(F.coalesce(F.sum("v"), F.lit(0))).first()[0]


def filter_by(a: DataFrame, predicate: DataFrame) -> DataFrame:
    """``a[i]`` as often as ``predicate[i]`` says, so where a 0/1 array is 1."""
    return repeat(predicate, a)


def filter_by_dense(a: DataFrame, predicate: DataFrame) -> DataFrame:
    """The values of ``a`` at which ``predicate`` is 1."""
    kept = a.join(predicate.where("v = 1").select(F.col("i").alias("k_")), F.col("v") == F.col("k_"), "left_semi")
    return indexed(kept.select(F.col("i").alias("o_"), "v"), ["o_"]).select("i", "v")


def filter_unvisited(visited: DataFrame, candidates: DataFrame) -> DataFrame:
    """Candidates at which the ``visited`` flag is 0, in order."""
    return filter_by_dense(candidates, visited.select("i", (1 - F.col("v")).alias("v")))


def all_elements_equal(a: Column, b: Column) -> Column:
    """Whether all elements of two array columns are the same, null-safe; true if there are none."""
    both = F.concat(a, b)
    return F.forall(both, lambda x: x.eqNullSafe(F.element_at(both, 1)))


def stack(arrays: list[DataFrame]) -> DataFrame:
    return reduce(concatenate, arrays)
