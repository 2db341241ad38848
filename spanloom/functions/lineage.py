"""Cutting lineage in loops, numbering rows, and prefix sums, without a single task that sees all rows.

What is kept for later reading lies in the folder that driver and executors share, ``spark.checkpoint.dir``, so
a lost executor costs a task and no table. Each application has a folder of its own there: ``release`` empties
it once nothing that was returned is in use. Checkpoints of loops go with it, or, with the setting
``spark.cleaner.referenceTracking.cleanCheckpoints``, when the driver forgets them.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Bits of a row's place in its part in ``monotonically_increasing_id``.
PLACE_BITS = 33


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    Where spark.checkpoint.dir is unset, a local master gets a folder of this machine; on a cluster, where
    no such folder would do, that is an error.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir names no folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="checkpoints-")
        spark.conf.set("spark.checkpoint.dir", path)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(path)
    return path


def run_dir(spark: SparkSession) -> str:
    """This application's folder in the shared one."""
    return f"{shared_dir(spark).rstrip('/')}/spanloom-{spark.sparkContext.applicationId}"


def fresh(spark: SparkSession, what: str) -> str:
    """A new name in this application's folder."""
    return f"{run_dir(spark)}/{what}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder of the shared store, if it is there."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def release(spark: SparkSession) -> None:
    """Deletes all that this application keeps in the shared folder; frames that were returned before cannot be read after it."""
    remove(spark, run_dir(spark))
    if spark.sparkContext.getCheckpointDir() is not None:
        remove(spark, spark.sparkContext.getCheckpointDir())
        spark.sparkContext.setCheckpointDir(shared_dir(spark))


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, what: str) -> DataFrame:
    """``df`` computed once and kept in the shared folder as a Parquet table: its size is known, and columns that are not read cost nothing."""
    path = fresh(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def dealt(df: DataFrame) -> DataFrame:
    """``df`` as a side of a join that deals both by key.

    Sizes are estimated from compressed files and from rows before they are unnested, so a table of any number
    of rows may seem small enough to go through the driver to all workers. One that grows with the input never does.
    """
    return df.hint("merge")


def by_key(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` dealt by ``keys`` to as many parts as shuffles have, however small it is: for rows that are unfolded into many."""
    return df.repartition(max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))), *keys)


def _ranged(df: DataFrame, within: list[str], order: list) -> DataFrame:
    """Rows dealt and sorted by ``within`` and ``order``, with the number of their part and their place in it; kept, as these change when recomputed."""
    parts = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    keys = [F.col(c) for c in within] + [F.col(c) if isinstance(c, str) else c for c in order]
    at = F.monotonically_increasing_id()
    out = df.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).withColumn("lineage_at_", at)
    part, place = F.shiftright("lineage_at_", PLACE_BITS).alias("lineage_part_"), F.col("lineage_at_").bitwiseAND(F.lit((1 << PLACE_BITS) - 1)).alias("lineage_own_")
    return stored(out.select("*", part, place).drop("lineage_at_"), "ranged")


def _shifted(ranged: DataFrame, counts: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with the columns of ``counts`` (*keys, lineage_part_, ...), one row for each part of a group: few, so that they are sent to the rows where that is cheaper."""
    side = counts.select(*[F.col(k).alias(f"lineage_{k}") for k in keys], F.col("lineage_part_").alias("lineage_p_"), *[c for c in counts.columns if c not in (*keys, "lineage_part_")])
    same = F.col("lineage_part_") == F.col("lineage_p_")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"lineage_{k}"))
    # without groups there is one row a part: their number is that of the shuffle partitions
    return ranged.join(dealt(side) if keys else F.broadcast(side), same)


def indexed(df: DataFrame, order: list, name: str = "i", within: tuple[str, ...] = (), start: int = 0) -> DataFrame:
    """``df`` with a dense number ``name`` from ``start`` in the order of ``order``, within each group of ``within``.

    Rows are dealt and sorted by range, so a row's place in its part is its number but for what stands in
    the parts before and, with groups, before its group in its part. A group may fill any number of parts.
    """
    keys = list(within)
    ranged = _ranged(df, keys, order)
    counts = ranged.groupBy(*keys, "lineage_part_").agg(F.count("*").alias("lineage_n_"), F.min("lineage_own_").alias("lineage_first_"))
    before = F.sum("lineage_n_").over(W.partitionBy(*keys).orderBy("lineage_part_")) - F.col("lineage_n_")
    shift = counts.withColumn("lineage_shift_", before - F.col("lineage_first_")).drop("lineage_n_", "lineage_first_")
    return _shifted(ranged, shift, keys).withColumn(name, (F.col("lineage_own_") + F.col("lineage_shift_") + start).cast("long")).select(*df.columns, name)


def prefix_sums(df: DataFrame, values: dict[str, Column], order: list, within: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with, for each name of ``values``, the sum of its value over the rows before each, in the order of ``order``, within each group of ``within``."""
    keys, names = list(within), list(values)
    ranged = _ranged(df.withColumns({f"lineage_v{i}_": v.cast("long") for i, v in enumerate(values.values())}), keys, order)
    sums = ranged.groupBy(*keys, "lineage_part_").agg(*[F.sum(f"lineage_v{i}_").alias(f"lineage_n{i}_") for i in range(len(names))])
    before = W.partitionBy(*keys).orderBy("lineage_part_")
    shift = sums.select(*keys, "lineage_part_", *[(F.sum(f"lineage_n{i}_").over(before) - F.col(f"lineage_n{i}_")).alias(f"lineage_shift{i}_") for i in range(len(names))])
    part = W.partitionBy("lineage_part_", *keys).orderBy("lineage_own_").rowsBetween(W.unboundedPreceding, W.currentRow)
    own = ranged.withColumns({f"lineage_sum{i}_": F.sum(f"lineage_v{i}_").over(part) - F.col(f"lineage_v{i}_") for i in range(len(names))})
    at = [(F.col(f"lineage_shift{i}_") + F.col(f"lineage_sum{i}_")).cast("long").alias(name) for i, name in enumerate(names)]
    return _shifted(own, shift, keys).select(*df.columns, *at)


def prefix_sum(df: DataFrame, value: Column, order: list, name: str, within: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with the sum of ``value`` over the rows before each, in the order of ``order``, within each group of ``within``."""
    return prefix_sums(df, {name: value}, order, within)


#: Rows that one row is unfolded into at a time.
RUN = 1 << 16


def unfolded(df: DataFrame, size: Column, name: str = "p_") -> DataFrame:
    """Each row of ``df`` ``size`` times, with ``name`` from 0.

    A size is first split into runs, which are dealt out, so that a very large one is neither one array nor one task.
    Runs are few and small beside the rows they become, so their number of parts is never left to their size.
    """
    runs = df.withColumn("lineage_size_", size.cast("long")).where("lineage_size_ > 0")
    runs = runs.withColumn("lineage_run_", F.explode(F.sequence(F.lit(0).cast("long"), F.col("lineage_size_") - 1, F.lit(RUN).cast("long"))))
    spread = by_key(runs, "lineage_run_", *df.columns)
    last = F.least(F.col("lineage_run_") + RUN, F.col("lineage_size_")) - 1
    return spread.withColumn(name, F.explode(F.sequence(F.col("lineage_run_"), last))).select(*df.columns, name)


#: Of a table with one row a key, as many rows at most are sent to all workers.
HOT = 1024


def looked_up(rows: DataFrame, keyed: DataFrame, key: str, n: str, how: str = "inner", renamed: str | None = None) -> DataFrame:
    """``rows`` joined by ``key`` to ``keyed``, which has each key once, as ``renamed`` if that is given, and in ``n`` how many of ``rows`` have it.

    Keys of more than one in ``HOT`` of all those rows are fewer than ``HOT``, by arithmetic: they are sent to
    the rows. The rows of all other keys are dealt by key, where none of them is large.
    """
    theirs = renamed or key
    keyed = keyed.withColumnRenamed(theirs, "lineage_key_")
    added = [c for c in keyed.columns if c != "lineage_key_"]
    same = F.col(key) == F.col("lineage_key_")
    total, keys = keyed.agg(F.coalesce(F.sum(n), F.lit(0)), F.count("*")).first()
    if keys <= HOT:
        return rows.join(F.broadcast(keyed), same, how).select(*rows.columns, *added)
    least = total // HOT + 1
    hot, cold = keyed.where(F.col(n) >= least), keyed.where(F.col(n) < least)
    mine = rows.join(F.broadcast(hot.withColumn("lineage_hot_", F.lit(True))), same, "left")
    first = mine.where("lineage_hot_").select(*rows.columns, *added)
    rest = mine.where("lineage_hot_ IS NULL").select(*rows.columns).join(cold.hint("merge"), same, how)
    return first.unionByName(rest.select(*rows.columns, *added))
