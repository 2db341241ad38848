"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

The rows of a source lie in blocks by a hash, which is a random permutation; a source has the more blocks the
larger it is, so that a block stays small. A source whose target is t times its size is drawn floor(t) times
whole and once more in part: the blocks of a prefix of the permutation, the last of them cut at the row where
the words come nearest to the target. The number of these draws is the source's exact block quota.

The quotas of all sources are split over the output shards by a tree: the draws of a node are divided between
its halves by a multivariate hypergeometric draw, so that every shard gets an equal number of blocks and is a
random sample of the mix. A leaf's draws of a source are consecutive in the source's permuted passes, so
leaves are disjoint. What a row is taken for follows from the leaves: a row is taken once for each draw of its
block. The rows of a shard are then shuffled within it.

With very many sources the tree is climbed in two steps, first with sources in ``GROUPS`` groups, on the
driver, then within each group, on the workers: a hypergeometric draw of groups, and of sources given those
of their group, is one of all sources.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.lineage import indexed, prefix_sum
from . import common

SHARDS, CAP, SEED = 16, 3, 20240229
#: Words of a block of a large source, and blocks of a small one, unless it has fewer rows.
BLOCK_WORDS, LEAST_BLOCKS = 1 << 16, 1024
#: Groups of sources whose quotas the driver splits; parts of a shard, a power of 2.
GROUPS, PARTS = 1024, 64


def targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: int = CAP) -> DataFrame:
    """``sizes`` (source, source_size, ...) with ``target``: shares of all sizes by weight, none above ``cap`` times the size.

    Sources take the weights in turn by code point, null last. Filling by weight until the caps of the
    sources that are full: sorted by cap over weight, a source is full if an even share of what the fuller
    ones leave exceeds its cap; all others share what is left. Ranks and sums are found part by part, so any
    number of sources will do.
    """
    ranked = indexed(sizes, [F.col("source").asc_nulls_last()], "rank")
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod("rank", F.lit(len(weights))) + 1).cast("int")).cast("long")
    x = ranked.withColumn("weight", weight).withColumn("limit", F.col("source_size") * cap)
    order = [F.col("limit") / F.col("weight"), F.col("rank")]
    x = common.cut(prefix_sum(prefix_sum(x, F.col("limit"), order, "full_before"), F.col("weight"), order, "weight_before"))
    total, weights_ = x.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
    x = x.withColumn("level", (F.lit(total) - F.col("full_before")) / (F.lit(weights_) - F.col("weight_before")))
    x = x.withColumn("full", F.col("level") > F.col("limit") / F.col("weight"))
    share = x.where("NOT full").agg(F.max("level")).first()[0] or 0.0
    target = F.when(F.col("full"), F.col("limit").cast("double")).otherwise(F.least(F.col("weight") * F.lit(share), F.col("limit").cast("double")))
    return x.select(*sizes.columns, target.cast("double").alias("target"))


def rooms(total: int, shards: int) -> list[int]:
    """``total`` in ``shards`` numbers that differ by one at most."""
    return [total * (i + 1) // shards - total * i // shards for i in range(shards)]


def split_quotas(quotas: list[int], room: list[int], seed: int | list[int] = SEED) -> np.ndarray:
    """Block quotas of the leaves, a row for each: rows sum to ``room``, columns to ``quotas``, which have one sum."""
    rng = np.random.default_rng(seed)
    out = np.zeros((len(room), len(quotas)), dtype=np.int64)

    def split(first: int, last: int, have: np.ndarray) -> None:
        if last - first == 1:
            out[first] = have
            return
        mid = (first + last) // 2
        left = rng.multivariate_hypergeometric(have, sum(room[first:mid]), method="marginals")
        split(first, mid, left)
        split(mid, last, have - left)

    if len(quotas):
        split(0, len(room), np.array(quotas, dtype=np.int64))
    return out


def leaves(quotas: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """(s_, shard, start, n, n_blocks, whole, cut, left): the draws of each source (s_, quota, n_blocks, whole, cut, left) that each shard has, counted through its passes."""
    grouped = common.cut(quotas.withColumn("group_", F.pmod(F.xxhash64("s_"), F.lit(GROUPS)).cast("int")))
    sums = grouped.groupBy("group_").agg(F.sum("quota").alias("quota")).orderBy("group_").collect()
    total = sum(r["quota"] for r in sums)
    top = split_quotas([r["quota"] for r in sums], rooms(total, shards), seed)
    room = {r["group_"]: top[:, i].tolist() for i, r in enumerate(sums)}

    def within(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("s_").reset_index(drop=True)
        group = int(frame["group_"].iloc[0])
        each = split_quotas(frame["quota"].tolist(), room[group], [seed, group])
        starts = np.concatenate((np.zeros((1, len(frame)), dtype=np.int64), np.cumsum(each, axis=0)[:-1]))
        parts = [frame[["s_", "n_blocks", "whole", "cut", "left"]].assign(shard=j, start=starts[j], n=each[j]) for j in range(shards)]
        return pd.concat(parts)

    return grouped.groupBy("group_").applyInPandas(within, "s_ string, n_blocks long, whole long, cut long, left double, shard int, start long, n long").where("n > 0")


def draws(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", shards: int = SHARDS, seed: int = SEED, keep: tuple[str, ...] = ()) -> DataFrame:
    """For each row: (id, source, size, key, block, source_size, target, turns, shards), and its columns ``keep`` as ``keep0_``, ``keep1_``, ...

    ``turns`` are the passes in which the mix takes the row, ``shards`` the output shard of each. Null texts
    have size 0, null sources are one source, and a source without words is taken not at all. Rows of equal
    id and text have one place in the permutation and are drawn one by one. An empty table gives no rows.
    """
    kept = [f"keep{i}_" for i in range(len(keep))]
    plain = common.pick(docs, id_col, text_col, source_col, *keep).toDF("id", "text", "source", *kept)
    key = F.xxhash64(F.lit(seed), "id", "text")
    s_ = F.when(F.col("source").isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), F.col("source").cast("string")))
    full = plain.select("id", "source", s_.alias("s_"), common.n_words(F.col("text")).alias("size"), key.alias("key"), *kept)
    rows = common.stored(full.drop(*kept), "mix-rows")
    sizes = rows.groupBy("s_", "source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_rows"))
    n_blocks = F.greatest(F.ceil(F.col("source_size") / BLOCK_WORDS), F.least(F.col("n_rows"), F.lit(LEAST_BLOCKS))).cast("long")
    goals = common.stored(targets(sizes).withColumn("n_blocks", n_blocks), "mix-goals")

    def placed(some: DataFrame, table: DataFrame) -> DataFrame:
        at = F.floor(F.shiftrightunsigned("key", 11).cast("double") / F.lit(2.0**53) * F.col("n_blocks")).cast("long")
        return common.looked_up(some, table, "s_", "n_rows").withColumn("block", at).drop("n_rows")

    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    goal = goals.select(F.col("s_").alias("g_"), "n_blocks", whole.alias("whole"), (F.col("target") - whole * F.col("source_size")).alias("rest"))
    here = placed(rows, goals.select("s_", "n_blocks", "n_rows"))
    words = prefix_sum(here.groupBy("s_", "block").agg(F.sum("size").alias("words")), F.col("words"), ["block"], "before", ("s_",))
    begun = words.join(goal, F.col("s_") == F.col("g_")).where(F.col("before") < F.col("rest"))
    last = begun.groupBy(F.col("s_").alias("c_")).agg(F.max("block").alias("cut"), F.max_by(F.col("rest") - F.col("before"), "block").alias("left"))
    quotas = goal.join(last, F.col("g_") == F.col("c_"), "left").select(F.col("g_").alias("s_"), (F.col("n_blocks") * F.col("whole") + F.coalesce(F.col("cut") + 1, F.lit(0))).alias("quota"), "n_blocks", "whole", "cut", "left")

    # a row finds its draws among the leaves of its source, one for each shard, so no row is dealt by its block
    leaf = F.struct("start", (F.col("start") + F.col("n")).alias("end"), "shard")
    each = leaves(quotas, shards, seed).groupBy(F.col("s_").alias("l_")).agg(F.collect_list(leaf).alias("leaves"), F.first("whole").alias("whole"), F.first("cut").alias("cut"), F.first("left").alias("left"))
    plan = common.stored(goals.drop("source").join(each, F.col("s_") == F.col("l_"), "left").drop("l_"), "mix-plan")
    x = placed(full if keep else rows, plan)

    def take(turn: Column) -> Column:
        """The draw of the row's block in a pass, in the one leaf that has it, or in none."""
        at = turn * F.col("n_blocks") + F.col("block")
        return F.transform(F.filter("leaves", lambda e: (e["start"] <= at) & (at < e["end"])), lambda e: F.struct(turn.cast("int").alias("turn"), e["shard"].alias("shard")))

    drawn = F.flatten(F.transform(F.sequence(F.lit(0).cast("long"), F.col("whole")), take))
    x = x.withColumn("takes", F.coalesce(drawn, F.array().cast("array<struct<turn:int,shard:int>>"))).withColumn("partial", F.coalesce(F.col("block") == F.col("cut"), F.lit(False))).drop("leaves")
    # the block that the last pass cuts holds few rows; those behind the cut are not taken in that pass
    passed = W.partitionBy("s_", "block").orderBy("key", "size", "id")
    halfway = F.sum("size").over(passed.rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("size") / 2
    some = x.where("partial").withColumn("takes", F.when(halfway <= F.col("left"), F.col("takes")).otherwise(F.slice("takes", 1, F.size("takes") - 1)))
    x = x.where("NOT partial").unionByName(some)
    return x.select("id", "source", "size", "key", "block", "source_size", "target", F.col("takes.turn").alias("turns"), F.col("takes.shard").alias("shards"), *kept)


def taken(docs: DataFrame) -> DataFrame:
    """(doc_id, size, source_size, target, taken, shards): one row for each row of (doc_id, text, source).

    ``taken`` is the size as often as the tree's draws take the row. Null and empty texts have size 0 and take
    nothing; texts of any length count whole; equal rows each give a row, and may be taken differently often;
    columns besides and clashing names are left out; an empty table gives no rows.
    """
    return draws(docs).select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.size("shards")).cast("long").alias("taken"), F.concat_ws(",", F.transform("shards", lambda s: s.cast("string"))).alias("shards"))


def mix(docs: DataFrame, columns: list[str]) -> DataFrame:
    """The mix itself: ``columns`` of each document as often as it is taken, with its ``shard`` and a place in the shuffled shard, ``shuffle_key``.

    Rows come shuffled: a shard lies in ``PARTS`` parts by the first bits of ``shuffle_key``, each in one
    partition and sorted by the key there, so that no task holds a whole shard. Written as they come, the
    files keep that order, also without the two further columns.
    """
    d = draws(docs, keep=tuple(columns)).select("key", F.explode(F.arrays_zip("turns", "shards")).alias("t"), *[F.col(f"keep{i}_").alias(f"out{i}_") for i in range(len(columns))])
    d = d.withColumn("shard", F.col("t.shards")).withColumn("order_", F.xxhash64("shard", F.col("t.turns"), "key")).withColumn("part_", part_of(F.col("order_")))
    d = d.repartition("shard", "part_").sortWithinPartitions("shard", "part_", "order_")
    return d.select(*[F.col(f"out{i}_").alias(c) for i, c in enumerate(columns)], "shard", F.col("order_").alias("shuffle_key"))


def part_of(shuffle_key: Column) -> Column:
    """The part of a shard that a row lies in."""
    return F.shiftrightunsigned(shuffle_key, 65 - PARTS.bit_length()).cast("int")
