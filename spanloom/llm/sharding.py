"""K-d tree sharding, in DataFrame operations only.

A node that has to become k leaves is split along its widest metadata dimension at the distributed weighted
quantile that leaves each side bytes for its share of the k; leaves hold about the target bytes. A dimension
is measured by the ranks of its values, so neither long common beginnings nor outliers flatten it.

A level of the tree is one pass over narrow rows that carry the number of their node: the widths of all nodes
in one aggregation, then one prefix sum of the bytes, by node, dimension and a hash of the row, from which
every row knows the side it goes to. Ties in a dimension are broken by that hash, so any number of equal
values splits evenly. Nothing but counts reaches the driver, whatever the number of leaves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.lineage import indexed, prefix_sum
from . import common

#: Parts of a shard that are numbered apart.
PARTS = 256
#: Open nodes that are sent to the rows, one small row each; with more of them, no node holds more than a small share of the rows.
FEW_NODES = 4096


def ranked(rows: DataFrame, dims: int) -> tuple[DataFrame, list[int]]:
    """``rows`` with the ranks ``r0_``, ``r1_``, ... of the distinct values of ``x0_``, ``x1_``, ..., null as the least, and how many there are."""
    out, counts = rows, []
    for i in range(dims):
        # a value is told from null by a struct, which also compares NaN as the greatest
        values = rows.groupBy(F.struct(F.col(f"x{i}_").alias("v")).alias("key_")).agg(F.count("*").alias("n_"))
        numbers = common.stored(indexed(values, [F.col("key_.v").asc_nulls_first()], f"r{i}_"), "shard-ranks")
        counts.append(numbers.count())
        out = common.looked_up(out.withColumn("own_", F.struct(F.col(f"x{i}_").alias("v"))), numbers.withColumnRenamed("n_", "n_rows_"), "own_", "n_rows_", renamed="key_").drop("own_", "n_rows_", f"x{i}_")
        out = common.stored(out, "shard-rows")
    return out, counts


def shards(df: DataFrame, size: Column, dims: list[str], tie: Column, n_shards: int | None = None, target_bytes: int | None = None) -> DataFrame:
    """``df`` with ``shard`` and ``slot``; give ``n_shards`` or the ``target_bytes`` of a shard.

    ``size`` is a positive number of bytes, ``dims`` are columns of ``df``, ``tie`` a BIGINT hash of a row.
    Columns of ``df`` named ``shard`` or ``slot`` are replaced. Nulls in a dimension sort first; equal
    rows may go to different shards. Of an empty ``df`` nothing remains to be split.
    """
    if not dims:
        raise ValueError("a k-d tree needs a dimension")
    base = df.drop("shard", "slot")
    kept = [f"keep{i}_" for i in range(len(base.columns))]
    rows = base.withColumns({"size_": size.cast("long"), "tie_": tie.cast("long")} | {f"x{i}_": F.col(d) for i, d in enumerate(dims)})
    rows = common.stored(rows.toDF(*kept, *rows.columns[len(kept) :]), "shards")
    total = rows.agg(F.coalesce(F.sum("size_"), F.lit(0))).first()[0]
    k = n_shards or max(1, -(-total // target_bytes))
    if total:
        rows, counts = ranked(rows, len(dims))
    rows = rows.withColumns({"first_": F.lit(0).cast("long"), "leaves_": F.lit(k).cast("long")})
    nodes, finished = 1, []
    while k > 1 and total:
        done = rows.where("leaves_ = 1")
        finished.append(done.drop("leaves_", *[f"r{i}_" for i in range(len(dims))]))
        rows = rows.where("leaves_ > 1")
        spans = rows.groupBy("first_", "leaves_").agg(F.sum("size_").alias("bytes_"), *[((F.max(f"r{i}_") - F.min(f"r{i}_")) / max(1, n - 1)).alias(f"w{i}_") for i, n in enumerate(counts)])
        widest = F.greatest(*[F.col(f"w{i}_") for i in range(len(dims))]) if len(dims) > 1 else F.col("w0_")
        dim = F.coalesce(*[F.when(F.col(f"w{i}_") == widest, F.lit(i)) for i in range(len(dims))])
        left = F.expr("leaves_ div 2")
        plan = spans.select(F.col("first_").alias("node_"), dim.alias("dim_"), left.alias("left_"), (F.col("bytes_") * left / F.col("leaves_")).alias("want_"))
        at = rows.join(F.broadcast(plan) if nodes <= FEW_NODES else plan.hint("merge"), F.col("first_") == F.col("node_")).drop("node_")
        key = F.coalesce(*[F.when(F.col("dim_") == i, F.col(f"r{i}_")) for i in range(len(dims))])
        summed = prefix_sum(at.withColumn("key_", key), F.col("size_"), ["key_", "tie_", "size_"], "before_", ("first_",))
        goes = F.col("before_") + F.col("size_") / 2 < F.col("want_")
        moved = summed.withColumns({"first_": F.when(goes, F.col("first_")).otherwise(F.col("first_") + F.col("left_")), "leaves_": F.when(goes, F.col("left_")).otherwise(F.col("leaves_") - F.col("left_"))})
        rows = common.stored(moved.drop("dim_", "left_", "want_", "key_", "before_"), "shard-level")
        nodes *= 2
        if rows.where("leaves_ > 1").isEmpty():
            break
    placed = rows.drop("leaves_", *[f"r{i}_" for i in range(len(dims))], *[f"x{i}_" for i in range(len(dims))])
    for part in finished:
        placed = placed.unionByName(part)
    placed = placed.withColumn("shard", F.col("first_").cast("int")).withColumn("part_", F.pmod(F.xxhash64("tie_"), F.lit(PARTS)))
    return numbered(placed).select(*[F.col(c).alias(name) for c, name in zip(kept, base.columns, strict=True)], "shard", "slot")


def numbered(placed: DataFrame) -> DataFrame:
    """A gapless ``slot`` from 0 in each shard: parts of a shard are numbered side by side and then shifted by what stands before them."""
    counts = placed.groupBy("shard", "part_").agg(F.count("*").alias("n_"))
    starts = counts.select(F.col("shard").alias("s_"), F.col("part_").alias("p_"), (F.sum("n_").over(W.partitionBy("shard").orderBy("part_")) - F.col("n_")).alias("start_"))
    rank = placed.withColumn("rank_", F.row_number().over(W.partitionBy("shard", "part_").orderBy("tie_", "size_")))
    return rank.join(starts, (F.col("shard") == F.col("s_")) & (F.col("part_") == F.col("p_"))).withColumn("slot", (F.col("start_") + F.col("rank_") - 1).cast("long"))


def documents(docs: DataFrame, n_shards: int = 16) -> DataFrame:
    """Shards of near-equal bytes over (doc_id, text, source, lang); a row for each row.

    A null text has no bytes and crc32 0; every row counts one byte more, so empty texts are dealt out too. A
    text of any length lies in one shard, which it may fill. Equal rows go wherever their bytes fit; null ids,
    sources and languages sort first. Columns besides are left out; an empty table gives no rows.
    """
    plain = common.pick(docs, "doc_id", "text", "lang", "source")
    text = F.coalesce("text", F.lit("")).cast("binary")
    row = plain.select("doc_id", "lang", "source", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.xxhash64("doc_id", "text").alias("tie"))
    out = shards(row, F.col("size"), ["source", "lang", "doc_id"], F.col("tie"), n_shards=n_shards)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
