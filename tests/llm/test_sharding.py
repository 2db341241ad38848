import random
import zlib

from pyspark.sql import functions as F

from spanloom.llm import sharding


def check(rows, got, n):
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r)
    assert set(by) <= set(range(n))
    for part in by.values():
        assert sorted(r.slot for r in part) == list(range(len(part)))
    return {k: sum(r["size"] for r in v) for k, v in by.items()}


def test_documents(spark):
    rng = random.Random(4)
    rows = [(i, None if i % 50 == 0 else "é" * rng.randrange(200), rng.choice(["en", None]), "hot" if i % 3 else f"s{i % 17}", "x") for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, shard string")
    got = sharding.documents(df).collect()
    bytes_ = check(rows, got, 16)
    assert len(bytes_) == 16 and max(bytes_.values()) < 1.03 * min(bytes_.values())
    text = {r[0]: r[1] or "" for r in rows}
    assert all(r.text_crc32 == zlib.crc32(text[r.doc_id].encode()) and r["size"] == len(text[r.doc_id].encode()) + 1 for r in got)
    assert sorted(map(tuple, got)) == sorted(map(tuple, sharding.documents(df).collect()))


def test_equal_rows_and_nulls(spark):
    rows = [(None, "same", None, None)] * 40
    got = sharding.documents(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()
    check(rows, got, 16)
    assert sharding.documents(spark.createDataFrame([], "doc_id long, text string, lang string, source string")).count() == 0


def test_target_bytes(spark):
    df = spark.range(1000).select("id", (F.col("id") % 7).alias("a"), F.col("id").cast("string").alias("b"), F.lit(1).alias("slot"))
    got = sharding.shards(df, F.lit(10), ["a", "b", "id"], F.xxhash64("id"), target_bytes=1500)
    sizes = [r["count"] * 10 for r in got.groupBy("shard").count().collect()]
    assert len(sizes) == 7 and max(sizes) - min(sizes) <= 40
    assert got.select("slot").agg(F.min("slot")).first()[0] == 0


def brute(rows, n_dims, k):
    """{row number: shard} of (number, size, tie, *values) by splitting node by node."""
    ranks = [{v: i for i, v in enumerate(sorted({r[3 + d] for r in rows}, key=lambda v: (v is not None, v)))} for d in range(n_dims)]
    out = {}

    def split(part, first, leaves):
        if leaves == 1:
            out.update((r[0], first) for r in part)
            return
        at = [[ranks[d][r[3 + d]] for r in part] for d in range(n_dims)]
        widths = [(max(x) - min(x)) / max(1, len(ranks[d]) - 1) if x else 0 for d, x in enumerate(at)]
        d = widths.index(max(widths))
        want, before, sides = sum(r[1] for r in part) * (leaves // 2) / leaves, 0, ([], [])
        for r in sorted(part, key=lambda r: (ranks[d][r[3 + d]], r[2], r[1])):
            sides[before + r[1] / 2 >= want].append(r)
            before += r[1]
        split(sides[0], first, leaves // 2)
        split(sides[1], first + leaves // 2, leaves - leaves // 2)

    split(rows, 0, k)
    return out


def test_against_brute_force(spark):
    rng = random.Random(9)
    rows = [(i, rng.randrange(1, 90), rng.randrange(10**12), rng.choice(["commoncrawl-2020", "commoncrawl-2021", None, "web"]) if i % 3 else "hot", rng.choice([1, 2, None]), 10**9 if i == 7 else rng.randrange(500)) for i in range(900)]
    df = spark.createDataFrame(rows, "n long, size long, tie long, a string, b long, c long")
    for k in (2, 7, 16):
        got = {r.n: r.shard for r in sharding.shards(df, F.col("size"), ["a", "b", "c"], F.col("tie"), n_shards=k).collect()}
        assert got == brute(rows, 3, k)


def test_common_beginnings_and_outliers_do_not_hide_a_dimension(spark):
    df = spark.range(832).select("id", F.concat(F.lit("http://one.host/path/"), (F.col("id") % 64).cast("string")).alias("url"), F.when(F.col("id") == 3, 10**15).otherwise(F.col("id") % 4).alias("year"))
    got = sharding.shards(df, F.lit(1), ["url"], F.xxhash64("id"), n_shards=32)
    assert got.groupBy("url").agg(F.count_distinct("shard").alias("n")).agg(F.max("n")).first()[0] == 1
    got = sharding.shards(df, F.lit(1), ["year"], F.xxhash64("id"), n_shards=4)
    assert got.where("year < 9").groupBy("year").agg(F.count_distinct("shard").alias("n")).agg(F.max("n")).first()[0] <= 2


def test_a_thousand_leaves(spark):
    df = spark.range(20_000).select("id", (F.col("id") % 13).alias("a"))
    got = sharding.shards(df, F.lit(10), ["a", "id"], F.xxhash64("id"), target_bytes=200)
    sizes = [r["count"] for r in got.groupBy("shard").count().collect()]
    assert len(sizes) == 1000 and max(sizes) - min(sizes) <= 4


def test_a_very_long_text(spark):
    rows = [(1, "é" * 3_000_000, "en", "s")] + [(i, "a few words", "en", "s") for i in range(2, 300)]
    got = sharding.documents(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()
    check(rows, got, 16)
    assert max(r["size"] for r in got) == 6_000_001
