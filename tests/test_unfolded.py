"""Few small rows that become very many: they are dealt to as many parts as shuffles have, whatever their own size."""

import pytest
from pyspark.sql import functions as F

from spanloom.functions import lineage
from spanloom.plans import catalog

DIR = "/root/testdata/sf0.001"


@pytest.fixture(autouse=True)
def adaptive(spark):
    assert spark.conf.get("spark.sql.adaptive.enabled") == "true"
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", was)


def parts(df):
    """Rows by the part they come from, those without rows left out."""
    return [x["count"] for x in df.groupBy(F.spark_partition_id().alias("part")).count().collect()]


def test_runs_are_not_gathered_in_one_task(spark):
    rows = spark.range(200).select(F.col("id").alias("i"), F.lit(500).alias("n"))
    out = lineage.unfolded(rows, F.col("n"))
    got = parts(out)
    assert len(got) == 7 and max(got) < 100_000 / 3
    assert out.agg(F.count("*"), F.countDistinct("i", "p_"), F.min("p_"), F.max("p_")).first()[:] == (100_000, 100_000, 0, 499)


def test_one_large_size_fills_several_tasks(spark, monkeypatch):
    monkeypatch.setattr(lineage, "RUN", 100)
    out = lineage.unfolded(spark.range(1).select("id", F.lit(10_000).alias("n")), F.col("n"))
    got = parts(out)
    assert len(got) == 7 and max(got) < 10_000 / 2
    assert out.agg(F.count("*"), F.countDistinct("p_"), F.max("p_")).first()[:] == (10_000, 10_000, 9_999)


def test_half_spider_map_is_made_by_many_tasks(spark):
    out = catalog.QUERIES["half_spider_map"](spark, DIR)
    got = parts(out)
    c, s = (spark.read.parquet(f"{DIR}/{t}.parquet") for t in ("customer", "supplier"))
    n = c.join(s, F.col("c_nationkey") == F.col("s_nationkey")).count()
    assert n > 0 and sum(got) == n and len(got) > 1
    assert out.agg(F.min("i"), F.max("i"), F.countDistinct("i")).first()[:] == (0, n - 1, n)
