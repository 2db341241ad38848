"""Batches of long texts, lookups, and folders."""

import os

import pyarrow as pa
from pyspark.sql import functions as F

from spanloom.functions import lineage
from spanloom.llm import common


def test_batches_of_long_texts_are_bounded_by_bytes(spark):
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    df = spark.range(120).select("id", F.repeat(F.lit("x"), 3_000_000).alias("text")).coalesce(1)

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"n": pa.array([b.num_rows], pa.int64()), "bytes": pa.array([b.nbytes], pa.int64())})

    got = df.mapInArrow(sizes, "n long, bytes long").collect()
    assert sum(r.n for r in got) == 120 and max(r.bytes for r in got) < 80 << 20
    step = lambda batch: {"n": [len(x) for x in common.texts_of(batch)]}
    assert common.map_slices(df, step, "n long").agg(F.sum("n")).first()[0] == 360_000_000
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before


def test_scratch_goes(spark):
    work = common.Scratch(spark, "some")
    assert work.stored(spark.range(5), "a").count() == 5 and os.path.exists(work.path)
    work.drop()
    assert not os.path.exists(work.path)


def test_folder_of_the_application(spark):
    path = lineage.fresh(spark, "x")
    assert path.startswith(lineage.run_dir(spark)) and spark.sparkContext.applicationId in path
