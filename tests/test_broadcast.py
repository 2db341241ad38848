"""Tables that grow with the input go to all workers under no setting: the threshold here is far above their size."""

import pytest
from pyspark.sql import functions as F

from spanloom.operators import functor, traverse
from spanloom.plans import fixtures
from spanloom.plans.building import wired
from spanloom.plans.queries import many, polynomial, square_plus_one
from spanloom.plans.rewrite import identity_functor


@pytest.fixture
def eager(spark):
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1g")
    yield spark
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)


def plan(df):
    return df._jdf.queryExecution().sparkPlan().toString()


def test_layers_and_values_are_dealt(eager):
    c = eager.range(50).select(F.col("id").alias("gid"), F.lit(0).cast("long").alias("pos"), F.col("id").alias("value"))
    d = many(square_plus_one(), c.select("gid"))
    assert "BroadcastHashJoin" not in plan(d.nested()) and "BroadcastHashJoin" not in plan(d.operations())
    out = traverse.evaluate(d, c, polynomial, F.lit(0))
    assert "BroadcastHashJoin" not in plan(out)
    assert sorted(map(tuple, out.collect())) == [(i, 0, i * i + 1) for i in range(50)]


def test_images_are_dealt(eager):
    d = functor.apply_functor(fixtures.chain(eager, "/root/testdata/sf0.001"), identity_functor())
    out = wired(d)
    assert not any("BroadcastHashJoin" in plan(t) for t in (d.nodes, d.incidence, d.interface, out))
    assert out.count() == eager.read.parquet("/root/testdata/sf0.001/events.parquet").count()
