"""A formula in a diagram of its own for each row: one pass over all, with nothing kept on the way, and whole numbers as in SQL."""

import os

import duckdb

from spanloom.functions import lineage
from spanloom.plans.building import calculator, variables
from spanloom.plans.queries import ORACLES


def kept(spark):
    return {os.path.join(at, d) for at, dirs, _ in os.walk(lineage.shared_dir(spark).removeprefix("file:")) for d in dirs}


def test_variables_take_one_pass(spark, tmp_path):
    rows = [(k, None if k == 3 else k - 4) for k in range(1, 40)]
    spark.createDataFrame(rows, "c_custkey long, c_nationkey int").write.parquet(str(tmp_path / "customer.parquet"))
    before = kept(spark)
    out = variables(spark, str(tmp_path))
    assert kept(spark) == before and "Broadcast" not in out._jdf.queryExecution().sparkPlan().toString()
    db = duckdb.connect()
    # SQL shifts no negative numbers
    db.execute(f"CREATE VIEW customer AS FROM '{tmp_path}/customer.parquet/*.parquet' WHERE c_nationkey IS NULL OR c_nationkey >= 0")
    expected = {tuple(r) for r in db.execute(ORACLES["variables"]).fetchall()}
    got = {tuple(r) for r in out.collect()}
    assert {r for r in got if r[0] >= 3} == expected and {r[2] for r in got if r[0] == 3} == {None}


def test_quotients_are_cut_off():
    assert [calculator("divmod", [a, 3]) for a in (-7, 7)] == [[-2, -1], [2, 1]] and calculator("/", [-7, 2]) == [-3]
    assert calculator("divmod", [None, 3]) == [None, None] and calculator("neg", [None]) == [None]
