"""Diagrams derived from ordinary tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.lineage import indexed
from ..operators.diagram import INTERFACE, QUOTIENT, Diagram

#: Ids of the kinds in ``trade`` follow each other in this order: kind letter, table, key.
KINDS = (("r", "region", "r_regionkey"), ("n", "nation", "n_nationkey"), ("c", "customer", "c_custkey"), ("s", "supplier", "s_suppkey"), ("p", "part", "p_partkey"), ("o", "orders", "o_orderkey"), ("l", "lineitem", None))
LINE_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items numbered from 0, as ``line``."""
    return indexed(table(spark, sf_dir, "lineitem").select(*LINE_ORDER), LINE_ORDER, "line")


def trade(spark: SparkSession, sf_dir: str, with_lines: bool = True) -> Diagram:
    """One diagram: regions, nations, customers, suppliers, parts, orders and lines are nodes; each but regions and parts is made by an operation.

    A node's id is ten times its key plus the place of its kind, so none has to be looked up.
    """
    place = {k: i for i, (k, _, _) in enumerate(KINDS)}
    at = lambda kind, key: (F.col(key).cast("long") * 10 + place[kind])
    line_rows = lines(spark, sf_dir) if with_lines else None
    read = lambda name: line_rows if name == "lineitem" else table(spark, sf_dir, name)
    kinds = [k for k in KINDS if with_lines or k[0] != "l"]
    zero = F.lit(0).cast("long").alias("gid")
    makes = {"n": [("r", "n_regionkey")], "c": [("n", "c_nationkey")], "s": [("n", "s_nationkey")], "o": [("c", "o_custkey")], "l": [("o", "l_orderkey"), ("p", "l_partkey"), ("s", "l_suppkey")]}
    nodes, edges, wires = [], [], []
    for k, t, key in kinds:
        own = at(k, key or "line")
        nodes.append(read(t).select(zero, own.alias("node"), F.lit(k).alias("label")))
        if k in makes:
            edges.append(read(t).select(zero, own.alias("edge"), F.lit(k).alias("label")))
            wire = lambda side, pos, node: F.struct(F.lit(side).alias("side"), F.lit(pos).cast("long").alias("pos"), node.alias("node"))
            legs = F.explode(F.array(wire("t", 0, own), *[wire("s", i, at(a, b)) for i, (a, b) in enumerate(makes[k])]))
            wires.append(read(t).select(zero, own.alias("edge"), legs.alias("w")).select("gid", "edge", "w.*"))
    union = lambda dfs: reduce(DataFrame.unionByName, dfs)
    return Diagram(union(nodes), union(edges), union(wires), spark.createDataFrame([], INTERFACE), spark.createDataFrame([], QUOTIENT))


def chain(spark: SparkSession, sf_dir: str) -> Diagram:
    """A path for each user, ``gid``: the events in time are operations, each from node k to node k + 1."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("gid"), (F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")) - 1).cast("long").alias("edge"), F.col("event_type").alias("label"))
    n = e.groupBy("gid").agg(F.count("*").alias("n"))
    nodes = n.select("gid", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n"))).alias("node"), F.lit("w").alias("label"))
    zero = F.lit(0).cast("long").alias("pos")
    wires = e.select("gid", "edge", F.lit("s").alias("side"), zero, F.col("edge").alias("node")).unionByName(e.select("gid", "edge", F.lit("t").alias("side"), zero, (F.col("edge") + 1).alias("node")))
    face = n.select("gid", F.lit("s").alias("side"), zero, F.lit(0).cast("long").alias("node")).unionByName(n.select("gid", F.lit("t").alias("side"), zero, F.col("n").alias("node")))
    return Diagram(nodes, e, wires, face, spark.createDataFrame([], QUOTIENT))


def blocks(spark: SparkSession, sf_dir: str, label: str = "user_id") -> Diagram:
    """A lax diagram of events, each to be one with the first of its user and day."""
    e = indexed(table(spark, sf_dir, "events"), ["event_id"], "node")
    nodes = e.select(F.lit(0).cast("long").alias("gid"), "node", F.col(label).alias("label"))
    first = F.min("node").over(W.partitionBy("user_id", F.to_date("ts")))
    pairs = e.select(F.lit(0).cast("long").alias("gid"), F.col("node").alias("seq"), F.col("node").alias("a"), first.alias("b"))
    base = Diagram.empty(spark)
    return Diagram(nodes, base.edges, base.incidence, base.interface, pairs)


def star(spark: SparkSession, sf_dir: str) -> Diagram:
    """A variable for each customer, ``gid``: one source, and a target for each order, which an operation uses."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("gid"), F.row_number().over(W.partitionBy("o_custkey").orderBy("o_orderkey")).cast("long").alias("k"))
    n = o.groupBy("gid").agg(F.count("*").alias("n"))
    zero = F.lit(0).cast("long")
    nodes = n.select("gid", F.explode(F.sequence(zero, F.col("n"))).alias("node"), F.lit("w").alias("label"))
    edges = n.select("gid", zero.alias("edge"), F.lit("Copy").alias("label")).unionByName(o.select("gid", F.col("k").alias("edge"), F.lit("use").alias("label")))
    wires = n.select("gid", zero.alias("edge"), F.lit("s").alias("side"), zero.alias("pos"), zero.alias("node"))
    wires = wires.unionByName(o.select("gid", zero.alias("edge"), F.lit("t").alias("side"), (F.col("k") - 1).alias("pos"), F.col("k").alias("node")))
    wires = wires.unionByName(o.select("gid", F.col("k").alias("edge"), F.lit("s").alias("side"), zero.alias("pos"), F.col("k").alias("node")))
    face = n.select("gid", F.lit("s").alias("side"), zero.alias("pos"), zero.alias("node"))
    return Diagram(nodes, edges, wires, face, spark.createDataFrame([], QUOTIENT))
