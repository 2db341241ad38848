"""Diagrams in and out: JSON lines, Parquet tables and Graphviz text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.diagram import Diagram

TABLES = ("nodes", "edges", "incidence", "interface", "quotient")


def write_parquet(d: Diagram, path: str) -> None:
    for name in TABLES:
        getattr(d, name).write.parquet(f"{path}/{name}")


def read_parquet(spark: SparkSession, path: str) -> Diagram:
    return Diagram(*[spark.read.parquet(f"{path}/{name}") for name in TABLES])


def _list(order: str, value: str):
    return F.transform(F.sort_array(F.collect_list(F.struct(order, value))), lambda s: s[value])


def to_json(d: Diagram) -> DataFrame:
    """(gid, json): a document for each diagram, {sources, targets, hypergraph {nodes, edges, adjacency, quotient}}."""
    empty = F.array()
    ops = d.nested().groupBy("gid").agg(_list("edge", "label").alias("edges"), F.transform(F.sort_array(F.collect_list(F.struct("edge", F.struct("sources", "targets").alias("a")))), lambda s: s["a"]).alias("adjacency"))
    nodes = d.nodes.groupBy("gid").agg(_list("node", "label").alias("nodes"))
    legs = lambda s: F.transform(F.sort_array(F.collect_list(F.when(F.col("side") == s, F.struct("pos", "node")))), lambda x: x["node"])
    face = d.interface.groupBy("gid").agg(legs("s").alias("sources"), legs("t").alias("targets"))
    pairs = d.quotient.groupBy("gid").agg(_list("seq", "a").alias("qa"), _list("seq", "b").alias("qb"))
    all_ = nodes.join(ops, "gid", "full").join(face, "gid", "full").join(pairs, "gid", "full")
    some = lambda c: F.coalesce(F.col(c), empty.cast(all_.schema[c].dataType))
    graph = F.struct(some("nodes").alias("nodes"), some("edges").alias("edges"), some("adjacency").alias("adjacency"), F.array(some("qa"), some("qb")).alias("quotient"))
    return all_.select("gid", F.to_json(F.struct(some("sources").alias("sources"), some("targets").alias("targets"), graph.alias("hypergraph"))).alias("json"))


def from_json(df: DataFrame, node_kind: str = "string", edge_kind: str = "string") -> Diagram:
    """Diagrams from (gid, json); a document that does not parse is an error."""
    schema = f"sources array<bigint>, targets array<bigint>, hypergraph struct<nodes: array<{node_kind}>, edges: array<{edge_kind}>, adjacency: array<struct<sources: array<bigint>, targets: array<bigint>>>, quotient: array<array<bigint>>>"
    x = df.select("gid", F.from_json("json", schema, {"mode": "FAILFAST"}).alias("j"))
    h = "j.hypergraph."
    nodes = x.select("gid", F.posexplode(h + "nodes").alias("node", "label")).withColumn("node", F.col("node").cast("long"))
    edges = x.select("gid", F.posexplode(h + "edges").alias("edge", "label")).withColumn("edge", F.col("edge").cast("long"))
    ops = x.select("gid", F.posexplode(h + "adjacency").alias("edge", "a"))
    rows = ops.select("gid", "edge", F.lit("s").alias("side"), F.posexplode("a.sources").alias("pos", "node")).unionByName(ops.select("gid", "edge", F.lit("t").alias("side"), F.posexplode("a.targets").alias("pos", "node")))
    face = x.select("gid", F.lit("s").alias("side"), F.posexplode("j.sources").alias("pos", "node")).unionByName(x.select("gid", F.lit("t").alias("side"), F.posexplode("j.targets").alias("pos", "node")))
    pairs = x.select("gid", F.posexplode(F.arrays_zip(F.element_at(h + "quotient", 1).alias("a"), F.element_at(h + "quotient", 2).alias("b"))).alias("seq", "p"))
    long = lambda d, *cs: d.withColumns({c: F.col(c).cast("long") for c in cs})
    return Diagram(nodes, edges, long(rows, "edge", "pos"), long(face, "pos"), long(pairs.select("gid", "seq", F.col("p")["a"].alias("a"), F.col("p")["b"].alias("b")), "seq"))


def to_dot(d: Diagram) -> DataFrame:
    """(gid, dot): Graphviz text of each diagram."""
    quoted = lambda c: F.concat(F.lit('"'), F.regexp_replace(F.col(c).cast("string"), r'(["\\])', r"\\$1"), F.lit('"'))
    node, edge = F.concat(F.lit("n"), F.col("node")), F.concat(F.lit("e"), F.col("edge"))
    lines = d.nodes.select("gid", F.lit(0).alias("a"), F.col("node").alias("b"), F.lit(0).cast("long").alias("c"), F.concat(node, F.lit(" [shape=point, xlabel="), quoted("label"), F.lit("];")).alias("line"))
    lines = lines.unionByName(d.edges.select("gid", F.lit(1).alias("a"), F.col("edge").alias("b"), F.lit(0).cast("long").alias("c"), F.concat(edge, F.lit(" [shape=box, label="), quoted("label"), F.lit("];")).alias("line")))
    arrow = F.when(F.col("side") == "s", F.concat(node, F.lit(" -> "), edge, F.lit(' [headlabel="'), F.col("pos"), F.lit('"];'))).otherwise(F.concat(edge, F.lit(" -> "), node, F.lit(' [taillabel="'), F.col("pos"), F.lit('"];')))
    lines = lines.unionByName(d.incidence.select("gid", F.when(F.col("side") == "s", 2).otherwise(3).alias("a"), F.col("edge").alias("b"), F.col("pos").alias("c"), arrow.alias("line")))
    listed = F.transform(F.sort_array(F.collect_list(F.struct("a", "b", "c", "line"))), lambda s: s["line"])
    return lines.groupBy("gid").agg(F.concat(F.lit("digraph {\n"), F.array_join(listed, "\n"), F.lit("\n}")).alias("dot"))
