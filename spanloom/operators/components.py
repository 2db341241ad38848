"""Connected components and quotients."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.lineage import cut, dealt, indexed, stored


class LabelConflict(ValueError):
    """Nodes that are to be one have different labels."""


def _ordered(edges: DataFrame, keys: list[str]) -> DataFrame:
    return edges.where("a <> b").select(*keys, F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def relabel(df: DataFrame, labels: DataFrame, column: str, within: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with ``column`` replaced by its ``root`` in ``labels`` (*within, id, root), where it has one."""
    side = labels.select(*[F.col(k).alias(f"{k}_k") for k in within], F.col("id").alias("i_"), F.col("root").alias("r_"))
    same = F.col(column) == F.col("i_")
    for k in within:
        same = same & F.col(k).eqNullSafe(F.col(f"{k}_k"))
    return df.join(dealt(side), same, "left").withColumn(column, F.coalesce("r_", column)).select(*df.columns)


def least_members(edges: DataFrame, within: tuple[str, ...] = ()) -> DataFrame:
    """(*within, id, root): the least id that each id of ``edges`` (*within, a, b) is joined to.

    By contraction: every id hooks onto its least neighbour, the trees are flattened by pointer jumping,
    and the edges are rewritten to the roots, until none is left. Minima are aggregated before a shuffle,
    so an id with very many edges gathers nowhere.
    """
    keys = list(within)
    edges = stored(_ordered(edges, keys), "edges")
    labels = None
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(*keys, F.col("b").alias("a"), F.col("a").alias("b")))
        parent = stored(both.groupBy(*keys, F.col("a").alias("id")).agg(F.min("b").alias("m")).select(*keys, "id", F.least("id", "m").alias("root")), "parents")
        while True:
            jumped = stored(relabel(parent.withColumn("was", F.col("root")), parent, "root", within), "parents")
            parent = jumped.drop("was")
            if jumped.where("root <> was").isEmpty():
                break
        labels = parent if labels is None else stored(relabel(labels, parent, "root", within), "roots")
        edges = stored(_ordered(relabel(relabel(edges, parent, "a", within), parent, "b", within), keys), "edges")
    return labels if labels is not None else edges.select(*keys, F.col("a").alias("id"), F.col("b").alias("root"))


def quotient_map(nodes: DataFrame, pairs: DataFrame, within: tuple[str, ...] = ()) -> DataFrame:
    """(*within, id, component) for every id of ``nodes`` (*within, id): components of ``pairs`` (*within, a, b), numbered from 0 in the order of their least ids."""
    keys = list(within)
    rooted = relabel(nodes.select(*keys, "id", F.col("id").alias("root")), least_members(pairs, within), "root", within)
    rooted = stored(rooted, "rooted")
    numbers = indexed(rooted.select(*keys, "root").distinct(), ["root"], "component", within)
    side = numbers.select(*[F.col(k).alias(f"{k}_k") for k in keys], F.col("root").alias("r_"), "component")
    same = F.col("root") == F.col("r_")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"{k}_k"))
    return rooted.join(dealt(side), same).select(*keys, "id", "component")


def connected_components(sources: DataFrame, targets: DataFrame, n: int) -> tuple[DataFrame, int]:
    """Components of 0 to ``n - 1`` under ``sources[i] ~ targets[i]``, as an (i, v) array, and how many there are."""
    pairs = sources.select("i", F.col("v").alias("a")).join(targets.select(F.col("i").alias("j_"), F.col("v").alias("b")), F.col("i") == F.col("j_"), "full")
    pairs = pairs.select(F.when(F.col("a").isNull() | F.col("b").isNull() | (F.greatest("a", "b") >= n), F.raise_error(F.lit("not a list of edges"))).otherwise(F.col("a")).alias("a"), "b")
    labels = cut(quotient_map(sources.sparkSession.range(n), pairs))
    return labels.select(F.col("id").alias("i"), F.col("component").alias("v")), (labels.agg(F.max("component")).first()[0] if n else -1) + 1


def to_dense(a: DataFrame) -> tuple[DataFrame, int]:
    """Any keys renumbered from 0 in the order of their first appearance, and how many there are."""
    first = indexed(a.groupBy("v").agg(F.min("i").alias("f_")), ["f_"], "d_")
    out = cut(a.join(first.select(F.col("v").alias("k_"), "d_"), F.col("v").eqNullSafe(F.col("k_"))).select("i", F.col("d_").alias("v")))
    return out, (out.agg(F.max("v")).first()[0] if not out.isEmpty() else -1) + 1


def push_labels(q: DataFrame, labels: DataFrame, within: tuple[str, ...] = ()) -> DataFrame:
    """(*within, component, label, clash): labels (*within, id, label) through ``q``; ``clash`` where members' labels differ.

    Labels are compared null-safe and may be structs; count and distinct extremes decide.
    """
    keys = list(within)
    both = q.join(dealt(labels), [*keys, "id"])
    some = F.count("label") < F.count("*")
    return both.groupBy(*keys, "component").agg(F.min("label").alias("label"), (~F.min("label").eqNullSafe(F.max("label")) | (some & (F.count("label") > 0))).alias("clash"))
