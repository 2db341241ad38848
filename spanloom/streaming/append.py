"""A diagram collection that grows by a stream of operations.

Each micro-batch of (gid, edge_key, label, src_types, tgt_types) is numbered behind what is stored and
appended as Parquet. Batches are written under their epoch, so one that is retried replaces itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.lineage import cut, indexed
from ..operators.diagram import EDGES, INCIDENCE, INTERFACE, NODES, QUOTIENT, Diagram

SCHEMAS = {"nodes": NODES.format("string"), "edges": EDGES.format("string"), "incidence": INCIDENCE}


def read(spark: SparkSession, path: str, before: int | None = None) -> Diagram:
    """What is stored, or what the epochs under ``before`` have stored."""
    tables = []
    for name, schema in SCHEMAS.items():
        found = spark.read.schema(f"{schema}, epoch bigint").parquet(f"{path}/{name}") if _exists(spark, f"{path}/{name}") else spark.createDataFrame([], f"{schema}, epoch bigint")
        tables.append((found if before is None else found.where(F.col("epoch") < before)).drop("epoch"))
    return Diagram(*tables, spark.createDataFrame([], INTERFACE), spark.createDataFrame([], QUOTIENT))


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def append_batch(batch: DataFrame, epoch: int, path: str) -> None:
    """Stores one batch; of an empty one nothing."""
    spark = batch.sparkSession
    ops = cut(indexed(batch, ["edge_key"], "edge", ("gid",)))
    if ops.isEmpty():
        return
    by = cut(read(spark, path, before=epoch).sizes())
    new = Diagram.from_operations(ops.select("gid", "edge", "label", "src_types", "tgt_types"))._moved(by)
    for name in SCHEMAS:
        getattr(new, name).write.mode("overwrite").parquet(f"{path}/{name}/epoch={epoch}")


def append_stream(operations: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Starts appending a stream of operations to the collection at ``path``."""
    return operations.writeStream.foreachBatch(lambda df, epoch: append_batch(df, epoch, path)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
