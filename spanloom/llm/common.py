"""What the operators of this subpackage share: picking columns, batches of Arrow rows, the shared folder.

A *word* is everywhere a run of ``[^\\x20\\x09-\\x0D]+``. On the JVM that is a regular expression, in
Python ``bytes.split()`` of the UTF-8 text, which splits at exactly these six bytes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.lineage import cut, fresh, looked_up, remove, stored  # noqa: F401

#: Of the text that one step holds as Python objects at a time.
SLICE_BYTES = 4 << 20
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def pick(df: DataFrame, *names: str) -> DataFrame:
    """The columns of exactly these names, the first of each; whatever else ``df`` has, equal names in another case included, is left out."""
    have = df.columns
    at = [have.index(n) for n in names]
    return df.toDF(*[f"c{i}_" for i in range(len(have))]).select(*[F.col(f"c{i}_").alias(n) for i, n in zip(at, names, strict=True)])


def n_words(text: Column) -> Column:
    """Words of a text as BIGINT; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def is_word(text: Column) -> Column:
    """Whether a text has a word; null for null."""
    return text.rlike(WORD)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Scratch:
    """Tables of one computation in a folder of their own, which goes as a whole once the results stand elsewhere."""

    def __init__(self, spark: SparkSession, what: str):
        self.spark, self.path = spark, fresh(spark, what)

    def stored(self, df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{self.path}/{name}")
        return self.spark.read.parquet(f"{self.path}/{name}")

    def drop(self) -> None:
        remove(self.spark, self.path)


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """``batch`` in pieces whose ``column``, texts or a number of bytes, comes to at most ``most``, or one row."""
    if batch.num_rows == 0:
        return
    values = batch.column(column)
    sizes = values if pa.types.is_integer(values.type) else pc.binary_length(values)
    ends = np.cumsum(pc.fill_null(sizes, 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < batch.num_rows:
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + most, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """Null texts count as empty."""
    return [x or "" for x in batch.column(column).to_pylist()]


def map_slices(df: DataFrame, step: Callable[[pa.RecordBatch], dict], schema: str, by: str = "text", most: int = SLICE_BYTES) -> DataFrame:
    """``step`` over slices of Arrow batches; it returns the columns of ``schema``.

    Spark bounds a batch by ``spark.sql.execution.arrow.maxBytesPerBatch``, 64 MB unless set, so many very
    long texts come in many batches.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    kind = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, by, most):
                out = step(part)
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], type=f.type) if not isinstance(out[f.name], pa.Array) else out[f.name].cast(f.type) for f in kind], schema=kind)

    return df.mapInArrow(run, schema)


def gather(starts: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the items of the segments ``codes`` one after another, and the offsets of each."""
    n = lengths[codes]
    ends = np.cumsum(n)
    offsets = np.concatenate(([0], ends))
    at = np.arange(offsets[-1], dtype=np.int64) + np.repeat(starts[codes] - offsets[:-1], n)
    return at, offsets
