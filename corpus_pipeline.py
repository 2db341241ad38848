"""From raw documents to token ids, in five stages of the ``llm`` subpackage.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again
as the ``docs`` of the next. All but the last return the columns of ``documents``. A text that a stage
shortens has its ``n_chars`` counted again.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm import bpe, linededup, mixing, neardup, quality
from spanloom.llm.common import fresh, is_word, pick, table
from spanloom.llm.queries import BYTE_BPE, PIECES

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Numbers of rows without doc_id begin here; ids lie below.
NO_ID = 1 << 62


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep."""
    return quality.rules(docs, PIECES, BYTE_BPE, public_tokenizers.PATTERN, keep_row=True).where("kept").select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that are repeated elsewhere; those of which no word is left go."""
    left = linededup.dedup(docs, keep=("lang", "source", "n_chars"))
    changed = F.col("n_removed") > 0
    out = left.where(~changed | is_word(F.col("text")))
    return out.withColumn("n_chars", F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: that with the smallest doc_id; of rows that repeat it, one.

    A row without doc_id stands behind all that have one, under a number made of its text.
    """
    plain = pick(docs, *COLUMNS)
    number = F.coalesce(F.col("doc_id"), F.lit(NO_ID) + F.shiftrightunsigned(F.xxhash64("text"), 2)).alias("number")
    kept = neardup.near_duplicates(plain.select(number.alias("doc_id"), "text")).where("kept").select(F.col("doc_id").alias("kept_id")).distinct()
    rows = plain.select("*", number)
    return rows.join(kept, F.col("number") == F.col("kept_id"), "left_semi").dropDuplicates(["number", "text"]).select(*COLUMNS)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, in the shuffled order of the mix: shard by shard, which the written files keep."""
    return mixing.mix(docs, COLUMNS).select(*COLUMNS)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each row, encoded and decoded again, with their digests."""
    return bpe.digests(docs, BYTE_BPE, public_tokenizers.PATTERN, ids=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("MinHash near-dedup", near_dedup),
    ("mixing sources to target weights", source_mix),
    ("byte-level BPE encoding and decoding", token_ids),
]

#: The tokeniser's measures and the random mix are beyond SQL; tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            path = fresh(spark, f"pipeline-{i}")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
