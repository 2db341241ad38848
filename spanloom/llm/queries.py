"""The queries of this subpackage, one for each operator, over whole tables, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, lattice, licenses, linededup, mixing, neardup, quality, sharding, tiff, warc
from .common import fresh, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Paths of the vocabularies; parameters of the operators.
BYTE_BPE = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def query(function: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[function.__name__] = function
    return function


@query
def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A WARC record for each row of ``pages``, in packages that are read back. A null html is an empty payload; equal rows each give a record; an empty table gives no rows."""
    pages = table(spark, sf_dir, "pages")
    kind = pages.schema["page_id"].dataType
    back = warc.read(warc.write(pages, fresh(spark, "warc")), payload=False)
    return back.select(F.col("page_id").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"))


ORACLES["op1_warc"] = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, h, sha1(h) AS x, min(page_id) OVER (PARTITION BY h) AS first FROM p)
SELECT page_id, CAST(octet_length(encode(h)) AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(((CAST('0x' || substr(x, CAST(1 + 5 * (i // 4) AS BIGINT), 5) AS BIGINT) >> CAST(5 * (3 - i % 4) AS BIGINT)) & 31) + 1 AS BIGINT), 1)), '') AS payload_digest,
  CASE WHEN page_id IS NOT DISTINCT FROM first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM d
"""


@query
def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words the mix takes of each row of ``documents``; see ``mixing.taken`` for nulls, empty and long texts, repeats and clashing names."""
    return mixing.taken(table(spark, sf_dir, "documents"))


@query
def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, measures and verdict of each row of ``documents``; see ``quality.rules``. A null or empty text fails the base rules; equal rows each give a row."""
    return quality.rules(table(spark, sf_dir, "documents"), PIECES, BYTE_BPE, public_tokenizers.PATTERN)


@query
def op8_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of each row of ``documents``; see ``sharding.documents`` for nulls, ties, repeats and long texts."""
    return sharding.documents(table(spark, sf_dir, "documents"))


@query
def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and their decoding of each row of ``documents``, as digests; see ``bpe.digests``. A null text counts as empty; equal rows each give a row."""
    return bpe.digests(table(spark, sf_dir, "documents"), BYTE_BPE, public_tokenizers.PATTERN)


@query
def op10_tiff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each text of ``documents`` as an image file that is read back, as digests; see ``tiff.digests``. A null text counts as empty; equal texts have equal values."""
    return tiff.digests(table(spark, sf_dir, "documents"))


@query
def op2_minhash_hamming(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The component of near-duplicates of each row of ``documents``; see ``neardup.near_duplicates``. Null and empty texts link with nothing; rows of equal doc_id are one document."""
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


ORACLES["op2_minhash_hamming"] = """
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
  ELSE list_distinct(list_transform(range(1, CAST(len(ws) - 3 AS BIGINT)), lambda i: array_to_string(list_slice(ws, i, i + 4), ' '))) END AS sh FROM w),
e AS (SELECT doc_id, unnest(sh) AS x FROM s), n AS (SELECT doc_id, len(sh) AS n FROM s),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM e a JOIN e b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM o JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * k >= 75 * (p.n + q.n - k)),
r(doc_id, c) AS (SELECT doc_id, doc_id FROM s UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.doc_id WHERE r.c < l.b),
m AS (SELECT doc_id, min(c) AS component_id FROM r GROUP BY 1)
SELECT doc_id, CAST(n AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept FROM n JOIN m USING (doc_id)
"""


@query
def op4_lattice_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probabilities of each row of ``documents``; see ``lattice.scores``. A null text is one token, the end; equal rows each give a row."""
    return lattice.scores(table(spark, sf_dir, "documents"), PIECES)


@query
def op5_line_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` without lines that stand in a chunk that occurs before; see ``linededup.dedup``. A null text stays null; rows of equal doc_id and text are one document."""
    return linededup.dedup(table(spark, sf_dir, "documents"))


ORACLES["op5_line_chunks"] = linededup.ORACLE


@query
def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notices of licenses in ``documents``, and candidates that are none; see ``licenses.scan``. Texts without such words have no rows; equal rows each give theirs."""
    return licenses.scan(table(spark, sf_dir, "documents"))
