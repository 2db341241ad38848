"""Line dedup by content-defined chunks of lines, in DataFrame operations only.

The lines of a text, blank ones left out, are hashed, and a rolling hash over two neighbouring line hashes
decides whether the seam between them is a boundary: one seam in ``every``, on average. Boundaries depend on
the text alone, and on no more of it than two lines, so they stand at the same places of a passage wherever
it occurs. Between boundaries lie pieces; a chunk is a piece of several lines, or two neighbouring pieces.
Every occurrence of a chunk but the first, by document and line, is removed.

The smaller ``every``, the shorter the passages that are found whatever stands around them: with 1, which is
the default, every seam is a boundary, pieces are lines, chunks are of two lines, and no repeated passage of
two lines or more is missed. Larger values list fewer chunks and miss passages with fewer than two boundaries.

The rolling hash works in two levels. One boundary in ``BLOCK`` also ends a block, and a block of several lines
that occurs before is removed whole, by one hash. Chunks are then listed only of blocks that remain, and across
the seams between blocks: a chunk inside a block that occurs before has its first occurrence before, too, so
what is removed is the same as if all chunks were listed.

Chunks are compared by the MD5 of all their lines, one after another, and lines byte for byte: a line hash
that stands for different bytes anywhere makes no chunk equal to another. A line that is as long as a
passage, ``long_words`` words, is a chunk by itself, as it would be if it were wrapped over several lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .common import Scratch, looked_up, stored

#: One seam in so many is a boundary.
EVERY = 1
#: Blocks end at one boundary in so many.
BLOCK = 4
#: Words of a line that is a chunk by itself.
LONG_WORDS = 50


def rolled(one: Column, other: Column, every: int) -> Column:
    """Whether the seam between two lines, given by their hashes, is a boundary; ``every`` is 256 at most."""
    return F.conv(F.substring(F.md5(F.concat(one, other)), 1, 2), 16, 10).cast("int") % every == 0


def _lines(docs: DataFrame, long_words: int) -> DataFrame:
    """(doc_id, mark, l): the lines of each text, blank ones left out, with their numbers, hashes and whether they are long."""
    at = F.filter(F.transform(F.split("text", "\n", -1), lambda x, i: F.struct(i.alias("pos"), x.alias("x"))), lambda s: common.is_word(s["x"]))
    return docs.select("doc_id", "mark", F.transform(at, lambda s: F.struct(s["pos"].alias("pos"), F.md5(s["x"]).alias("h"), (F.regexp_count(s["x"], F.lit(common.WORD)) >= long_words).alias("long"))).alias("l")).where(F.size("l") > 0)


def _ends(lines: str, every: int) -> Column:
    """The places in the array ``lines`` where pieces begin, and its size."""
    n = F.size(lines)
    return F.filter(F.sequence(F.lit(0), n), lambda i: (i == 0) | (i == n) | rolled(F.get(lines, i - 1)["h"], F.get(lines, i)["h"], every))


def _chunk(lines: Column) -> Column:
    """All of ``lines`` as a chunk; null if they are not several."""
    return F.when(F.size(lines) > 1, F.struct(F.get(lines, F.lit(0))["pos"].alias("first"), F.element_at(lines, -1)["pos"].alias("last"), F.unhex(F.array_join(F.transform(lines, lambda s: s["h"]), "")).alias("chunk")))


def _listed(rows: DataFrame, every: int) -> tuple[DataFrame, Column]:
    """``rows`` with what is needed for it, and the chunks of the array ``l``."""
    n = F.size("l")
    alone = F.transform(F.filter("l", lambda s: s["long"]), lambda s: F.struct(s["pos"].alias("first"), s["pos"].alias("last"), F.unhex(s["h"]).alias("chunk")))
    if every == 1:
        seams = F.slice("l", 1, F.greatest(n - 1, F.lit(0))), F.slice("l", 2, F.greatest(n - 1, F.lit(0)))
        return rows, F.concat(F.zip_with(*seams, lambda a, b: F.struct(a["pos"].alias("first"), b["pos"].alias("last"), F.unhex(F.concat(a["h"], b["h"])).alias("chunk"))), alone)
    pieces = lambda k: F.transform(F.filter(F.transform("ends", lambda e, i: F.struct(e.alias("a"), F.get("ends", i + k).alias("b"))), lambda s: s["b"].isNotNull()), lambda s: _chunk(F.slice("l", s["a"] + 1, s["b"] - s["a"])))
    return rows.withColumn("ends", _ends("l", every)), F.concat(F.array_compact(F.concat(pieces(1), pieces(2))), alone)


def chunks(docs: DataFrame, every: int = EVERY, long_words: int = LONG_WORDS) -> DataFrame:
    """(doc_id, mark, first, last, chunk) of all chunks of (doc_id, mark, text): the numbers of its lines, blank ones counted, and the hashes of the others."""
    rows, several = _listed(_lines(docs, long_words), every)
    return rows.select("doc_id", "mark", F.explode(several).alias("c")).select("doc_id", "mark", "c.*")


def blocks(docs: DataFrame, every: int, long_words: int = LONG_WORDS) -> DataFrame:
    """(doc_id, mark, l, ahead): the lines of each block, which ends at one seam in ``every``, and those of the block behind it."""
    rows = _lines(docs, long_words).withColumn("ends", _ends("l", every))
    at = F.filter(F.transform("ends", lambda e, i: F.struct(e.alias("a"), F.get("ends", i + 1).alias("b"), F.get("ends", i + 2).alias("c"))), lambda s: s["b"].isNotNull())
    cut = F.transform(at, lambda s: F.struct(F.slice("l", s["a"] + 1, s["b"] - s["a"]).alias("l"), F.slice("l", s["b"] + 1, F.coalesce(s["c"], s["b"]) - s["b"]).alias("ahead")))
    return rows.select("doc_id", "mark", F.explode(cut).alias("b")).select("doc_id", "mark", "b.*")


def chunks_by_block(rows: DataFrame, every: int) -> DataFrame:
    """(doc_id, mark, block, first, last, chunk) of all chunks of ``blocks``, ``block`` the first line of the one that holds it, null where it crosses a seam between two."""
    own = F.col("l")[0]["pos"], F.element_at("l", -1)["pos"]
    rows, several = _listed(rows.withColumn("from", own[0]).withColumn("to", own[1]), every)
    if every == 1:
        joint = F.concat(F.slice("l", -1, 1), F.slice("ahead", 1, 1))
    else:
        rows = rows.withColumn("after", _ends("ahead", every))
        begin = F.get("ends", F.size("ends") - 2)
        joint = F.concat(F.slice("l", begin + 1, F.size("l") - begin), F.slice("ahead", 1, F.coalesce(F.get("after", F.lit(1)), F.lit(0))))
    crossing = F.when(F.size("ahead") > 0, _chunk(joint))
    rows = rows.select("doc_id", "mark", "from", "to", F.explode(F.array_compact(F.concat(several, F.array(crossing)))).alias("c"))
    return rows.select("doc_id", "mark", F.when(F.col("c.last") <= F.col("to"), F.col("from")).alias("block"), "c.*")


def ambiguous(docs: DataFrame) -> DataFrame:
    """(line): hashes that stand for lines of different bytes."""
    lines = docs.select(F.explode(F.split("text", "\n", -1)).alias("x")).where(common.is_word(F.col("x")))
    same = lines.groupBy(F.unhex(F.md5("x")).alias("line")).agg(F.min("x").alias("a"), F.max("x").alias("b"))
    return same.where("a <> b").select("line")


def repeats(found: DataFrame, clash: DataFrame, work: Scratch) -> DataFrame:
    """(doc_id, mark, first, last) of each chunk of ``found`` that occurs before."""
    if not clash.isEmpty():
        parts = found.select("chunk").distinct().select("chunk", F.explode(F.sequence(F.lit(1), F.octet_length("chunk"), F.lit(16))).alias("at"))
        unsure = parts.select("chunk", F.substring("chunk", F.col("at"), F.lit(16)).alias("line")).join(clash, "line", "left_semi").select("chunk").distinct()
        found = work.stored(found.join(unsure, "chunk", "left_anti"), "sure")
    first = F.min(F.struct("doc_id", "mark", "first"))
    heads = work.stored(found.groupBy("chunk").agg(first.alias("o"), F.count("*").alias("n")).where("n > 1").select("chunk", "n", F.col("o.doc_id").alias("od"), F.col("o.mark").alias("om"), F.col("o.first").alias("of")), "heads")
    is_head = F.col("doc_id").eqNullSafe(F.col("od")) & (F.col("mark") == F.col("om")) & (F.col("first") == F.col("of"))
    return looked_up(found, heads, "chunk", "n").where(~is_head).select("doc_id", "mark", "first", "last")


def dedup(docs: DataFrame, keep: tuple[str, ...] = (), every: int = EVERY, long_words: int = LONG_WORDS) -> DataFrame:
    """(doc_id, n_lines, n_removed, text), and the columns ``keep``, for each row of ``docs``.

    ``text`` is without the removed lines; blank lines count in neither number, and those inside a removed
    chunk go with it. The first occurrence of a line always stays. A null text stays null and has no lines,
    an empty one stays empty. Rows of equal doc_id and text are one document, so a repeated row takes nothing
    from itself; a null doc_id sorts first. Further columns and names that clash are left out.
    """
    plain = common.pick(docs, "doc_id", "text", *[k for k in keep if k not in ("doc_id", "text")]).withColumn("mark", F.xxhash64("text"))
    work, first = Scratch(docs.sparkSession, "lines"), Scratch(docs.sparkSession, "line-blocks")
    clash = work.stored(ambiguous(plain), "clash")
    # blocks that occur before go whole; a chunk inside one is never the first of its kind, so only what is left is listed
    split = blocks(plain, every * max(1, min(BLOCK, 256 // every)), long_words)
    whole = work.stored(split.select("doc_id", "mark", _chunk(F.col("l")).alias("c")).where("c IS NOT NULL").select("doc_id", "mark", "c.*"), "blocks")
    known = work.stored(repeats(whole, clash, first), "blocks-gone")
    found = chunks_by_block(split, every).join(known.select(F.col("doc_id").alias("d_"), F.col("mark").alias("m_"), F.col("first").alias("b_")).hint("merge"), F.col("doc_id").eqNullSafe(F.col("d_")) & (F.col("mark") == F.col("m_")) & (F.col("block") == F.col("b_")), "left_anti")
    found = work.stored(found.drop("block"), "chunks")
    gone = stored(repeats(found, clash, work).unionByName(known).groupBy("doc_id", "mark").agg(F.collect_set(F.struct("first", "last")).alias("spans")).withColumnRenamed("doc_id", "d_").withColumnRenamed("mark", "m_"), "lines-gone")
    work.drop()
    first.drop()

    # what is gone grows with the corpus, so it is never broadcast, however little it is here
    gone = gone.hint("merge")
    out = plain.join(gone, plain["doc_id"].eqNullSafe(gone["d_"]) & (plain["mark"] == gone["m_"]), "left").withColumn("lines", F.split("text", "\n", -1))
    at = F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s["first"], s["last"]))))
    out = out.withColumn("gone", F.coalesce(at, F.array().cast("array<int>")))
    left = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("gone"))
    text = F.when(F.size("gone") == 0, F.col("text")).otherwise(F.array_join(F.transform(left, lambda i: F.get("lines", i)), "\n"))
    n_lines = F.when(F.col("text").isNull(), 0).otherwise(F.size(F.filter("lines", common.is_word))).cast("long")
    n_removed = F.size(F.filter("gone", lambda i: common.is_word(F.get("lines", i)))).cast("long")
    return out.select("doc_id", n_lines.alias("n_lines"), n_removed.alias("n_removed"), text.alias("text"), *[k for k in keep if k not in ("doc_id", "text")])


#: With ``every`` 1.
ORACLE = f"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents),
m AS (SELECT doc_id, pos, x, len(regexp_extract_all(x, '[^\\x20\\x09-\\x0D]+')) AS words FROM l WHERE regexp_matches(x, '[^\\x20\\x09-\\x0D]')),
p AS (SELECT doc_id, pos AS first, lead(pos) OVER w AS last, x || chr(10) || lead(x) OVER w AS chunk FROM m WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
g AS (SELECT * FROM p WHERE last IS NOT NULL UNION ALL SELECT doc_id, pos, pos, x FROM m WHERE words >= {LONG_WORDS}),
d AS (SELECT doc_id, first, last FROM g QUALIFY row_number() OVER (PARTITION BY chunk ORDER BY doc_id, first) > 1),
z AS (SELECT DISTINCT doc_id, unnest(range(first, last + 1)) AS pos FROM d),
k AS (SELECT l.doc_id, string_agg(l.x, chr(10) ORDER BY l.pos) FILTER (z.pos IS NULL) AS kept, count(*) FILTER (z.pos IS NOT NULL AND regexp_matches(l.x, '[^\\x20\\x09-\\x0D]')) AS n_removed, count(*) FILTER (regexp_matches(l.x, '[^\\x20\\x09-\\x0D]')) AS n_lines FROM l LEFT JOIN z ON z.doc_id = l.doc_id AND z.pos = l.pos GROUP BY 1)
SELECT doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, CASE WHEN text IS NULL THEN NULL ELSE coalesce(kept, '') END AS text FROM documents LEFT JOIN k USING (doc_id)
"""
