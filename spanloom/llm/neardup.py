"""Near-duplicates by a multi-index Hamming join of b-bit MinHash signatures.

A document's set is that of its distinct five-word shingles. Documents with equal sets are one class. A
class has a signature of ``POSITIONS`` symbols of 16 bits, split into ``CHUNKS`` chunks of four. Two
signatures that differ in fewer than twice as many positions as there are chunks agree, by pigeonhole,
in some chunk but for one symbol at most; so with a key for each chunk and each symbol left out of it,
every such pair shares a key. At the threshold, similarity 0.75, a pair differs in 12 of 48 positions
on average, and misses all keys with a probability of 1e-7.

Keys may be shared by very many classes, so no bucket is gathered and no bucket's pairs are listed:

1. Every member is compared, on full sets, with its bucket's leader only, the member that shares most
   keys with others. Links and members stay linear in the keys.
2. What may remain are links between members of one bucket that the leaders left in different
   components. Only members that agree with some other component in enough positions, and of those only
   the ones with shingles enough in common with others (a prefix filter in the order of frequency), are
   compared again, in blocks of ``BLOCK`` by ``BLOCK`` sets, each block pair one small matrix product.

Sets are compared as sets of 64-bit shingle hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.components import least_members, relabel
from . import common
from .common import cut, stored

WIDTH, PERCENT = 5, 75
POSITIONS, CHUNKS = 48, 12
#: Positions in which a linked pair is taken to agree at least; fewer at 0.75 has a probability of 1e-7.
AGREE = 20
BLOCK = 256
ODD = np.array([xxhash.xxh3_64_intdigest(b"position", i) | 1 for i in range(POSITIONS)], dtype=np.uint64)
MIX = np.uint64(0x9E3779B97F4A7C15)
PLACES = [np.uint64(xxhash.xxh3_64_intdigest(b"place", i) | 1) for i in range(WIDTH)]


def shingles(words: list[bytes]) -> np.ndarray:
    """The sorted set of a document's shingle hashes; of fewer than five words the whole is one."""
    if not words:
        return np.zeros(0, dtype=np.uint64)
    if len(words) < WIDTH:
        return np.array([xxhash.xxh3_64_intdigest(b"\0".join(words), 1 + len(words))], dtype=np.uint64)
    digest = xxhash.xxh3_64_intdigest
    h = np.array([digest(w) for w in words], dtype=np.uint64)
    return _sets(h)


def _sets(h: np.ndarray) -> np.ndarray:
    last = len(h) - WIDTH + 1
    out = np.zeros(last, dtype=np.uint64)
    for i, p in enumerate(PLACES):
        out = (out ^ (h[i : last + i] * p)) * MIX
        out ^= out >> np.uint64(29)
    return np.unique(out)


def sets_of(texts: list[str]) -> Iterator[np.ndarray]:
    seen: dict[bytes, int] = {}
    digest = xxhash.xxh3_64_intdigest
    for text in texts:
        words = text.encode("utf-8", "surrogatepass").lower().split()
        if len(words) < WIDTH:
            yield shingles(words)
            continue
        for w in words:
            if w not in seen:
                seen[w] = digest(w)
        yield _sets(np.array([seen[w] for w in words], dtype=np.uint64))


def signature(s: np.ndarray) -> bytes:
    low = np.full(POSITIONS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for i in range(0, len(s), 4096):
        low = np.minimum(low, (s[i : i + 4096, None] * ODD[None, :]).min(axis=0))
    low = (low ^ (low >> np.uint64(31))) * MIX
    return (low >> np.uint64(48)).astype("<u2").tobytes()


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    if 100 * min(len(a), len(b)) < PERCENT * max(len(a), len(b)):
        return False
    both = len(a) + len(b) - len(np.union1d(a, b))
    return 100 * both >= PERCENT * (len(a) + len(b) - both)


def kind_of(docs: DataFrame) -> str:
    """The type of doc_id, which may be any that orders."""
    return common.pick(docs, "doc_id").schema[0].dataType.simpleString()


def signatures(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, set_id, sig) of every document."""

    def step(batch: pa.RecordBatch) -> dict:
        n, ids, sigs = [], [], []
        for s in sets_of(common.texts_of(batch)):
            n.append(len(s))
            ids.append(xxhash.xxh3_128_digest(s.tobytes()))
            sigs.append(signature(s) if len(s) else None)
        return {"doc_id": batch.column("doc_id"), "n_shingles": n, "set_id": ids, "sig": sigs}

    return common.map_slices(common.pick(docs, "doc_id", "text"), step, f"doc_id {kind_of(docs)}, n_shingles long, set_id binary, sig binary")


def keyed(classes: DataFrame) -> DataFrame:
    """(key, id): each class under its keys."""
    keys = []
    for c in range(CHUNKS):
        symbols = [F.substring("sig", 8 * c + 2 * i + 1, 2) for i in range(4)]
        keys += [F.xxhash64(F.lit(4 * c + out), *[s for i, s in enumerate(symbols) if i != out]) for out in range(4)]
    return classes.select("id", F.explode(F.array(*keys)).alias("key"))


def with_sets(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, set) of the documents in ``ids``, which has each once."""

    def step(batch: pa.RecordBatch) -> dict:
        return {"id": batch.column("doc_id"), "set": [s.tobytes() for s in sets_of(common.texts_of(batch))]}

    plain = common.pick(docs, "doc_id", "text")
    # the ids grow with the corpus, so they are never broadcast, however few they are here
    wanted = plain.join(ids.select(F.col("id").alias("doc_id")).hint("merge"), "doc_id", "left_semi")
    return common.map_slices(wanted, step, f"id {kind_of(docs)}, set binary")


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The ``pairs`` (a, b) whose full sets are similar enough."""
    left = sets.select(F.col("id").alias("a"), F.col("set").alias("sa"))
    right = sets.select(F.col("id").alias("b"), F.col("set").alias("sb"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "sa", "sb", (F.octet_length("sa") + F.octet_length("sb")).alias("weight"))

    def step(batch: pa.RecordBatch) -> dict:
        keep = [linked(np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64)) for x, y in zip(batch.column("sa").to_pylist(), batch.column("sb").to_pylist(), strict=True)]
        part = batch.filter(pa.array(keep, type=pa.bool_()))
        return {"a": part.column("a"), "b": part.column("b")}

    kind = both.schema["a"].dataType.simpleString()
    return common.map_slices(both, step, f"a {kind}, b {kind}", by="weight")


def block_links(frame: pd.DataFrame) -> pd.DataFrame:
    """Links between components among the sets of two blocks, as few as join all that are linked."""
    rows = frame.drop_duplicates(["side", "id", "set"])
    left, right = rows[rows["side"] == 0], rows[rows["side"] == 1]
    if not len(right):
        right = left
    sides = []
    for part in (left, right):
        sets = [np.frombuffer(x, dtype=np.uint64) for x in part["set"]]
        sides.append((sets, np.array([len(s) for s in sets]), part["component"].to_numpy()))
    (sa, na, ca), (sb, nb, cb) = sides
    if not len(sa):
        return pd.DataFrame({"a": ca, "b": ca})
    tokens = np.intersect1d(np.concatenate(sa), np.concatenate(sb))
    both = np.zeros((len(sa), len(sb)), dtype=np.float32)

    def incidence(sets: list[np.ndarray], some: np.ndarray) -> np.ndarray:
        out = np.zeros((len(sets), len(some)), dtype=np.float32)
        for i, s in enumerate(sets):
            at = np.searchsorted(some, s)
            at[at == len(some)] = 0
            out[i, at[some[at] == s]] = 1
        return out

    for i in range(0, len(tokens), 8192):
        some = tokens[i : i + 8192]
        both += incidence(sa, some) @ incidence(sb, some).T
    hit = (100 * both >= PERCENT * (na[:, None] + nb[None, :] - both)) & (ca[:, None] != cb[None, :])
    found = sorted({(min(x, y), max(x, y)) for x, y in zip(ca[np.nonzero(hit)[0]], cb[np.nonzero(hit)[1]], strict=True)})
    return pd.DataFrame({"a": np.array([x for x, _ in found], dtype=ca.dtype), "b": np.array([y for _, y in found], dtype=ca.dtype)})


def rest(members: DataFrame, labels: DataFrame, classes: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (a, b) between components of ``labels`` (id, root) that no leader has found."""
    at = relabel(members.select("key", "id", F.col("id").alias("component")), labels, "component")
    at = stored(at, "neardup-at")
    open_ = stored(at.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y").select("key"), "neardup-open")
    some = at.join(open_, "key", "left_semi").select("id", "component").distinct()
    some = stored(some.join(classes.select("id", "sig"), "id"), "neardup-some")
    # of each, the positions in which it agrees with another component
    place = some.select("id", "component", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(POSITIONS - 1)), lambda i: F.substring("sig", 2 * i + 1, F.lit(2)))).alias("position", "symbol"))
    crossed = stored(place.groupBy("position", "symbol").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y").select("position", "symbol"), "neardup-crossed")
    close = place.join(crossed, ["position", "symbol"], "left_semi").groupBy("id", "component").count().where(F.col("count") >= AGREE).select("id", "component")
    close = stored(close.join(sets, "id"), "neardup-close")

    def spread(batch: pa.RecordBatch) -> dict:
        each = [np.frombuffer(x, dtype=np.uint64) for x in batch.column("set").to_pylist()]
        n = [len(s) for s in each]
        flat = np.concatenate(each) if each else np.zeros(0, dtype=np.uint64)
        return {"id": batch.column("id").take(pa.array(np.repeat(np.arange(len(n)), n))), "n": np.repeat(n, n), "shingle": flat.view(np.int64)}

    kind = close.schema["id"].dataType.simpleString()
    rows = common.map_slices(close.select("id", "set"), spread, f"id {kind}, n long, shingle long", by="set", most=1 << 20)
    often = stored(rows.groupBy("shingle").agg(F.count("*").alias("f")).where("f > 1"), "neardup-often")
    shared = rows.join(often, "shingle")
    rank = F.row_number().over(W.partitionBy("id").orderBy("f", "shingle"))
    many = F.count("*").over(W.partitionBy("id"))
    # a set's prefix: all but three quarters of it, plus one; what it has alone comes first in it
    prefix = F.col("n") - F.ceil(F.col("n") * PERCENT / 100) + 1
    live = stored(shared.withColumn("r", rank).withColumn("m", many).where(F.col("r") <= prefix - (F.col("n") - F.col("m"))).select("id", "shingle"), "neardup-live")
    heads = stored(live.groupBy("shingle").agg(F.min("id").alias("b"), F.count("*").alias("c")).where("c > 1").select("shingle", "b"), "neardup-heads")
    groups = least_members(live.join(heads, "shingle").select(F.col("id").alias("a"), "b"))
    sized = cut(groups.groupBy(F.col("root").alias("g")).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")))
    x = close.join(groups.withColumnRenamed("root", "g"), "id").join(sized, "g")
    x = x.withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    x = x.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    x = x.select("g", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).cast("int").alias("side"), "id", "component", "set")
    return x.groupBy("g", "i", "j").applyInPandas(lambda f: block_links(f[["side", "id", "component", "set"]]), f"a {kind}, b {kind}")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of (doc_id, text).

    A-Z count as a-z. Null texts and texts without words have an empty set and link with nothing. Rows of
    equal doc_id count as one document; ids may be of any type that orders. Texts of any length are shingled
    whole, other columns are left out, an empty table gives no rows. A row without doc_id shares the component
    of the rows with its set; where no such row has an id, its component_id is null and it is kept.
    """
    sigs = stored(signatures(docs), "neardup-sigs")
    classes = stored(sigs.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("set_id").agg(F.min("doc_id").alias("id"), F.min("sig").alias("sig")), "neardup-classes")
    keys = keyed(classes)
    buckets = stored(keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "neardup-buckets")
    members = stored(keys.join(buckets, "key"), "neardup-members")
    central = members.groupBy("id").agg(F.sum("n").alias("central"))
    ranked = stored(members.select("key", "id").join(central, "id"), "neardup-ranked")
    leaders = stored(ranked.groupBy("key").agg(F.min(F.struct((-F.col("central")).alias("m"), "id")).alias("top")).select("key", F.col("top.id").alias("b")), "neardup-leaders")
    pairs = stored(ranked.select("key", F.col("id").alias("a")).join(leaders, "key").where("a <> b").select("a", "b").distinct(), "neardup-pairs")
    sets = stored(with_sets(docs, pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()), "neardup-sets")
    links = stored(confirmed(pairs, sets), "neardup-links")
    labels = least_members(links)
    more = least_members(cut(rest(members, labels, classes, sets)))
    final = relabel(classes.select("set_id", F.col("id").alias("component")), labels, "component")
    final = cut(relabel(final, more, "component").select(F.col("set_id").alias("s_"), F.col("component").alias("c_")))
    out = sigs.join(final, (F.col("set_id") == F.col("s_")) & (F.col("n_shingles") > 0), "left")
    out = out.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("c_")).otherwise(F.col("doc_id")).alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
