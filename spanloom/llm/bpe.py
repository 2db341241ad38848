"""Byte-level BPE encoding and decoding over padded matrices.

A text is split by a pattern; each piece that is itself a token is that token. The rest of a slice's
distinct pieces are sorted into buckets by length and stand as padded rows of a matrix. In each round
every row merges its leftmost pair of least rank; rows without a pair that merges leave the matrix.
Whether and to what a pair merges is looked up in a hash table over pairs of ids, whose key holds
whenever the joined bytes are a token, however the token itself came about. Rows of up to ``WIDE`` bytes are
compacted in every round. Wider ones keep the places of merged ids open, linked past, with the least rank
of every block of columns, so that a round looks at few columns of a row; they are compacted whenever half of
their places are open.
"""

from __future__ import annotations

import base64
import functools
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import common

#: Bytes of the widest rows that are compacted in every round, columns of a block of wider ones, and places of one matrix of these.
WIDE, COLUMNS, PLACES = 256, 64, 1 << 20
NONE = np.iinfo(np.int32).max


class HashTable:
    """Open addressing with linear probing over uint64 keys."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(len(keys) * 6).bit_length())
        self.keys = np.full(1 << self.bits, np.uint64(2**64 - 1), dtype=np.uint64)
        self.values = np.full(1 << self.bits, NONE, dtype=np.int32)
        todo = np.arange(len(keys))
        slot = self.slot(keys)
        while len(todo):
            free = self.values[slot[todo]] == NONE
            _, first = np.unique(slot[todo][free], return_index=True)
            now = todo[free][first]
            self.keys[slot[now]], self.values[slot[now]] = keys[now], values[now]
            todo = np.setdiff1d(todo, now, assume_unique=True)
            taken = self.keys[slot[todo]] != keys[todo]
            slot[todo[taken]] = (slot[todo[taken]] + 1) & ((1 << self.bits) - 1)

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The value of each key, or ``NONE``."""
        slot = self.slot(keys)
        found = self.keys[slot]
        out = np.where(found == keys, self.values[slot], NONE)
        open_ = np.flatnonzero((found != keys) & (self.values[slot] != NONE))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & ((1 << self.bits) - 1)
            hit = self.keys[slot[open_]] == keys[open_]
            out[open_[hit]] = self.values[slot[open_[hit]]]
            open_ = open_[~hit & (self.values[slot[open_]] != NONE)]
        return out

    def get(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The merged id of each pair, or ``NONE``; negative ids are padding and never merge."""
        return self.find((left.astype(np.uint64) << np.uint64(32)) | (right.astype(np.uint64) & np.uint64(0xFFFFFFFF)))


class Ranks:
    """A vocabulary of byte strings with ranks, which are also the ids."""

    def __init__(self, path: str):
        with open(path, "rb") as file:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in file if line.strip())}
        lost = [b for b in range(256) if bytes([b]) not in self.ranks]
        if lost:
            raise ValueError(f"{path} has no token for the bytes {lost[:8]}")
        size = max(self.ranks.values()) + 1
        self.bytes_ = np.array([self.ranks[bytes([b])] for b in range(256)], dtype=np.int32)
        pairs = [(self.ranks[t[:i]], self.ranks[t[i:]], r) for t, r in self.ranks.items() for i in range(1, len(t)) if t[:i] in self.ranks and t[i:] in self.ranks]
        a = np.array(pairs, dtype=np.uint64).reshape(-1, 3)
        self.pairs = HashTable((a[:, 0] << np.uint64(32)) | a[:, 1], a[:, 2].astype(np.int32))
        spelled = [b""] * size
        for token, rank in self.ranks.items():
            spelled[rank] = token
        self.lengths = np.array([len(x) for x in spelled], dtype=np.int64)
        self.starts = np.concatenate(([0], np.cumsum(self.lengths)[:-1]))
        self.spelling = np.frombuffer(b"".join(spelled), dtype=np.uint8)

    def encode(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all pieces one after another, and the offsets of each piece."""
        known = [self.ranks.get(p, -1) for p in pieces]
        counts = np.ones(len(pieces), dtype=np.int64)
        direct = np.array(known, dtype=np.int32)
        rest = np.flatnonzero(direct < 0)
        size = np.array([len(pieces[i]) for i in rest], dtype=np.int64)
        counts[rest[size == 0]] = 0
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        low = 0
        for high in (4, 6, 8, 10, 12, 16, 24, 32, 64, 128, WIDE):
            rows = rest[(size > low) & (size <= high)]
            low = high
            if len(rows):
                ids, n = self._matrix([pieces[i] for i in rows], high)
                found.append((rows, ids, n))
                counts[rows] = n
        while (size > low).any():
            high = 2 * low
            rows, low = rest[(size > low) & (size <= high)], high
            for k in range(0, len(rows), max(1, PLACES // high)):
                some = rows[k : k + max(1, PLACES // high)]
                ids, n = self._wide([pieces[i] for i in some], high)
                found.append((some, ids, n))
                counts[some] = n
        offsets = np.concatenate(([0], np.cumsum(counts)))
        out = np.empty(offsets[-1], dtype=np.int32)
        hit = direct >= 0
        out[offsets[:-1][hit]] = direct[hit]
        for rows, ids, n in found:
            keep = np.arange(ids.shape[1])[None, :] < n[:, None]
            at = offsets[rows][:, None] + np.arange(ids.shape[1])[None, :]
            out[at[keep]] = ids[keep]
        return out, offsets

    def _matrix(self, pieces: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
        size = np.array([len(p) for p in pieces], dtype=np.int64)
        raw = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), dtype=np.uint8).reshape(len(pieces), width)
        col = np.arange(width)
        ids = np.where(col[None, :] < size[:, None], self.bytes_[raw], -1).astype(np.int32)
        ranks = np.full((len(pieces), width), NONE, dtype=np.int32)
        ranks[:, :-1] = self.pairs.get(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(len(pieces), width - 1)
        out, n, row = ids.copy(), size.copy(), np.arange(len(pieces))
        while len(row):
            at = ranks.argmin(axis=1)
            best = ranks[np.arange(len(row)), at]
            live = best != NONE
            if not live.all():
                done = ~live
                out[row[done], : ids.shape[1]] = ids[done]
                out[row[done], ids.shape[1] :] = -1
                row, ids, ranks, at, best = row[live], ids[live], ranks[live], at[live], best[live]
                if not len(row):
                    break
            k, w = np.arange(len(row)), ids.shape[1]
            n[row] -= 1
            shift = np.minimum(np.arange(w)[None, :] + (np.arange(w)[None, :] > at[:, None]), w - 1)
            ids, ranks = np.take_along_axis(ids, shift, 1), np.take_along_axis(ranks, shift, 1)
            ids[:, -1], ranks[:, -1] = -1, NONE
            ids[k, at] = best
            ids, ranks = ids[:, :-1], ranks[:, :-1]  # each row has lost an id
            last = w - 2
            right = np.where(at < last, ids[k, np.minimum(at + 1, last)], -1)
            ranks[k, np.minimum(at, last)] = np.where(at <= last, self.pairs.get(best, right), NONE)
            left = np.where(at > 0, ids[k, np.maximum(at - 1, 0)], -1)
            fresh = self.pairs.get(left, best)
            has = at > 0
            ranks[k[has], at[has] - 1] = fresh[has]
            if w == 2:
                out[row, 0], out[row, 1:] = ids[:, 0], -1
                break
        return out, n

    def _wide(self, pieces: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
        """As ``_matrix`` for rows of very many columns."""
        n = np.array([len(p) for p in pieces], dtype=np.int64)
        raw = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), dtype=np.uint8).reshape(len(pieces), width)
        ids = np.where(np.arange(width)[None, :] < n[:, None], self.bytes_[raw], -1).astype(np.int32)
        out, row = np.full(ids.shape, -1, dtype=np.int32), np.arange(len(pieces))
        while len(row):
            ids, done = self._merged(ids, n, row)
            out[row[done], : ids.shape[1]] = ids[done]
            ids, row = ids[~done], row[~done]
        return out, n

    def _merged(self, ids: np.ndarray, n: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rounds over rows without open places, until half of the places of some row are open: compacted rows, and which of them have no pair left; ``n`` is counted down."""
        rows, width = ids.shape[0], -(-ids.shape[1] // COLUMNS) * COLUMNS
        wide = np.full((rows, width + 1), -1, dtype=np.int32)
        wide[:, : ids.shape[1]] = ids
        ranks = np.full((rows, width), NONE, dtype=np.int32)
        ranks[:] = self.pairs.get(wide[:, :-1].ravel(), wide[:, 1:].ravel()).reshape(rows, width)
        least = ranks.reshape(rows, -1, COLUMNS).min(axis=2)
        after, before = np.tile(np.arange(1, width + 2), (rows, 1)), np.tile(np.arange(-1, width), (rows, 1))
        live, left = np.arange(rows), max(1, int(n[row].min()) // 2)
        for _ in range(left):
            block = least[live].argmin(axis=1)
            going = least[live, block] != NONE
            live, block = live[going], block[going]
            if not len(live):
                break
            at = block * COLUMNS + ranks.reshape(rows, -1, COLUMNS)[live, block].argmin(axis=1)
            best = ranks[live, at]
            gone = after[live, at]
            right = after[live, gone]
            wide[live, at], wide[live, gone] = best, -1
            after[live, at] = right
            before[live, np.minimum(right, width - 1)] = np.where(right < width, at, before[live, np.minimum(right, width - 1)])
            ranks[live, gone] = NONE
            ranks[live, at] = np.where(right < width, self.pairs.get(best, wide[live, np.minimum(right, width)]), NONE)
            left_ = before[live, at]
            has = left_ >= 0
            ranks[live[has], left_[has]] = self.pairs.get(wide[live[has], left_[has]], best[has])
            for col in (at, gone, np.maximum(left_, 0)):
                least[live, col // COLUMNS] = ranks.reshape(rows, -1, COLUMNS)[live, col // COLUMNS].min(axis=1)
            n[row[live]] -= 1
        done = (least == NONE).all(axis=1)
        order = np.argsort(wide[:, :-1] < 0, axis=1, kind="stable")
        packed = np.take_along_axis(wide[:, :-1], order, 1)
        return packed[:, : max(1, int(n[row].max()))], done

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all segments of ids, and the offsets of each segment."""
        at, ends = common.gather(self.starts, self.lengths, ids)
        return self.spelling[at], ends[offsets]


@functools.lru_cache(maxsize=4)
def ranks(path: str) -> Ranks:
    return Ranks(path)


@functools.lru_cache(maxsize=4)
def splitter(pattern: str):
    import regex

    return regex.compile(pattern)


def encode_texts(texts: list[str], path: str, pattern: str) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all texts one after another, and the offsets of each text."""
    find, codes, seen, ends = splitter(pattern).findall, [], {}, [0]
    for text in texts:
        codes += [seen.setdefault(p, len(seen)) for p in find(text)]
        ends.append(len(codes))
    ids, offsets = ranks(path).encode([p.encode("utf-8", "surrogatepass") for p in seen])
    at, token_ends = common.gather(offsets[:-1], np.diff(offsets), np.array(codes, dtype=np.int64))
    return ids[at], token_ends[np.array(ends)]


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and ``ids array<int>`` for each row of ``docs``.

    Null and empty texts have no ids; equal rows each give a row; other columns are ignored.
    """

    def step(batch: pa.RecordBatch) -> dict:
        ids, ends = encode_texts(common.texts_of(batch), path, pattern)
        return {"id": batch.column("id"), "ids": pa.ListArray.from_arrays(pa.array(ends, type=pa.int32()), pa.array(ids))}

    plain = common.pick(docs, id_col, text_col).toDF("id", "text")
    return common.map_slices(plain, step, f"id {plain.schema['id'].dataType.simpleString()}, ids array<int>").toDF(id_col, "ids")


def decode(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``id_col`` and ``decoded binary`` for each row; null ids decode to nothing, an id that the vocabulary lacks is an error."""

    def step(batch: pa.RecordBatch) -> dict:
        lists = [x or [] for x in batch.column("ids").to_pylist()]
        ends = np.concatenate(([0], np.cumsum([len(x) for x in lists]))).astype(np.int64)
        flat = np.array([y for x in lists for y in x], dtype=np.int64)
        book = ranks(path)
        if len(flat) and (flat.min() < 0 or flat.max() >= len(book.lengths) or (book.lengths[flat] == 0).any()):
            raise ValueError("an id is not in the vocabulary")
        data, cuts = book.decode(flat, ends)
        return {"id": batch.column("id"), "decoded": [data[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]}

    plain = common.pick(encoded, id_col, ids_col).toDF("id", "ids").selectExpr("id", "ids", "32 * size(ids) as weight")
    return common.map_slices(plain, step, f"id {plain.schema['id'].dataType.simpleString()}, decoded binary", by="weight").toDF(id_col, "decoded")


def digests(docs: DataFrame, path: str, pattern: str, ids: bool = False) -> DataFrame:
    """For each row of (doc_id, text): encode, decode, and digest both; with ``ids`` the ids too.

    Null texts count as empty; an empty text has no ids, and its digests are those of no bytes. Equal rows each
    give a row, a null doc_id stays null, texts of any length are encoded whole, and other columns, clashing
    names among them, are ignored. An empty table gives no rows.
    """
    with_ids = ids

    def step(batch: pa.RecordBatch) -> dict:
        ids, ends = encode_texts(common.texts_of(batch), path, pattern)
        data, cuts = ranks(path).decode(ids, ends)
        raw, decoded = ids.astype("<u4"), memoryview(np.ascontiguousarray(data))
        return {
            "doc_id": batch.column("doc_id"),
            "n_tokens": np.diff(ends),
            "ids_sha256": [hashlib.sha256(raw[a:b].tobytes()).hexdigest() for a, b in zip(ends[:-1], ends[1:], strict=True)],
            "decoded_sha256": [hashlib.sha256(decoded[a:b]).hexdigest() for a, b in zip(cuts[:-1], cuts[1:], strict=True)],
        } | ({"ids": pa.ListArray.from_arrays(pa.array(ends, type=pa.int32()), pa.array(ids))} if with_ids else {})

    plain = common.pick(docs, "doc_id", "text")
    more = ", ids array<int>" if with_ids else ""
    return common.map_slices(plain, step, f"doc_id {plain.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string{more}")
