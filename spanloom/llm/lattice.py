"""Language-model scoring by the likelihood of subword lattices.

The pieces of a public vocabulary, in the order of its scores, span a lattice over every word: its arcs
are the pieces that spell a part of it, and the bytes of characters that no piece spells. The sum over all
paths is found by a forward recursion in log space; a text's probability is the product over its words
and its end, so it is marginal over all segmentations of the text. The vocabulary's scores are ranks: by
Zipf's law a piece of rank r has a weight of 1 / (r + 1). These weights are then moved towards the training
texts by expectation-maximisation, still over the same pieces, until words of training texts that were left
out of it are not told better. A further score, with a cache of words, takes a word of the training texts as
one more arc, over the whole lattice: of N tokens, V of them distinct, a token seen c times has c / (N + V),
and the paths through pieces share the rest, V / (N + V).

Words recur, so each distinct word is looked at once. Counts of all words form a table in the shared
folder. The most frequent ``HEAD`` words, if they are not very long, are sent to the workers; a text's other words
are joined to the table. What reaches the driver is bounded by the vocabulary and by ``HEAD``.
"""

from __future__ import annotations

import functools
import os
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .bpe import NONE, HashTable

SPACE = "▁"
#: Most frequent words that every worker holds, and the bytes of the longest of them; together they bound what is broadcast.
HEAD, HEAD_BYTES = 1 << 18, 64
#: Most rounds of expectation-maximisation, and nats a token by which a round has to improve on the one before; uses that the prior counts for.
ROUNDS, GAIN, PRIOR = 8, 0.005, 1000.0
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
#: Nats by which a character's probability is raised.
LIFT = 3.0
#: Characters of the longest word that stands in a matrix with others of its length.
WIDE = 64
#: Words of one matrix, and of the batches that they are sorted out of.
ROWS, POOL = 1 << 13, 1 << 16


class Lattice:
    """Pieces with their prior; id 0 to 255 are the bytes, the last is the end of a text."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        text, rank = [], []
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i)) and SPACE not in piece[1:]:
                text.append(piece)
                rank.append(-model.get_score(i))
        self.text = text
        self.size = 256 + len(text) + 1
        self.longest = max(map(len, text))
        keys = np.array([self.hash_of(t) for t in text], dtype=np.uint64)
        self.table = HashTable(keys, np.arange(256, 256 + len(text), dtype=np.int32))
        weight = 1.0 / (1.0 + np.array(rank))
        self.prior = np.concatenate((np.full(256, weight.min() / 256), weight, [weight.max()]))
        self.prior /= self.prior.sum()

    @staticmethod
    def hash_of(piece: str) -> int:
        h = 0
        for c in piece:
            h = (h * int(BASE) + ord(c) + 1) & (2**64 - 1)
        return h

    def arcs(self, points: np.ndarray) -> list[np.ndarray]:
        """For rows of equally many code points: at [l - 1] the piece of each substring of length l by its start, or ``NONE``."""
        n, width = points.shape
        prefix = np.zeros((n, width + 1), dtype=np.uint64)
        for i in range(width):
            prefix[:, i + 1] = prefix[:, i] * BASE + points[:, i] + np.uint64(1)
        out, power = [], BASE
        for size in range(1, min(self.longest, width) + 1):
            h = prefix[:, size:] - prefix[:, : width + 1 - size] * power
            out.append(self.table.find(h.ravel()).reshape(h.shape))
            power = np.uint64((int(power) * int(BASE)) & (2**64 - 1))
        return out

    def weights(self, points: np.ndarray, arcs: list[np.ndarray], log_p: np.ndarray) -> list[np.ndarray]:
        """Log weights of the arcs; a character without a piece is its bytes."""
        lp = np.append(log_p, -np.inf)
        out = [lp[np.where(a == NONE, len(log_p), a)] for a in arcs]
        for r, c in zip(*np.nonzero(arcs[0] == NONE), strict=True):
            out[0][r, c] = sum(log_p[b] for b in chr(points[r, c]).encode("utf-8", "surrogatepass"))
        return out

    def forward(self, w: list[np.ndarray], width: int) -> np.ndarray:
        n = len(w[0])
        alpha = np.full((n, width + 1), -np.inf)
        alpha[:, 0] = 0
        for j in range(1, width + 1):
            reach = min(j, len(w))
            options = np.stack([alpha[:, j - size] + w[size - 1][:, j - size] for size in range(1, reach + 1)])
            top = options.max(axis=0)
            alpha[:, j] = top + np.log(np.exp(options - top).sum(axis=0))
        return alpha

    def batches(self, words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(rows of ``words``, their code points with the space in front), by equal length and at most so many at a time."""
        sizes = np.array([len(w) for w in words])
        for size in np.unique(sizes):
            rows = np.flatnonzero(sizes == size)
            most = max(1, ROWS * 8 // (int(size) + 1)) if size <= WIDE else max(1, (1 << 20) // int(size))
            for i in range(0, len(rows), most):
                some = rows[i : i + most]
                text = "".join(SPACE + words[k] for k in some)
                yield some, np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).reshape(len(some), int(size) + 1).astype(np.uint64)

    def score(self, words: list[str], log_p: np.ndarray) -> np.ndarray:
        """Natural log of each word's probability."""
        out = np.zeros(len(words))
        for rows, points in self.batches(words):
            w = self.weights(points, self.arcs(points), log_p)
            out[rows] = self.forward(w, points.shape[1])[:, -1]
        return out

    def expect(self, words: list[str], counts: np.ndarray, log_p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Expected uses of every piece over ``counts`` of the words, and the natural log of each word's probability.

        Products of ordinary numbers, raised by ``LIFT`` a character, do for all words but those whose
        probability leaves their range; these go through logarithms.
        """
        out, scores = np.zeros(self.size), np.zeros(len(words))
        for rows, points in self.batches(words):
            width, arcs = points.shape[1], self.arcs(points)
            w = self.weights(points, arcs, log_p)
            lifted = [np.exp(x + LIFT * size).T.copy() for size, x in enumerate(w, 1)]
            alpha = self.products(lifted, width)
            beta = self.products([x[::-1] for x in lifted], width)[::-1]
            total = alpha[-1]
            fits = (total > 1e-200) & (total < 1e200)
            with np.errstate(divide="ignore", invalid="ignore"):
                scores[rows] = np.log(total) - LIFT * width
                share = np.where(fits, counts[rows] / total, 0.0)
                self._add(out, points, arcs, lambda size: np.where(fits[:, None], (alpha[: width + 1 - size] * lifted[size - 1] * beta[size:] * share).T, 0.0))
            odd = np.flatnonzero(~fits)
            if len(odd):
                some = [x[odd] for x in w]
                a, b = self.forward(some, width), self.forward([x[:, ::-1] for x in some], width)[:, ::-1]
                scores[rows[odd]] = a[:, -1]
                self._add(out, points[odd], [x[odd] for x in arcs], lambda size: np.exp(a[:, : width + 1 - size] + some[size - 1] + b[:, size:] - a[:, -1:]) * counts[rows[odd], None])
        return out, scores

    def products(self, w: list[np.ndarray], width: int) -> np.ndarray:
        """As ``forward`` without logarithms; a row for each place, a column for each word."""
        alpha = np.zeros((width + 1, w[0].shape[1]))
        alpha[0] = 1
        for j in range(1, width + 1):
            for size in range(1, min(j, len(w)) + 1):
                alpha[j] += alpha[j - size] * w[size - 1][j - size]
        return alpha

    def _add(self, out: np.ndarray, points: np.ndarray, arcs: list[np.ndarray], use: Callable[[int], np.ndarray]) -> None:
        """Adds to ``out`` the uses of each arc, which ``use`` gives by its length."""
        for size, a in enumerate(arcs, 1):
            u, known = use(size), a != NONE
            out += np.bincount(a[known], weights=u[known], minlength=self.size)
            if size == 1:
                for r, c in zip(*np.nonzero(~known), strict=True):
                    for b in chr(points[r, c]).encode("utf-8", "surrogatepass"):
                        out[b] += u[r, c]


@functools.lru_cache(maxsize=2)
def lattice(path: str) -> Lattice:
    return Lattice(path)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def text_of(word: bytes) -> str:
    return word.decode("utf-8", "surrogatepass")


def pooled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of short batches in batches of ``POOL``, as matrices are slow on few rows."""
    held, rows = [], 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= POOL:
            yield pa.concat_batches(held)
            held, rows = [], 0
    if held:
        yield pa.concat_batches(held)


def count_words(docs: DataFrame) -> DataFrame:
    """(word, train, dev, every): uses of each word in the rows of (text, part) whose part is not 0, in those of part 1, and in all."""

    def step(batch: pa.RecordBatch) -> dict:
        sides: tuple[Counter, ...] = (Counter(), Counter(), Counter())
        for text, part in zip(batch.column("text").to_pylist(), batch.column("part").to_pylist(), strict=True):
            sides[min(part, 2)].update(words_of(text))
        words = list(sides[0].keys() | sides[1].keys() | sides[2].keys())
        dev = [sides[1][w] for w in words]
        train = [a + sides[2][w] for a, w in zip(dev, words, strict=True)]
        return {"word": [text_of(w) for w in words], "train": train, "dev": dev, "every": [a + sides[0][w] for a, w in zip(train, words, strict=True)]}

    seen = common.map_slices(docs.select("text", "part"), step, "word string, train long, dev long, every long", most=16 << 20)
    return seen.groupBy("word").agg(*[F.sum(c).alias(c) for c in ("train", "dev", "every")])


def fit(words: DataFrame, n_ends: int, path: str, rounds: int = ROUNDS, gain: float = GAIN) -> np.ndarray:
    """Log weights of the pieces after expectation-maximisation over (word, train, dev), from the prior and with it as ``PRIOR`` uses.

    Uses in ``dev``, a part of those in ``train``, are left out of it; it ends once they are told better by
    less than ``gain`` a token than the round before, at the latest after ``rounds``.
    """
    model = lattice(path)
    log_p = best = np.log(model.prior)
    n_dev, before = words.agg(F.coalesce(F.sum("dev"), F.lit(0))).first()[0], -np.inf
    for _ in range(rounds + 1):

        def run(batches: Iterator[pa.RecordBatch], log_p: np.ndarray = log_p) -> Iterator[pa.RecordBatch]:
            total, told = None, 0.0
            for batch in pooled(batches):
                train, dev = (batch.column(c).to_numpy().astype(float) for c in ("train", "dev"))
                got, scores = lattice(path).expect(batch.column("word").to_pylist(), train - dev, log_p)
                total, told = got if total is None else total + got, told + float(dev @ scores)
            if total is not None:
                at = np.flatnonzero(total)
                yield pa.RecordBatch.from_pydict({"piece": pa.array(np.append(at, -1), pa.int64()), "uses": pa.array(np.append(total[at], told))})

        found = words.where("train > 0").select("word", "train", "dev").mapInArrow(run, "piece long, uses double").groupBy("piece").agg(F.sum("uses").alias("uses")).collect()
        sums = {r["piece"]: r["uses"] for r in found}
        told = sums.pop(-1, 0.0) / max(1, n_dev)
        if told < before + gain:
            return log_p if told >= before else best
        best, before = log_p, told
        uses = np.zeros(model.size)
        uses[list(sums)] = list(sums.values())
        uses[-1] += n_ends
        p = uses + PRIOR * model.prior
        log_p = np.log(p / p.sum())
    return best


def scores(docs: DataFrame, path: str, head: int = HEAD) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, cached_score) for each row of (doc_id, text).

    ``score`` is the lattice's alone, ``cached_score`` that with the words of the training texts as arcs.
    Texts whose remainder is 1, a ninth of the training texts, say when the pieces' weights are fitted; all
    training texts count for the base score and the cache. A null text is empty: one token, the end. A null
    doc_id is held out, as the crc32 of no text is 0. Texts of any length are scored whole, equal rows each
    give a row, other columns are left out, an empty table gives no rows. Without training texts all words
    are unknown, and the pieces keep their prior.
    """
    spark = docs.sparkSession
    part = (F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 10).cast("int")
    plain = common.pick(docs, "doc_id", "text").withColumn("part", part).withColumn("held_out", F.col("part") == 0)
    kind = plain.schema["doc_id"].dataType.simpleString()
    words = common.stored(count_words(plain), "lm-words")
    ends = plain.where(~F.col("held_out")).count()
    tokens, distinct = words.agg(F.coalesce(F.sum("train"), F.lit(0)), F.count_if(F.col("train") > 0)).first()
    tokens, distinct = tokens + ends, distinct + (ends > 0)
    log_p = fit(words, ends, path)
    floor = tokens + 0.1 * (distinct + 1)

    # words that end at a space or at the end of the text share one distribution with the end itself
    starts = np.array([t.startswith(SPACE) for t in lattice(path).text])
    at_end = log_p[-1] - np.logaddexp(np.logaddexp.reduce(log_p[256:-1][starts]), log_p[-1])
    seen_mass, rest = 1 / max(1, tokens + distinct), np.log(distinct / (tokens + distinct)) if tokens else 0.0

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pooled(batches):
            train, paths = batch.column("train").to_numpy(), lattice(path).score(batch.column("word").to_pylist(), log_p)
            with np.errstate(divide="ignore"):
                cached = np.logaddexp(np.log(train * seen_mass), rest + paths) / np.log(10)
            base = np.log10((train + 0.1) / floor)
            yield pa.RecordBatch.from_arrays([batch.column("word"), pa.array(train > 0), batch.column("every"), pa.array(base), pa.array(paths / np.log(10)), pa.array(cached)], names=["word", "known", "every", "base", "score", "cached"])

    table = common.stored(words.mapInArrow(score, "word string, known boolean, every long, base double, score double, cached double"), "lm-scores")
    # how frequent the most frequent words are, of which there may be `head` at most
    steps = table.groupBy(F.ceil(F.log2(F.col("every").cast("double")) * 8).alias("step")).agg(F.count("*").alias("n"), F.max("every").alias("most")).orderBy(F.desc("step")).collect()
    least, room = None, head
    for r in steps:
        room -= r["n"]
        if room < 0:
            least = r["most"]
            break
    top = table.where((F.lit(True) if least is None else F.col("every") > least) & (F.octet_length("word") <= HEAD_BYTES))
    rows = top.select("word", "known", "base", "score", "cached").collect()
    end_base = float(np.log10((ends + 0.1) / floor))
    end_score = float(at_end / np.log(10))
    end_cached = float(np.logaddexp(np.log(ends * seen_mass), rest + at_end) if ends else rest + at_end) / float(np.log(10))
    columns = np.array([(r["known"], r["base"], r["score"], r["cached"]) for r in rows], dtype=float).reshape(-1, 4)
    known = spark.sparkContext.broadcast(({r["word"].encode("utf-8", "surrogatepass"): i for i, r in enumerate(rows)}, columns))

    # a rare or very long word may still be in a third of the texts, so words that are no heads are looked up with hot ones apart
    def step(batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {k: [] for k in ("row", "doc_id", "held_out", "n_tokens", "word", "n", "n_known", "base", "score", "cached")}
        mark = int.from_bytes(os.urandom(16), "little")
        book, values = known.value
        get, lists = book.get, list(out.values())
        for i, (doc, text, held_out) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "held_out")), strict=True)):
            found, row = words_of(text), f"{mark:x}.{i}"
            at = [get(w, -1) for w in found]
            seen, base, total, cached = values[[k for k in at if k >= 0]].sum(axis=0)
            others = Counter(w for w, k in zip(found, at, strict=True) if k < 0)
            for w, n in others.items():
                for c, v in zip(lists, (row, None, None, None, text_of(w), n, None, None, None, None), strict=True):
                    c.append(v)
            own = (row, doc, held_out, len(found) + 1, None, None, int(seen) + (ends > 0), float(base) + end_base, float(total) + end_score, float(cached) + end_cached)
            for c, v in zip(lists, own, strict=True):
                c.append(v)
        return out

    parts = common.stored(common.map_slices(plain.drop("part"), step, f"row string, doc_id {kind}, held_out boolean, n_tokens long, word string, n long, n_known long, base double, score double, cached double"), "lm-parts")
    told = ("base", "score", "cached")
    rare = common.looked_up(parts.where("word IS NOT NULL").select("row", "word", "n"), table.select("word", "known", *told, "every"), "word", "every")
    rare = rare.select("row", F.when(F.col("known"), F.col("n")).otherwise(0).alias("n_known"), *[(F.col("n") * F.col(c)).alias(c) for c in told])
    none = {"doc_id": F.lit(None).cast(kind), "held_out": F.lit(None).cast("boolean"), "n_tokens": F.lit(None).cast("long")}
    every = parts.where("word IS NULL").select("row", "doc_id", "held_out", "n_tokens", "n_known", *told).unionByName(rare.withColumns(none))
    summed = every.groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.max("held_out").alias("held_out"), F.max("n_tokens").alias("n_tokens"), F.sum("n_known").alias("n_known"), F.sum("base").alias("base_score"), F.sum("score").alias("score"), F.sum("cached").alias("cached_score"))
    return summed.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), "base_score", "score", "cached_score")
