"""Quality rules by tokeniser fertility.

Public vocabularies measure every text: characters per token of each, the share of byte-fallback tokens
of the piece vocabulary, and the entropy of its tokens. Each measure has a band for the text's language,
or else for its script; a text outside a band is rejected. The lower limits of the languages grow with the
length of the text, as measures swing on few tokens. In front of these stand base rules on words,
symbols and repeats. One pass, no statistics of the corpus: a text's verdict depends on it alone.

The words of a slice of texts are coded once; only distinct words are tokenised, as neither vocabulary
has tokens across white space but for the space in front.
"""

from __future__ import annotations

import functools
import itertools
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import bpe, common

SYMBOLS = b"#*$%&|<>"


#: Binary logarithms of the piece tokens at which floors are given.
AT = (4.5, 5.5, 6.5, 7.5, 8.5, 9.5, 10.5)


@dataclass(frozen=True)
class Floors:
    """Lower limits at the lengths ``AT``, straight lines between them. Entropy decides only over texts of at most ``typical`` characters a piece, as plain texts of few different words are low in it too."""

    piece_chars: tuple[float, ...]
    byte_chars: tuple[float, ...]
    entropy: tuple[float, ...]
    typical: float

    def hold(self, n: int, piece_chars: float, byte_chars: float, entropy: float) -> bool:
        at = math.log2(n)
        low = [float(np.interp(at, AT, x)) for x in (self.piece_chars, self.byte_chars, self.entropy)]
        # under the first length, no more than its distance from the highest entropy that many tokens can have
        low[2] -= max(0.0, AT[0] - at)
        return piece_chars >= low[0] and byte_chars >= low[1] and (entropy >= low[2] or piece_chars > self.typical)


@dataclass(frozen=True)
class Band:
    """Limits, both included, for texts of any length; entropy is in bits a token.

    A ratio of n tokens swings by about 1 / sqrt(n) of itself around that of a long text, so its limits widen
    by ``SWING`` times that. No n tokens have more entropy than log2(n), so the lower limit of entropy is at
    most that less ``SLACK``. A share of n tokens is in steps of 1 / n, so one more token may always fall back.
    """

    piece_chars: tuple[float, float] = (1.0, 12.0)
    byte_chars: tuple[float, float] = (1.0, 14.0)
    fallback: tuple[float, float] = (0.0, 0.05)
    entropy: tuple[float, float] = (3.0, 20.0)
    floors: Floors | None = None

    def hold(self, n: int, piece_chars: float, byte_chars: float, fallback: float, entropy: float) -> bool:
        swing = SWING / math.sqrt(n)
        ratios = all(low / (1 + swing) <= x <= high * (1 + swing) for x, (low, high) in ((piece_chars, self.piece_chars), (byte_chars, self.byte_chars)))
        share = self.fallback[0] <= fallback <= self.fallback[1] + 1 / n
        spread = min(self.entropy[0], math.log2(n) - SLACK) <= entropy <= self.entropy[1]
        return ratios and share and spread and (self.floors is None or self.floors.hold(n, piece_chars, byte_chars, entropy))


SWING, SLACK = 2.0, 1.5


#: Floors from the texts of even doc_id of sf0.1 that ``labels`` calls good and the base rules keep (1628): their 0.25th percentile in each octave of
#: piece tokens, over all languages where one has under 30 texts; ratios are at most those of longer texts. ``typical`` is the median.
FLOORS: dict[str, Floors] = {
    "en": Floors((1.358, 1.358, 1.493, 1.902, 2.043, 2.099, 2.148), (1.666, 1.666, 1.886, 2.007, 2.11, 2.132, 2.179), (3.78, 4.455, 4.96, 5.715, 6.041, 6.378, 6.647), 2.219),
    "de": Floors((1.309, 1.309, 1.309, 1.793, 2.078, 2.147, 2.185), (1.637, 1.637, 1.637, 1.887, 2.208, 2.229, 2.242), (3.78, 4.455, 4.939, 5.691, 6.015, 6.304, 6.459), 2.244),
    "fr": Floors((1.309, 1.309, 1.309, 1.747, 1.747, 1.878, 1.946), (1.637, 1.637, 1.637, 1.887, 1.895, 1.933, 2.003), (3.78, 4.455, 4.939, 5.691, 6.019, 6.178, 6.424), 1.978),
    "es": Floors((1.309, 1.309, 1.309, 1.793, 1.801, 1.863, 1.888), (1.637, 1.637, 1.637, 1.887, 1.93, 1.996, 2.002), (3.78, 4.455, 4.939, 5.691, 6.05, 6.208, 6.504), 1.941),
}
#: For other languages in Latin script the lowest of these.
LOWEST = Floors(*(tuple(map(min, zip(*(getattr(f, k) for f in FLOORS.values()), strict=True))) for k in ("piece_chars", "byte_chars", "entropy")), min(f.typical for f in FLOORS.values()))
#: Bands by script; a language in LANGUAGES comes first. Scripts that the piece vocabulary spells in bytes have no limit there; no labelled texts are in
#: scripts other than Latin, so these are not fitted. A text without letters, script "none", has no band and is rejected.
SCRIPTS: dict[str, Band] = {
    "latin": Band(floors=LOWEST),
    "cyrillic": Band(piece_chars=(1.2, 12.0), byte_chars=(0.8, 14.0), fallback=(0.0, 0.1)),
    "greek": Band(piece_chars=(0.8, 12.0), byte_chars=(0.4, 14.0), fallback=(0.0, 0.2)),
    "cjk": Band(piece_chars=(0.25, 4.0), byte_chars=(0.25, 6.0), fallback=(0.0, 0.9)),
    "other": Band(piece_chars=(0.2, 12.0), byte_chars=(0.2, 14.0), fallback=(0.0, 1.0)),
}
LANGUAGES: dict[str, Band] = {name: Band(floors=floors) for name, floors in FLOORS.items()}
#: First code points and names of the ranges that decide a text's script; letters elsewhere are "other".
RANGES = [(0x41, "latin"), (0x370, "greek"), (0x400, "cyrillic"), (0x530, "other"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "none"), (0x2C00, "other"), (0x2E80, "cjk"), (0xA4D0, "other"), (0xAC00, "cjk"), (0xD7B0, "other"), (0xF900, "cjk"), (0xFB00, "other"), (0x1F000, "none"), (0x20000, "cjk")]


@functools.lru_cache(maxsize=2)
def pieces(path: str):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return model, np.array([model.is_byte(i) for i in range(model.get_piece_size())])


def script(text: str) -> str:
    """The script of most letters; "none" without letters."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    points = points[(points >= 0x80) | ((points | 32) >= 97) & ((points | 32) <= 122)]
    if not len(points):
        return "none"
    counts = np.bincount(np.searchsorted([a for a, _ in RANGES], points, side="right"), minlength=len(RANGES) + 1)
    total: dict[str, int] = {}
    for (_, name), n in zip(RANGES, counts[1:], strict=True):
        if name != "none":
            total[name] = total.get(name, 0) + int(n)
    best = max(total, key=lambda k: (total[k], k))
    return best if total[best] else "none"


def measure(texts: list[str], piece_path: str, bpe_path: str, pattern: str) -> dict[str, np.ndarray]:
    """Of each text the base counts and the measures of both vocabularies."""
    raws = [t.encode("utf-8", "surrogatepass") for t in texts]
    seen: dict[bytes, int] = {}
    codes, ends, size = [], [0], []
    for raw in raws:
        words = raw.split()
        codes += [seen.setdefault(w, len(seen)) for w in words]
        ends.append(len(codes))
        size.append(sum(map(len, words)))
    ends_, codes_ = np.array(ends), np.array(codes, dtype=np.int64)
    out = {"n_words": np.diff(ends_)}
    out["word_chars"] = np.array([len(t) - len(r) + n for t, r, n in zip(texts, raws, size, strict=True)], dtype=np.int64)
    out["n_symbols"] = np.array([len(r) - len(r.translate(None, SYMBOLS)) for r in raws], dtype=np.int64)
    lines = [[x for x in r.split(b"\n") if x and not x.isspace()] for r in raws]
    out["n_dup_lines"] = np.array([len(x) - len(set(x)) for x in lines], dtype=np.int64)
    doc = np.repeat(np.arange(len(texts)), out["n_words"])
    out["n_repeat_words"] = repeated(doc, codes_, len(texts))

    words = [w.decode("utf-8", "surrogatepass") for w in seen]
    model, is_byte = pieces(piece_path)
    coded = model.encode(words, num_threads=1) if words else []
    n = np.array([len(x) for x in coded], dtype=np.int64)
    flat = np.fromiter(itertools.chain.from_iterable(coded), dtype=np.int64, count=int(n.sum()))
    at, offsets = common.gather(np.concatenate(([0], np.cumsum(n)[:-1])) if len(n) else n, n, codes_)
    tokens, token_ends = flat[at], offsets[ends_]
    out["n_pieces"] = np.diff(token_ends)
    owner = np.repeat(np.arange(len(texts)), out["n_pieces"])
    out["n_bytes"] = np.bincount(owner, weights=is_byte[tokens], minlength=len(texts)).astype(np.int64)
    pairs, counts = np.unique(owner * len(is_byte) + tokens, return_counts=True)
    pair_owner = pairs // len(is_byte)
    whole = np.maximum(out["n_pieces"], 1).astype(float)
    spread = np.bincount(pair_owner, weights=counts * np.log2(counts), minlength=len(texts))
    out["entropy"] = np.log2(whole) - spread / whole

    each = bpe.encode_texts([" " + w for w in words], bpe_path, pattern)[1] if words else np.zeros(1, dtype=np.int64)
    out["n_bpe"] = np.bincount(doc, weights=np.diff(each)[codes_], minlength=len(texts)).astype(np.int64) if len(codes_) else np.zeros(len(texts), dtype=np.int64)
    return out


def repeated(doc: np.ndarray, codes: np.ndarray, n: int, width: int = 5) -> np.ndarray:
    """Words of each document that stand in a window of ``width`` words found twice or more in it."""
    last = len(codes) - width + 1
    if last <= 0:
        return np.zeros(n, dtype=np.int64)
    key = doc[:last].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for i in range(width):
        key = (key ^ (codes[i : last + i].astype(np.uint64) + np.uint64(0x632BE59BD9B4E019))) * np.uint64(0xFF51AFD7ED558CCD)
        key ^= key >> np.uint64(32)
    at = np.flatnonzero(doc[:last] == doc[width - 1 :])
    if not len(at):
        return np.zeros(n, dtype=np.int64)
    order = at[np.argsort(key[at], kind="stable")]
    same = key[order][1:] == key[order][:-1]
    twice = order[np.concatenate((same, [False])) | np.concatenate(([False], same))]
    marked = np.zeros(len(codes) + 1, dtype=np.int64)
    np.add.at(marked, twice, 1)
    np.add.at(marked, twice + width, -1)
    return np.bincount(doc, weights=np.cumsum(marked[:-1]) > 0, minlength=n).astype(np.int64)


def judge(lang: str | None, text: str, m: dict) -> tuple[str, bool]:
    """The name of the band and whether the text lies within it."""
    name = lang if lang in LANGUAGES else script(text)
    band = LANGUAGES.get(name) or SCRIPTS.get(name)
    n = int(m["n_pieces"])
    if not n or band is None:
        return name, False
    return name, band.hold(n, m["word_chars"] / n, m["word_chars"] / max(1, m["n_bpe"]), m["n_bytes"] / n, m["entropy"])


SCHEMA = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, band string, piece_chars double, byte_chars double, fallback double, entropy double"


def rules(docs: DataFrame, piece_path: str, bpe_path: str, pattern: str, id_col: str = "doc_id", keep_row: bool = False) -> DataFrame:
    """For each row of (id, text, lang) its counts, measures and verdict; with ``keep_row`` text, lang, source and n_chars too.

    A null or empty text has no words, so it fails the base rules. A null or unknown language is judged by
    script; a text without letters in such a language is rejected. Texts of any length are judged by their
    band. Equal rows each give a row, and all other columns are ignored.
    """
    more = ["source", "n_chars"] if keep_row else []
    plain = common.pick(docs, id_col, "text", "lang", *more).withColumnRenamed(id_col, "id_")
    kinds = {f.name: f.dataType.simpleString() for f in plain.schema}
    carried = ["text", "lang", *more] if keep_row else []

    def step(batch: pa.RecordBatch) -> dict:
        texts = common.texts_of(batch)
        m = measure(texts, piece_path, bpe_path, pattern)
        failed = (m["n_words"] < 10) | (100 * m["n_repeat_words"] > 20 * m["n_words"])
        verdicts = [judge(a, t, {k: v[i] for k, v in m.items()}) for i, (a, t) in enumerate(zip(batch.column("lang").to_pylist(), texts, strict=True))]
        size = np.maximum(m["n_pieces"], 1)
        return {k: m[k] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "entropy")} | {
            "id_": batch.column("id_"), "base_failed": failed, "kept": [bool(ok and not f) for (_, ok), f in zip(verdicts, failed, strict=True)], "band": [x for x, _ in verdicts],
            "piece_chars": m["word_chars"] / size, "byte_chars": m["word_chars"] / np.maximum(m["n_bpe"], 1), "fallback": m["n_bytes"] / size,
        } | {c: batch.column(c) for c in carried}

    head = "".join(f"{c} {kinds[c]}, " for c in carried)
    return common.map_slices(plain, step, f"id_ {kinds['id_']}, {head}{SCHEMA}").withColumnRenamed("id_", id_col)
