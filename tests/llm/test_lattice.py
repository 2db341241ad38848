import math
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from spanloom.llm import lattice

PATH = public_tokenizers.path("piece_bpe_32k.model")


def brute(model, log_p, word):
    """The sum over all segmentations, one by one."""
    book = {t: 256 + i for i, t in enumerate(model.text)}
    text = lattice.SPACE + word

    def paths(i):
        if i == len(text):
            yield []
            return
        for j in range(i + 1, len(text) + 1):
            if text[i:j] in book:
                for rest in paths(j):
                    yield [book[text[i:j]], *rest]
        if text[i] not in book:
            for rest in paths(i + 1):
                yield [*text[i].encode(), *rest]

    all_ = list(paths(0))
    p = [math.exp(sum(log_p[k] for k in path)) for path in all_]
    uses = Counter()
    for path, q in zip(all_, p):
        for k in path:
            uses[k] += q / sum(p)
    return math.log(sum(p)), uses


WORDS = ["the", "a", "héron", "x\U0001f9ffy", "ingthe", "z", "naïve,", "日本"]


def test_forward_and_backward():
    model = lattice.lattice(PATH)
    log_p = np.log(model.prior)
    got = model.score(WORDS, log_p)
    counts = np.arange(1.0, len(WORDS) + 1)
    expected = np.zeros(model.size)
    for w, g, n in zip(WORDS, got, counts):
        score, uses = brute(model, log_p, w)
        assert g == pytest.approx(score, abs=1e-9)
        for k, v in uses.items():
            expected[k] += n * v
    uses, scores = model.expect(WORDS, counts, log_p)
    assert np.allclose(uses, expected) and np.allclose(scores, got)
    assert model.score(["a" * 3000], log_p)[0] < -100
    far = ["\U0001f9ff" * 40, "é\u4e00" * 60, "the"]
    assert np.allclose(model.expect(far, np.ones(3), log_p)[1], model.score(far, log_p))
    assert model.expect(far, np.ones(3), log_p)[0][:256].sum() >= 160 - 1e-6


@pytest.mark.parametrize("head", [0, 3, 1 << 18])
def test_scores(spark, head):
    texts = [None, "", "The cat the hat", "the CAT sat on\na\tmat", "dog the unseen" * 3, "the the the"] * 12
    rows = [(i if i != 5 else None, t, "x") for i, t in enumerate(texts)]
    got = lattice.scores(spark.createDataFrame(rows, "doc_id long, text string, score string"), PATH, head=head).collect()
    held = [zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0 for i, _, _ in rows]
    words = [(t or "").lower().split() for t in texts]
    train = Counter(w for ws, h in zip(words, held) if not h for w in [*ws, None])
    n, v = sum(train.values()), len(train)
    assert len(got) == len(rows) and any(held)
    by = {r.doc_id: r for r in got}
    model = lattice.lattice(PATH)
    dev = Counter(w for ws, (i, _, _) in zip(words, rows) if zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 1 for w in ws)
    known = [w for w in train if w]
    steps, told = [np.log(model.prior)], [-math.inf]
    while True:
        told.append(sum(dev[w] * x for w, x in zip(known, model.score(known, steps[-1]))) / sum(dev.values()))
        if told[-1] < told[-2] + lattice.GAIN or len(steps) > lattice.ROUNDS:
            log_p = steps[-1] if told[-1] >= told[-2] and len(steps) <= lattice.ROUNDS + 1 else steps[-2]
            break
        uses = lattice.PRIOR * model.prior + model.expect(known, np.array([float(train[w] - dev[w]) for w in known]), steps[-1])[0]
        uses[-1] += train[None]
        steps.append(np.log(uses / uses.sum()))
    assert len(steps) > 2
    for (i, _, _), ws, h in zip(rows, words, held):
        r = by[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (h, len(ws) + 1, sum(train[w] > 0 for w in [*ws, None]), n)
        assert r.base_score == pytest.approx(sum(math.log10((train[w] + 0.1) / (n + 0.1 * (v + 1))) for w in [*ws, None]))
        paths = dict(zip(ws, model.score(ws, log_p)))
        starts = sum(math.exp(x) for x, t in zip(log_p[256:], model.text) if t[0] == lattice.SPACE)
        paths[None] = log_p[-1] - math.log(starts + math.exp(log_p[-1]))
        assert r.score == pytest.approx(sum(paths[w] / math.log(10) for w in [*ws, None]))
        assert r.cached_score == pytest.approx(sum(math.log10(train[w] / (n + v) + v / (n + v) * math.exp(paths[w])) for w in [*ws, None]))


def test_empty(spark):
    assert lattice.scores(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0
    (r,) = lattice.scores(spark.createDataFrame([(None, "only")], "doc_id long, text string"), PATH).collect()
    assert r.held_out and r.train_tokens == 0


def test_very_long_texts_and_words(spark):
    long = "xy" * 40
    rows = [(i, f"{long} a b", i) for i in range(60)] + [(90, "the cat " * 200_000, 0), (91, "z" * 5000, 0)]
    got = {r.doc_id: r for r in lattice.scores(spark.createDataFrame(rows, "doc_id long, text string, word long"), PATH, head=2).collect()}
    assert len(got) == 62 and got[90].n_tokens == 400_001 and got[91].n_tokens == 2
    assert len({round(got[i].score, 9) for i in range(60)}) == 1
