import random

import pytest

from spanloom.llm import neardup


def brute(rows):
    sets = {}
    for i, t in rows:
        w = (t or "").lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    ids = list(sets)
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return sorted((i, len(sets[i]), find(i), find(i) == i) for i in ids)


def corpus(seed, edits):
    """A base, many copies of it with words exchanged, copies of copies, texts that share a passage, and strangers."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    base = [word() for _ in range(120)]
    texts = []
    for _ in range(150):
        copy = list(rng.choice([base, *[t for t in texts if len(t) == 120]]) if rng.random() < 0.4 else base)
        for _ in range(rng.randrange(edits)):
            copy[rng.randrange(len(copy))] = word()
        texts.append(copy)
    for _ in range(40):
        texts.append(base[:30] + [word() for _ in range(rng.randrange(5, 60))])
    texts += [[word() for _ in range(rng.randrange(9))] for _ in range(60)]
    rng.shuffle(texts)
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    return rows + [(1000, rows[3][1].upper()), (1001, None), (1002, "  \n"), (1003, "one two"), (1004, "ONE\ttwo"), (1005, "one  two three")]


@pytest.mark.parametrize(("seed", "edits"), [(1, 6), (2, 9)])
def test_against_brute_force(spark, seed, edits, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 16)
    rows = corpus(seed, edits)
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, got)) == brute(rows)


def test_nulls_and_repeats(spark):
    rows = [(None, "a b c d e f", 1), (4, "a b c d e f", 2), (4, "a b c d e f", 2), (9, "A b c d e f", 3), (None, "alone here", 4), (None, None, 5)]
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, kept int")).collect()
    assert sorted(map(tuple, got), key=str) == sorted([(None, 2, 4, False), (4, 2, 4, True), (4, 2, 4, True), (9, 2, 4, False), (None, 1, None, True), (None, 0, None, True)], key=str)
    assert neardup.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_ids_of_text_and_long_texts(spark):
    rng = random.Random(4)
    base = [f"w{rng.randrange(10**6)}" for _ in range(60_000)]
    near = base[:50_000] + ["other"] + base[50_001:]
    rows = [("b", " ".join(base)), ("a", " ".join(near)), ("c", "far from these"), ("d", " ".join(base[:20_000]))]
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id string, text string")).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == [("a", "a"), ("b", "a"), ("c", "c"), ("d", "d")]
