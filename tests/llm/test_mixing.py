import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanloom.llm import mixing

SCHEMA = "doc_id long, text string, source string, lang string, n_chars long"


def fill(sizes, cap=3):
    """Targets by handing out by weight again and again."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: 1 + i % 3 for i, s in enumerate(names)}
    total, full = sum(sizes.values()), set()
    while True:
        rest = total - sum(cap * sizes[s] for s in full)
        open_ = [s for s in names if s not in full]
        share = {s: rest * weight[s] / sum(weight[t] for t in open_) for s in open_}
        over = {s for s in open_ if share[s] > cap * sizes[s]}
        if not over:
            return {s: cap * sizes[s] if s in full else share[s] for s in names}
        full |= over


def corpus(n, seed):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        source = "hot" if i % 3 == 0 else rng.choice(["a", "Ä", "b", "tiny", None, "z"])
        if source == "tiny" and rng.random() < 0.9:
            source = "a"
        out.append((i, None if i % 97 == 0 else " ".join("w" * rng.randrange(1, 5) for _ in range(rng.randrange(40))), source, "en", 5))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    rows = corpus(4000, seed)
    got = mixing.taken(spark.createDataFrame(rows, SCHEMA)).collect()
    sizes, taken, goal = defaultdict(int), defaultdict(int), {}
    words, source = {r[0]: len((r[1] or "").split()) for r in rows}, {r[0]: r[2] for r in rows}
    for i, s in source.items():
        sizes[s] += words[i]
    expected = fill(sizes)
    assert len(got) == len(rows)
    for r in got:
        assert r["size"] == words[r.doc_id] and r.taken <= 3 * r["size"] and r.source_size == sizes[source[r.doc_id]]
        assert r.target == pytest.approx(expected[source[r.doc_id]])
        taken[source[r.doc_id]] += r.taken
        assert r["size"] == 0 or r.taken // r["size"] == len([x for x in r.shards.split(",") if x])
    for s in sizes:
        assert abs(taken[s] - expected[s]) <= 20
    again = mixing.taken(spark.createDataFrame(rows, SCHEMA).repartition(7)).collect()
    assert sorted(got) == sorted(again)


def test_quotas():
    quotas = [100, 0, 7, 333]
    leaves = mixing.split_quotas(quotas, mixing.rooms(sum(quotas), 6))
    assert leaves.sum(axis=0).tolist() == quotas
    assert leaves.sum(axis=1).max() - leaves.sum(axis=1).min() <= 1
    assert mixing.split_quotas([], [0] * 4).shape == (4, 0)
    many = np.mean([mixing.split_quotas([50, 150], [100, 100], seed)[0, 0] for seed in range(300)])
    assert 24 < many < 26


def test_leaves(spark):
    """In two steps, as in one: leaves of equal size, quotas whole, draws of a source one after another."""
    rng = random.Random(5)
    quotas = [(f"1s{i}", rng.choice([0, 1, 17, 900]), 300, 2, None, None) for i in range(60)]
    frame = spark.createDataFrame(quotas, "s_ string, quota long, n_blocks long, whole long, cut long, left double")
    got = mixing.leaves(frame, 16).collect()
    sums, ends = defaultdict(int), defaultdict(int)
    for r in sorted(got, key=lambda r: (r["s_"], r["shard"])):
        assert r["start"] == ends[r["s_"]]
        ends[r["s_"]] += r["n"]
        sums[r["shard"]] += r["n"]
    assert all(ends[s] == q for s, q, *_ in quotas) and max(sums.values()) - min(sums.values()) <= 1


def test_the_tree_gives_the_result(spark, monkeypatch):
    """Every shard follows from the leaves: each pass draws a block once, whole passes draw all, and rows are taken as their blocks are."""
    monkeypatch.setattr(mixing, "LEAST_BLOCKS", 40)
    monkeypatch.setattr(mixing, "BLOCK_WORDS", 200)
    df = spark.createDataFrame(corpus(3000, 4), SCHEMA)
    seen = {}
    plain = mixing.leaves
    monkeypatch.setattr(mixing, "leaves", lambda q, *a: seen.setdefault("leaves", plain(q, *a).cache()))
    rows = mixing.draws(df).collect()
    shard_of = {}
    for r in seen["leaves"].collect():
        for at in range(r["start"], r["start"] + r["n"]):
            turn, block = divmod(at, r["n_blocks"])
            assert (r["s_"], turn, block) not in shard_of
            shard_of[r["s_"], turn, block] = (r["shard"], r["whole"], r["cut"])
    count = Counter(s for s, _ , _ in shard_of.values())
    assert set(count) == set(range(16)) and max(count.values()) - min(count.values()) <= 1
    cut_rows = 0
    for r in rows:
        s = "0" if r["source"] is None else "1" + r["source"]
        expected = [(t, shard_of[s, t, r["block"]][0]) for t in range(4) if (s, t, r["block"]) in shard_of]
        if list(zip(r["turns"], r["shards"])) != expected:
            turn, (_, whole, cut) = expected[-1][0], shard_of[s, expected[-1][0], r["block"]]
            assert list(zip(r["turns"], r["shards"])) == expected[:-1] and turn == whole and r["block"] == cut
            cut_rows += 1
    assert cut_rows < 60 and len({r["block"] for r in rows if r["source"] == "hot"}) > 80


def test_edges(spark):
    assert mixing.taken(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(1, None, None, None, None), (1, None, None, None, None), (None, "a b", "s", None, None), (None, "a b", "s", None, None)]
    got = mixing.taken(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sum(r.taken for r in got) == 4 and len(got) == 4


def test_mix(spark):
    rows = corpus(600, 3)
    df = spark.createDataFrame(rows, SCHEMA)
    times = {r.doc_id: (r.taken // r["size"] if r["size"] else None) for r in mixing.taken(df).collect()}
    out = mixing.mix(df, ["doc_id", "text", "lang", "source", "n_chars"]).collect()
    seen = defaultdict(int)
    for r in out:
        seen[r.doc_id] += 1
        assert (r.doc_id, r.text, r.source) == (rows[r.doc_id][0], rows[r.doc_id][1], rows[r.doc_id][2])
    assert all(n is None or seen[i] == n for i, n in times.items())


def test_mix_comes_shuffled(spark):
    rows = [(i, f"text {i} of a few words", f"s{i % 3}") for i in range(3000)]
    out = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), ["doc_id", "source"])
    placed = out.select("doc_id", "source", "shard", "shuffle_key", mixing.part_of(F.col("shuffle_key")).alias("part"), F.spark_partition_id().alias("task"), F.monotonically_increasing_id().alias("at"))
    got = sorted(placed.collect(), key=lambda r: r["at"])
    tasks = {}
    for r in got:
        tasks.setdefault((r["shard"], r["part"]), set()).add(r["task"])
    assert all(len(t) == 1 for t in tasks.values()) and {p for _, p in tasks} == set(range(mixing.PARTS))
    units = [(r["shard"], r["part"]) for r in got]
    assert sum(a != b for a, b in zip(units, units[1:])) == len(tasks) - 1
    assert all(a["shuffle_key"] <= b["shuffle_key"] for a, b in zip(got, got[1:]) if (a["shard"], a["part"]) == (b["shard"], b["part"]))
    beside = sum(a["source"] == b["source"] for a, b in zip(got, got[1:])) / len(got)
    shares = [sum(r["source"] == s for r in got) / len(got) for s in ("s0", "s1", "s2")]
    assert abs(beside - sum(x * x for x in shares)) < 0.06


def test_clashing_names_long_texts_and_many_sources(spark):
    rows = [(i, "w " * (200_000 if i == 5 else 3), f"s{i % 1500}", "x", "y", "z", "u") for i in range(3000)]
    got = mixing.taken(spark.createDataFrame(rows, "doc_id long, text string, source string, size string, key string, block string, shards string")).collect()
    assert len(got) == 3000 and {r["size"] for r in got} == {3, 200_000}
    words = defaultdict(int)
    for r in rows:
        words[r[2]] += len(r[1].split())
    goal = fill(words)
    assert all(r.target == pytest.approx(goal[rows[r.doc_id][2]]) for r in got)
