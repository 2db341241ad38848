"""The pipeline against plain Python over a small corpus; each stage is held against its own input."""

import random
from collections import Counter

import pytest
import tiktoken  # noqa: F401

import corpus_pipeline as p
from tests.llm.test_bpe import library  # noqa: F401
from tests.llm.test_linededup import oracle as lines_oracle
from tests.llm.test_mixing import fill
from tests.llm.test_neardup import brute as neardup_brute
from tests.llm.test_quality import brute as quality_brute

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
BOOK = "the harbour ship year nobody thought would come back first late morning water stone bridge house light winter garden letter answer question river".split()


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(6)
    text = lambda n: "\n".join(" ".join(rng.choice(BOOK) + rng.choice(["", "", "s", "ing"]) for _ in range(12)) for _ in range(n))
    passage = " ".join(rng.choice(BOOK) for _ in range(60))
    rows = [(i, text(rng.randrange(2, 9)), "en", f"s{i % 4}" if i % 11 else None, 0) for i in range(120)]
    rows += [(200, rows[3][1], "en", "s1", 0), (201, rows[4][1] + " more", "en", "s0", 0), (202, text(3) + "\n" + passage, "en", "s2", 0), (203, passage + "\n" + text(3), "en", "s2", 0)]
    rows += [(210, "too short", "en", "s1", 0), (211, "buy now or never again " * 30, "en", "s1", 0), (212, None, None, None, None)]
    return [(a, b, c, d, len(b or "")) for a, b, c, d, _ in rows]


def test_stages(spark, corpus, library):  # noqa: F811
    docs = spark.createDataFrame(corpus, SCHEMA)
    stages = dict(p.STAGES)
    assert [n for n, _ in p.STAGES] == ["quality rules", "line dedup", "MinHash near-dedup", "mixing sources to target weights", "byte-level BPE encoding and decoding"]

    def step(name, frame):
        out = stages[name](spark, frame, "")
        rows = [tuple(r) for r in out.collect()]
        return rows, spark.createDataFrame(rows, out.schema)

    kept, frame = step("quality rules", docs)
    counts = {r[0]: quality_brute(r[1] or "") for r in corpus}
    assert sorted(r[0] for r in kept) == sorted(i for i, (n, _, _, _, again) in counts.items() if n >= 10 and 100 * again <= 20 * n)
    assert set(kept) <= set(corpus)

    lines, frame = step("line dedup", frame)
    expected = {i: t for i, _, _, t in lines_oracle([(r[0], r[1]) for r in kept])}
    assert {r[0]: r[1] for r in lines} == {i: t for i, t in expected.items() if t.split()}
    assert all(r[4] == len(r[1]) for r in lines) and 200 not in {r[0] for r in lines}

    unique, frame = step("MinHash near-dedup", frame)
    assert sorted(r[0] for r in unique) == [i for i, _, _, first in neardup_brute([(r[0], r[1]) for r in lines]) if first]

    mixed, frame = step("mixing sources to target weights", frame)
    sizes = {}
    for r in unique:
        sizes[r[3]] = sizes.get(r[3], 0) + len(r[1].split())
    taken = Counter()
    for r in mixed:
        taken[r[3]] += len(r[1].split())
    assert set(mixed) <= set(unique) and max(Counter(mixed).values()) <= 3
    assert all(abs(taken[s] - goal) <= 110 for s, goal in fill(sizes).items())

    coded, _ = step("byte-level BPE encoding and decoding", frame)
    assert sorted((r[0], tuple(r[4])) for r in coded) == sorted((r[0], tuple(library.encode_ordinary(r[1]))) for r in mixed)


def test_run_is_the_stages(spark, corpus, tmp_path):
    spark.createDataFrame(corpus, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    frame = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for i, (_, stage) in enumerate(p.STAGES):
        stage(spark, frame, "").write.parquet(str(tmp_path / str(i)))
        frame = spark.read.parquet(str(tmp_path / str(i)))
    assert sorted(map(tuple, p.run(spark, str(tmp_path)).collect())) == sorted(map(tuple, frame.collect()))


def test_empty(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    assert p.run(spark, str(tmp_path)).count() == 0
