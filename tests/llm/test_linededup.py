import hashlib
import random

import duckdb
import pyarrow as pa
import pytest

from spanloom.llm import linededup

SCHEMA = "doc_id long, text string, n_lines string, mark string"


def oracle(rows):
    con = duckdb.connect()
    con.register("documents", pa.table({"doc_id": [r[0] for r in rows], "text": [r[1] for r in rows]}))
    return sorted(con.sql(f"SELECT doc_id, n_lines, n_removed, text FROM ({linededup.ORACLE})").fetchall())


def got(spark, rows, **options):
    return sorted(map(tuple, linededup.dedup(spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA), **options).collect()), key=str)


def line(rng, n):
    return " ".join("".join(rng.choice("abcdef") for _ in range(5)) for _ in range(n))


def corpus(seed, n):
    """Texts of passages, parts of passages, common and own lines, in any order."""
    rng = random.Random(seed)
    passages = [[line(rng, rng.choice([1, 1, 2, 8, 15, 50])) for _ in range(rng.randrange(1, 12))] for _ in range(14)]
    common = [line(rng, 1), line(rng, 4), line(rng, 12)]
    rows = []
    for i in range(n):
        body = []
        for _ in range(rng.randrange(6)):
            p = rng.choice(passages)
            a = rng.randrange(len(p))
            body += rng.choice([p, p[a:], p[:a], [line(rng, 6)], ["", " "], [rng.choice(common)], [line(rng, 30)]])
        rows.append((i, "\n".join(body)))
    return rows


def test_against_sql(spark):
    rows = corpus(2, 250)
    rows += [(300, rows[7][1]), (301, rows[7][1] + "\n"), (302, None), (303, ""), (304, "a\na\na\na"), (305, "\n \n")]
    assert got(spark, rows) == sorted(oracle(rows), key=str)


def chunks_of(lines, every, long_words=linededup.LONG_WORDS):
    """(first, last) among ``lines``, which are not blank, of pieces of several, of two pieces, and of long lines."""
    h = [hashlib.md5(x.encode()).hexdigest() for x in lines]
    ends = [0, *(i for i in range(1, len(h)) if hashlib.md5((h[i - 1] + h[i]).encode()).digest()[0] % every == 0), len(h)]
    for k in (1, 2):
        yield from ((a, b - 1) for a, b in zip(ends, ends[k:]) if b - a > 1)
    yield from ((i, i) for i, x in enumerate(lines) if len(x.split()) >= long_words)


def brute(rows, every):
    seen, out = set(), []
    for i, text in sorted(rows):
        lines = text.split("\n")
        at = [k for k, x in enumerate(lines) if x.strip()]
        gone = set()
        for a, b in sorted(chunks_of([lines[k] for k in at], every)):
            chunk = tuple(lines[k] for k in at[a : b + 1])
            if chunk in seen:
                gone.update(range(at[a], at[b] + 1))
            seen.add(chunk)
        out.append((i, "\n".join(x for k, x in enumerate(lines) if k not in gone)))
    return out


@pytest.mark.parametrize("every", [1, 2, 4])
def test_against_brute_force(spark, every):
    rows = corpus(4, 150)
    assert [(r[0], r[3]) for r in sorted(got(spark, rows, every=every), key=lambda r: r[0])] == brute(rows, every)


def test_every_repeated_passage_is_found(spark):
    """All windows of two lines or more, and all long lines, that stand in an earlier text."""
    rows = corpus(5, 150)
    seen, expected = set(), []
    for i, text in rows:
        lines = [x for x in text.split("\n") if x.strip()]
        gone = set()
        for a in range(len(lines)):
            for b in range(a, len(lines)):
                window = tuple(lines[a : b + 1])
                if b > a or len(lines[a].split()) >= linededup.LONG_WORDS:
                    if window in seen:
                        gone.update(range(a, b + 1))
                    seen.add(window)
        expected.append((i, len(gone)))
    assert sorted((r[0], r[2]) for r in got(spark, rows)) == expected


def test_boundaries_depend_on_the_text_alone(spark):
    rng = random.Random(7)
    text = "\n".join(line(rng, 5) for _ in range(60))
    spans = lambda rows: {(r["first"], r["last"]) for r in linededup.chunks(spark.createDataFrame(rows, "doc_id long, mark long, text string"), every=4).where("doc_id = 1").collect()}
    alone = spans([(1, 0, text)])
    assert alone == spans([(1, 0, text), (2, 0, text[100:]), (3, 0, text)]) and len(alone) > 8


def test_passages_go_and_the_rest_stays(spark):
    words = [f"w{i}" for i in range(120)]
    long, two = " ".join(words[:60]), " ".join(words[60:75]) + "\n" + " ".join(words[75:90])
    rows = [(1, f"own one\n{long}\nend one"), (2, f"own two\n\n{two}\nend two"), (3, f"{long}\n{two}\nlast own line"), (4, "Home\nown four"), (5, "Home\nown five"), (6, f"before\n{two}")]
    out = {r[0]: r[3] for r in got(spark, rows)}
    assert out == {1: rows[0][1], 2: rows[1][1], 3: "last own line", 4: rows[3][1], 5: rows[4][1], 6: "before"}


def test_short_blocks_go(spark):
    rows = [(i, f"own {i}\nHome\nAbout us\nContact\nend {i}") for i in range(20)]
    assert [r[3] for r in sorted(got(spark, rows), key=lambda r: r[0])] == [rows[0][1], *(f"own {i}\nend {i}" for i in range(1, 20))]


def test_rows_without_id_and_repeated_rows(spark):
    text = " ".join(f"w{i}" for i in range(50))
    rows = [(None, text), (3, text), (3, text), (4, text + "\n" + text)]
    assert got(spark, rows) == sorted([(None, 1, 0, text), (3, 1, 1, ""), (3, 1, 1, ""), (4, 2, 2, "")], key=str)
    assert got(spark, []) == []


def test_very_long_text(spark):
    body = "\n".join(f"line {i} of many" for i in range(60_000))
    out = {r[0]: r[1:3] for r in got(spark, [(1, body), (2, "own\n" + body[-400_000:]), (3, "x " * 300_000)])}
    assert out[1] == (60_000, 0) and out[3] == (1, 0) and out[2][0] - out[2][1] <= 2


def test_lines_that_only_share_a_hash_stay(spark):
    """Both lines of a made-up clash, and chunks with them, are equal to none."""
    from spanloom.llm.common import Scratch

    rows = [(i, f"own {i}\nHome\nAbout us\nContact\nend {i}") for i in range(4)]
    docs = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "doc_id long, text string, mark long")
    clash = spark.createDataFrame([(bytearray(hashlib.md5(b"Home").digest()),)], "line binary")
    left = linededup.repeats(linededup.chunks(docs), clash, Scratch(spark, "t")).collect()
    assert sorted((r["doc_id"], r["first"], r["last"]) for r in left) == [(i, 2, 3) for i in (1, 2, 3)]
    assert linededup.ambiguous(docs).isEmpty()


@pytest.mark.parametrize("every", [1, 2, 4])
def test_rolling_hash_cuts_blocks_in_the_query(spark, every, monkeypatch):
    """The seams of blocks are those that the hash names; chunks of blocks and across seams are all chunks; and the query asks it."""
    rows = [(i, text, i) for i, text in corpus(9, 40) if text.strip()]
    docs = spark.createDataFrame(rows, "doc_id long, text string, mark long")
    found = {}
    for r in linededup.blocks(docs, 4 * every).collect():
        found.setdefault(r["doc_id"], []).append([x["pos"] for x in r["l"]])
    for i, text, _ in rows:
        lines = [(k, hashlib.md5(x.encode()).hexdigest()) for k, x in enumerate(text.split("\n")) if x.strip()]
        expected = [[]]
        for k, (pos, h) in enumerate(lines):
            if k and hashlib.md5((lines[k - 1][1] + h).encode()).digest()[0] % (4 * every) == 0:
                expected.append([])
            expected[-1].append(pos)
        assert sorted(found[i]) == expected
    key = lambda df: sorted((r["doc_id"], r["first"], r["last"], bytes(r["chunk"])) for r in df.collect())
    assert key(linededup.chunks_by_block(linededup.blocks(docs, 4 * every), every)) == key(linededup.chunks(docs, every))
    asked, rolled = [], linededup.rolled
    monkeypatch.setattr(linededup, "rolled", lambda a, b, n: asked.append(n) or rolled(a, b, n))
    linededup.dedup(docs, every=every)
    assert 4 * every in asked
