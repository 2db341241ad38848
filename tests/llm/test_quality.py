import random
import re
from collections import Counter

import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st

from spanloom.llm import quality

PATHS = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
WORD = re.compile("[^\x20\x09-\x0d]+")


def brute(text):
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    often = Counter(windows)
    marked = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), sum(x in lines[:i] for i, x in enumerate(lines)), len(marked)


NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


@given(st.lists(st.text(alphabet="ab #\n\té\x85\x1c\xa0", max_size=60), max_size=5))
@settings(max_examples=150, deadline=None)
def test_base(texts):
    m = quality.measure(texts, *PATHS)
    assert [tuple(int(m[k][i]) for k in NAMES) for i in range(len(texts))] == [brute(t) for t in texts]


def test_measures():
    import sentencepiece

    text = "The cat sat on the mat, the cat sat \U0001f9ff still. " * 3
    m = quality.measure(["", text], *PATHS)
    model = sentencepiece.SentencePieceProcessor(model_file=PATHS[0])
    ids = [x for w in text.split() for x in model.encode(w)]
    assert m["n_pieces"].tolist() == [0, len(ids)] and m["n_bytes"][1] == sum(model.is_byte(i) for i in ids) > 0
    import math

    p = [n / len(ids) for n in Counter(ids).values()]
    assert abs(m["entropy"][1] + sum(x * math.log2(x) for x in p)) < 1e-9


def test_rules(spark):
    rng = random.Random(1)
    plain = "It was late in the year when the first of the ships came back to the harbour and nobody had thought that any of them would. "
    long = " ".join(rng.choice(plain.split()) for _ in range(300))
    junk = " ".join(rng.choice(plain.split()) + rng.choice(["&&&", "$$$", "%%%", "***"]) for _ in range(300)).replace("the", "qxzv")
    rows = [(1, plain + long, "en", "s", 1, 9), (2, junk, "en", "s", 1, 9), (3, None, None, None, None, None), (4, "two words", "en", "s", 1, 9), (5, "same five words once more " * 40, "en", "s", 1, 9), (6, "!!! ??? " * 20 + "0 1 2 3 4 5 6 7 8 9 10 11", "xx", "s", 1, 9), (7, plain + long, "zz", "s", 1, 9), (7, plain + long, "zz", "s", 1, 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, n_words int")
    got = {(r.doc_id, r.base_failed, r.kept) for r in quality.rules(df, *PATHS).collect()}
    assert got == {(1, False, True), (2, False, False), (3, True, False), (4, True, False), (5, True, False), (6, True, False), (7, False, True)}
    carried = quality.rules(df, *PATHS, keep_row=True)
    assert {(r.doc_id, r.text, r.source) for r in carried.collect()} == {(r[0], r[1], r[3]) for r in rows}
    assert quality.rules(df.limit(0), *PATHS).count() == 0


def test_script():
    assert [quality.script(t) for t in ("abc é", "привет мир", "123 !?", "日本語 ab", "αβγ", "שלום")] == ["latin", "cyrillic", "none", "cjk", "greek", "other"]


def test_fragments_go_and_clean_texts_stay():
    """On texts that the floors are not taken from: odd doc_ids of sf0.1."""
    import pyarrow.parquet as pq

    good = {r["doc_id"]: r["quality"] for r in pq.read_table("/root/testdata/sf0.1/labels.parquet").to_pylist()}
    docs = [r for r in pq.read_table("/root/testdata/sf0.1/documents.parquet").to_pylist() if r["doc_id"] % 2 and r["text"]]
    clean, junk = [r for r in docs if good.get(r["doc_id"]) == 1][:600], [r for r in docs if r["text"].count(" | ") >= 5]

    def kept(rows):
        m = quality.measure([r["text"] for r in rows], *PATHS)
        return sum(quality.judge(r["lang"], r["text"], {k: v[i] for k, v in m.items()})[1] for i, r in enumerate(rows))

    assert len(junk) > 100 and kept(junk) < 0.05 * len(junk)
    assert kept(clean) > 0.98 * len(clean)


def test_short_texts_are_judged():
    text = "Thndou | erhaha | eaernd | ertible | erheble | eronin | eredble | aninou | shingou | thinor | bleing, | shnttion | reennt. | totheaoued | erenha, | ndinat. | oninan | estion. | ofreshshes | inghalyea | onstesre | erndnd"
    few = "the cat sat on the mat and the dog sat by the door"
    m = quality.measure([text, few], *PATHS)
    assert m["n_pieces"][0] < 160
    assert [quality.judge("en", t, {k: v[i] for k, v in m.items()})[1] for i, t in enumerate([text, few])] == [False, True]


def test_measures_against_the_libraries():
    """Tokens of both vocabularies, word by word, as the libraries count them, and the bytes among them."""
    import base64

    import sentencepiece
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATHS[1], "rb"))}
    book = tiktoken.Encoding("own", pat_str=PATHS[2], mergeable_ranks=ranks, special_tokens={})
    model = sentencepiece.SentencePieceProcessor(model_file=PATHS[0])
    rng = random.Random(3)
    texts = ["", " \n", "x", "naïve café", "привет мир 日本語", "a\x00b \U0001f9ff"] + [" ".join("".join(rng.choice("abcdeéж日#1") for _ in range(rng.randrange(1, 9))) for _ in range(rng.randrange(60))) for _ in range(40)]
    m = quality.measure(texts, *PATHS)
    for i, t in enumerate(texts):
        words = WORD.findall(t)
        pieces = [x for w in words for x in model.encode(w)]
        assert (m["n_pieces"][i], m["n_bytes"][i], m["n_bpe"][i]) == (len(pieces), sum(model.is_byte(x) for x in pieces), sum(len(book.encode_ordinary(" " + w)) for w in words)), t


def brute_judge(lang, text, m):
    """The bands said again, limit by limit."""
    import math

    n, band = m["n_pieces"], quality.LANGUAGES.get(lang)
    if band is None:
        letters = Counter(quality.script(c) for c in text if quality.script(c) != "none")
        if not letters:
            return False
        band = quality.SCRIPTS[max(letters, key=lambda k: (letters[k], k))]
    if n == 0:
        return False
    for value, (low, high) in ((m["word_chars"] / n, band.piece_chars), (m["word_chars"] / max(1, m["n_bpe"]), band.byte_chars)):
        if value * (1 + 2 / math.sqrt(n)) < low or value > high * (1 + 2 / math.sqrt(n)):
            return False
    if m["n_bytes"] > band.fallback[1] * n + 1 or m["entropy"] > band.entropy[1] or m["entropy"] < min(band.entropy[0], math.log2(n) - 1.5):
        return False
    if band.floors is None:
        return True
    x, f = math.log2(n), band.floors

    def floor(values):
        if x <= quality.AT[0]:
            return values[0]
        for a, b, u, v in zip(quality.AT, quality.AT[1:], values, values[1:]):
            if x <= b:
                return u + (v - u) * (x - a) / (b - a)
        return values[-1]

    if m["word_chars"] / n < floor(f.piece_chars) or m["word_chars"] / max(1, m["n_bpe"]) < floor(f.byte_chars):
        return False
    return m["word_chars"] / n > f.typical or m["entropy"] >= floor(f.entropy) - max(0, quality.AT[0] - x)


def test_judge_against_brute_force():
    rng = random.Random(8)
    alphabets = ["abcdefghij ", "the and of in ", "бвгдежзий ", "日本語中文 ", "αβγδεζ ", "bcdfghjkl ", "0123456789 ", "שלום ", "ab日本ж "]
    rows = []
    for _ in range(400):
        a = rng.choice(alphabets)
        words = [" ".join("".join(rng.choice(a) for _ in range(rng.randrange(1, 8))) for _ in range(rng.choice([1, 3, 12, 40, 200])))]
        rows.append((rng.choice(["en", "de", "xx", None, "fr"]), " ".join(words)))
    m = quality.measure([t for _, t in rows], *PATHS)
    verdicts = []
    for i, (lang, text) in enumerate(rows):
        one = {k: v[i] for k, v in m.items()}
        verdicts.append(quality.judge(lang, text, one)[1])
        assert verdicts[-1] == brute_judge(lang, text, one), (lang, text[:80])
    assert 40 < sum(verdicts) < 360


def test_short_junk_goes():
    rng = random.Random(9)
    noise = " ".join("".join(rng.choice("bcdfghjklmnpqrstvwxz") for _ in range(rng.randrange(3, 9))) for _ in range(20))
    texts = [("en", noise), ("en", "a b c d e f g h i j k l m n o p"), ("xx", noise), ("en", "It was late in the year when the first of the ships came back to the harbour.")]
    m = quality.measure([t for _, t in texts], *PATHS)
    assert [quality.judge(a, t, {k: v[i] for k, v in m.items()})[1] for i, (a, t) in enumerate(texts)] == [False, False, False, True]


def test_very_long_text(spark):
    text = " ".join(f"word{i % 977}" for i in range(400_000))
    (r,) = quality.rules(spark.createDataFrame([(1, text, "en", "s")], "doc_id long, text string, lang string, kept string"), *PATHS).collect()
    assert r.n_words == 400_000 and r.n_repeat_words == 400_000 and r.base_failed and not r.kept
