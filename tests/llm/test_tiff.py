import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from spanloom.llm import tiff


@given(st.binary(max_size=3000))
@settings(max_examples=100, deadline=None)
def test_codecs(data):
    assert tiff.unpack_bits(tiff.pack_bits(data)) == data
    assert tiff.unpack_lzw(tiff.pack_lzw(data)) == data


def test_lzw_beyond_its_table():
    data = np.random.default_rng(1).integers(0, 256, 60000, dtype=np.uint8).tobytes() + b"a" * 20000
    assert tiff.unpack_lzw(tiff.pack_lzw(data)) == data


@pytest.mark.parametrize("compression", [tiff.NONE, tiff.DEFLATE, tiff.LZW, tiff.PACKBITS])
@pytest.mark.parametrize("predictor", [1, 2])
@pytest.mark.parametrize("tile", [0, 16])
def test_round_trip(compression, predictor, tile):
    rng = np.random.default_rng(2)
    images = [rng.integers(0, 256, (h, w, s), dtype=np.uint8) for h, w, s in ((1, 1, 1), (40, 64, 3), (33, 17, 4))]
    got = list(tiff.read_pages(tiff.write_pages(images, compression, predictor, 8, tile)))
    assert [(p.height, p.width, p.samples) for p in got] == [x.shape for x in images]
    assert [p.data for p in got] == [x.tobytes() for x in images]


def build(order, entries, body, big=False):
    """A file of one directory whose strips lie in ``body`` at offset 16."""
    slot, q = (8, "Q") if big else (4, "I")
    at = 16 + len(body)
    head = (b"II" if order == "<" else b"MM") + (struct.pack(order + "HHHQ", 43, 8, 0, at) if big else struct.pack(order + "HI", 42, at))
    out = head.ljust(16, b"\0") + body + struct.pack(order + ("Q" if big else "H"), len(entries))
    for tag, kind, value in entries:
        out += struct.pack(order + "HH" + q, tag, kind, 1) + struct.pack(order + {3: "H", 4: "I", 16: "Q"}[kind], value).ljust(slot, b"\0")
    return out + b"\0" * slot


@pytest.mark.parametrize("order", ["<", ">"])
@pytest.mark.parametrize("big", [False, True])
def test_wide_samples(order, big):
    values = np.random.default_rng(3).integers(0, 65536, (5, 7), dtype=np.uint16)
    steps = np.concatenate((values[:, :1], values[:, 1:] - values[:, :-1]), axis=1).astype(order + "u2")
    body = zlib.compress(steps.tobytes())
    entries = [(256, 3, 7), (257, 3, 5), (258, 3, 16), (259, 3, 8), (262, 3, 1), (273, 4, 16), (277, 3, 1), (278, 3, 5), (279, 4, len(body)), (317, 3, 2)]
    (page,) = tiff.read_pages(build(order, entries, body, big))
    assert page.data == values.astype("<u2").tobytes()


def test_floating_point_predictor():
    values = np.random.default_rng(4).normal(size=(4, 6)).astype(">f4")
    lanes = values.view(np.uint8).reshape(4, 6, 4).transpose(0, 2, 1).reshape(4, 24)
    body = np.concatenate((lanes[:, :1], lanes[:, 1:] - lanes[:, :-1]), axis=1).tobytes()
    entries = [(256, 3, 6), (257, 3, 4), (258, 3, 32), (259, 3, 1), (262, 3, 1), (273, 4, 16), (277, 3, 1), (278, 3, 4), (279, 4, len(body)), (317, 3, 3), (339, 3, 3)]
    (page,) = tiff.read_pages(build("<", entries, body))
    assert page.data == values.astype("<f4").tobytes()


def test_frames(spark):
    good = tiff.from_bytes(b"ab" * 96)
    ring = bytearray(good)
    head = struct.unpack("<I", good[4:8])[0]
    ring[-4:] = struct.pack("<I", head)
    df = spark.createDataFrame([(1, good, 5), (2, None, 5), (3, b"no", 5), (4, good[:60], 5), (5, bytes(ring), 5), (1, good, 5)], "k long, media binary, page int")
    got = sorted((r.k, r.page, r.error is None) for r in tiff.pages(df, "k", "media").collect())
    assert got == [(1, 0, True), (1, 0, True), (3, 0, False), (4, 0, False), (5, 0, True), (5, 1, False)]
    assert tiff.pages(df.limit(0), "k", "media").count() == 0


def test_digests(spark):
    import hashlib

    texts = [None, "", "x" * 192, "é" * 100, "y" * (192 * 5000)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in tiff.digests(df).collect():
        raw = (texts[r.doc_id] or "").encode()
        padded = raw + b" " * (-len(raw) % 192 if raw else 192)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-16:]))
        assert r.media_sha256 == hashlib.sha256(tiff.from_bytes(padded)).hexdigest()


def test_pages_after_a_lost_one_follow(spark):
    image = np.arange(64 * 3 * 4, dtype=np.uint8).reshape(4, 64, 3)
    data = bytearray(tiff.write_pages([image, image, np.zeros((90, 64, 3), dtype=np.uint8), image]))
    second = [m for m in range(len(data) - 8) if struct.unpack_from("<HHI", data, m)[:3] == (259, 4, 1)][1]
    struct.pack_into("<I", data, second + 8, 7)  # a compression that is not known
    got = list(tiff.read_pages(bytes(data), most_samples=5000))
    assert [type(p).__name__ for p in got] == ["Page", "Lost", "Lost", "Page"]
    assert "compression 7" in got[1].error and "17280 samples" in got[2].error and (got[2].width, got[2].height) == (64, 90)
    rows = tiff.pages(spark.createDataFrame([(1, bytes(data))], "k long, media binary"), "k", "media").orderBy("page").collect()
    assert [(r.page, r.error is None) for r in rows] == [(0, True), (1, False), (2, True), (3, True)]


def test_digests_of_repeats_clashes_and_nothing(spark):
    df = spark.createDataFrame([(1, "a", "x"), (1, "a", "y"), (2, "a", "z")], "doc_id long, text string, n_bytes string")
    got = [tuple(r) for r in tiff.digests(df).collect()]
    assert len(got) == 3 and len({r[:-1] if isinstance(r[-1], int) else r[1:] for r in got}) == 1
    assert tiff.digests(df.limit(0)).count() == 0
