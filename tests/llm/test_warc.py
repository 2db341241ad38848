import io
import random
import zipfile

import pytest

from spanloom.llm import common, warc


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string, digest string")


def brute(rows, least=0):
    first = {}
    for i, _, h, _ in rows:
        if i is not None and i < first.get(h or "", 10**9):
            first[h or ""] = i
    out = []
    for i, _, h, _ in rows:
        h = h or ""
        f = first.get(h)
        again = len(h.encode()) >= least and f is not None and i != f
        out.append((i, len(h.encode()), warc.base32_sha1(h.encode()), "revisit" if again else "response", f if again else None))
    return sorted(out, key=str)


ROWS = [(3, "http://a/\r\nx y", "<p>é</p>", "z"), (1, None, "<p>é</p>", None), (2, "u", None, None), (5, "u", "", None), (5, "u", "", None), (None, "v", "<p>é</p>", None), (None, "w", "only", None), (7, "w", "x" * 300000, None)]


@pytest.mark.parametrize("least", [0, 5])
def test_round_trip(spark, least):
    manifest = warc.write(pages(spark, ROWS), common.fresh(spark, "warc"), min_bytes=least, package_bytes=1000)
    rows = warc.read(manifest).collect()
    got = sorted(((int(r.page_id) if r.page_id else None, r.payload_bytes, r.payload_digest, r.record_type, int(r.refers_to) if r.refers_to else None) for r in rows), key=str)
    assert got == brute(ROWS, least)
    assert all((r.payload is None) == (r.record_type == "revisit") for r in rows)


def test_empty(spark):
    assert warc.read(warc.write(pages(spark, []), common.fresh(spark, "warc"))).count() == 0


def test_directory_is_that_of_zipfile():
    rng = random.Random(1)
    for wide in (False, True):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
            bodies = {f"archive/é{i}": rng.randbytes(rng.randrange(500)) for i in range(5)}
            for name, body in bodies.items():
                with z.open(name, "w", force_zip64=wide) as f:
                    f.write(body)
            z.comment = b"a comment"
        data = out.getvalue()
        package = warc.Package(lambda a, n: data[a : a + n], len(data))
        for name, body in bodies.items():
            at, n = package.place(name)
            assert data[at : at + n] == body


def test_zip64_end_of_directory():
    import struct

    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("archive/a", b"abc")
    data = out.getvalue()
    end = data.rfind(b"PK\x05\x06")
    count, length, start = struct.unpack("<HII", data[end + 10 : end + 20])
    record = struct.pack("<4sQHHIIQQQQ", b"PK\x06\x06", 44, 45, 45, 0, 0, count, count, length, start)
    locator = struct.pack("<4sIQI", b"PK\x06\x07", 0, end, 1)
    wide = data[:end] + record + locator + struct.pack("<4sHHHHIIH", b"PK\x05\x06", 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0)
    package = warc.Package(lambda a, n: wide[a : a + n], len(wide))
    at, n = package.place("archive/a")
    assert wide[at : at + n] == b"abc"


def test_compressed_members_and_damage_are_errors():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("archive/a", b"abc" * 100)
    data = out.getvalue()
    package = warc.Package(lambda a, n: data[a : a + n], len(data))
    with pytest.raises(ValueError, match="compressed"):
        package.place("archive/a")
    with pytest.raises(ValueError, match="central directory"):
        warc.Package(lambda a, n: b"x" * n, 100)


def test_the_mark_of_the_end_in_a_comment():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("archive/a", b"body")
        z.comment = b"a comment with PK\x05\x06 in it and more than twenty-two bytes behind"
    data = out.getvalue()
    package = warc.Package(lambda at, n: data[at : at + n], len(data))
    at, n = package.place("archive/a")
    assert data[at : at + n] == b"body"


def test_one_payload_of_very_many_pages(spark, monkeypatch):
    from spanloom.functions import lineage

    monkeypatch.setattr(lineage, "HOT", 4)
    rows = [(i, f"u{i}", None if i % 3 == 0 else f"page {i % 40}") for i in range(900)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    back = warc.read(warc.write(df, lineage.fresh(spark, "warc")), payload=False).collect()
    first = {}
    for i, _, h in rows:
        first.setdefault(h, i)
    assert sorted((int(r.page_id), r.refers_to and int(r.refers_to)) for r in back) == [(i, None if first[h] == i else first[h]) for i, _, h in rows]
