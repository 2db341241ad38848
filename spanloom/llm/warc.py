"""WARC records in ZIP packages: a writer, and a reader that unpacks nothing.

A package is a ZIP of stored members: gzipped WARC files under ``archive/``, an index of their records
under ``indexes/`` and a description. The reader fetches the end of a package, follows the central
directory (ZIP64 too) to the stored members, reads the index, and fetches just the byte ranges of the
records. Packages lie in the shared folder, reached by pyarrow.fs, so any of its stores will do.
"""

from __future__ import annotations

import base64
import hashlib
import io
import json
import struct
import urllib.parse
import uuid
import zipfile
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

PACKAGE_BYTES = 16 << 20
RANGE_BYTES = 4 << 20
#: Packages that one task reads at most.
PACKAGES = 16
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def open_store(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


# Reading packages


class Package:
    """The directory of a ZIP of which ``read(offset, size)`` gives byte ranges."""

    def __init__(self, read: Callable[[int, int], bytes], size: int):
        self.read = read
        self.members: dict[str, tuple[int, int, int]] = {}  # name: (offset of the local header, stored size, method)
        tail_at = max(0, size - 65557)
        tail = read(tail_at, size - tail_at)
        # a comment may hold the mark too; the record is the one whose comment ends with the file
        at = tail.rfind(b"PK\x05\x06")
        while at >= 0 and (at + 22 > len(tail) or at + 22 + struct.unpack("<H", tail[at + 20 : at + 22])[0] != len(tail)):
            at = tail.rfind(b"PK\x05\x06", 0, at)
        if at < 0:
            raise ValueError("no end of central directory")
        count, length, start = struct.unpack("<HII", tail[at + 10 : at + 20])
        if count == 0xFFFF or length == 0xFFFFFFFF or start == 0xFFFFFFFF:
            locator = tail_at + at - 20
            mark, _, end64, _ = struct.unpack("<4sIQI", read(locator, 20))
            record = read(end64, 56)
            if mark != b"PK\x06\x07" or record[:4] != b"PK\x06\x06":
                raise ValueError("broken ZIP64 end of central directory")
            count, length, start = struct.unpack("<QQQ", record[32:56])
        directory, p = read(start, length), 0
        for _ in range(count):
            if directory[p : p + 4] != b"PK\x01\x02":
                raise ValueError("broken central directory")
            flags, method = struct.unpack("<HH", directory[p + 8 : p + 12])
            packed, full, names, extras, comments = struct.unpack("<IIHHH", directory[p + 20 : p + 34])
            (offset,) = struct.unpack("<I", directory[p + 42 : p + 46])
            name = directory[p + 46 : p + 46 + names].decode("utf-8" if flags & 0x800 else "cp437")
            extra, q = directory[p + 46 + names : p + 46 + names + extras], 0
            while q + 4 <= len(extra):
                kind, n = struct.unpack("<HH", extra[q : q + 4])
                if kind == 1:
                    wide = list(struct.unpack(f"<{n // 8}Q", extra[q + 4 : q + 4 + n // 8 * 8]))
                    full = wide.pop(0) if full == 0xFFFFFFFF else full
                    packed = wide.pop(0) if packed == 0xFFFFFFFF else packed
                    offset = wide.pop(0) if offset == 0xFFFFFFFF else offset
                q += 4 + n
            self.members[name] = (offset, packed, method)
            p += 46 + names + extras + comments

    def place(self, name: str) -> tuple[int, int]:
        """Where a stored member's bytes begin, and how many there are."""
        offset, size, method = self.members[name]
        if method != 0:
            raise ValueError(f"{name} is compressed; only stored members can be read in ranges")
        head = self.read(offset, 30)
        if head[:4] != b"PK\x03\x04":
            raise ValueError(f"broken local header of {name}")
        names, extras = struct.unpack("<HH", head[26:30])
        return offset + 30 + names + extras, size


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """The header fields, names in lower case, and the block of a gzipped record."""
    raw = zlib.decompress(data, wbits=31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    first, *lines = head.decode("utf-8").split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    size = int(fields["content-length"])
    if len(rest) < size:
        raise ValueError("truncated WARC record")
    return fields, rest[:size]


def read_package(path: str) -> Iterator[tuple[dict[str, str], bytes]]:
    """Every indexed record of a package, in the order of its index; neighbours are fetched together."""
    store, name = open_store(path)
    with store.open_input_file(name) as file:
        size = file.size()

        def read(offset: int, n: int) -> bytes:
            return file.read_at(n, offset)

        package = Package(read, size)
        starts = {n: package.place(n)[0] for n in package.members if n.startswith("archive/")}
        for index in sorted(n for n in package.members if n.startswith("indexes/")):
            at, n = package.place(index)
            spans = []
            for line in read(at, n).decode("utf-8").splitlines():
                entry = json.loads(line.split(" ", 2)[2])
                spans.append((starts["archive/" + entry["filename"]] + int(entry["offset"]), int(entry["length"])))
            i = 0
            while i < len(spans):
                j = i + 1
                while j < len(spans) and spans[j][0] == spans[j - 1][0] + spans[j - 1][1] and spans[j][0] + spans[j][1] - spans[i][0] <= RANGE_BYTES:
                    j += 1
                base = spans[i][0]
                data = read(base, spans[j - 1][0] + spans[j - 1][1] - base)
                for a, n in spans[i:j]:
                    yield parse_record(data[a - base : a - base + n])
                i = j


# Writing packages


def record(page_id: str | None, url: str | None, payload: bytes, digest: str, refers_to: str | None, revisit: bool) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    fields = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{url}')}>", f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha1:{digest}"]
    if url is not None:
        fields.append("WARC-Target-URI: " + urllib.parse.quote(url, safe="%/:=&?~#+!$,;'@()*[]"))
    if page_id is not None:
        fields.append(f"Page-ID: {page_id}")
    if revisit:
        fields += [f"WARC-Profile: {PROFILE}", f"Refers-To-Page-ID: {refers_to}"]
    fields += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(fields).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


def write_package(path: str, records: list[bytes], keys: list[str]) -> None:
    lines, at = [], 0
    for key, data in zip(keys, records, strict=True):
        lines.append(f"{key} {DATE} " + json.dumps({"filename": "data.warc.gz", "offset": at, "length": len(data)}))
        at += len(data)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        for name, body in (("archive/data.warc.gz", b"".join(records)), ("indexes/index.cdxj", "\n".join(lines).encode()), ("datapackage.json", b'{"profile": "data-package", "wacz_version": "1.1.1"}')):
            with z.open(zipfile.ZipInfo(name, (2024, 1, 1, 0, 0, 0)), "w", force_zip64=True) as member:
                member.write(body)
    store, name = open_store(path)
    with store.open_output_stream(name) as file:
        file.write(out.getvalue())


def write(pages: DataFrame, folder: str, min_bytes: int = 0, package_bytes: int = PACKAGE_BYTES) -> DataFrame:
    """Writes ``pages`` (page_id, url, html) as packages in ``folder``; a row (path, n_records) for each.

    Null html is an empty payload, a null url or page_id just has no field. Of rows with equal payloads of
    at least ``min_bytes`` bytes, those with the smallest page_id are responses and the others revisits of
    it; null ids count as larger than all, and if all are null, all are responses. Other columns are ignored.
    A package's name is new for each attempt, and only finished ones are listed, so a task may run again.
    """
    spark = pages.sparkSession
    store, name = open_store(folder)
    store.create_dir(name, recursive=True)
    plain = common.pick(pages, "page_id", "url", "html").withColumn("html", F.coalesce("html", F.lit(""))).withColumn("sha", F.sha1("html"))
    sized = F.octet_length("html") >= min_bytes
    firsts = common.stored(plain.where(sized).groupBy(F.col("sha").alias("sha_")).agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1"), "warc-firsts")
    # one payload may be that of a third of all pages
    joined = common.looked_up(plain, firsts, "sha", "n", "left", renamed="sha_").select(F.col("page_id").cast("string").alias("page_id"), "url", "html", F.unhex("sha").alias("sha"), F.col("first").cast("string").alias("first"), (F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))).alias("revisit"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, keys, size = [], [], 0

        def flush() -> pa.RecordBatch:
            path = f"{folder}/{uuid.uuid4().hex}.wacz"
            write_package(path, held, keys)
            out = pa.RecordBatch.from_pydict({"path": [path], "n_records": pa.array([len(held)], pa.int64())})
            held.clear(), keys.clear()
            return out

        for batch in batches:
            for page_id, url, html, sha, first, revisit in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held.append(record(page_id, url, html.encode("utf-8", "surrogatepass"), base64.b32encode(sha).decode(), first, revisit))
                keys.append(urllib.parse.quote(url or "-", safe=":/,()"))
                size += len(held[-1])
                if size >= package_bytes:
                    yield flush()
                    size = 0
        if held:
            yield flush()

    return common.stored(joined.mapInArrow(run, "path string, n_records long"), "warc-manifest")


FIELDS = "page_id string, url string, record_type string, payload_digest string, payload_bytes long, refers_to string"


def read(manifest: DataFrame, payload: bool = True) -> DataFrame:
    """A row for each record of the packages in ``manifest`` (path): page_id, url, record_type, payload_digest, payload_bytes, refers_to and, if asked for, the payload, which is null for revisits.

    A response's digest and length are those of the bytes read; one that differs from the digest in its
    header is an error. Of a revisit they come from its headers. An empty manifest gives no rows.
    """
    schema = FIELDS + (", payload binary" if payload else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["page_id", "url", "record_type", "payload_digest", "payload_bytes", "refers_to", *["payload"] * payload]
        kinds = [pa.string()] * 4 + [pa.int64(), pa.string(), *[pa.binary()] * payload]

        def flush(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

        for batch in batches:
            for path in batch.column("path").to_pylist():
                rows, held = [], 0
                for fields, block in read_package(path):
                    head, _, body = block.partition(b"\r\n\r\n")
                    kind, digest = fields["warc-type"], fields["warc-payload-digest"].partition(":")[2]
                    if kind == "response":
                        size = len(body)
                        if base32_sha1(body) != digest:
                            raise ValueError(f"{path}: a payload differs from its digest")
                    else:
                        size = next(int(v) for k, _, v in (x.partition(b":") for x in head.split(b"\r\n")) if k.strip().lower() == b"content-length")
                    rows.append((fields.get("page-id"), fields.get("warc-target-uri"), kind, digest, size, fields.get("refers-to-page-id"), *[body if kind == "response" else None] * payload))
                    held += len(block) * payload + 200
                    if held > common.SLICE_BYTES:
                        yield flush(rows)
                        rows, held = [], 0
                if rows:
                    yield flush(rows)

    files = manifest.select("path")
    n = files.count()
    tasks = max(1, min(n, manifest.sparkSession.sparkContext.defaultParallelism), -(-n // PACKAGES))
    return files.repartition(tasks).mapInArrow(run, schema)
