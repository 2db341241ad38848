"""TIFF images in binary columns: a reader that walks the image directories, and a plain writer.

The reader takes both byte orders, classic and BigTIFF, strips and tiles, chunky and planar samples,
no compression, PackBits, LZW and deflate, and undoes the horizontal and the floating-point predictor.
"""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import common

NONE, LZW, DEFLATE, PACKBITS, OLD_DEFLATE = 1, 5, 8, 32773, 32946
#: Bytes of the field types 1 to 18 that can hold whole numbers.
KINDS = {1: ("B", 1), 3: ("H", 2), 4: ("I", 4), 6: ("b", 1), 8: ("h", 2), 9: ("i", 4), 13: ("I", 4), 16: ("Q", 8), 17: ("q", 8), 18: ("Q", 8)}
#: Samples of the largest page that is decoded, unless the caller says otherwise: a page is one value of a row.
MOST_SAMPLES = 1 << 28
#: What a broken part of a file raises.
BROKEN = (ValueError, struct.error, IndexError, zlib.error, KeyError, ZeroDivisionError)


@dataclass
class Page:
    width: int
    height: int
    samples: int
    bits: int
    compression: int
    predictor: int
    photometric: int
    tiled: bool
    data: bytes  #: rows from the top, samples side by side, little-endian; rows of under 8 bits a sample end at a byte


def unpack_bits(data: bytes) -> bytes:
    out, i, n = bytearray(), 0, len(data)
    while i < n:
        k = data[i]
        if k < 128:
            out += data[i + 1 : i + 2 + k]
            i += 2 + k
        else:
            if k > 128 and i + 1 < n:
                out += data[i + 1 : i + 2] * (257 - k)
            i += 2 if k > 128 else 1
    return bytes(out)


def unpack_lzw(data: bytes) -> bytes:
    out, table, width, held, bits, last = bytearray(), [], 9, 0, 0, b""
    base = [bytes([i]) for i in range(256)] + [b"", b""]
    table = list(base)
    for byte in data:
        held = (held << 8) | byte
        bits += 8
        if bits < width:
            continue
        bits -= width
        code = held >> bits
        held &= (1 << bits) - 1
        if code == 257:
            break
        if code == 256:
            table, width, last = list(base), 9, b""
            continue
        if not last:
            if code > 255:
                raise ValueError("broken LZW data")
            entry = table[code]
        else:
            if code > len(table):
                raise ValueError("broken LZW data")
            entry = table[code] if code < len(table) else last + last[:1]
            table.append(last + entry[:1])
        out += entry
        last = entry
        width = 9 if len(table) < 511 else 10 if len(table) < 1023 else 11 if len(table) < 2047 else 12
    return bytes(out)


def pack_lzw(data: bytes) -> bytes:
    out, held, bits, width = bytearray(), 0, 0, 9
    base = {bytes([i]): i for i in range(256)}
    table, after = dict(base), 258

    def put(code: int) -> None:
        nonlocal held, bits
        held = (held << width) | code
        bits += width
        while bits >= 8:
            bits -= 8
            out.append(held >> bits)
            held &= (1 << bits) - 1

    put(256)
    word = b""
    for i in range(len(data)):
        longer = word + data[i : i + 1]
        if longer in table:
            word = longer
            continue
        put(table[word])
        table[longer] = after
        after += 1
        width = 9 if after < 512 else 10 if after < 1024 else 11 if after < 2048 else 12
        if after == 4095:
            put(256)
            table, after, width = dict(base), 258, 9
        word = data[i : i + 1]
    if word:
        put(table[word])
        after += 1
        width = 9 if after < 512 else 10 if after < 1024 else 11 if after < 2048 else 12
    put(257)
    if bits:
        out.append(held << (8 - bits) & 255)
    return bytes(out)


def pack_bits(data: bytes) -> bytes:
    out, i, n = bytearray(), 0, len(data)
    while i < n:
        j = i + 1
        while j < n and data[j] == data[i] and j - i < 128:
            j += 1
        if j - i > 1:
            out += bytes([257 - (j - i), data[i]])
        else:
            while j < n and j - i < 128 and (j + 1 >= n or data[j] != data[j + 1]):
                j += 1
            out.append(j - i - 1)
            out += data[i:j]
        i = j
    return bytes(out)


def decompress(data: bytes, compression: int, most: int) -> bytes:
    if compression == NONE:
        return data
    if compression in (DEFLATE, OLD_DEFLATE):
        return zlib.decompressobj().decompress(data, most)
    if compression == LZW:
        return unpack_lzw(data)
    if compression == PACKBITS:
        return unpack_bits(data)
    raise ValueError(f"compression {compression} is not known")


def unpredict(block: np.ndarray, order: str, bits: int, samples: int, width: int, predictor: int) -> np.ndarray:
    """Rows of bytes without the predictor, little-endian."""
    size = bits // 8
    if predictor == 3:
        if bits not in (16, 32, 64):
            raise ValueError(f"predictor 3 with {bits} bits")
        lanes = np.cumsum(block.reshape(len(block), -1, samples), axis=1, dtype=np.uint8)
        planes = lanes.reshape(len(block), size, width * samples)
        return np.ascontiguousarray(planes[:, ::-1].transpose(0, 2, 1)).reshape(len(block), -1)
    if bits % 8 or size == 3:
        if predictor == 2:
            raise ValueError(f"predictor 2 with {bits} bits")
        return block
    rows = block.view(f"{order}u{size}").reshape(len(block), width, samples)
    if predictor == 2:
        rows = np.cumsum(rows, axis=1, dtype=np.dtype(f"u{size}"))
    elif predictor != 1:
        raise ValueError(f"predictor {predictor} is not known")
    return np.ascontiguousarray(rows.astype(f"<u{size}")).reshape(len(block), -1).view(np.uint8)


@dataclass
class Lost:
    """A page that cannot be decoded, and why; its sizes, if they can be read."""

    error: str
    width: int | None = None
    height: int | None = None


def read_pages(data: bytes, most_samples: int = MOST_SAMPLES) -> Iterator[Page | Lost]:
    """The pages of a file in the order of its image directories, and what is lost; raises ValueError where the directories themselves are broken."""
    try:
        yield from _walk(data, most_samples)
    except BROKEN as e:
        raise ValueError(f"broken file: {e}") from e


def _walk(data: bytes, most_samples: int) -> Iterator[Page | Lost]:
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None:
        raise ValueError("no TIFF byte order")
    magic = struct.unpack(order + "H", data[2:4])[0]
    if magic not in (42, 43):
        raise ValueError("no TIFF")
    big = magic == 43
    at = struct.unpack(order + ("Q" if big else "I"), data[8:16] if big else data[4:8])[0]
    seen = set()
    while at:
        if at in seen:
            raise ValueError("image directories form a ring")
        seen.add(at)
        n = struct.unpack(order + ("Q" if big else "H"), data[at : at + (8 if big else 2)])[0]
        p, step, slot = at + (8 if big else 2), 20 if big else 12, 8 if big else 4
        if n * step > len(data):
            raise ValueError("broken image directory")
        tags: dict[int, list[int]] = {}
        for i in range(n):
            e = p + i * step
            tag, kind = struct.unpack(order + "HH", data[e : e + 4])
            count = struct.unpack(order + ("Q" if big else "I"), data[e + 4 : e + 4 + slot])[0]
            if kind not in KINDS:
                continue
            code, size = KINDS[kind]
            if count * size > len(data):
                raise ValueError("broken field")
            where = e + 4 + slot
            if count * size > slot:
                where = struct.unpack(order + ("Q" if big else "I"), data[where : where + slot])[0]
            tags[tag] = list(struct.unpack(f"{order}{count}{code}", data[where : where + count * size]))
        try:
            page: Page | Lost = _page(data, order, tags, most_samples)
        except BROKEN as e:
            page = Lost(str(e), *(tags.get(t, [None])[0] for t in (256, 257)))
        yield page
        end = p + n * step
        at = struct.unpack(order + ("Q" if big else "I"), data[end : end + slot])[0]


def _page(data: bytes, order: str, tags: dict[int, list[int]], most_samples: int) -> Page:
    def tag(t: int, default: int) -> int:
        return tags.get(t, [default])[0]

    width, height, samples, compression, predictor = tags[256][0], tags[257][0], tag(277, 1), tag(259, 1), tag(317, 1)
    depths = set(tags.get(258, [1]))
    if len(depths) != 1:
        raise ValueError("samples of different depths")
    bits, planar, tiled = depths.pop(), tag(284, 1) == 2, 322 in tags
    if width * height * samples > most_samples:
        raise ValueError(f"a page of {width * height * samples} samples, more than the {most_samples} asked for")
    if width * height * samples <= 0 or bits not in (1, 2, 4, 8, 16, 24, 32, 64):
        raise ValueError("sizes out of range")
    offsets, counts = (tags[324], tags[325]) if tiled else (tags[273], tags[279])
    bw, bh = (tags[322][0], tags[323][0]) if tiled else (width, min(tag(278, height), height))
    if bw <= 0 or bh <= 0 or bw * bh * samples > 4 * max(most_samples, 1 << 20):
        raise ValueError("sizes out of range")
    across, down, own = -(-width // bw), -(-height // bh), 1 if planar else samples
    planes = samples if planar else 1
    if len(offsets) < across * down * planes or len(counts) < across * down * planes:
        raise ValueError("strips or tiles are missing")
    row = -(-bw * own * bits // 8)
    out = np.zeros((planes, height, -(-width * own * bits // 8)), dtype=np.uint8)
    for k in range(planes):
        for y in range(down):
            rows = bh if tiled else min(bh, height - y * bh)
            for x in range(across):
                i = (k * down + y) * across + x
                if offsets[i] + counts[i] > len(data):
                    raise ValueError("a strip or tile is truncated")
                raw = data[offsets[i] : offsets[i] + counts[i]]
                if tag(266, 1) == 2:
                    raw = bytes(int(f"{b:08b}"[::-1], 2) for b in raw)
                block = decompress(raw, compression, rows * row)
                if len(block) < rows * row:
                    raise ValueError("a strip or tile is truncated")
                got = unpredict(np.frombuffer(block, dtype=np.uint8)[: rows * row].reshape(rows, row), order, bits, own, bw, predictor)
                take = min(rows, height - y * bh)
                left = x * bw * own * bits // 8
                out[k, y * bh : y * bh + take, left : left + row] = got[:take, : out.shape[2] - left]
    if planar and bits % 8 == 0:
        flat = out.reshape(planes, height, width, bits // 8).transpose(1, 2, 0, 3).tobytes()
    else:
        flat = out.tobytes()
    return Page(width, height, samples, bits, compression, predictor, tag(262, 1), tiled, flat)


def write_pages(pages: list[np.ndarray], compression: int = DEFLATE, predictor: int = 2, strip_rows: int = 128, tile: int = 0) -> bytes:
    """A little-endian file of 8-bit pages, arrays of (rows, columns, samples), in strips or in square tiles."""
    packers = {NONE: bytes, DEFLATE: lambda b: zlib.compress(b, 1), LZW: pack_lzw, PACKBITS: pack_bits}
    pack = packers[compression]
    parts, at, links = [b"II*\0\0\0\0\0"], 8, [4]

    def add(piece: bytes) -> int:
        nonlocal at
        where = at
        parts.append(piece + b"\0" * (len(piece) % 2))
        at += len(parts[-1])
        return where

    heads = []
    for image in pages:
        h, w, s = image.shape
        blocks = []
        if tile:
            for y in range(0, h, tile):
                for x in range(0, w, tile):
                    block = np.zeros((tile, tile, s), dtype=np.uint8)
                    block[: min(tile, h - y), : min(tile, w - x)] = image[y : y + tile, x : x + tile]
                    blocks.append(block)
        else:
            blocks = [image[y : y + strip_rows] for y in range(0, h, strip_rows)]
        spots = []
        for block in blocks:
            if predictor == 2:
                block = np.concatenate((block[:, :1], block[:, 1:] - block[:, :-1]), axis=1)
            body = pack(np.ascontiguousarray(block).tobytes())
            spots.append((add(body), len(body)))
        offsets, counts = [a for a, _ in spots], [n for _, n in spots]
        fields = [(256, [w]), (257, [h]), (258, [8] * s), (259, [compression]), (262, [2 if s == 3 else 1]), (277, [s])]
        fields += [(322, [tile]), (323, [tile]), (324, offsets), (325, counts)] if tile else [(273, offsets), (278, [strip_rows]), (279, counts)]
        fields.append((317, [predictor]))
        entries = []
        for tag, values in sorted(fields):
            inline = struct.pack("<I", values[0]) if len(values) == 1 else struct.pack("<I", add(struct.pack(f"<{len(values)}I", *values)))
            entries.append(struct.pack("<HHI", tag, 4, len(values)) + inline)
        heads.append(add(struct.pack("<H", len(entries)) + b"".join(entries) + b"\0\0\0\0"))
        links.append(heads[-1] + 2 + 12 * len(entries))
    out = bytearray(b"".join(parts))
    for link, head in zip(links, heads, strict=False):
        struct.pack_into("<I", out, link, head)
    return bytes(out)


PAGES = "page int, width int, height int, samples int, bits int, compression int, predictor int, photometric int, tiled boolean, data binary, error string"


def pages(df: DataFrame, id_col: str, media_col: str, most_samples: int = MOST_SAMPLES) -> DataFrame:
    """A row for each page of the files in ``media_col``: ``id_col``, page from 0, sizes, and the samples as bytes.

    A null file has no pages. A page that is broken, or of more samples than ``most_samples``, gives a row with
    its error and without samples, and the pages after it follow; where the chain of directories itself is
    broken, the last row has only id, page and error. Equal rows each give their pages; other columns are ignored.
    """
    plain = common.pick(df, id_col, media_col).toDF("id_", "media")
    names = [x.split()[0] for x in PAGES.split(", ")]

    def step(batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {k: [] for k in ("id_", *names)}

        def add(*row) -> None:
            for k, v in zip(out, row, strict=True):
                out[k].append(v)

        for key, media in zip(batch.column("id_").to_pylist(), batch.column("media").to_pylist(), strict=True):
            number = 0
            try:
                for p in read_pages(media, most_samples) if media is not None else ():
                    if isinstance(p, Lost):
                        add(key, number, p.width, p.height, *[None] * 7, p.error)
                    else:
                        add(key, number, p.width, p.height, p.samples, p.bits, p.compression, p.predictor, p.photometric, p.tiled, p.data, None)
                    number += 1
            except ValueError as e:
                add(key, number, *[None] * 9, str(e))
        return out

    return common.map_slices(plain, step, f"id_ {plain.schema['id_'].dataType.simpleString()}, {PAGES}", by="media").withColumnRenamed("id_", id_col)


#: Of the pages that texts are stored in: 64 pixels of three samples in a row, so many rows in a page at most.
WIDTH, SAMPLES, ROWS = 64, 3, 4096


def from_bytes(payload: bytes) -> bytes:
    """A file whose samples are ``payload``, a positive multiple of 192 bytes."""
    rows = np.frombuffer(payload, dtype=np.uint8).reshape(-1, WIDTH, SAMPLES)
    return write_pages([rows[i : i + ROWS] for i in range(0, len(rows), ROWS)])


def digests(docs: DataFrame) -> DataFrame:
    """Stores each text's padded bytes as a file, reads the file back, and gives digests and features of what it read.

    Null and empty texts are 192 spaces; texts of any length are stored whole, over as many pages as they need.
    Equal texts have equal values, equal rows each give a row; other columns, clashing names among them, are
    ignored, and an empty table gives no rows.
    """
    import hashlib

    def step(batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {k: [] for k in ("n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")}
        for text in common.texts_of(batch):
            raw = text.encode("utf-8", "surrogatepass")
            media = from_bytes(raw + b" " * (-len(raw) % 192 if raw else 192))
            got = list(read_pages(media))
            payload = b"".join(p.data for p in got)
            samples = np.frombuffer(payload, dtype=np.uint8).reshape(-1, SAMPLES)
            means = "/".join(f"{x:.3f}" for x in samples.mean(axis=0))
            row = (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest(), f"pages={len(got)};rows={sum(p.height for p in got)};means={means}")
            for k, v in zip(out, row, strict=True):
                out[k].append(v)
        return out | {"doc_id": batch.column("doc_id")}

    plain = common.pick(docs, "doc_id", "text")
    return common.map_slices(plain, step, f"doc_id {plain.schema['doc_id'].dataType.simpleString()}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
