"""TIFF: a page decoder for PackBits, LZW and deflate strips and tiles with predictors, and a small encoder.

Decoding walks the chain of image directories of a file (either byte order), joins strips or tiles, undoes the
horizontal predictor and gives one page for each directory.  `pages` turns a binary column into one row per page.

`text_images` stores texts as files whose codec, predictor, layout, byte order and number of pages follow from a hash of
the text, so equal texts give equal files and a corpus uses every way to store a page.

Nulls and ties: a null file has no pages; a file that is not a TIFF, or whose chain of directories breaks off, gives a row
with page -1 and the error, a page that can't be decoded one with its number and the error, and the pages behind it are
still read.  Repeated rows stay rows.  A very long text is one file of several pages, held in memory as a whole.  An empty
table gives an empty table.  Kept columns whose names clash with the new ones are given back as k_<name>.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import base

#: Bytes of a field type, and the tags that are read.
_SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8, 13: 4, 16: 8}
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC = 256, 257, 258, 259, 262
STRIP_AT, SAMPLES, ROWS, STRIP_BYTES, PLANAR = 273, 277, 278, 279, 284
PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILE_AT, TILE_BYTES = 317, 322, 323, 324, 325
NONE, LZW, DEFLATE, PACKBITS, OLD_DEFLATE = 1, 5, 8, 32773, 32946


# ---- codecs


def packbits_decode(data: bytes) -> bytes:
    out, i = bytearray(), 0
    while i < len(data):
        n = data[i]
        i += 1
        if n < 128:
            out += data[i : i + n + 1]
            i += n + 1
        elif n > 128:
            out += data[i : i + 1] * (257 - n)
            i += 1
    return bytes(out)


def packbits_encode(data: bytes) -> bytes:
    out, i = bytearray(), 0
    while i < len(data):
        run = 1
        while run < 128 and i + run < len(data) and data[i + run] == data[i]:
            run += 1
        if run > 1:
            out += bytes((257 - run, data[i]))
            i += run
            continue
        j = i + 1
        while j < len(data) and j - i < 128 and not (j + 1 < len(data) and data[j] == data[j + 1]):
            j += 1
        out += bytes((j - i - 1,)) + data[i:j]
        i = j
    return bytes(out)


def lzw_decode(data: bytes) -> bytes:
    """Codes of 9 to 12 bits, high bit first, widened one code early; 256 clears, 257 ends."""
    out, table = bytearray(), [bytes((i,)) for i in range(256)] + [b"", b""]
    width, bits, n, before = 9, 0, 0, b""
    for byte in data:
        bits, n = (bits << 8) | byte, n + 8
        if n < width:
            continue
        n -= width
        code, bits = bits >> n, bits & ((1 << n) - 1)
        if code == 257:
            break
        if code == 256:
            del table[258:]
            width, before = 9, b""
            continue
        if not before:
            entry = table[code]
        else:
            entry = table[code] if code < len(table) else before + before[:1]
            table.append(before + entry[:1])
        out += entry
        before = entry
        size = len(table) + 1
        width = 12 if size >= 2048 else 11 if size >= 1024 else 10 if size >= 512 else 9
    return bytes(out)


def lzw_encode(data: bytes) -> bytes:
    out, bits, n, width = bytearray(), 0, 0, 9
    table: dict[bytes, int] = {}

    def put(code: int) -> None:
        nonlocal bits, n
        bits, n = (bits << width) | code, n + width
        while n >= 8:
            n -= 8
            out.append(bits >> n & 255)
        bits &= (1 << n) - 1

    def clear() -> None:
        nonlocal table, width
        put(256)
        table, width = {bytes((i,)): i for i in range(256)}, 9

    clear()
    held = b""
    for i in range(len(data)):
        c = data[i : i + 1]
        if held + c in table:
            held += c
            continue
        put(table[held])
        table[held + c] = len(table) + 2
        size = len(table) + 2
        width = 12 if size >= 2048 else 11 if size >= 1024 else 10 if size >= 512 else 9
        if size >= 4094:
            clear()
        held = c
    if held:
        put(table[held])
        size = len(table) + 3
        width = 12 if size >= 2048 else 11 if size >= 1024 else 10 if size >= 512 else 9
    put(257)
    if n:
        out.append(bits << (8 - n) & 255)
    return bytes(out)


#: What a damaged file can raise.
_DAMAGE = (ValueError, KeyError, IndexError, TypeError, ArithmeticError, MemoryError, struct.error, zlib.error)
#: Bytes that a page may have, and how many times its stored bytes; a header that asks for more is damaged.
MOST_BYTES = 1 << 30

_DECODERS = {NONE: bytes, LZW: lzw_decode, DEFLATE: zlib.decompress, OLD_DEFLATE: zlib.decompress, PACKBITS: packbits_decode}
_ENCODERS = {NONE: bytes, LZW: lzw_encode, DEFLATE: lambda d: zlib.compress(d, 1), OLD_DEFLATE: lambda d: zlib.compress(d, 1), PACKBITS: packbits_encode}


# ---- reading


def directories(data: bytes) -> Iterator[dict[int, list]]:
    """The tags of each image directory, in order; a chain that comes back to itself is an error."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or len(data) < 8 or struct.unpack(order + "H", data[2:4])[0] != 42:
        raise ValueError("not a TIFF")
    at, seen = struct.unpack(order + "I", data[4:8])[0], set()
    while at:
        if at in seen:
            raise ValueError("directories in a circle")
        seen.add(at)
        n = struct.unpack_from(order + "H", data, at)[0]
        tags = {}
        for i in range(n):
            tag, kind, count = struct.unpack_from(order + "HHI", data, at + 2 + 12 * i)
            size = _SIZES.get(kind, 0) * count
            where = at + 10 + 12 * i if size <= 4 else struct.unpack_from(order + "I", data, at + 10 + 12 * i)[0]
            raw = data[where : where + size]
            if len(raw) < size:
                raise ValueError("a tag ends beyond the file")
            letter = {1: "B", 3: "H", 4: "I", 13: "I", 16: "Q", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d"}.get(kind)
            tags[tag] = list(struct.unpack(f"{order}{count}{letter}", raw)) if letter else [raw]
        tags["order"] = order
        yield tags
        at = struct.unpack_from(order + "I", data, at + 2 + 12 * n)[0]


def image(data: bytes, tags: dict) -> np.ndarray:
    """The samples of one page: height, width, samples."""
    one = lambda tag, other: tags.get(tag, [other])[0]
    width, height, samples, planar = one(WIDTH, 0), one(HEIGHT, 0), one(SAMPLES, 1), one(PLANAR, 1)
    bits = tags.get(BITS, [1])
    if len(set(bits)) > 1 or bits[0] not in (1, 2, 4, 8, 16, 32):
        raise ValueError(f"samples of {bits} bits")
    if not all(isinstance(x, int) and x > 0 for x in (width, height, samples)) or width * height * samples * max(bits[0], 8) // 8 > MOST_BYTES:
        raise ValueError(f"a page of {height} by {width} by {samples} samples")
    if one(COMPRESSION, 1) not in _DECODERS:
        raise ValueError(f"compression {one(COMPRESSION, 1)}")
    packed = bits[0] < 8
    kind = np.dtype(f"u{max(bits[0], 8) // 8}").newbyteorder(tags["order"])
    decode, predictor = _DECODERS[one(COMPRESSION, 1)], one(PREDICTOR, 1)
    tiled = TILE_AT in tags
    w, h = (one(TILE_WIDTH, 0), one(TILE_HEIGHT, 0)) if tiled else (width, min(one(ROWS, height), height))
    if not all(isinstance(x, int) and x > 0 for x in (w, h)) or w * h > MOST_BYTES:
        raise ValueError(f"strips or tiles of {h} by {w}")
    at, sizes = (tags[TILE_AT], tags[TILE_BYTES]) if tiled else (tags[STRIP_AT], tags[STRIP_BYTES])
    deep = samples if planar == 1 else 1
    across, down = -(-width // w), -(-height // h)
    if len(at) < across * down * (samples // deep):
        raise ValueError("strips or tiles are missing")
    out = np.zeros((height, width, samples), kind.newbyteorder("="))
    for k, (start, size) in enumerate(zip(at, sizes)):
        plane, cell = divmod(k, across * down)
        if plane * deep >= samples:
            break
        y, x = cell // across * h, cell % across * w
        rows = h if tiled else min(h, height - y)
        raw = decode(data[start : start + size])
        if packed:  # rows begin at whole bytes, the first sample in the upper bits
            a_row = -(-w * deep * bits[0] // 8)
            flat = np.unpackbits(np.frombuffer(raw, np.uint8, rows * a_row).reshape(rows, a_row), axis=1)[:, : w * deep * bits[0]]
            part = flat.reshape(rows, w, deep, bits[0]) @ (1 << np.arange(bits[0])[::-1]).astype(np.uint8)
        else:
            part = np.frombuffer(raw, kind, rows * w * deep).reshape(rows, w, deep).astype(out.dtype)
        if predictor == 2:
            part = np.cumsum(part, axis=1, dtype=out.dtype)
        elif predictor != 1:
            raise ValueError(f"predictor {predictor}")
        part = part[: height - y, : width - x]
        out[y : y + len(part), x : x + part.shape[1], plane : plane + deep] = part
    return out


def decode(data: bytes) -> Iterator[np.ndarray]:
    """Every page of a file."""
    for tags in directories(data):
        yield image(data, tags)


# ---- writing


def encode(arrays: list[np.ndarray], compression: int = DEFLATE, predictor: int = 1, rows: int = 4096, tile: tuple[int, int] | None = None, order: str = "<") -> bytes:
    """A file with one page for each array (height, width[, samples]) of unsigned samples, in strips or tiles."""
    out = bytearray((b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, 0))
    link = 4
    for array in arrays:
        a = array if array.ndim == 3 else array[:, :, None]
        height, width, samples = a.shape
        w, h = tile or (width, min(rows, height))
        at, sizes = [], []
        for y in range(0, height, h):
            for x in range(0, width, w):
                part = a[y : y + h, x : x + w]
                if tile:
                    part = np.pad(part, ((0, h - part.shape[0]), (0, w - part.shape[1]), (0, 0)))
                if predictor == 2:
                    part = np.concatenate((part[:, :1], part[:, 1:] - part[:, :-1]), axis=1)
                data = _ENCODERS[compression](part.astype(part.dtype.newbyteorder(order)).tobytes())
                at.append(len(out))
                sizes.append(len(data))
                out += data
        tags = [(WIDTH, 4, [width]), (HEIGHT, 4, [height]), (BITS, 3, [8 * a.dtype.itemsize] * samples), (COMPRESSION, 3, [compression])]
        tags += [(PHOTOMETRIC, 3, [2 if samples == 3 else 1]), (SAMPLES, 3, [samples]), (PREDICTOR, 3, [predictor])]
        tags += [(TILE_WIDTH, 4, [w]), (TILE_HEIGHT, 4, [h]), (TILE_AT, 4, at), (TILE_BYTES, 4, sizes)] if tile else [(STRIP_AT, 4, at), (ROWS, 4, [h]), (STRIP_BYTES, 4, sizes)]
        entries = b""
        for tag, kind, values in sorted(tags):
            raw = struct.pack(f"{order}{len(values)}{'H' if kind == 3 else 'I'}", *values)
            if len(raw) > 4:
                where = struct.pack(order + "I", len(out))
                out += raw
            else:
                where = raw.ljust(4, b"\0")
            entries += struct.pack(order + "HHI", tag, kind, len(values)) + where
        if len(out) % 2:
            out.append(0)
        struct.pack_into(order + "I", out, link, len(out))
        out += struct.pack(order + "H", len(tags)) + entries
        link = len(out)
        out += struct.pack(order + "I", 0)
    return bytes(out)


# ---- columns


def _pages(data: bytes) -> Iterator[tuple[int, np.ndarray | None, str | None]]:
    """(number, samples, error) of each page; number -1 where the walk ends in an error."""
    walk, k = directories(data), 0
    while True:
        try:
            tags = next(walk, None)
        except _DAMAGE as e:
            yield -1, None, str(e) or type(e).__name__
            return
        if tags is None:
            return
        try:
            yield k, image(data, tags), None
        except _DAMAGE as e:
            yield k, None, str(e) or type(e).__name__
        k += 1


def pages(df: DataFrame, column: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """The kept columns and one row for each page of the files in a binary column: page, height, width, samples, bits,
    data (the samples, row by row, little-endian), error."""
    new = "page int, height int, width int, samples int, bits int, data binary, error string"
    added = T.StructType.fromDDL(new).fields
    taken = {f.name for f in added}
    mine = df.select(*(df[c].alias(f"k_{c}" if c.lower() in taken else c) for c in keep), df[column].alias("__file"))
    schema = T.StructType([*mine.schema.fields[:-1], *added])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = [pa.int32()] * 5 + [pa.binary(), pa.string()]
        for b in batches:
            rows, at, held = [], [], 0

            def batch() -> pa.RecordBatch:
                kept = [b.column(j).take(pa.array(at)) for j in range(len(keep))]  # noqa: B023
                return pa.RecordBatch.from_arrays([*kept, *(pa.array(c, t) for c, t in zip(zip(*rows), arrow))], schema.names)  # noqa: B023

            for i, value in enumerate(b.column(len(keep))):
                data = value.as_py()
                for k, a, error in _pages(data) if data is not None else ():
                    rows.append((k, *((None,) * 5 if a is None else (*a.shape, 8 * a.dtype.itemsize, a.astype(a.dtype.newbyteorder("<")).tobytes())), error))
                    at.append(i)
                    held += 0 if a is None else a.nbytes
                    if held >= 8 << 20:
                        yield batch()
                        rows, at, held = [], [], 0
            if rows:
                yield batch()

    return base.mapped(mine, run, schema)


def text_payload(text: str, multiple: int = 64) -> bytes:
    """UTF-8, filled with zeros to a positive multiple."""
    data = text.encode()
    return data + bytes(max(1, -(-len(data) // multiple)) * multiple - len(data))


class Feature:
    """Sixteen hex digits: which of 64 columns are above the mean of all; then the mean and the spread, in hundredths.  It
    is gathered page by page."""

    def __init__(self) -> None:
        self.sums, self.n, self.squares = np.zeros(64, np.int64), 0, 0

    def add(self, a: np.ndarray) -> None:
        self.sums += a.sum(axis=0, dtype=np.int64)
        self.n += a.size
        self.squares += int((a.astype(np.int64) ** 2).sum())

    def text(self) -> str:
        above = np.packbits(self.sums * len(self.sums) > self.sums.sum())
        n, s = self.n, int(self.sums.sum())
        return f"{above.tobytes().hex()}:{100 * s // n}:{100 * (n * self.squares - s * s) // (n * n)}"


def feature(a: np.ndarray) -> str:
    """The feature of one page of 64 columns."""
    out = Feature()
    out.add(a)
    return out.text()


#: Ways to store a text: codec, predictor, tile (or strips of so many rows), byte order.  LZW and PackBits are coded in
#: Python, so texts beyond `SLOW_BYTES` take deflate in their place.
WAYS = tuple((c, p, t, r, o) for c in (DEFLATE, NONE, PACKBITS, LZW, DEFLATE, OLD_DEFLATE) for p in (1, 2) for t, r in ((None, 16), ((64, 16), 16), (None, 4096)) for o in "<>")
SLOW_BYTES = 4096
#: Rows of 64 samples on a page.
PAGE_ROWS = 8192


def text_image(text: str, compression: int | None = None, predictor: int = 1) -> bytes:
    """A text's payload as a TIFF, 64 samples of 8 bits a row, in pages of PAGE_ROWS rows (short texts: of half of theirs)."""
    rows = np.frombuffer(text_payload(text), np.uint8).reshape(-1, 64)
    if compression is not None:
        return encode([rows], compression, predictor)
    h = zlib.crc32(rows.tobytes())
    codec, predictor, tile, strip, order = WAYS[h % len(WAYS)]
    if codec in (LZW, PACKBITS) and rows.size > SLOW_BYTES:
        codec = DEFLATE
    many = PAGE_ROWS if len(rows) > PAGE_ROWS else max(1, -(-len(rows) // (1 + h // len(WAYS) % 2)))
    return encode([rows[i : i + many] for i in range(0, len(rows), many)], codec, predictor, strip, tile, order)


def text_images(docs: DataFrame, text: str = "text", compression: int | None = None, predictor: int = 1) -> DataFrame:
    """doc_id, n_bytes and media: each text as a TIFF, stored in a way that its hash says or, where a compression is given,
    by that on one page."""
    schema = T.StructType([docs.schema["doc_id"], *T.StructType.fromDDL("n_bytes long, media binary").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, held, sizes, media = 0, 0, [], []
            for i, t in enumerate(b.column(1)):
                t = t.as_py()
                sizes.append(len(t.encode()))
                media.append(text_image(t, compression, predictor))
                held += len(media[-1])
                if held >= 8 << 20 or i == b.num_rows - 1:
                    yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(media)), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])
                    at, held, sizes, media = i + 1, 0, [], []

    return base.mapped(docs.select("doc_id", base.text_of(docs, text).alias("text")), run, schema)


def digests(media: DataFrame) -> DataFrame:
    """From doc_id, n_bytes, media: what reading the pages of the stored bytes back gives, in digests, and a feature.  The
    pages of a file come one after the other, and their rows are read as they come."""
    new = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    schema = T.StructType([media.schema["doc_id"], *T.StructType.fromDDL(new).fields])
    stored = media.select("doc_id", "n_bytes", "media", F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"))
    read = pages(stored, "media", ("doc_id", "n_bytes", "media_bytes", "media_sha256"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        kind, one = None, None

        def row() -> pa.RecordBatch:
            doc_id, n, media_bytes, media_sha, size, sha, tail, found = one
            values = (doc_id, n, size, sha.hexdigest(), zlib.crc32(tail), media_bytes, media_sha, found.text())
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, (kind, *ARROW))], schema.names)

        ARROW = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
        out: list[pa.RecordBatch] = []
        for b in batches:
            kind = b.schema.field(0).type
            for doc_id, n, media_bytes, media_sha, page, data, error in zip(*(c.to_pylist() for c in b.columns)):
                if error is not None:
                    raise ValueError(f"a stored text can't be read back: {error}")
                if page == 0:
                    if one is not None:
                        out.append(row())
                    one = [doc_id, n, media_bytes, media_sha, 0, hashlib.sha256(), b"", Feature()]
                one[4] += len(data)
                one[5].update(data)
                one[6] = data[-64:]
                one[7].add(np.frombuffer(data, np.uint8).reshape(-1, 64))
            if out:
                yield pa.Table.from_batches(out).combine_chunks().to_batches()[0]
                out = []
        if one is not None:
            yield row()

    names = ("doc_id", "n_bytes", "media_bytes", "media_sha256", "page", "data", "error")
    return base.mapped(read.select(*names), run, schema)
