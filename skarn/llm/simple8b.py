"""Simple-8b: ids packed into 64-bit words, and the shard files of token ids built from it.

A word's upper four bits select how many ids of which width its lower 60 bits hold.  Selector 0 is a run of zeros;
selector 1 is an escape: its lower bits number an id of 60 bits or more among the block's raw ids.  A block holds up to
`BLOCK` ids; its index entry says where it starts, so blocks decode alone and each by whole arrays.

A shard file: MAGIC; the blocks (words, then raw ids); per document its id, whether that is null, and its number of
ids; per block its numbers of ids, words and raw ids; the counts of documents and blocks; MAGIC.  All integers are
little-endian and 64 bits wide (the null marks: bytes).
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np

#: Ids in a word and bits of each, by selector (0: a run of zeros, 1: an escape).
COUNTS = (240, 1, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1)
WIDTHS = (0, 60, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60)
MAGIC = b"SKIDS8B1"
BLOCK = 1 << 16
_SHIFTS = [np.arange(c, dtype=np.uint64) * np.uint64(w) for c, w in zip(COUNTS, WIDTHS)]
_AT = [np.arange(c) for c in COUNTS]


def _selectors(ids: np.ndarray) -> np.ndarray:
    """For each place the selector that takes most ids from there on."""
    n = len(ids)
    best = np.full(n, 15, np.int64)
    best[ids >= np.uint64(1 << 60)] = 1
    run = None  # places where the selector before held; only there can the next, narrower one hold
    for s in range(14, 1, -1):
        c, w = COUNTS[s], WIDTHS[s]
        if c > n:
            break
        if run is None:
            fits = ids < np.uint64(1 << w)
            span = fits[: n - c + 1].copy()
            for j in range(1, c):
                span &= fits[j : n - c + 1 + j]
            at = np.flatnonzero(span)
            if s == 12:
                run = at
        else:
            at = run[run <= n - c]
            for j in range(c):
                at = at[ids[at + j] < np.uint64(1 << w)]
            run = at
        if not len(at):
            break
        best[at] = s
    at = np.flatnonzero(best == 2)
    if len(at) and n >= COUNTS[0]:
        zeros = np.concatenate(([0], np.cumsum(ids != 0)))
        at = at[at <= n - COUNTS[0]]
        best[at[zeros[at + COUNTS[0]] == zeros[at]]] = 0
    return best


def pack(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words, raw ids) of one block."""
    ids = ids.astype(np.uint64)
    best = _selectors(ids)
    step = (np.arange(len(ids)) + np.array(COUNTS)[best]).tolist()
    starts, i, n = [], 0, len(ids)
    while i < n:
        starts.append(i)
        i = step[i]
    starts = np.array(starts, np.int64)
    chosen = best[starts]
    words, raw = chosen.astype(np.uint64) << np.uint64(60), np.zeros(0, np.uint64)
    for s in np.unique(chosen):
        at = np.flatnonzero(chosen == s)
        if s == 1:
            raw = ids[starts[at]]
            words[at] |= np.arange(len(at), dtype=np.uint64)
        elif s > 1:
            words[at] |= np.bitwise_or.reduce(ids[starts[at][:, None] + _AT[s]] << _SHIFTS[s], axis=1)
    return words, raw


def unpack(words: np.ndarray, raw: np.ndarray, n: int) -> np.ndarray:
    """The n ids of a block."""
    chosen = (words >> np.uint64(60)).astype(np.int64)
    counts = np.array(COUNTS)[chosen]
    ends = np.cumsum(counts)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint64)
    for s in np.unique(chosen):
        at = np.flatnonzero(chosen == s)
        first = ends[at] - counts[at]
        if s == 1:
            out[first] = raw[words[at] & np.uint64((1 << 60) - 1)]
        elif s > 1:
            out[first[:, None] + _AT[s]] = (words[at][:, None] >> _SHIFTS[s]) & np.uint64((1 << WIDTHS[s]) - 1)
    return out[:n]


class Writer:
    """Writes one shard to a binary stream; holds one block and the documents' index."""

    def __init__(self, stream):
        self.stream, self.docs, self.nulls, self.counts, self.blocks = stream, [], bytearray(), [], []
        self.held, self.n, self.bytes = [], 0, 0
        self._put(MAGIC)

    def _put(self, data: bytes) -> None:
        self.stream.write(data)
        self.bytes += len(data)

    def _block(self, ids: np.ndarray) -> None:
        words, raw = pack(ids)
        self._put(words.astype("<u8").tobytes() + raw.astype("<u8").tobytes())
        self.blocks.append((len(ids), len(words), len(raw)))

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append(doc_id or 0)
        self.nulls.append(doc_id is None)
        self.counts.append(len(ids))
        self.held.append(ids)
        self.n += len(ids)
        if self.n >= BLOCK:
            every = np.concatenate(self.held)
            whole = len(every) - len(every) % BLOCK
            for i in range(0, whole, BLOCK):
                self._block(every[i : i + BLOCK])
            self.held, self.n = [every[whole:]], len(every) - whole

    def close(self) -> None:
        if self.n:
            self._block(np.concatenate(self.held))
        self._put(np.array(self.docs, "<i8").tobytes() + bytes(self.nulls) + np.array(self.counts, "<u8").tobytes())
        self._put(np.array(self.blocks, "<u8").tobytes() + struct.pack("<QQ", len(self.docs), len(self.blocks)) + MAGIC)


def read(stream, size: int) -> Iterator[tuple[int | None, int, int, int]]:
    """(doc_id, ids before it in the shard, its ids, their crc32) from a shard; one block at a time."""
    stream.seek(size - 24)
    tail = stream.read(24)
    n, b = struct.unpack("<QQ", tail[:16])
    stream.seek(size - 24 - 24 * b - 17 * n)
    index = stream.read(17 * n + 24 * b)
    stream.seek(0)
    if tail[16:] != MAGIC or stream.read(8) != MAGIC:
        raise ValueError("not a shard of token ids")
    docs, nulls = np.frombuffer(index, "<i8", n), index[8 * n : 9 * n]
    counts, blocks = np.frombuffer(index, "<u8", n, 9 * n), np.frombuffer(index, "<u8", 3 * b, 17 * n).reshape(-1, 3).tolist()
    here, at, before = np.zeros(0, "<u4"), 0, 0
    following = iter(blocks)
    for doc, null, count in zip(docs.tolist(), nulls, counts.tolist()):
        crc, left = 0, count
        while left:
            if at == len(here):
                ids, words, raw = next(following)
                data = np.frombuffer(stream.read(8 * (words + raw)), "<u8")
                full = unpack(data[:words], data[words:], ids)
                here, at = full.astype("<u4"), 0
            take = min(left, len(here) - at)
            crc = zlib.crc32(here[at : at + take].tobytes(), crc)
            at, left = at + take, left - take
        yield None if null else doc, before, count, crc
        before += count
