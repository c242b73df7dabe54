"""Array kernels over UTF-8 text held in Arrow buffers.

The operators that need a text's words work on whole Arrow batches: the bytes of many texts lie in one buffer, and
words, shingles and their hashes are found with numpy on that buffer, so no Python loop runs over rows or words.
Work goes in chunks of about ``CHUNK`` bytes (one text is never cut) to bound a worker's memory.

A *word* is a maximal run of bytes other than blank, tab, line feed, form feed and carriage return.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK = 1 << 20
BLANKS = (9, 10, 12, 13, 32)
IS_BLANK = np.zeros(256, bool)
IS_BLANK[list(BLANKS)] = True

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, for exponents 0 .. n at least."""
    if len(_powers[0]) <= n:
        size = max(2 * n, CHUNK) + 1
        for slot, base in ((0, _BASE), (1, _INVERSE)):
            table = np.full(size, base, np.uint64)
            table[0] = 1
            np.multiply.accumulate(table, out=table)
            _powers[slot] = table
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers (the splitmix finalizer); works on a copy."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def text_buffer(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and the n + 1 offsets of a string or binary column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if len(column) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    ends = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
    ends = ends.astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[ends[0] : ends[-1]], ends - ends[0]


def chunks(offsets: np.ndarray, size: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose texts have about ``size`` bytes together, at least one row each."""
    n, at = len(offsets) - 1, 0
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + size, side="right")) - 1
        to = min(max(to, at + 1), n)
        yield at, to
        at = to


class Words:
    """The words of a chunk of texts.

    ``data`` and ``offsets`` hold the texts; ``start`` and ``end`` the words' bytes in ``data``; ``row`` the text each
    word is of; ``first`` the n + 1 positions at which each text's words begin.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets = data, offsets
        n = len(data)
        solid = ~IS_BLANK[data]
        # A word may also begin where a text begins and end where it ends: texts touch each other in the buffer.
        begin, stop = solid.copy(), solid.copy()
        begin[1:] &= ~solid[:-1]
        stop[:-1] &= ~solid[1:]
        inner = offsets[1:-1]
        inner = inner[(inner > 0) & (inner < n)]
        begin[inner] = solid[inner]
        stop[inner - 1] = solid[inner - 1]
        self.start = np.flatnonzero(begin)
        self.end = np.flatnonzero(stop) + 1
        self.first = np.searchsorted(self.start, offsets)
        self.row = np.repeat(np.arange(len(offsets) - 1), np.diff(self.first))

    def hashes(self, salt: int = 0) -> np.ndarray:
        """A 64-bit hash of each word's bytes: a polynomial over them, scrambled."""
        n = len(self.data)
        power, inverse = _power_tables(n + 1)
        prefix = np.zeros(n + 1, np.uint64)
        np.multiply(self.data.astype(np.uint64) + np.uint64(1), power[:n], out=prefix[1:])
        np.cumsum(prefix, out=prefix)
        h = (prefix[self.end] - prefix[self.start]) * inverse[self.start]
        return mix(h + np.uint64(salt))

    def ids(self) -> tuple[np.ndarray, pa.Array]:
        """Numbers that are equal exactly for equal words of the chunk, and the words."""
        packed = take_bytes(self.data, self.start, self.end)
        encoded = packed.dictionary_encode()
        return encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64), encoded.dictionary


def take_bytes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """A binary Arrow array of the given slices of ``data``, which must not overlap and go up."""
    length = end - start
    to = np.zeros(len(start) + 1, np.int64)
    np.cumsum(length, out=to[1:])
    mark = np.zeros(len(data) + 1, np.int8)
    mark[start] += 1
    mark[end] -= 1
    kept = data[np.cumsum(mark[:-1], dtype=np.int8).view(bool)]
    return pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(to), pa.py_buffer(kept)])


def shingles(hashes: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every run of n words within a text, and the texts they are of.

    A text of 1 to n - 1 words has one shingle, of all its words; a text without words has none.
    """
    count = np.diff(first)
    lengths = np.where(count >= n, count - n + 1, (count > 0).astype(count.dtype))
    row = np.repeat(np.arange(len(count)), lengths)
    begin = np.zeros(len(count), np.int64)
    np.cumsum(lengths[:-1], out=begin[1:])
    at = first[:-1][row] + (np.arange(len(row)) - begin[row])
    limit = first[1:][row]
    padded = np.concatenate([hashes, np.zeros(n, np.uint64)])
    out = np.zeros(len(row), np.uint64)
    for k in range(n):
        word = padded[at + k]
        if k:
            word = np.where(at + k < limit, word, np.uint64(0x5851F42D4C957F2D))
        out *= np.uint64(0xD6E8FEB86659FD93)
        out += word ^ (word >> np.uint64(29))
    return mix(out), row


def to_long(x: np.ndarray) -> np.ndarray:
    """The same 64 bits as Spark's bigint."""
    return x.view(np.int64)
