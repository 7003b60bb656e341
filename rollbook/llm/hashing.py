"""Vectorised hashing of whole texts inside tasks: words, shingles and byte windows of an Arrow batch.

A batch is one byte array with document borders; no function looks across a border. Hashes are 64 bits
wide: prefix sums of random byte codes times powers of an odd number, scaled back and mixed."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SPACES = b" \t\n\v\f\r"
_STEP = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1


@functools.cache
def codes() -> np.ndarray:
    return np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


@functools.lru_cache(4)
def _powers_to(n: int, base: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def powers(n: int, base: int = _STEP) -> np.ndarray:
    """1, base, base^2, ... modulo 2^64."""
    return _powers_to(1 << max(10, int(n - 1).bit_length()), base)[:n]


def inverse_powers(n: int) -> np.ndarray:
    return powers(n, pow(_STEP, -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit ."""
    x = x ^ (x >> np.uint64(32))
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column end to end, and its n + 1 borders; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = texts.buffers()
    borders = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return raw[borders[0] : borders[-1]], borders - borders[0]


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = 4 << 20, rows: int = 4096) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about `limit` bytes of `column` (a longer text is a batch of its own)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, borders = flat(batch.column(column))
        start = 0
        while start < batch.num_rows:
            end = min(start + rows, max(start + 1, int(np.searchsorted(borders, borders[start] + limit, "right")) - 1))
            yield batch.slice(start, end - start)
            start = end


class Words:
    """The words of a batch: maximal runs of bytes outside `spaces`. starts, ends: byte places; doc: row of each word;
    first: n + 1 borders of the rows among the words."""

    def __init__(self, texts: pa.Array, spaces: bytes = SPACES, lower: bool = False):
        data, self.borders = flat(texts)
        if lower:
            table = np.arange(256, dtype=np.uint8)
            table[65:91] += 32
            data = table[data]
        self.data = data
        inside = np.ones(256, bool)
        inside[list(spaces)] = False
        kept = np.zeros(len(data) + 2, bool)
        kept[1:-1] = inside[data]
        edge = kept[1:] != kept[:-1]
        starts = edge & kept[1:]
        ends = edge & kept[:-1]
        cuts = self.borders[kept[self.borders] & kept[self.borders + 1]]  # a word ends where its document ends
        starts[cuts] = ends[cuts] = True
        self.starts, self.ends = np.flatnonzero(starts), np.flatnonzero(ends)
        self.first = np.searchsorted(self.starts, self.borders)
        self.counts = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(self.counts)), self.counts)

    def hashes(self) -> np.ndarray:
        n = len(self.data)
        if not len(self.starts):
            return np.zeros(0, np.uint64)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(codes()[self.data] * powers(n), out=total[1:])
        return mix((total[self.ends] - total[self.starts]) * inverse_powers(n)[self.starts])

    def grams(self, size: int, hashes: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(hash of the `size` words from each word on, whether so many follow in its document)."""
        h = self.hashes() if hashes is None else hashes
        out = np.zeros(len(h), np.uint64)
        whole = np.arange(len(h)) + size <= np.repeat(self.first[1:], self.counts)
        n = len(h) - size + 1
        if n > 0:
            for j in range(size):
                out[:n] += h[j : j + n] * np.uint64(pow(0xC2B2AE3D27D4EB4F, j + 1, 1 << 64))
        return mix(out), whole


def window_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """Hash of the `size` bytes from each place on (short by size - 1)."""
    n = len(data)
    if n < size:
        return np.zeros(0, np.uint64)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(codes()[data] * powers(n), out=total[1:])
    return mix((total[size:] - total[:-size]) * inverse_powers(n)[: n - size + 1])


def ragged(values: np.ndarray, first: np.ndarray) -> pa.Array:
    """Rows of binary from a flat array and its n + 1 borders."""
    flat_bytes = np.ascontiguousarray(values)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(first) - 1, [None, pa.py_buffer((first * flat_bytes.itemsize).astype(np.int64)), pa.py_buffer(flat_bytes)]).cast(pa.binary())
