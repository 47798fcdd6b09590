"""Words, word hashes and shingles of a column of texts, for whole Arrow chunks at once.

Texts are handled as UTF-8 bytes. All word patterns used here are unions of ASCII
classes plus every non-ASCII character, so a byte table decides what belongs to a
word exactly, and A-Z is lower-cased by another byte table. A word's hash is a
polynomial over a table of random 64-bit values, then mixed; equal words have equal
hashes, and different ones differ but for a chance of about 2**-64.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
_random = np.random.default_rng(20240521)
BYTE = _random.integers(0, 2**64, 256, dtype=U)
FACTORS = _random.integers(0, 2**64, 64, dtype=U) | U(1)
BASE, INVERSE = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 2**64)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: [^\x20\x09-\x0D]+
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
#: [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ on lower-cased text
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
CHUNK_BYTES = 1 << 20
_powers = {BASE: np.ones(1, U), INVERSE: np.ones(1, U)}


def powers(base: int, n: int) -> np.ndarray:
    have = _powers[base]
    if len(have) < n:
        steps = np.full(max(n, CHUNK_BYTES + 1), base, U)
        steps[0] = 1
        have = np.cumprod(steps)
        if n <= CHUNK_BYTES + 1:
            _powers[base] = have
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> U(31))
    h = h * U(0xBF58476D1CE4E5B9)
    h ^= h >> U(29)
    h = h * U(0x94D049BB133111EB)
    return h ^ (h >> U(32))


def flat(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column and the n + 1 offsets of its rows; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays([c.cast(pa.large_string()) for c in column.chunks]) if column.num_chunks != 1 else column.chunk(0)
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8) if len(column) else np.zeros(1, np.int64)
    data = column.buffers()[2]
    if data is None or offsets[-1] == offsets[0]:
        return np.empty(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def binaries(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a binary column without nulls and the n + 1 offsets of its rows."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8) if len(column) else np.zeros(1, np.int64)
    data = column.buffers()[2]
    if data is None or offsets[-1] == offsets[0]:
        return np.empty(0, np.uint8), offsets - offsets[0]
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


#: Caches that a worker holds from task to task; operators that don't use them empty them.
held: list[dict] = []


def trim() -> None:
    """Gives freed memory back to the system: workers live on and would keep it from the stages that follow."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim is not None:
        trim(0)


def release() -> None:
    """Empties the worker's caches and gives their memory back."""
    for cache in held:
        cache.clear()
    trim()


def released(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, which gives its memory back when it ends."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    return whole


def chunks(batches: Iterator[pa.RecordBatch], column: str = "text", keep: bool = False) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of about CHUNK_BYTES of text (one row at least), with bytes and offsets. keep: the worker's caches stay."""
    for batch in batches:
        if not batch.num_rows:
            continue
        data, offsets = flat(batch.column(batch.schema.get_field_index(column)))
        low = 0
        while low < batch.num_rows:
            high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + CHUNK_BYTES, "right")) - 1)
            yield batch.slice(low, high - low), data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low]
            low = high
    trim() if keep else release()


class Words:
    """Words of a chunk: starts and ends in bytes, hashes, and each row's first word in ``rows``.

    Bytes are looked at in slices, so that a text of any length takes a few bytes for
    each of its own and some arrays as long as its words are many.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, table: np.ndarray = NOT_SPACE, hashed: bool = True, lower: bool = True):
        data = LOWER[data] if lower else data
        n = len(data)
        starts, ends = [], []
        for low in range(0, n, CHUNK_BYTES):
            high = min(low + CHUNK_BYTES, n)
            # with one byte more on either side; rows end words
            inside = np.zeros(high - low + 2, bool)
            a, b = max(low - 1, 0), min(high + 1, n)
            inside[a - low + 1 : b - low + 1] = table[data[a:b]]
            edge = np.zeros(high - low + 1, bool)
            edge[offsets[np.searchsorted(offsets, low) : np.searchsorted(offsets, high, "right")] - low] = True
            own = inside[1:-1]
            starts.append(np.flatnonzero(own & (~inside[:-2] | edge[:-1])) + low)
            ends.append(np.flatnonzero(own & (~inside[2:] | edge[1:])) + low + 1)
        self.data, self.offsets = data, offsets
        self.starts = np.concatenate(starts) if starts else np.empty(0, np.int64)
        self.ends = np.concatenate(ends) if ends else np.empty(0, np.int64)
        self.rows = np.searchsorted(self.starts, offsets)
        if hashed:
            self.hashes = np.empty(len(self.starts), U)
            first = 0
            while first < len(self.starts):
                low = int(self.starts[first])
                last = max(first + 1, int(np.searchsorted(self.ends, low + CHUNK_BYTES, "right")))
                s, e = self.starts[first:last] - low, self.ends[first:last] - low
                sums = np.zeros(int(e[-1]) + 1, U)
                np.cumsum(BYTE[data[low : low + int(e[-1])]] * powers(BASE, int(e[-1])), out=sums[1:])
                self.hashes[first:last] = mix((sums[e] - sums[s]) * powers(INVERSE, len(sums))[s] + (e - s).astype(U))
                first = last

    def word(self, i: int) -> bytes:
        return self.data[self.starts[i] : self.ends[i]].tobytes()


def shingles(hashes: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-word shingles of each row and the rows' offsets in them.

    A row with words, but fewer than k, has one shingle: all of them. A row without
    words has none.
    """
    counts = np.diff(rows)
    sizes = np.where(counts >= k, counts - k + 1, (counts > 0).astype(counts.dtype))
    offsets = np.zeros(len(rows), np.int64)
    np.cumsum(sizes, out=offsets[1:])
    n = len(hashes)
    if n >= k:
        whole = hashes[: n - k + 1] * FACTORS[0]
        for j in range(1, k):
            whole += hashes[j : n - k + 1 + j] * FACTORS[j]
    else:
        whole = np.empty(0, U)
    out = np.empty(offsets[-1], U)
    full = counts >= k
    if full.all() and len(counts):
        first = np.repeat(rows[:-1] - offsets[:-1], sizes)
        out[:] = whole[np.arange(len(out)) + first]
    else:
        long = np.repeat(full, sizes)
        first = np.repeat(rows[:-1] - offsets[:-1], sizes)
        at = np.arange(len(out)) + first
        out[long] = whole[at[long]]
        for i in np.flatnonzero((counts > 0) & ~full):
            row = hashes[rows[i] : rows[i + 1]]
            out[offsets[i]] = np.append(row * FACTORS[: len(row)], FACTORS[63 - len(row)]).sum(dtype=U)
    return mix(out), offsets
