"""Vectorised views of Arrow batches of texts: UTF-8 bytes, words, and polynomial prefix hashes.

All hashes are polynomials modulo 2**64 with an odd base, so that the hash of any slice comes from
two prefix sums: ``(P[e] - P[s]) * BASE**-s``. Byte values go through a table of random words first,
and every slice hash is mixed before use.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)
BYTES = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
#: Bytes that part words: U+0020 and U+0009 to U+000D. In UTF-8 they are never part of another character.
SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SLICE = 1 << 21
_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i for i below n at least; kept for the process."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, 1 << 16)
        up, down = np.full(size, BASE, np.uint64), np.full(size, INVERSE, np.uint64)
        up[0] = down[0] = 1
        _powers[:] = [np.cumprod(up), np.cumprod(down)]
    return _powers[0], _powers[1]


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xA3B195354A39B70D)
    h ^= h >> np.uint64(32)
    return h


def prefix(tokens: np.ndarray) -> np.ndarray:
    """P with P[i] = sum of tokens[j] * BASE**j over j < i, modulo 2**64."""
    out = np.zeros(len(tokens) + 1, np.uint64)
    np.cumsum(tokens * powers(len(tokens))[0][: len(tokens)], out=out[1:])
    return out


def slices(p: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Unmixed hashes of tokens[start:end]."""
    return (p[end] - p[start]) * powers(len(p))[1][start]


def grams(tokens: np.ndarray, q: int) -> np.ndarray:
    """Mixed hash of every q consecutive tokens."""
    if len(tokens) < q:
        return np.zeros(0, np.uint64)
    p = prefix(tokens)
    return mix((p[q:] - p[:-q]) * powers(len(p))[1][: len(p) - q])


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the n + 1 offsets of its rows; null is empty."""
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, at, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(at, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return buf[offsets[0] : offsets[-1]], offsets - offsets[0]


def parts(offsets: np.ndarray, limit: int = SLICE):
    """Ranges of rows (lo, hi) of at most ``limit`` bytes each, or of one row."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def words(buf: np.ndarray, offsets: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first byte and end of every word, and the n + 1 word offsets of the rows.

    Works through slices cut between words, so memory beyond the result is bounded by the slice
    (or the longest word)."""
    hashes, starts, ends = [], [], []
    lo, n = 0, len(buf)
    heads = offsets[1:-1]
    while lo < n:
        hi = min(n, lo + SLICE)
        while hi < n and not SPACE[buf[hi]] and hi not in _Sorted(heads):
            step = buf[hi : hi + 4096]
            gap = np.flatnonzero(SPACE[step])
            edge = heads[np.searchsorted(heads, hi, "right") :][:1]
            to = hi + (int(gap[0]) if len(gap) else len(step))
            hi = min(to, int(edge[0])) if len(edge) else to
        b = buf[lo:hi]
        ink = ~SPACE[b]
        first = ink.copy()
        first[1:] &= ~ink[:-1]
        last = ink.copy()
        last[:-1] &= ~ink[1:]
        cut = heads[np.searchsorted(heads, lo) : np.searchsorted(heads, hi)] - lo
        cut = cut[cut < len(b)]
        first[cut] |= ink[cut]
        cut = cut[cut > 0]
        last[cut - 1] |= ink[cut - 1]
        s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
        p = prefix(BYTES[LOWER[b] if lower else b])
        hashes.append(mix(slices(p, s, e) + (e - s).astype(np.uint64)))
        starts.append(s + lo)
        ends.append(e + lo)
        lo = hi
    join = lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind)
    s = join(starts, np.int64)
    return join(hashes, np.uint64), s, join(ends, np.int64), np.searchsorted(s, offsets)


class _Sorted:
    def __init__(self, values: np.ndarray):
        self.values = values

    def __contains__(self, x: int) -> bool:
        i = int(np.searchsorted(self.values, x))
        return i < len(self.values) and self.values[i] == x


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def longs(column: pa.Array, null: int = -(1 << 63)) -> np.ndarray:
    """An integer column as int64, with a value in place of null."""
    return column.cast(pa.int64()).fill_null(null).to_numpy(zero_copy_only=False)


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... counts[0] of them, and so on."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(counts)
    return np.arange(total) + np.repeat(starts - (ends - counts), counts)


def packed(df: DataFrame) -> DataFrame:
    """df with its last column, text, as compressed bytes: what a shuffle of whole texts should carry."""
    fields = [f"{name} {kind}" for name, kind in df.dtypes[:-1]]
    names = [*df.columns[:-1], "body"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            buf, offsets = utf8(batch.column(batch.num_columns - 1))
            raw = memoryview(np.ascontiguousarray(buf))
            bodies = [pack(raw[s:e]) for s, e in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(bodies, pa.binary())], names=names)

    return df.mapInArrow(run, ", ".join([*fields, "body binary"]))


def unpacked(batch: pa.RecordBatch, at: int, limit: int = SLICE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Ranges of rows with the bytes and offsets of their texts, about so many bytes at a time, from a column of packed()."""
    unpack = zstandard.ZstdDecompressor().decompress
    lo, held, size = 0, [], 0
    for i, body in enumerate(batch.column(at)):
        held.append(unpack(body.as_buffer()))
        size += len(held[-1])
        if size >= limit or i == batch.num_rows - 1:
            yield lo, i + 1, np.frombuffer(b"".join(held), np.uint8), np.r_[0, np.cumsum([len(x) for x in held])].astype(np.int64)
            lo, held, size = i + 1, [], 0
