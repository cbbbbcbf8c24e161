"""Vectorised byte-level text helpers that run inside Arrow batches.

Texts stay in Arrow's UTF-8 buffers; words, hashes and n-grams come from whole-buffer numpy operations.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
#: Bytes of text handled at once; numpy temporaries take about 60 times as much.
CHUNK_BYTES = 2_000_000
_BASE = U(0x9E3779B97F4A7C15)


def _inverse(x: int) -> int:
    return pow(x, -1, 1 << 64)


_rng = np.random.default_rng(20240131)
BYTE_CODE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)
IS_SEPARATOR = np.zeros(256, bool)
IS_SEPARATOR[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on uint64."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse, modulo 2^64."""
    up, down = np.full(n, _BASE, U), np.full(n, U(_inverse(int(_BASE))), U)
    if n:
        up[0] = down[0] = 1
    return np.cumprod(up, dtype=U), np.cumprod(down, dtype=U)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty."""
    if column.null_count:
        column = column.fill_null("")
    if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
        kind = np.int64
    elif pa.types.is_string(column.type) or pa.types.is_binary(column.type):
        kind = np.int32
    else:
        column, kind = column.cast(pa.large_string()), np.int64
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def text_chunks(batches: Iterator[pa.RecordBatch], name: str, limit: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, bytes, offsets) in slices of about ``limit`` bytes; a longer single text is a slice of its own."""
    for batch in batches:
        data, offsets = text_bytes(batch.column(name))
        start, n = 0, batch.num_rows
        while start < n:
            end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + limit, "right")) - 1)
            end = min(end, n)
            yield batch.slice(start, end - start), data[offsets[start] : offsets[end]], offsets[start : end + 1] - offsets[start]
            start = end


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and row of each word, a run of bytes outside space and 0x09-0x0D; words never cross rows."""
    if len(data) == 0:
        z = np.zeros(0, np.int64)
        return z, z, z
    inside = ~IS_SEPARATOR[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    edges = offsets[1:-1][offsets[1:-1] < len(data)]
    first[edges] = inside[edges]
    starts = np.flatnonzero(first)
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    ends_at = offsets[1:-1][offsets[1:-1] > 0] - 1
    last[ends_at] |= inside[ends_at]
    ends = np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span, equal for equal bytes wherever they stand."""
    up, down = powers(len(data) + 1)
    total = np.zeros(len(data) + 1, U)
    np.cumsum(BYTE_CODE[data] * up[:-1], out=total[1:])
    return mix64((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(U))


def combine(hashes: np.ndarray, width: int) -> np.ndarray:
    """A hash of each run of ``width`` consecutive values (order matters)."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, U)
    out = np.full(n, U(width), U)
    for i in range(width):
        out = (out ^ (out >> U(29))) * U(0x9FB21C651E98DF25) + hashes[i : i + n]
    return mix64(out)


def combine_rows(hashes: np.ndarray, rows: np.ndarray, n_rows: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Word shingles of each row: (hash, row). A row with 1 to width-1 words gives its whole sequence as one."""
    grams = combine(hashes, width)
    if len(grams):
        same = rows[: len(grams)] == rows[width - 1 :]
        grams, owner = grams[same], rows[: len(same)][same]
    else:
        owner = np.zeros(0, np.int64)
    counts = np.bincount(rows, minlength=n_rows)
    begin = np.concatenate([[0], np.cumsum(counts)])
    extra, extra_rows = [], []
    for size in range(1, width):
        at = np.flatnonzero(counts == size)
        if len(at):
            h = np.full(len(at), U(size), U)
            for i in range(size):
                h = (h ^ (h >> U(29))) * U(0x9FB21C651E98DF25) + hashes[begin[at] + i]
            extra.append(mix64(h))
            extra_rows.append(at)
    if extra:
        grams = np.concatenate([grams, *extra])
        owner = np.concatenate([owner, *extra_rows])
    return grams, owner


def distinct_pairs(owner: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, value), sorted by row then value."""
    order = np.lexsort((values, owner))
    owner, values = owner[order], values[order]
    keep = np.ones(len(owner), bool)
    keep[1:] = (owner[1:] != owner[:-1]) | (values[1:] != values[:-1])
    return owner[keep], values[keep]
