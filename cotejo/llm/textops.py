"""Vectorised text helpers for Arrow batches: byte views, word spans, word and shingle hashes.

Everything works on the UTF-8 bytes of a whole column slice at once, so no Python object is made per word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that one slice of a batch holds at most, unless a single row is longer.
SLICE_BYTES = 2 << 20
#: Rows per Arrow batch asked of Spark, so that a batch of long documents stays small.
BATCH_ROWS = 1000

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_BYTE_CODES = np.random.default_rng(20_240_501).integers(1, 2**64 - 1, 256, dtype=np.uint64)
_LANE_CODES = np.random.default_rng(20_240_502).integers(1, 2**63 - 1, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

WORD_SPACE = np.zeros(256, bool)
WORD_SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A"):ord("Z") + 1] += 32


def small_batches(spark) -> None:
    """Keep Arrow batches small enough for long documents. Only lowers the session's setting."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string or binary column and the n + 1 offsets of its rows; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = pc.fill_null(column, b"")
    n, at = len(column), column.offset
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[at:at + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows with at most ``most`` bytes of text each; a longer row stands alone."""
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    start, held = 0, 0
    for i, n in enumerate(lengths):
        if i > start and held + n > most:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += int(n)
    if len(lengths) > start:
        yield batch.slice(start)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_spans(data: np.ndarray, offsets: np.ndarray,
               space: np.ndarray = WORD_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every run of bytes that are not ``space`` (by default words ``[^\\x20\\x09-\\x0D]+``), none across
    rows, and the number of them in each row."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets) - 1, np.int64)
    inside = ~space[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    starts = np.flatnonzero(inside & np.concatenate(([True], ~inside[:-1] | edge[1:-1])))
    ends = np.flatnonzero(inside & np.concatenate((~inside[1:] | edge[1:-1], [True]))) + 1
    counts = np.diff(np.searchsorted(starts, offsets))
    return starts, ends, counts


def span_array(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> pa.LargeBinaryArray:
    """The bytes of each span (in order, none overlapping) as an Arrow array, A-Z lower-cased if asked."""
    edges = np.zeros(len(data) + 1, np.int8)
    edges[starts] += 1
    edges[ends] -= 1
    taken = data[np.cumsum(edges[:-1], dtype=np.int8).astype(bool)]
    bounds = np.append(0, np.cumsum(ends - starts)).astype(np.int64)
    return pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(LOWER[taken] if lower else taken)])


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    """A 64-bit hash of each word's bytes (A-Z lower-cased by default)."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lengths = ends - starts
    total = int(lengths.sum())
    first = np.cumsum(lengths) - lengths
    within = np.arange(total) - np.repeat(first, lengths)
    at = within + np.repeat(starts, lengths)
    powers = np.cumprod(np.full(int(lengths.max()), _MULTIPLIER, np.uint64))
    taken = data[at]
    coded = _BYTE_CODES[LOWER[taken] if lower else taken] * powers[within]
    return mix(np.add.reduceat(coded, first) + lengths.astype(np.uint64) * _LANE_CODES[63])


def row_shingles(hashes: np.ndarray, words: int) -> np.ndarray:
    """Hashes of the runs of ``words`` words of one row; a row with fewer words is one run; none gives none."""
    n = len(hashes)
    if n == 0:
        return hashes
    width = min(words, n)
    out = np.zeros(n - width + 1, np.uint64)
    for k in range(width):
        out += hashes[k:n - width + 1 + k] * _LANE_CODES[k]
    return mix(out + np.uint64(width) * _LANE_CODES[62])


def per_row(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of ``values`` over rows with ``bounds``; 0 for empty rows."""
    return np.diff(np.append(0, np.cumsum(values, dtype=np.int64))[bounds])


def distinct_per_row(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Number of distinct hashes in each row, where row i holds the next ``counts[i]`` of them."""
    row = np.repeat(np.arange(len(counts), dtype=np.uint64), counts)
    order = np.unique(mix(hashes ^ mix(row + np.uint64(1))), return_index=True)[1]
    return np.bincount(row[order].astype(np.int64), minlength=len(counts))
