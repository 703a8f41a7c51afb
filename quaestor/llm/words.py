"""Word and shingle hashes of whole Arrow text columns, computed on the UTF-8 buffers.

A word is a run of bytes other than space and \\t \\n \\v \\f \\r; A-Z are lower-cased. Nothing is
decoded and nothing runs per row: boundaries, hashes and shingles of a slice of many documents
are numpy operations on its bytes. Slices hold about ``SLICE_BYTES`` (one longer document makes
a slice of its own), which bounds memory."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20
BASE = np.uint64(0x2545F4914F6CDD1D)
UNBASE = np.uint64(pow(0x2545F4914F6CDD1D, -1, 1 << 64))
SPACE = np.isin(np.arange(256), [0x20, 9, 10, 11, 12, 13])
LOWER = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], np.uint8)

_powers: dict[int, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; grown by doubling and kept by the worker."""
    have = _powers.get(int(base))
    if have is None or len(have) < n:
        size = max(n, SLICE_BYTES + 1, 2 * len(have) if have is not None else 0)
        have = np.full(size, base, np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        _powers[int(base)] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every input bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def row_slices(column: pa.Array, size: int = SLICE_BYTES) -> Iterator[tuple[int, pa.Array]]:
    """(first row, rows) of consecutive parts of a text column, without copying it."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    before = np.append(0, np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)))
    row = 0
    while row < len(column):
        end = int(np.searchsorted(before, before[row] + size, side="right")) - 1
        end = min(max(end, row + 1), len(column))
        yield row, column.slice(row, end - row)
        row = end


def text_slices(column: pa.Array, size: int = SLICE_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of consecutive rows; a null text is an empty one."""
    for row, part in row_slices(column, size):
        part = part.cast(pa.large_string()).fill_null("")
        offsets = np.frombuffer(part.buffers()[1], np.int64)[part.offset:part.offset + len(part) + 1]
        data = part.buffers()[2]
        data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
        yield row, data[offsets[0]:offsets[-1]], offsets - offsets[0]


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and offsets of each document's words among them."""
    inside = ~SPACE[data]
    first = np.zeros(len(data) + 1, bool)  # where a document begins
    first[offsets] = True
    before = np.zeros(len(data), bool)
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | first[:-1]))
    after = np.zeros(len(data), bool)
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | first[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each word, from one running polynomial over the slice."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    running = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(BASE, len(data)), out=running[1:])
    return mix((running[ends] - running[starts]) * powers(UNBASE, len(data))[starts])


def shingle_hashes(words: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``width`` words within each document, and their offsets; a shorter
    document that has words is one shingle. Runs are in order, with repeats."""
    counts = np.diff(offsets)
    sizes = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    out_offsets = np.zeros(len(offsets), np.int64)
    np.cumsum(sizes, out=out_offsets[1:])
    if not out_offsets[-1]:
        return np.zeros(0, np.uint64), out_offsets
    doc = np.repeat(np.arange(len(counts)), sizes)
    at = np.arange(out_offsets[-1]) - out_offsets[doc] + offsets[doc]
    last = offsets[1:][doc] - 1
    mixed = np.full(len(at), np.uint64(width), np.uint64)
    for k in range(width):
        here = at + k
        inside = here <= last
        word = np.where(inside, words[np.minimum(here, len(words) - 1)], np.uint64(0))
        mixed = mixed * BASE + word
    return mix(mixed), out_offsets


def distinct_by_row(values: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's values ascending and once, with new offsets."""
    values = values.copy()
    for low, high in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        values[low:high].sort()
    rows = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    new = np.ones(len(values), bool)
    new[1:] = (values[1:] != values[:-1]) | (rows[1:] != rows[:-1])
    values, rows = values[new], rows[new]
    return values, np.searchsorted(rows, np.arange(len(offsets)))


def shingle_sets(column: pa.Array, width: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, ascending distinct shingle hashes, offsets by row) of consecutive rows."""
    for row, data, offsets in text_slices(column):
        data = LOWER[data]
        starts, ends, by_doc = word_bounds(data, offsets)
        hashes, by_doc = shingle_hashes(word_hashes(data, starts, ends), by_doc, width)
        yield (row, *distinct_by_row(hashes, by_doc))
