"""Whole texts of Arrow batches as byte arrays, their words and their sets of word shingles.

Everything works on the UTF-8 bytes of many texts at once. Words are the runs
``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z; a word's 64-bit hash is a polynomial over its bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
WORDS_IN_SHINGLE = 5
# Texts of about this many bytes are worked on at a time; a longer text makes a slice of its own.
SLICE_BYTES = 2 << 20

_rng = np.random.default_rng(20240607)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)
_PLACE = _rng.integers(1, 1 << 63, 8, dtype=np.uint64) * U(2) + U(1)
_BASE = 0x9E3779B97F4A7C15 | 1
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_LOWER_BYTE = _BYTE[LOWER]
_powers: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (splitmix64)."""
    x = x + U(0x9E3779B97F4A7C15)
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The base's powers 0 to n and those of its inverse, modulo 2**64."""
    if not _powers or len(_powers[0]) <= n:
        size = max(n + 1, SLICE_BYTES + 1)
        made = []
        for b in (_BASE, pow(_BASE, -1, 1 << 64)):
            p = np.full(size, U(b))
            p[0] = U(1)
            made.append(np.cumprod(p))
        _powers[:] = made
    return _powers[0], _powers[1]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """64-bit hashes of the byte spans, as of lower-case letters A-Z if ``lower``; equal bytes give equal hashes wherever they stand."""
    power, inverse = powers(len(data))
    sums = np.empty(len(data) + 1, np.uint64)
    sums[0] = 0
    np.take(_LOWER_BYTE if lower else _BYTE, data, out=sums[1:], mode="clip")
    sums[1:] *= power[: len(data)]
    np.cumsum(sums[1:], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def strings(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and each value's offsets; null counts as empty."""
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, at, data = column.buffers()
    if at is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(at, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) over a column, whole texts in slices of about ``most`` bytes."""
    data, offsets = strings(column)
    first, n = 0, len(offsets) - 1
    while first < n:
        end = max(first + 1, int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1)
        yield first, end, data[offsets[first] : offsets[end]], offsets[first : end + 1] - offsets[first]
        first = end


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of every word, in order."""
    if not len(data):
        return (np.zeros(0, np.int64),) * 3
    inside = (data != 0x20) & (data - np.uint8(0x09) > 0x0D - 0x09)
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    full = np.flatnonzero(np.diff(offsets) > 0)
    heads, tails = offsets[full], offsets[full + 1] - 1
    first[heads] = inside[heads]
    last[tails] = inside[tails]
    starts = np.flatnonzero(first)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(np.searchsorted(starts, offsets)))
    return starts, np.flatnonzero(last) + 1, row


def shingles(words: np.ndarray, rows: np.ndarray, n: int, size: int = WORDS_IN_SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the word shingles in text order, and each row's offsets; fewer words make one shingle of all."""
    counts = np.bincount(rows, minlength=n)
    made = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    at = np.concatenate([[0], np.cumsum(made)])
    out = np.empty(at[-1], np.uint64)
    firsts = np.concatenate([[0], np.cumsum(counts)])[:-1]
    short = np.flatnonzero((counts > 0) & (counts < size))
    if len(words) >= size:
        whole = np.zeros(len(words) - size + 1, np.uint64)
        for k in range(size):
            whole += words[k : len(words) - size + 1 + k] * _PLACE[k]
        place = np.ones(at[-1], bool)
        place[at[short]] = False
        out[place] = whole[rows[: len(whole)] == rows[size - 1 :]]
    if len(short):
        total = counts[short].astype(np.uint64) * _PLACE[-1]
        for k in range(size - 1):
            has = counts[short] > k
            total[has] += words[firsts[short][has] + k] * _PLACE[k]
        out[at[short]] = total
    return mix(out), at


def sorted_sets(values: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's distinct values in ascending order."""
    values = values.copy()
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if b - a > 1:
            values[a:b].sort()
    keep = np.ones(len(values), bool)
    keep[1:] = values[1:] != values[:-1]
    keep[at[:-1][np.diff(at) > 0]] = True
    row = np.repeat(np.arange(len(at) - 1), np.diff(at))
    return values[keep], np.concatenate([[0], np.cumsum(np.bincount(row[keep], minlength=len(at) - 1))])


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The set of word shingles of every text: sorted hashes and each text's offsets."""
    starts, ends, rows = word_spans(data, offsets)
    hashes = span_hashes(data, starts, ends, lower=True) if len(starts) else np.zeros(0, np.uint64)
    return sorted_sets(*shingles(hashes, rows, len(offsets) - 1))


def sums_by_row(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sum modulo 2**64 of each row's values."""
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)])
    return total[at[1:]] - total[at[:-1]]


def codepoints(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The code points of UTF-8 bytes and the place of each one's first byte."""
    at = np.flatnonzero((data & 0xC0) != 0x80)
    code = data[at].astype(np.int64)
    long = np.flatnonzero(code >= 0xC0)
    if len(long):
        head, where = code[long], at[long]
        padded = np.concatenate([data, np.zeros(3, np.uint8)]).astype(np.int64)
        b1, b2, b3 = (padded[where + k] & 0x3F for k in (1, 2, 3))
        two, three = head < 0xE0, (head >= 0xE0) & (head < 0xF0)
        code[long] = np.where(
            two,
            (head & 0x1F) << 6 | b1,
            np.where(three, (head & 0x0F) << 12 | b1 << 6 | b2, (head & 0x07) << 18 | b1 << 12 | b2 << 6 | b3),
        )
    return code, at
