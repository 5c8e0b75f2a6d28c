"""Numpy views of Arrow text columns: bytes, words and rolling hashes.

Everything here works on one bounded run of texts inside a task. Hashes are
64-bit polynomials over a random byte table, mixed at the end; two strings are
only called equal on two independent keys or after a comparison of the bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 20  # bytes of text handled at once; one text may be longer

_rng = np.random.default_rng(20240607)
_BYTE = _rng.integers(1 << 63, dtype=np.uint64) | np.uint64(1)
_TABLE = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = int(_BYTE) | 5
_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS = {"n": 0, "up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, at least n of each."""
    if _POWERS["n"] < n:
        for key, base in (("up", _BASE), ("down", _INVERSE)):
            steps = np.full(n + 1, np.uint64(base & (2**64 - 1)), np.uint64)
            steps[0] = 1
            _POWERS[key] = np.cumprod(steps, dtype=np.uint64)
        _POWERS["n"] = n
    return _POWERS["up"], _POWERS["down"]


def mix(values: np.ndarray) -> np.ndarray:
    """Finaliser: every input bit reaches every output bit."""
    values = values ^ (values >> np.uint64(33))
    values = values * np.uint64(0xFF51AFD7ED558CCD)
    values = values ^ (values >> np.uint64(33))
    values = values * np.uint64(0xC4CEB9FE1A85EC53)
    return values ^ (values >> np.uint64(33))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text column and its n + 1 offsets; null reads as empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def runs(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes; every row is in exactly one range."""
    first, rows = 0, len(offsets) - 1
    while first < rows:
        last = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        last = min(rows, max(first + 1, last))
        yield first, last
        first = last


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Running polynomial hash; feed to ``span_hash``."""
    up, _ = powers(len(data))
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_TABLE[data] * up[: len(data)], out=total[1:], dtype=np.uint64)
    return total


def span_hash(total: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Mixed hash of each byte span; depends on content and length only."""
    _, down = powers(len(total) - 1)
    value = (total[end] - total[start]) * down[start]
    return mix(value + (end - start).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every run of bytes other than ASCII white space."""
    inside = ~((data == 32) | ((data >= 9) & (data <= 13)))
    start = inside.copy()
    start[1:] &= ~inside[:-1]
    edges = offsets[:-1][(offsets[:-1] < len(data))]
    start[edges] |= inside[edges]
    end = inside.copy()
    end[:-1] &= ~inside[1:]
    tails = offsets[1:][offsets[1:] > 0] - 1
    end[tails] |= inside[tails]
    starts = np.flatnonzero(start)
    rows = np.searchsorted(offsets, starts, side="right") - 1
    return starts, np.flatnonzero(end) + 1, rows


def shingles(
    data: np.ndarray, offsets: np.ndarray, size: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shingle hashes, their rows, and the word count of every row.

    A row with fewer words than ``size`` but at least one has one shingle of all
    its words; a row without words has none.
    """
    starts, ends, rows = word_spans(data, offsets)
    count = np.bincount(rows, minlength=len(offsets) - 1)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), count
    word = span_hash(prefix_hash(data), starts, ends)
    first = np.concatenate([[0], np.cumsum(count)])[:-1]
    place = np.arange(len(word)) - first[rows]
    width = np.minimum(count, size)
    heads = np.flatnonzero(place + width[rows] <= count[rows])
    value = np.zeros(len(heads), np.uint64)
    reach = width[rows[heads]]
    for k in range(size):
        use = reach > k
        at = np.minimum(heads + k, len(word) - 1)
        value = np.where(use, mix(value * np.uint64(0x9E3779B97F4A7C15) + word[at]), value)
    return value, rows[heads], count
