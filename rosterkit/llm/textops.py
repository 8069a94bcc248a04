"""Vectorised text primitives shared by the operators that run in Arrow tasks.

A batch of texts is handled as one UTF-8 byte array with row offsets (the
Arrow buffers themselves), so word borders, word hashes and n-gram hashes
of all rows come from a handful of numpy passes; no Python string is made
per word.  Words are maximal runs of bytes whose class table entry is
true; every separator of the task's word classes is ASCII, so byte runs
and code point runs are the same words.

Hashes are 64 bits: a random table value per byte times an odd power per
position, prefix-summed modulo 2**64, so that the hash of any byte range is
one subtraction and one product with the inverse power.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Most bytes of text handled at a time; a longer single text is handled alone.
CHUNK_BYTES = 1 << 19

_rng = np.random.default_rng(20240611)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 2**64)
_POWERS = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _classes(is_word) -> np.ndarray:
    return np.array([is_word(b) for b in range(256)], dtype=bool)


#: ``[^\x20\x09-\x0D]+``
SPACED = _classes(lambda b: not (b == 0x20 or 0x09 <= b <= 0x0D))
#: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after A-Z became a-z (so A-Z count as word bytes here)
ALNUM = _classes(lambda b: 0x30 <= b <= 0x39 or 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A or b >= 0x80)
#: A-Z to a-z, every other byte unchanged
LOWER = np.array([b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)], dtype=np.uint8)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a bijection of 64-bit values."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the base and of its inverse, modulo 2**64."""
    if len(_POWERS["up"]) < n:
        for key, base in (("up", _BASE), ("down", _BASE_INV)):
            steps = np.full(n, base, dtype=np.uint64)
            steps[0] = 1
            table = np.multiply.accumulate(steps)
            if n <= 2 * CHUNK_BYTES:
                _POWERS[key] = table
            else:  # one very long text: not kept
                return (table, powers_of(_BASE_INV, n)) if key == "up" else (powers_of(_BASE, n), table)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def powers_of(base: int, n: int) -> np.ndarray:
    steps = np.full(n, base, dtype=np.uint64)
    steps[0] = 1
    return np.multiply.accumulate(steps)


def prefix_hashes(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(prefix sums of value * base**position, inverse powers) for ``range_hash``."""
    up, down = powers(len(values) + 1)
    sums = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * up[:-1], out=sums[1:])
    return sums, down


def range_hash(hashed: tuple[np.ndarray, np.ndarray], start: np.ndarray, end: np.ndarray) -> np.ndarray:
    sums, down = hashed
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))


def chunks(column: pa.Array) -> Iterator[tuple[int, int]]:
    """Row ranges of a string column with at most CHUNK_BYTES of text, or one row."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False))
    first, base = 0, 0
    while first < len(ends):
        last = max(first + 1, int(np.searchsorted(ends, base + CHUNK_BYTES, side="right")))
        yield first, last
        base, first = int(ends[last - 1]), last


class Words:
    """The words of a slice of texts.

    ``data``: the bytes (lower-cased A-Z if asked), ``offsets``: byte offset
    of each row, ``start`` / ``end``: byte range of each word, ``row``: its
    row, ``first``: index of the first word of each row (one more at the
    end).  A null text has no words.
    """

    def __init__(self, column: pa.Array, word_class: np.ndarray = SPACED, lower: bool = True):
        column = pc.fill_null(column, "").cast(pa.large_string())
        _, where, raw = column.buffers()
        offsets = np.frombuffer(where, dtype=np.int64)[column.offset:column.offset + len(column) + 1]
        low, high = (int(offsets[0]), int(offsets[-1])) if len(column) else (0, 0)
        data = np.frombuffer(raw, dtype=np.uint8)[low:high] if raw is not None and high > low \
            else np.zeros(0, np.uint8)
        self.offsets = offsets - low if len(column) else np.zeros(1, np.int64)
        self.rows = len(column)
        self.data = LOWER[data] if lower else data
        inside = word_class[self.data]
        begin = inside.copy()
        begin[1:] &= ~inside[:-1]
        stop = inside.copy()
        stop[:-1] &= ~inside[1:]
        full = self.offsets[1:] > self.offsets[:-1]
        at = self.offsets[:-1][full]
        begin[at] = inside[at]
        at = self.offsets[1:][full] - 1
        stop[at] = inside[at]
        self.start = np.flatnonzero(begin)
        self.end = np.flatnonzero(stop) + 1
        self.row = np.searchsorted(self.offsets[1:], self.start, side="right")
        self.first = np.searchsorted(self.row, np.arange(self.rows + 1))

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes."""
        return range_hash(prefix_hashes(_BYTE[self.data]), self.start, self.end)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)


_STEP = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93,
                  0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3],
                 dtype=np.uint64)


def gram_hashes(word: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of ``n`` consecutive words (rows are not looked at)."""
    if len(word) < n:
        return np.zeros(0, np.uint64)
    total = np.zeros(len(word) - n + 1, dtype=np.uint64)
    for j in range(n):
        step = _STEP[j % 8] + np.uint64(2 * (j // 8))
        total += mix(word[j:len(word) - n + 1 + j] ^ step) * step
    return mix(total)


def as_long(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def row_slices(batch: pa.RecordBatch, text: str = "text") -> Iterator[pa.RecordBatch]:
    """The batch in slices of bounded text size."""
    for first, last in chunks(batch.column(text)):
        yield batch.slice(first, last - first)
