"""Vectorised words and 64-bit fingerprints over Arrow string columns.

The whole column is handled as one flat byte buffer: word borders, lower-casing of A-Z and hashing are
numpy passes over that buffer, with no Python loop over rows or words.  A word's fingerprint is a
position-free polynomial hash, taken from a running sum; it depends on the word's bytes alone.
Temporaries take about 40 bytes a text byte, so callers go through `chunks`, which bounds the bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
_MULT = 0x9E3779B97F4A7C15 | 1
_BASE = 0xD6E8FEB86659FD93  # odd, so that it has an inverse modulo 2**64
_INV = pow(_BASE, -1, 1 << 64)
CHUNK_BYTES = 1_000_000
#: Rows whose bytes are laid out at once.
SLICE_ROWS = 1_000


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, elementwise."""
    x = x.astype(U, copy=True)
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


_RAW = mix(np.arange(1, 257, dtype=U) * U(_MULT))
_FOLD = _RAW.copy()
_FOLD[65:91] = _RAW[97:123]  # A-Z hash as a-z

SPACED = np.ones(256, bool)  # [^\x20\x09-\x0D]+
SPACED[[32, *range(9, 14)]] = False
ALNUM = np.zeros(256, bool)  # [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after lower-casing
ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = ALNUM[128:] = True

_powers: list[np.ndarray] = [np.ones(1, U), np.ones(1, U)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The base's powers 0..n-1 and their inverses."""
    if len(_powers[0]) < n:
        m = max(n, CHUNK_BYTES + 1)
        for i, b in enumerate((_BASE, _INV)):
            x = np.full(m, U(b), U)
            x[0] = 1
            _powers[i] = np.multiply.accumulate(x)
    return _powers[0][:n], _powers[1][:n]


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column; null rows are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, at, data = column.buffers()
    off = np.frombuffer(at, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, off - off[0]


def chunks(batch: pa.RecordBatch, text: str, most: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of a batch whose texts hold at most about `most` bytes (a longer text is a slice alone)."""
    at = batch.schema.get_field_index(text)
    for first in range(0, batch.num_rows, SLICE_ROWS):
        some = batch.slice(first, SLICE_ROWS)
        raw, off = flat(some.column(at))
        i = 0
        while i < some.num_rows:
            j = max(i + 1, int(np.searchsorted(off, off[i] + most, "right")) - 1)
            yield some.slice(i, j - i), raw[off[i] : off[j]], off[i : j + 1] - off[i]
            i = j


class Words:
    """Words of a flat buffer: start and end bytes, 64-bit hash, and row, in text order."""

    def __init__(self, raw: np.ndarray, off: np.ndarray, letters: np.ndarray = SPACED, fold: bool = True):
        n = len(raw)
        inside = letters[raw]
        border = np.zeros(n + 1, bool)  # a row begins here
        border[off] = True
        first = inside.copy()
        first[1:] &= ~inside[:-1] | border[1:n]
        last = inside.copy()
        last[:-1] &= ~inside[1:] | border[1:n]
        self.start = np.flatnonzero(first)
        self.end = np.flatnonzero(last) + 1
        up, down = powers(n + 1)
        run = np.zeros(n + 1, U)
        np.cumsum((_FOLD if fold else _RAW)[raw] * up[:n], out=run[1:])
        self.hash = mix((run[self.end] - run[self.start]) * down[self.start] + (self.end - self.start).astype(U) * U(_MULT))
        self.row = np.searchsorted(off, self.start, "right") - 1
        self.rows = len(off) - 1
        #: words of row i are at[i]..at[i+1]
        self.at = np.searchsorted(self.row, np.arange(self.rows + 1))


def joined(h: np.ndarray, k: int) -> np.ndarray:
    """Fingerprints of all runs of k consecutive items."""
    n = max(0, len(h) - k + 1)
    out = mix(h[:n] + U(k))
    for i in range(1, k):
        out = mix(out * U(_MULT) + h[i : i + n])
    return out


def shingle_sets(w: Words, k: int) -> Iterator[np.ndarray]:
    """Each row's sorted distinct k-word shingles; the whole sequence as one if it has fewer words."""
    every = joined(w.hash, k)
    for a, b in zip(w.at[:-1].tolist(), w.at[1:].tolist()):
        if b - a >= k:
            s = np.sort(every[a : b - k + 1])
            keep = np.empty(len(s), bool)
            keep[0] = True
            np.not_equal(s[1:], s[:-1], out=keep[1:])
            yield s[keep]
        elif b > a:
            yield joined(w.hash[a:b], b - a)
        else:
            yield np.zeros(0, U)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
