"""Which windows of many texts are patterns, for more patterns than a task can hold.

A pattern of n characters is known by two windows of 2^j <= n characters, at its start and at its end, whose hashes come from
those of half the width.  All patterns become one bitmap of bounded size, made by Spark and sent to all tasks; what a task finds
in it leaves the task as text, to be joined with the patterns.  So a hash only rules out, and memory does not grow with either side.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.batches import slices

#: Bits of the bitmap a pattern, and bits of the largest one; of a bitmap of pairs; characters looked at together, places tried at once.
BITS, MOST_BITS, PAIR_BITS, CHARS, TRIED = 64, 1 << 29, 16, 1 << 16, 1 << 18
_BIT = np.uint8(1) << np.arange(8, dtype=np.uint8)
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _B
    h = (h ^ (h >> np.uint64(27))) * _C
    return h ^ (h >> np.uint64(31))


def _levels(code: np.ndarray):
    """j and the hash of the 2^j characters from each place on (fewer places by 2^j - 1), j from 0."""
    h, j = _mix(code + _A), 0
    while len(h):
        yield j, h
        a = h[: max(len(h) - (1 << j), 0)]
        a = a >> np.uint64(29) ^ a  # in place from here on
        a *= _B
        a += h[1 << j :]
        h = a
        j += 1


def _ends(a: np.ndarray, b: np.ndarray, n) -> np.ndarray:
    """Hash of the texts of n characters with these windows at both ends."""
    return _mix(_mix(a * _A + b) + np.asarray(n).astype(np.uint64))


def _starts(a: np.ndarray, j: int) -> np.ndarray:
    h = a ^ np.uint64((j + 1) * int(_C) % (1 << 64))
    h *= _B
    h ^= h >> np.uint64(32)
    return h


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points from 1 of all texts, each followed by a 0; where each text begins."""
    size = np.array([len(t) + 1 for t in texts], np.int64)
    code = np.frombuffer("\0".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
    start = np.r_[0, np.cumsum(size)]
    code[start[1:] - 1] = 0
    return code, start


def pieces(column: pa.Array):
    """The texts of a column (without nulls) in runs of about CHARS characters: the place of the first, the texts."""
    for a, b in slices(column):
        texts, from_, held = column.slice(a, b - a).to_pylist(), 0, 0
        for i, t in enumerate(texts):
            held += len(t)
            if held >= CHARS or i + 1 == len(texts):
                yield a + from_, texts[from_ : i + 1]
                from_, held = i + 1, 0


def _hashes(texts: list[str]) -> np.ndarray:
    """Of each text the hashes of its start and of its ends (0: empty)."""
    code, start = _codes(texts)
    size = np.diff(start) - 1
    level = np.frexp(np.maximum(size, 1).astype(float))[1] - 1
    out = np.zeros((len(texts), 2), np.uint64)
    for j, h in _levels(code):
        of = np.flatnonzero((level == j) & (size > 0))
        if len(of):
            a, b = h[start[of]], h[start[of] + size[of] - (1 << j)]
            out[of, 0], out[of, 1] = _starts(a, j), _ends(a, b, size[of])
        if j >= level.max(initial=0):
            break
    return out


def _bits(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The two bits of each hash."""
    most = np.uint64(bits - 1)
    return (h & most).view(np.int64), ((h >> np.uint64(32)) & most).view(np.int64)


def pair(h: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Hash of a text with this hash (of its ends) and of something else."""
    return _mix(h * _A + other.view(np.uint64))


def _masks(bit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return bit >> 6, (np.uint64(1) << (bit & 63).view(np.uint64)).view(np.int64)


def _paired(bits: int):
    """(word, mask) of the bits of each pair of a text and the hash of something else."""

    def run(batches):
        for batch in batches:
            other = np.asarray(batch.column(1))
            for a, texts in pieces(batch.column(0)):
                both = pair(_hashes(texts)[:, 1], other[a : a + len(texts)])
                yield pa.RecordBatch.from_arrays([*map(pa.array, _masks(np.concatenate(_bits(both, bits))))], ["word", "mask"])

    return run


def _marked(bits: int):
    """(word, mask) of the bits of each pattern; (-length, 0) of the lengths there are."""

    def run(batches):
        for batch in batches:
            for _, texts in pieces(batch.column(0)):
                h = _hashes(texts)
                bit = np.concatenate([x for y in h.T for x in _bits(y, bits)])
                lengths = np.unique([len(t) for t in texts])
                word, mask = _masks(bit)
                yield pa.RecordBatch.from_arrays([pa.array(np.r_[word, -lengths]), pa.array(np.r_[mask, np.zeros(len(lengths), np.int64)])], ["word", "mask"])

    return run


class Bitmap:
    """Bits of hashes: all of a set are in it, and few others."""

    def __init__(self, words: np.ndarray):
        self.words, self.bits = words, 64 * len(words)

    @property
    def _bytes(self) -> np.ndarray:
        return self.words.astype("<u8", copy=False).view(np.uint8)

    def has(self, h: np.ndarray) -> np.ndarray:
        """Places of the hashes that may be of the set."""
        at = np.flatnonzero(self._set((h & np.uint64(self.bits - 1)).view(np.int64)))
        return at[self._set(_bits(h[at], self.bits)[1])]

    def _set(self, bit: np.ndarray) -> np.ndarray:
        return (self._bytes[bit >> 3] & _BIT[bit & 7]) > 0


class Patterns(Bitmap):
    """Bitmap and lengths of patterns."""

    def __init__(self, words: np.ndarray, lengths: list[int]):
        super().__init__(words)
        self.lengths: dict[int, list[int]] = {}
        for n in lengths:
            self.lengths.setdefault(n.bit_length() - 1, []).append(n)
        self.longest = max(lengths, default=0)

    def windows(self, texts: list[str]) -> list[tuple[int, str]]:
        """(place of the text, window) of the windows that may be patterns: all that are, and few others."""
        row, at, n, *_ = self.places(texts)
        return [(k, texts[k][p : p + m]) for k, p, m in zip(row.tolist(), at.tolist(), n.tolist())]

    def places(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """`windows` as places of the text, where in it and how long they are, their hashes (of their ends, of their starts), one of equal
        ones of a text; and whether each character of all texts is in a window, equal ones too."""
        code, start = _codes(texts)
        covered = np.zeros(len(code) + 1, np.int32)
        found = [(np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),) * 2]
        for j, h in _levels(code):
            if j > max(self.lengths, default=-1):
                break
            if j not in self.lengths:
                continue
            places, lengths = self.has(_starts(h, j)), np.array(self.lengths[j])
            row = np.searchsorted(start, places, "right") - 1
            some = max(1, TRIED // len(lengths))
            for x in range(0, len(places), some):
                at, r, n = (v.ravel() for v in np.broadcast_arrays(places[x : x + some, None], row[x : x + some, None], lengths))
                fits = at + n < start[r + 1]
                at, r, n = at[fits], r[fits], n[fits]
                both = _ends(h[at], h[at + n - (1 << j)], n)
                hit = self.has(both)
                if len(hit):
                    at, r, n, both = at[hit], r[hit], n[hit], both[hit]
                    np.add.at(covered, at, 1)
                    np.subtract.at(covered, at + n, 1)
                    found.append(_single(r, at - start[r], n, both, h[at]))
        out = (np.concatenate(c) for c in zip(*found))
        return *_single(*out), np.delete(np.cumsum(covered[:-1]) > 0, start[1:] - 1)


def _single(row: np.ndarray, at: np.ndarray, n: np.ndarray, both: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, ...]:
    """One of equal windows of a text."""
    order = np.lexsort((both, row))
    r, h = row[order], both[order]
    order = order[np.r_[True, (r[1:] != r[:-1]) | (h[1:] != h[:-1])][: len(order)]]
    return row[order], at[order], n[order], both[order], first[order]


class Remembered:
    """The last of the pairs of hashes (128 bits) that share a place, of a bounded number of places."""

    def __init__(self, many: int):
        self.most = np.uint64((1 << max(1, (many - 1).bit_length())) - 1)
        self.held = np.zeros((2, int(self.most) + 1), np.uint64)

    def lacks(self, h: np.ndarray, other: np.ndarray) -> np.ndarray:
        at = (h & self.most).view(np.int64)
        return (self.held[0][at] != h) | (self.held[1][at] != other)

    def add(self, h: np.ndarray, other: np.ndarray) -> None:
        at, which = np.unique((h & self.most).view(np.int64), return_index=True)
        self.held[0][at], self.held[1][at] = h[which], other[which]


def _gathered(marked: DataFrame, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The words of a bitmap, and what else was marked."""
    rows = marked.groupBy("word").agg(F.bit_or("mask").alias("mask")).toArrow()
    word, mask = (np.asarray(rows.column(c).combine_chunks()) for c in ("word", "mask"))
    words = np.zeros(bits // 64, np.uint64)
    words[word[word >= 0]] = mask[word >= 0].view(np.uint64)
    return words, word[word < 0]


def _size(many: int, each: int) -> int:
    return min(MOST_BITS, 1 << max(12, (each * many).bit_length()))


def patterns(texts: DataFrame) -> Patterns:
    """The bitmap of the column of texts, none of them null; its size depends on their number, up to MOST_BITS."""
    bits = _size(texts.count(), BITS)
    words, others = _gathered(texts.mapInArrow(_marked(bits), "word long, mask long"), bits)
    return Patterns(words, sorted((-others).tolist()))


def pairs(of: DataFrame) -> Bitmap:
    """The bitmap of pairs of a text and a long, neither null; its size depends on their number, up to MOST_BITS."""
    bits = _size(of.count(), PAIR_BITS)
    return Bitmap(_gathered(of.mapInArrow(_paired(bits), "word long, mask long"), bits)[0])
