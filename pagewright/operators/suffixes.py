"""Suffix arrays over shards of text, searched by many patterns at once."""

from __future__ import annotations

import numpy as np

#: Characters whose codes make up one key; a code has 21 bits.
KEY = 3
_MOST = np.uint64((1 << 21) - 1)


def codes(text: str) -> np.ndarray:
    """A number from 1 for each character, so that 0 can stand between texts."""
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)


def keys(code: np.ndarray) -> np.ndarray:
    """The next KEY codes from each place, as one number; zeros follow the end."""
    code = np.concatenate([code, np.zeros(KEY, np.uint64)])
    n = len(code) - KEY
    return code[:n] << np.uint64(42) | code[1 : n + 1] << np.uint64(21) | code[2 : n + 2]


def suffix_array(key: np.ndarray) -> np.ndarray:
    """Places in the order of what follows them (prefix doubling; only places that are not told apart yet are sorted again)."""
    n = len(key)
    order = np.argsort(key, kind="stable")
    rank = np.zeros(n + 1, np.int64)  # a place's rank is where its group ends; behind the end stands 0
    fresh = np.r_[True, key[order][1:] != key[order][:-1]] if n else np.zeros(0, bool)
    width = KEY
    while True:
        ends = np.r_[np.flatnonzero(fresh)[1:], n] if n else np.zeros(0, np.int64)
        group = np.cumsum(fresh) - 1
        rank[order] = ends[group] if n else 0
        alone = fresh & np.r_[fresh[1:], True] if n else fresh
        open_ = np.flatnonzero(~alone)
        if not len(open_):
            return order.astype(np.int32)
        at = order[open_]
        if width > n:  # zeros at the end of the text: the shorter one comes first
            order[open_] = at[np.lexsort((-at, rank[at]))]
            return order.astype(np.int32)
        behind = rank[np.minimum(at + width, n)]
        sort = np.lexsort((behind, rank[at]))
        order[open_] = at[sort]
        own, behind = rank[at][sort], behind[sort]
        fresh[open_] = np.r_[True, (own[1:] != own[:-1]) | (behind[1:] != behind[:-1])]
        width *= 2


class Patterns:
    """Texts to look for, with the keys of their stretches of KEY characters: least and largest where the last one is short."""

    def __init__(self, texts: list[str]):
        size = np.array([len(t) for t in texts], np.int64)
        self.steps = -(-size // KEY)
        self.first = np.r_[0, np.cumsum(self.steps)]
        flat = np.zeros((int(self.first[-1]), KEY), np.uint64)
        there = np.zeros(flat.shape, bool)
        row = np.repeat(np.arange(len(texts)), size)
        place = np.arange(len(row)) - np.repeat(np.r_[0, np.cumsum(size)[:-1]], size) if len(row) else row
        at = self.first[row] * KEY + place
        flat.reshape(-1)[at] = codes("".join(texts))
        there.reshape(-1)[at] = True
        shift = np.array([42, 21, 0], np.uint64)
        self.low = (flat << shift).sum(1, dtype=np.uint64)
        self.high = (np.where(there, flat, _MOST) << shift).sum(1, dtype=np.uint64)

    def __len__(self) -> int:
        return len(self.steps)


def _bound(key, order, offset, lo, hi, wanted, right: bool) -> np.ndarray:
    """First rank in lo..hi whose key `offset` on is at least (right: over) what is wanted, for many at once."""
    lo, hi = lo.copy(), hi.copy()
    last = len(key) - 1
    while True:
        busy = np.flatnonzero(lo < hi)
        if not len(busy):
            return lo
        mid = (lo[busy] + hi[busy]) // 2
        place = order[mid].astype(np.int64) + offset
        found = np.where(place <= last, key[np.minimum(place, last)], np.uint64(0))
        low = found <= wanted[busy] if right else found < wanted[busy]
        lo[busy] = np.where(low, mid + 1, lo[busy])
        hi[busy] = np.where(low, hi[busy], mid)


def ranges(key: np.ndarray, order: np.ndarray, patterns: Patterns) -> tuple[np.ndarray, np.ndarray]:
    """Of each pattern the ranks (from, to) of the places where it stands; empty patterns stand nowhere."""
    lo, hi = np.zeros(len(patterns), np.int64), np.zeros(len(patterns), np.int64)
    some = np.flatnonzero(patterns.steps > 0)
    if not len(key) or not len(some):
        return lo, hi
    sorted_ = key[order]
    at = patterns.first[some]
    lo[some] = np.searchsorted(sorted_, patterns.low[at], "left")
    hi[some] = np.searchsorted(sorted_, patterns.high[at], "right")
    step = 1
    while True:
        some = np.flatnonzero((patterns.steps > step) & (lo < hi))
        if not len(some):
            return lo, hi
        at = patterns.first[some] + step
        left = _bound(key, order, KEY * step, lo[some], hi[some], patterns.low[at], False)
        hi[some] = _bound(key, order, KEY * step, left, hi[some], patterns.high[at], True)
        lo[some] = left
        step += 1
