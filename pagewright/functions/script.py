"""Text normalised in Python, for Arrow batches: the same rules as the native columns of `quotes`, and conversion by phrases."""

from __future__ import annotations

import re
from collections.abc import Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .batches import mapped
from .quotes import PUNCTUATION, SIMPLIFIED, TRADITIONAL
from .text import SPACES

CHARACTERS = {t: s for t, s in zip(TRADITIONAL, SIMPLIFIED) if t != s}
_SPACE = re.compile("[" + re.escape("".join(map(chr, SPACES))) + "]+")
_DELETED = dict.fromkeys(map(ord, PUNCTUATION))
_MARKS = re.compile("[" + re.escape(PUNCTUATION) + "]+")


def squeezed(text: str) -> str:
    """Without white space, of any script."""
    return _SPACE.sub("", text)


def bare(text: str) -> str:
    """Without punctuation and spacing."""
    return text.translate(_DELETED) if text.isascii() else _MARKS.sub("", text)


class Converter:
    """Replaces what a table (from -> to) has, by its longest entry at each place from the left.

    So phrases come before the characters in them, of two entries that overlap the one that starts first counts, and what
    has been replaced is not looked at again.  The entries form a trie, which is walked only from characters that begin one.
    """

    def __init__(self, table: Mapping[str, str] | None = None):
        table = CHARACTERS if table is None else table
        self.single = str.maketrans(dict(table)) if all(len(k) == 1 for k in table) else None
        self.trie: dict = {}
        self.native = not any(k[:1].isascii() for k in table if k)  # nothing of it begins in an ASCII text
        for key, to in table.items():
            if key:
                at = self.trie
                for c in key:
                    at = at.setdefault(c, {})
                at[""] = to  # no character is empty

    def __call__(self, text: str) -> str:
        if self.native and text.isascii() or self.trie.keys().isdisjoint(text):
            return text
        if self.single is not None:
            return text.translate(self.single)
        out, at, kept = [], 0, 0
        while at < len(text):
            node, end, best = self.trie.get(text[at]), at + 1, None
            while node is not None:
                if "" in node:
                    best = end, node[""]
                node = node.get(text[end]) if end < len(text) else None
                end += 1
            if best:
                out += text[kept:at], best[1]
                kept = at = best[0]
            else:
                at += 1
        return "".join([*out, text[kept:]])


class Forms:
    """Of a list of texts: `squeezed`, `bare`, and `bare` of what is converted.  A table of characters alone is applied to all texts at
    once, as arrays of code points."""

    def __init__(self, convert: Converter):
        self.convert, self.to = convert, None
        #: Whether each character of the second form stands at its place in the third.
        self.aligned = False
        if convert.single is not None and all(isinstance(x, str) and len(x) == 1 for x in convert.single.values()):
            self.to = np.arange(0x110000, dtype=np.uint32)
            for a, b in convert.single.items():
                self.to[a] = ord(b)
            self.shown, marked = np.ones((2, len(self.to)), bool)
            self.shown[list(SPACES)] = marked[list(_DELETED)] = False
            self.letters, self.after = marked, marked[self.to]
            self.aligned = bool((self.letters == self.after).all())

    def __call__(self, texts: list[str]) -> tuple[list[str], list[str], list[str]]:
        if self.to is None:
            return [squeezed(t) for t in texts], [bare(t) for t in texts], [bare(self.convert(t)) for t in texts]
        code = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        ends = np.cumsum([len(t) for t in texts], dtype=np.int64)
        return tuple(self._cut(x, keep[code], ends) for x, keep in ((code, self.shown), (code, self.letters), (self.to[code], self.after)))

    def around(self, texts: list[str], covered: np.ndarray) -> tuple[list[int], list[str]]:
        """The parts of the squeezed texts that hold the covered characters of their third forms (which have to be aligned) with all that
        is left out there before and behind, each with the place of its text.  A text with a character that only the first form leaves
        out is a part as a whole, as what is apart in the other forms may meet in the first."""
        code = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        size = np.array([len(t) for t in texts], np.int64)
        of, letter, shown = np.repeat(np.arange(len(texts)), size), self.letters[code], self.shown[code]
        before = np.cumsum(letter)  # letters up to here; of another character the number of the next one
        inside = np.zeros(len(code), bool)
        inside[letter] = covered
        text = np.r_[-1, of[letter], -1]
        own = np.r_[False, covered, False]
        gap = np.flatnonzero(~letter)
        b = before[gap]
        inside[gap] = own[b] & (text[b] == of[gap]) | own[b + 1] & (text[b + 1] == of[gap])
        whole = np.zeros(len(texts), bool)
        whole[of[letter & ~shown]] = True
        inside |= whole[of]
        at = np.flatnonzero(inside)
        if not len(at):
            return [], []
        first = np.r_[True, (np.diff(at) > 1) | (of[at[1:]] != of[at[:-1]])]
        ends = np.r_[np.flatnonzero(first)[1:], len(at)]
        return of[at[first]].tolist(), self._cut(code[at], shown[at], ends)

    @staticmethod
    def _cut(code: np.ndarray, keep: np.ndarray, ends: np.ndarray) -> list[str]:
        text = code[keep].tobytes().decode("utf-32-le", "surrogatepass")
        at = np.r_[0, np.cumsum(keep)][ends].tolist()
        return [text[a:b] for a, b in zip([0, *at], at)]


def converted(text: Column, table: Mapping[str, str] | None = None) -> Column:
    """A column of text, converted in Arrow batches by a table of phrases and characters; null stays null."""
    convert = Converter(table)

    @F.arrow_udf("string")
    def run(column: pa.Array) -> pa.Array:
        return mapped(column, convert, pa.string())

    return run(text)
