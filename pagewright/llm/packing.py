"""Packing: first-fit decreasing over a tournament tree of bin capacities, in randomised groups of documents.

Each whole text is encoded once, in the scan.  A document longer than a sequence gives full sequences there and then, of which only
checksums go on; what is left (less than a sequence) goes to one of many groups by a hash of the row's place, so that groups have
about GROUP_ROWS rows however ids are spread.  A group is packed by itself: its rests by falling length, each into the first bin
that has room, which the tree of bin capacities (the larger of two at each node) finds in logarithmic time.  Then gaps of `smallest` tokens
or more are filled with cut documents from the emptiest bins, and the one bin that stays part full is cut into powers of
two, which need no padding.  So a sequence lacks fewer than `smallest` tokens, or none at a power of two.

Encoding goes word by word, with a memory of words: the tokenizer drops white space and no piece spans it, so that the ids of a
text are those of its words.  The tokenizer itself encodes every word that is not remembered.  (A tokenizer that keeps white space
cannot be used here.)

Defined results: null and empty texts are the end id alone; rows with null or repeated ids, and repeated rows, are documents
of their own; very long texts are encoded whole; equal lengths are packed in the order of the rows; special tokens spelt in a text
are what the tokenizer makes of them; extra columns are ignored, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GROUP_ROWS = 2_048
#: Words that a Python worker remembers (twice as many at most), and the bytes of the longest of them.
WORDS, WORD_BYTES = 400_000, 48
_PIECES = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
#: Characters that stay as they are when composed, and whose lower case is one character.
_LATIN = re.compile("[!-~À-ÿ]+")
#: The letters that byte-level models have for bytes: themselves where they are printable, else the next from 256 on.
_SEEN = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_LETTER = {b: chr(b) for b in _SEEN} | {b: chr(256 + i) for i, b in enumerate(sorted(set(range(256)) - set(_SEEN)))}
_made: dict = {}
_words: dict = {}


def tokenizer(path: str | None = None):
    """The tokenizer of a file (default: word_bpe_49k), once a process."""
    if path not in _made:
        import public_tokenizers
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        _made[path] = Tokenizer.from_file(path or public_tokenizers.path("word_bpe_49k.json"))
    return _made[path]


class Words:
    """Ids of texts (bytes in, 32-bit little-endian ids out), through those of their words.

    Of the words, the last WORDS to 2 * WORDS different ones are remembered.  Other words are encoded together, with a special token
    of the tokenizer between them, as what stands beside one has no part in a word's ids.  Words of Latin letters whose rules the
    tokenizer states (lower case, a pattern for pieces, bytes as letters) go to its model piece by piece, which is quicker.
    """

    def __init__(self, path: str | None = None):
        self.tokenizer, self.known, self.before, self.pieces = tokenizer(path), {}, {}, {}
        self.model = self.tokenizer.model
        rules = json.loads(self.tokenizer.to_str())
        steps = [x["type"] for x in (rules["normalizer"] or {}).get("normalizers", [])]
        cuts = (rules["pre_tokenizer"] or {}).get("pretokenizers", [])
        plain = steps == ["NFC", "Replace", "Lowercase"] and [x["type"] for x in cuts] == ["Split", "ByteLevel"] and rules["model"]["type"] == "BPE"
        plain = plain and cuts[0]["invert"] and cuts[0]["behavior"] == "Removed" and not (cuts[1]["add_prefix_space"] or cuts[1]["use_regex"])
        self.pattern = regex.compile(cuts[0]["pattern"]["Regex"]) if plain else None
        # whether letters alone are one piece: no rule before that for letters begins with one
        self.runs = plain and bool(re.match(r"(?:'[a-z]+\|)*\[\\p\{L\}\]\+\|", cuts[0]["pattern"]["Regex"]))
        special = [(i, t.content) for i, t in self.tokenizer.get_added_tokens_decoder().items() if t.special and not t.normalized]
        self.between = min(special, default=None)

    def __call__(self, texts: list[bytes]) -> list[bytes]:
        words = [t.split() for t in texts]  # at ASCII white space
        every = set().union(*words)
        new = every.difference(self.known)
        ids = {w: self.before[w] for w in new if w in self.before}
        ids |= self._encoded(list(new.difference(ids)) if ids else list(new))
        if len(self.known) + len(ids) > WORDS:
            ids |= {w: self.known[w] for w in every.difference(ids)}
            self.known, self.before = {}, self.known
        self.known |= ids
        out = [b"".join(map(self.known.__getitem__, own)) for own in words]
        for w in ids:
            if len(w) > WORD_BYTES:
                del self.known[w]
        return out

    def _piece(self, piece: str) -> bytes:
        if len(self.pieces) > WORDS:
            self.pieces.clear()
        letters = piece if piece.isascii() else "".join(map(_LETTER.__getitem__, piece.encode()))  # those seen are themselves
        ids = self.pieces[piece] = array("I", [x.id for x in self.model.tokenize(letters)]).tobytes()
        return ids

    def _encoded(self, words: list[bytes]) -> dict[bytes, bytes]:
        out, known = {}, self.pieces.get
        plain = []
        for w in words:
            if self.runs and w.isalpha() and len(w) <= WORD_BYTES:  # ASCII letters
                t = w.lower().decode()
                out[w] = known(t) or self._piece(t)
            elif self.pattern and len(w) <= WORD_BYTES and b"<" not in w and ((t := w.decode()).isprintable() if w.isascii() else _LATIN.fullmatch(t := w.decode())):
                out[w] = b"".join([known(x) or self._piece(x) for x in self.pattern.findall(t.lower())])
            elif self.between is None or len(w) > WORD_BYTES or b"<" in w:  # may spell a special token
                out[w] = np.array(self.tokenizer.encode(w.decode(), add_special_tokens=False).ids, "<u4").tobytes()
            else:
                plain.append(w)
        for start in range(0, len(plain), 1_000):
            some = plain[start : start + 1_000]
            ids = np.array(self.tokenizer.encode(self.between[1].join(w.decode() for w in some), add_special_tokens=False).ids, "<u4")
            cut = np.flatnonzero(ids == self.between[0])
            flat = ids.tobytes()
            out.update((w, flat[4 * a : 4 * b]) for w, a, b in zip(some, [0, *(cut + 1).tolist()], [*cut.tolist(), len(ids)], strict=True))
        return out


def _encoded(path: str | None, size: int, end: int):
    def run(batches):
        from pyspark import TaskContext

        if path not in _words:
            _words[path] = Words(path)  # for all tasks of this worker
        encode = _words[path]
        row, last = TaskContext.get().partitionId() << 40, int(end).to_bytes(4, "little")
        for batch in batches:
            for first in range(0, batch.num_rows, 100):  # few tails at once
                part = batch.slice(first, 100)
                out = []
                for ids in encode([t or b"" for t in part.column(1).cast(pa.binary()).to_pylist()]):
                    ids += last
                    full = len(ids) // (4 * size)
                    out.append((len(ids) // 4, [zlib.crc32(ids[4 * size * i : 4 * size * (i + 1)]) for i in range(full)], ids[4 * size * full :], row))
                    row += 1
                columns = [pa.array(c, k) for c, k in zip(zip(*out), (pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.int64()))]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], ["doc_id", "tokens", "full", "tail", "row"])

    return run


def first_fit(lengths: list[int], size: int) -> list[list[int]]:
    """Items (by position, in the given order) of each bin: each item goes to the first bin with room for it."""
    leaves = 1 << max(0, len(lengths) - 1).bit_length()
    best = [size] * (2 * leaves)
    bins: list[list[int]] = []
    for item, n in enumerate(lengths):
        at = 1
        while at < leaves:
            at = 2 * at if best[2 * at] >= n else 2 * at + 1
        if at - leaves == len(bins):
            bins.append([])
        bins[at - leaves].append(item)
        best[at] -= n
        while at > 1:
            at //= 2
            best[at] = max(best[2 * at], best[2 * at + 1])
    return bins


def packed(lengths: list[int], size: int, smallest: int) -> list[list[tuple[int, int, int]]]:
    """Sequences of pieces (item, start, length) of the items, all of 1 to `size` tokens."""
    order = sorted(range(len(lengths)), key=lambda i: -lengths[i])
    bins = [[(order[i], 0, lengths[order[i]]) for i in b] for b in first_fit([lengths[i] for i in order], size)]
    room = [size - sum(n for _, _, n in b) for b in bins]
    # gaps are filled from the emptiest bins, the narrowest first
    line = sorted((b for b, r in enumerate(room) if r >= smallest), key=lambda b: room[b])
    taker, giver = 0, len(line) - 1
    while taker < giver:
        b, g = line[taker], line[giver]
        if room[b] < smallest:
            taker += 1
        elif not bins[g]:
            giver -= 1
        else:
            item, start, n = bins[g].pop()
            most = min(n, room[b])
            bins[b].append((item, start, most))
            room[b] -= most
            if most < n:
                bins[g].append((item, start + most, n - most))
    bins = [b for b in bins if b]
    out = []
    for b in bins:
        total = sum(n for _, _, n in b)
        out += [b] if size - total < smallest else _powers(b, total)
    return out


def _powers(pieces: list[tuple[int, int, int]], total: int) -> list[list[tuple[int, int, int]]]:
    """The pieces cut into sequences whose lengths are the powers of two in the total."""
    out = []
    pieces = pieces[::-1]
    for bit in reversed(range(total.bit_length())):
        left = total & (1 << bit)
        if left:
            out.append([])
        while left:
            item, start, n = pieces.pop()
            most = min(n, left)
            out[-1].append((item, start, most))
            if most < n:
                pieces.append((item, start + most, n - most))
            left -= most
    return out


def _packed(size: int, smallest: int):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("row")
        group, ids = table.column("group")[0].as_py(), table.column("doc_id")
        tokens, full, tails = (table.column(c).to_pylist() for c in ("tokens", "full", "tail"))
        out = [(i, size * k, size, crc, tokens[i], 0) for i, own in enumerate(full) for k, crc in enumerate(own)]
        number = list(range(len(out)))
        some = [i for i, t in enumerate(tails) if t]
        for k, pieces in enumerate(packed([len(tails[i]) // 4 for i in some], size, smallest), len(out)):
            at = 0
            for item, start, n in pieces:
                i = some[item]
                out.append((i, size * len(full[i]) + start, n, zlib.crc32(tails[i][4 * start : 4 * (start + n)]), tokens[i], at))
                number.append(k)
                at += n
        row, start, length, crc, total, offset = (np.array(c, np.int64) for c in zip(*out))
        columns = [start, length, crc, total, (group << 32) + np.array(number, np.int64), offset]
        return pa.table([ids.take(pa.array(row)), *map(pa.array, columns)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, size: int = 2_048, end: int = 1, smallest: int = 8, path: str | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per piece of a document: doc_id, start (tokens of its document before it), length, ids_crc32, doc_tokens,
    sequence_id and offset in it.

    smallest: a gap of fewer tokens is padded rather than filled with a cut document.
    """
    kind = docs.schema[doc_id].dataType.simpleString()
    groups = max(1, -(-docs.count() // GROUP_ROWS))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("t"))
    rows = rows.mapInArrow(_encoded(path, size, end), f"doc_id {kind}, tokens long, full array<long>, tail binary, row long")
    rows = rows.withColumn("group", F.pmod(F.xxhash64("row"), F.lit(groups).cast("long")))
    return rows.groupBy("group").applyInArrow(_packed(size, smallest), f"doc_id {kind}, {_PIECES}")
