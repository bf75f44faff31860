"""Packing against the tokenizer on whole texts, and first-fit decreasing against a plain loop."""

import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from pagewright.llm import packing

DOCS = "doc_id long, text string, row string, tokens string, full string"


def padding(lengths, size):
    return sum(0 if n & (n - 1) == 0 else size - n for n in lengths)


def checked(found, texts, size, path=None):
    """Every id of every text in one piece, sequences gapless, checksums those of the ids; returns the sequences' lengths."""
    t = packing.tokenizer(path)
    want = defaultdict(list)
    for i, text in texts:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 1]
        want[i].append(np.array(ids, "<u4").tobytes())
    left = {i: sorted(v) for i, v in want.items()}
    by = defaultdict(list)
    for r in found:
        by[r.doc_id].append(r)
    for i, pieces in by.items():
        if len(left[i]) == 1:
            ids = left[i][0]
            pieces.sort(key=lambda r: r.start)
            assert [r.start for r in pieces] == [0, *np.cumsum([r.length for r in pieces])[:-1]]
            assert sum(r.length for r in pieces) == len(ids) // 4 and {r.doc_tokens for r in pieces} == {len(ids) // 4}
            assert all(r.ids_crc32 == zlib.crc32(ids[4 * r.start : 4 * (r.start + r.length)]) for r in pieces)
        else:
            assert sum(r.length for r in pieces) == sum(map(len, left[i])) // 4
    assert set(by) == set(left)
    sequences = defaultdict(list)
    for r in found:
        sequences[r.sequence_id].append(r)
    total = []
    for pieces in sequences.values():
        pieces.sort(key=lambda r: r.offset)
        assert [r.offset for r in pieces] == [0, *np.cumsum([r.length for r in pieces])[:-1]]
        total.append(sum(r.length for r in pieces))
    assert max(total, default=0) <= size
    return total


def test_packing_is_whole(spark, monkeypatch):
    rng = random.Random(3)
    odd = ["Café", "CAFÉ", "don't", "I'LL'S", "ﬁx", "İstanbul", "ΣΑΣ", "a b\u0085c", "x​y", "1234", "№§!?", "<|endoftext|>", "a<|startoftext|>b", "漢字 仮名", "\x1c\x1f", "ẹ́", "w" * 300, "́"]
    texts = [(i, " ".join(rng.choice(odd) if rng.random() < 0.2 else f"word{rng.randrange(500)}" for _ in range(rng.choice([1, 5, 40, 300])))) for i in range(120)]
    texts += [(200, None), (201, ""), (202, " \t\n\r\x0b\f "), (203, "one  \n\n two"), (204, "long text of words " * 20_000), (205, "x" * 50_000)]
    texts += [(None, "no id"), (300, "same"), (300, "same"), (300, "other text of that id")]
    rng.shuffle(texts)
    frame = spark.createDataFrame([(i, t, "a", "b", "c") for i, t in texts], DOCS).repartition(3)
    found = packing.pack(frame, size=64).collect()
    total = checked(found, texts, 64)
    assert padding(total, 64) < 0.05 * sum(total)
    monkeypatch.setattr(packing, "GROUP_ROWS", 20)
    found = packing.pack(frame, size=64).collect()
    assert len({r.sequence_id >> 32 for r in found}) == 7
    checked(found, texts, 64)


def test_packing_empty(spark):
    empty = spark.createDataFrame([], DOCS)
    assert packing.pack(empty).count() == 0


@pytest.mark.parametrize("seed", range(20))
def test_first_fit_is_the_plain_loop(seed):
    rng = random.Random(seed)
    lengths = sorted((rng.randrange(1, 101) for _ in range(rng.randrange(0, 90))), reverse=True)
    bins, room = [], []
    for i, n in enumerate(lengths):
        b = next((b for b, r in enumerate(room) if r >= n), None)
        if b is None:
            bins.append([])
            room.append(100)
            b = len(bins) - 1
        bins[b].append(i)
        room[b] -= n
    assert packing.first_fit(lengths, 100) == bins


@pytest.mark.parametrize("seed", range(20))
@pytest.mark.parametrize("least", [1, 60])
def test_cut_pieces_cover_the_items(seed, least):
    rng = random.Random(seed)
    lengths = [rng.randrange(least, 101) for _ in range(rng.randrange(0, 60))]
    sequences = packing.packed(lengths, 100, 5)
    ids = sorted((item, t) for s in sequences for item, start, n in s for t in range(start, start + n))
    assert ids == [(i, t) for i, n in enumerate(lengths) for t in range(n)]
    assert all(100 - n < 5 or n & (n - 1) == 0 for n in (sum(p[2] for p in s) for s in sequences))


def test_words_are_forgotten_not_changed(monkeypatch):
    monkeypatch.setattr(packing, "WORDS", 10)
    encode = packing.Words()
    for i in range(60):
        texts = [f"alpha{i} beta{i % 7} GAMMA don't {i}", "", f"a<|endoftext|>b beta{i % 3} <x> " + "long" * 30]
        want = [packing.tokenizer().encode(t, add_special_tokens=False).ids for t in texts]
        assert [np.frombuffer(x, "<u4").tolist() for x in encode([t.encode() for t in texts])] == want
        assert len(encode.known) <= 20


def test_words_are_looked_up_and_cut_once(monkeypatch):
    """Before, each word of a text was looked up twice, and words of letters alone went through the pattern for pieces."""
    encode = packing.Words()
    texts = ["Alpha beta café I'LL it's", "alpha ÀÉÎ x\x1by \x7f a1b 'tis Alpha"]
    want = [packing.tokenizer().encode(t, add_special_tokens=False).ids for t in texts]

    class Pattern:
        cut: list = []

        def findall(self, text, keep=encode.pattern):
            self.cut.append(text)
            return keep.findall(text)

    encode.pattern = Pattern()
    assert [np.frombuffer(x, "<u4").tolist() for x in encode([t.encode() for t in texts])] == want
    assert sorted(Pattern.cut) == sorted(["café", "i'll", "it's", "àéî", "a1b", "'tis"])
