"""Work in slices of bounded bytes, pieces of texts, blocks of vectors."""

import numpy as np
import pyarrow as pa

from pagewright.functions import batches, tokens
from pagewright.operators import nearest
from pagewright.sources import files


def test_slices():
    texts = pa.array(["x" * 900_000, None, "y", "z" * 5_000_000, *["w" * 100] * 50_000])
    found = list(batches.slices(texts))
    assert [a for a, _ in found[1:]] == [b for _, b in found[:-1]] and found[0][0] == 0 and found[-1][1] == len(texts)
    size = batches.sizes(texts)
    assert all(b - a == 1 or size[a:b].sum() <= batches.SLICE_BYTES + size[a] for a, b in found) and len(found) >= 4
    assert list(batches.slices(texts.slice(0, 0))) == [(0, 0)]
    lists = pa.array([[b"ab", b"c"], None, [], [b"defg"]])
    assert batches.sizes(lists).tolist() == [35, 0, 0, 20] and batches.sizes(lists.slice(2)).tolist() == [0, 20]


def test_mapped():
    texts = pa.array(["a" * 1_500_000, None, "b" * 1_500_000, "c"])
    assert batches.mapped(texts, lambda t: t[0] * 2, pa.string()).to_pylist() == ["aa", None, "bb", "cc"]
    assert len(batches.mapped(texts.slice(0, 0), str, pa.string())) == 0


def test_csv_parts():
    rows = pa.RecordBatch.from_arrays([pa.array(["1", "2", None]), pa.array(["é" * 1_500_000, None, "x" * 1_500_000])], ["id", "text"])
    out = list(files._encoded(["id", "text"], "gb18030")([rows]))
    assert len(out) >= 3  # the header, then parts
    lines = [x for b in out for x in b.column(0).to_pylist()]
    assert [x.decode("gb18030") for x in lines] == ['"id","text"', '"1","' + "é" * 1_500_000 + '"', '"2",""', '"","' + "x" * 1_500_000 + '"']
    records = pa.RecordBatch.from_arrays([pa.array([[x] for x in lines[1:]])], ["lines"])
    back = list(files._parsed(["id", "text"], "gb18030")([records]))
    assert len(back) >= 2 and pa.Table.from_batches(back).to_pydict() == rows.to_pydict()


class _Counting:
    """A tokenizer that tells how many characters it got."""

    def __init__(self, tokenizer):
        self.tokenizer, self.read = tokenizer, 0

    def encode_batch_fast(self, texts, **how):
        self.read += sum(map(len, texts))
        return self.tokenizer.encode_batch_fast(texts, **how)


def test_reaches():
    import public_tokenizers

    t = tokens.tokenizer(public_tokenizers.path("byte_bpe_50k.json"))
    rng = np.random.default_rng(5)
    parts = np.array(["word", "Ünï", "年报", " ", "  ", "\n", " \t ", "'s", "'re", "<|endoftext|>", "!?", "12", "ab cd", "x" * 30])
    for n in (0, 1, 40, 400, 4_000):
        for _ in range(6):
            text = "".join(rng.choice(parts, n)) + " and then some more" * int(rng.integers(0, 60))
            whole = len(t.encode(text, add_special_tokens=False).ids)
            assert "".join(tokens.pieces(text)) == text
            assert sum(tokens._many(t, p) for p in tokens.pieces(text)) == whole
            assert all(tokens.reaches(t, text, most) == (whole >= most) for most in (1, 40, 512, whole, whole + 1))
    counting = _Counting(t)
    assert tokens.reaches(counting, "one more word " * 100_000, 512) and counting.read < 5_000
    counting = _Counting(t)
    assert not tokens.reaches(counting, "few words", 512) and counting.read == 0


def test_best_pairs():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(5_000, 8))
    x[100:140] = x[100]
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    centre = x[:1]
    away = nearest.angles(x, centre)[:, 0]
    order = np.argsort(away)
    x, away, ids = x[order], away[order], rng.permutation(5_000)[order]
    at = np.r_[rng.integers(0, 5_000, 60), np.flatnonzero(away == away[np.searchsorted(ids[np.argsort(ids)], ids[0])])[:1]]
    score = np.round(x[at] @ x.T, nearest.PLACES)
    for reach in (np.inf, np.pi, 0.4):
        row, column, got = nearest.best_pairs(ids, x, away, ids[at], x[at], away[at], np.full(len(at), reach), 7)
        for j in range(len(at)):
            near = [(-s, -d) for s, d in zip(score[j].tolist(), ids.tolist()) if d != ids[at[j]] and (reach > 1 or s >= np.cos(reach))]
            assert [(-s, -d) for s, d in zip(got[row == j].tolist(), ids[column[row == j]].tolist())] == sorted(near)[:7]
