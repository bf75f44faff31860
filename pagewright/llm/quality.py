"""Quality classifier: supervised subword embeddings.

A document is the average of learned vectors of its words, word pairs and character n-grams within words, all
hashed to BUCKETS rows (a word followed by itself is one pair, whichever word it is); a softmax layer turns the average into class probabilities.  Vectors and layer are trained together
by stochastic gradient descent in numpy, on the driver, over at most `per_class` labelled documents of each
class, of at most MAX_BYTES each (the smallest by a hash of the id): that is the bound of the training sample.
Every document is scored over its whole text.

Scoring uses that the average is linear: the layer is folded into the vectors, which leaves one number a row
of the table and the same result.  The folded table (1 MB) is what executors get, whatever the input.

Case is kept: capitals are evidence.  Ids, languages, sources and labels are never features.

Defined results: null, empty and blank texts have no features and get the bias alone; an empty or one-sided
training set gives a model that answers the smoothed class share; null labels and ids are not learned from;
repeated rows are scored one by one; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import fingerprints as fp
from .shared import bounded

BUCKETS = 1 << 18
GRAMS = (3, 4, 5)
DIM = 8
MAX_BYTES = 60_000


def features(raw: np.ndarray, off: np.ndarray) -> _Features:
    """Buckets of all words, and of all n-grams of each distinct word with its borders."""
    w = fp.Words(raw, off, fp.SPACED, fold=False)
    # every distinct word is cut once
    word, first, back = np.unique(w.hash, return_index=True, return_inverse=True)
    start, end = w.start[first], w.end[first]
    size = end - start + 2
    at = np.r_[0, np.cumsum(size)]
    text = np.full(at[-1], 32, np.uint8)  # a space before and after each word
    inner = size - 2
    step = np.arange(inner.sum()) - np.repeat(np.cumsum(inner) - inner, inner)
    text[np.repeat(at[:-1] + 1, inner) + step] = raw[np.repeat(start, inner) + step]
    code = fp._RAW[text]
    owner = np.repeat(np.arange(len(word)), size)
    grams, owners = [], []
    for n in GRAMS:
        if len(text) < n:
            continue
        h = code[: len(text) - n + 1].copy()
        for i in range(1, n):
            h = h * fp.U(0x9E3779B97F4A7C15) + code[i : len(text) - n + 1 + i]
        inside = owner[: len(h)] == owner[n - 1 :]
        grams.append((fp.mix(h[inside] + fp.U(n)) >> fp.U(46)).astype(np.int64))
        owners.append(owner[: len(h)][inside])
    gram, own = (np.concatenate(grams), np.concatenate(owners)) if grams else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    order = np.argsort(own, kind="stable")
    pair = fp.mix(w.hash[:-1] * fp.U(3) + w.hash[1:])
    pair[w.hash[:-1] == w.hash[1:]] = 0
    follows = np.r_[False, w.row[1:] == w.row[:-1]] if len(w.row) else np.zeros(0, bool)
    pairs = np.zeros(len(w.hash), np.int64)
    pairs[1:] = (pair >> fp.U(46)).astype(np.int64)
    return _Features(w, (w.hash >> fp.U(46)).astype(np.int64), pairs, follows, gram[order], np.searchsorted(own[order], np.arange(len(word) + 1)), back)


class _Features:
    """word, pair (where follows: with the word before): a bucket per word; gram[at[k]:at[k + 1]]: of distinct word k."""

    def __init__(self, words, word, pair, follows, gram, at, back):
        self.words, self.word, self.pair, self.follows = words, word, pair, follows
        self.gram, self.at, self.back = gram, at, back

    def score(self, folded: np.ndarray) -> np.ndarray:
        """Mean folded value of each row's features; 0 without any."""
        w = self.words
        sums = np.r_[0.0, np.cumsum(folded[self.gram], dtype=np.float64)]
        each = (sums[self.at[1:]] - sums[self.at[:-1]])[self.back] + folded[self.word] + np.where(self.follows, folded[self.pair], 0)
        count = (self.at[1:] - self.at[:-1])[self.back] + 1 + self.follows
        total = np.bincount(w.row, each, w.rows)
        n = np.bincount(w.row, count, w.rows)
        return total / np.maximum(n, 1)

    def rows(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """Each row's distinct buckets with their share."""
        out = []
        for a, b in zip(self.words.at[:-1], self.words.at[1:]):
            kinds, many = np.unique(self.back[a:b], return_counts=True)
            pairs = self.pair[a:b][self.follows[a:b]]
            parts = [self.word[a:b], pairs, *(self.gram[self.at[k] : self.at[k + 1]] for k in kinds)]
            weight = np.concatenate([np.ones(b - a + len(pairs)), np.repeat(many, self.at[kinds + 1] - self.at[kinds]).astype(float)]) if b > a else np.zeros(0)
            f = np.concatenate(parts)
            u, inv = np.unique(f, return_inverse=True)
            share = np.bincount(inv, weight, len(u))
            out.append((u, (share / max(share.sum(), 1)).astype(np.float32)))
        return out


def train(texts: list[str], labels: np.ndarray, epochs: int = 6, rate: float = 0.5, batch: int = 16, seed: int = 3) -> tuple[np.ndarray, float]:
    """Folded table and bias of the log-odds of label 1."""
    n1, n = int(labels.sum()), len(labels)
    prior = float(np.log((n1 + 1) / (n - n1 + 1)))
    if n1 == 0 or n1 == n:
        return np.zeros(BUCKETS, np.float32), prior
    rng = np.random.default_rng(seed)
    rows: list = []
    for i in range(0, n, 200):
        raw, off = fp.flat(pa.array(texts[i : i + 200], pa.large_string()))
        rows += features(raw, off).rows()
    emb = ((rng.random((BUCKETS, DIM), np.float32) - 0.5) / DIM).astype(np.float32)
    layer = np.zeros((DIM, 2), np.float32)
    layer[:, 0], layer[:, 1] = -(first := rng.standard_normal(DIM).astype(np.float32)), first
    bias = np.array([0.0, prior], np.float32)
    steps, at = epochs * -(-n // batch), 0
    for _ in range(epochs):
        order = rng.permutation(n)
        for i in range(0, n, batch):
            pick = order[i : i + batch]
            lr = rate * (1 - at / steps)
            at += 1
            size = np.array([len(rows[j][0]) for j in pick])
            f, s = np.concatenate([rows[j][0] for j in pick]), np.concatenate([rows[j][1] for j in pick])
            doc = np.repeat(np.arange(len(pick)), size)
            part = emb[f] * s[:, None]
            hidden = np.stack([np.bincount(doc, part[:, k], len(pick)) for k in range(DIM)], 1).astype(np.float32)
            z = hidden @ layer + bias
            z -= z.max(1, keepdims=True)
            p = np.exp(z)
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(pick)), labels[pick]] -= 1
            back = p @ layer.T
            layer -= lr * hidden.T @ p / len(pick)
            bias -= lr * 0.1 * p.mean(0)
            # a row's vectors move by their share of the text, scaled so that frequent and rare ones learn alike
            step = lr * 50 * s[:, None] * back[doc]
            np.subtract.at(emb, f, step)
    return (emb @ (layer[:, 1] - layer[:, 0])).astype(np.float32), float(bias[1] - bias[0])


def _score(model):
    def run(batches):
        folded, bias = model.value
        for batch in batches:
            for part, raw, off in fp.chunks(batch, "text", 1_000_000):
                z = np.clip(features(raw, off).score(folded) + bias, -500, 500)
                yield pa.RecordBatch.from_arrays([*part.drop_columns(["text"]).columns, pa.array(1 / (1 + np.exp(-z)))], [*[c for c in part.schema.names if c != "text"], "score"])

    return run


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = 2_000, doc_id: str = "doc_id", text: str = "text"):
    """The model (folded table, bias) from labelled documents, at most `per_class` of each class."""
    known = labels.select(F.col(doc_id).alias("id"), F.col(label).cast("int").alias("y")).where("id is not null and y in (0, 1)")
    known = known.groupBy("id").agg(F.max("y").alias("y"))
    size = docs.select(F.col(doc_id).alias("id"), F.col(text).cast("string").alias("t")).where(F.octet_length("t") <= MAX_BYTES)
    chosen = None
    both = size.select("id").join(known, "id")
    sizes = {r.y: r["count"] for r in both.groupBy("y").count().collect()}
    for y in (0, 1):
        some = bounded(both.where(F.col("y") == y), ["id"], per_class, sizes.get(y, 0))
        chosen = some if chosen is None else chosen.union(some)
    rows = size.join(F.broadcast(chosen), "id").select("id", "t", "y").toPandas().sort_values("id", kind="stable")
    return train(rows["t"].tolist(), rows["y"].to_numpy(np.int64))


def score(docs: DataFrame, model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and score (probability of label 1) of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    doc = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    return doc.mapInArrow(_score(shared), f"doc_id {doc.schema['doc_id'].dataType.simpleString()}, score double")
