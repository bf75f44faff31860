"""Scoring with a log-bilinear language model, trained with noise-contrastive estimation.

The `vocabulary` most frequent training words (of MIN_COUNT occurrences at least) have vectors of their own, as words to
predict and as context.  A word's probability after two context words is a product: that of an output (one of the SHORT most
frequent words, the end of a text, one of GROUPS groups of further vocabulary words of about equal frequency, or one of
CLASSES classes that share out all other words by their last byte), and within a group that of the word, or within
a class the word's add-one share of the class's training tokens; every class keeps one share for words never seen.
Outputs and words of a group are scored by the product of their vector with the sum of the contexts' vectors, each weighted
per dimension and position, plus a bias, and normalised exactly, by batched matrix products over the distinct contexts.

Training learns from every token of every training text once: ROUNDS rounds take a share of the texts each, by a hash.  Each task follows the gradient over its own texts, from common parameters, against
noise from the counted frequencies (outputs: shared by a minibatch; words: of the same group); the parameters are then
averaged, weighted by tokens; the step sizes (sums of squared gradients) go on with them.

Counts of all words are exact and are gathered from all texts.  The vocabulary is chosen by the exact counts of all training
words, a row for each distinct word of a chunk, added up by word.  For the counts of all other words in scoring, texts are dealt to chunks by a hash of id and text; a chunk's distinct words with their counts are grouped by word, and only those
whose total differs from the chunk's own count go back to the chunk.  So a word costs one row a chunk, no group is
that of a frequent word, no table of all words is held whole anywhere, and what is broadcast is the model.  Its size is
fixed by the parameters `vocabulary` and `dim`; what it learns from, and all counts, grow with the corpus.

Defined results: null and empty texts are the end alone; without training texts all counts are 0 and every
output is equally likely; repeated rows are scored one by one, and learned from as often as they occur; extra columns
are ignored, whatever their names; a null id counts as the text '' in the fold's rule; words of equal frequency go by their
hash; a very long text is worked on whole (about 100 bytes of a worker's memory a byte); an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import Window

from . import fingerprints as fp
from .shared import freed, written

VOCABULARY, DIM = 8_192, 16
SHORT, GROUPS, MIN_COUNT, CLASSES = 64, 96, 20, 16
NOISE, INNER_NOISE, BATCH, ROUNDS, RATE = 24, 4, 4096, 2, 0.2
CHUNK_BYTES = 3_000_000
#: Parameters that are averaged in one row.
BLOCK = 4096
LN10 = float(np.log(10))


def _classes(w: fp.Words, raw: np.ndarray) -> np.ndarray:
    """Class of each word, by its last byte without regard to case."""
    return (fp._FOLD[raw[w.end - 1]] >> fp.U(60)).astype(np.int16) if len(w.end) else np.zeros(0, np.int16)


class Model:
    """words: hashes of the vocabulary, sorted; rank[i]: place of words[i] by frequency; count: occurrences by rank.

    Outputs: the first `short` ranks, `short` (the end), the groups, the classes.  Contexts: the ranks, the classes, the start.
    """

    def __init__(self, words: np.ndarray, rank: np.ndarray, count: np.ndarray, ends: float, rest: np.ndarray, dim: int = DIM):
        v = len(words)
        self.words, self.rank, self.count = words, rank, count
        self.short = min(SHORT, v)
        inner = v - self.short
        groups = min(GROUPS, inner)
        self.edges = self.short + np.arange(groups + 1) * inner // max(groups, 1)  # ranks at which groups begin
        group = np.searchsorted(self.edges, np.arange(self.short, v), "right") - 1
        self.output = np.r_[np.arange(self.short), self.short + 1 + group].astype(np.int64)
        self.first_class = self.short + 1 + groups
        freq = np.bincount(self.output, count + 0.5, self.first_class + CLASSES).astype(float)
        freq[self.short] += ends + 0.5
        freq[self.first_class :] += rest + 0.5
        self.freq = freq / freq.sum()
        self.inner = np.r_[0.0, np.cumsum(count[self.short :] + 0.5)]
        self.share = (count[self.short :] + 0.5) / np.diff(self.inner[self.edges - self.short])[group]  # of a word in its group
        rng = np.random.default_rng(5)
        n = len(freq)
        self.params = [
            (rng.standard_normal((v + CLASSES + 1, dim)) * 0.1).astype(np.float32),
            (rng.standard_normal((n, dim)) * 0.1).astype(np.float32),
            np.log(self.freq).astype(np.float32),
            np.ones((2, dim), np.float32),
            (rng.standard_normal((inner, dim)) * 0.1).astype(np.float32),
            np.log(self.share).astype(np.float32),
        ]
        self.seen = [np.full_like(p, 1e-8) for p in self.params]  # sums of squared gradients

    def known(self, hashes: np.ndarray) -> np.ndarray:
        """Rank of each word, or -1."""
        if not len(self.words):
            return np.full(len(hashes), -1)
        at = np.searchsorted(self.words, hashes)
        at[at == len(self.words)] = 0
        return np.where(self.words[at] == hashes, self.rank[at], -1)

    def outputs(self, w: fp.Words, cls: np.ndarray, rank: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
        """Of all tokens, ends included: output, two context numbers, rank within the groups (-1: none); and each word's place
        among the tokens."""
        v = len(self.words)
        rank = self.known(w.hash) if rank is None else rank
        place = np.arange(len(rank)) + w.row
        token = np.full(len(rank) + w.rows, self.short, np.int64)
        token[place] = np.where(rank >= 0, self.output[rank] if v else 0, cls + self.first_class)
        inner = np.full(len(token), -1, np.int64)
        inner[place] = np.maximum(rank - self.short, -1)
        context = np.full(len(token), v + CLASSES, np.int64)
        context[place] = np.where(rank >= 0, rank, cls + v)
        start = v + CLASSES
        first = w.at[:-1] + np.arange(w.rows)
        one = np.r_[start, context[:-1]] if len(token) else token
        one[first] = start
        two = np.r_[start, one[:-1]] if len(token) else token
        two[first] = start
        return token, one, two, inner, place

    def log10(self, token, one, two, inner) -> np.ndarray:
        """Normalised log10 probability of each output, and of the word within its group, after its contexts."""
        r, q, b, c, q2, b2 = self.params
        kinds, back = np.unique(one * len(r) + two, return_inverse=True)
        h = r[kinds // len(r)] * c[0] + r[kinds % len(r)] * c[1]
        z = np.empty(len(kinds))
        for i in range(0, len(kinds), 4096):
            z[i : i + 4096] = _log_sum(h[i : i + 4096] @ q.T + b)
        score = np.empty(len(token))
        for i in range(0, len(token), 65536):
            t = token[i : i + 65536]
            score[i : i + 65536] = (h[back[i : i + 65536]] * q[t]).sum(1) + b[t]
        score -= z[back]
        within = np.flatnonzero(inner >= 0)
        within = within[np.argsort(token[within], kind="stable")]
        cuts = np.searchsorted(token[within], self.short + 1 + np.arange(len(self.edges)))
        for g in range(len(self.edges) - 1):
            lo, hi = self.edges[g] - self.short, self.edges[g + 1] - self.short
            for i in range(cuts[g], cuts[g + 1], 4096):
                at = within[i : min(i + 4096, cuts[g + 1])]
                s = h[back[at]] @ q2[lo:hi].T + b2[lo:hi]
                score[at] += s[np.arange(len(at)), inner[at] - lo] - _log_sum(s)
        return score / LN10


def _log_sum(s: np.ndarray) -> np.ndarray:
    top = s.max(1)
    return np.log(np.exp(s - top[:, None]).sum(1, dtype=np.float64)) + top


def _descend(model: Model, params: list, seen: list, token, one, two, inner, rng) -> None:
    """Noise-contrastive steps (AdaGrad) over the tokens, in place; of the large tables only the rows that a minibatch has."""
    r, q, b, c, q2, b2 = params
    chance = np.log(NOISE * model.freq).astype(np.float32)
    sums = np.cumsum(model.freq)
    edges = model.edges - model.short
    low, high = model.inner[edges[:-1]], model.inner[edges[1:]]
    share = np.log(INNER_NOISE * model.share).astype(np.float32)
    for i in range(0, len(token), BATCH):
        t, x, y, k = token[i : i + BATCH], one[i : i + BATCH], two[i : i + BATCH], inner[i : i + BATCH]
        m = np.minimum(np.searchsorted(sums, rng.random(NOISE)), len(q) - 1)
        rx, ry = r[x], r[y]
        h = rx * c[0] + ry * c[1]
        qt, qm = q[t], q[m]
        g = -1 / (1 + np.exp(np.clip(np.einsum("nd,nd->n", h, qt) + b[t] - chance[t], -30, 30)))  # true word: sigmoid - 1
        e = 1 / (1 + np.exp(-np.clip(h @ qm.T + (b[m] - chance[m]), -30, 30)))
        dh = g[:, None] * qt + e @ qm
        steps = [(q, seen[1], np.r_[t, m], np.concatenate([g[:, None] * h, e.T @ h])), (b, seen[2], np.r_[t, m], np.r_[g, e.sum(0)])]
        at = np.flatnonzero(k >= 0)
        if len(at):  # the word itself first, then noise of its group
            group = t[at] - model.short - 1
            u = low[group, None] + (high - low)[group, None] * rng.random((len(at), INNER_NOISE))
            noise = np.clip(np.searchsorted(model.inner, u.ravel(), "right") - 1, 0, len(q2) - 1).reshape(u.shape)
            kinds = np.concatenate([k[at, None], noise], 1)
            vectors, ha = q2[kinds], h[at]
            d = 1 / (1 + np.exp(-np.clip(np.einsum("nd,nkd->nk", ha, vectors) + (b2[kinds] - share[kinds]), -30, 30)))
            d[:, 0] -= 1
            dh[at] += np.einsum("nk,nkd->nd", d, vectors)
            flat = kinds.ravel()
            steps += [(q2, seen[4], flat, (d[:, :, None] * ha[:, None, :]).reshape(-1, ha.shape[1])), (b2, seen[5], flat, d.ravel())]
        steps.append((r, seen[0], np.r_[x, y], np.concatenate([dh * c[0], dh * c[1]])))
        steps.append((c, seen[3], np.arange(2), np.stack([np.einsum("nd,nd->d", dh, rx), np.einsum("nd,nd->d", dh, ry)])))
        for p, s, rows, values in steps:
            there, d = _rows(rows, values, len(p))
            d = (d / len(t)).astype(np.float32)
            s_ = s[there] + d * d
            s[there] = s_
            p[there] -= RATE * d / (np.sqrt(s_) + np.float32(1e-6))


def _rows(at: np.ndarray, values: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The places that occur, and the sums of the rows of `values` there."""
    there = np.flatnonzero(np.bincount(at, minlength=n))
    number = np.empty(n, np.int64)
    number[there] = np.arange(len(there))
    at = number[at]
    if values.ndim == 1:
        return there, np.bincount(at, values, len(there))
    d = values.shape[1]
    return there, np.bincount((at[:, None] * d + np.arange(d)).ravel(), values.ravel(), len(there) * d).reshape(-1, d)


def _train(shared, seed: int, salts: int):
    """A task's own parameters after its texts, in blocks, and the tokens that they come from."""

    def run(batches):
        model = shared.value
        params = [p.copy() for p in model.params]
        seen = [x.copy() for x in model.seen]
        part = TaskContext.get().partitionId()
        rng, n = np.random.default_rng((seed, part)), 0
        for batch in batches:
            for _, raw, off in fp.chunks(batch, "text"):
                w = fp.Words(raw, off)
                token, one, two, inner, _ = model.outputs(w, _classes(w, raw))
                _descend(model, params, seen, token, one, two, inner, rng)
                n += len(token)
        if n:
            flat = np.concatenate([p.ravel() for p in params + (seen if seed < ROUNDS - 1 else [])])
            blocks = [flat[i : i + BLOCK].tobytes() for i in range(0, len(flat), BLOCK)]
            k = len(blocks)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(k, dtype=np.int32)), pa.array(np.full(k, part % salts, np.int32)), pa.array(np.full(k, n, np.int64)), pa.array(blocks, pa.binary())], ["i", "salt", "n", "x"])

    return run


def _mean(table: pa.Table) -> pa.Table:
    """A block's mean, weighted by tokens."""
    n = table.column("n").to_numpy()
    total = sum(np.frombuffer(x.as_py(), np.float32).astype(np.float64) * k for x, k in zip(table.column("x"), n))
    return pa.table([table.column("i").slice(0, 1), table.column("salt").slice(0, 1), pa.array([int(n.sum())]), pa.array([(total / n.sum()).astype(np.float32).tobytes()], pa.binary())], names=["i", "salt", "n", "x"])


def _words(batches):
    """Distinct words of each chunk of training texts, with their class and their count there."""
    for batch in batches:
        for _, raw, off in fp.chunks(batch, "text", CHUNK_BYTES):
            w = fp.Words(raw, off)
            word, at, n = np.unique(w.hash, return_index=True, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(_classes(w, raw)[at]), pa.array(n.astype(np.int64))], ["word", "cls", "n"])


def _parsed(model: Model, table: pa.Table) -> list[tuple]:
    """A chunk's texts in parts: rows, words, their classes and ranks."""
    out = []
    for batch in table.combine_chunks().to_batches():
        for part, raw, off in fp.chunks(batch, "text"):
            w = fp.Words(raw, off)
            out.append((part.drop_columns(["text"]), w, _classes(w, raw), model.known(w.hash)))
    return out


def _counted(parts: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct words of a chunk that are not in the vocabulary, their classes, and counts in training texts."""
    found = []
    for part, w, cls, rank in parts:
        train = part.column(part.schema.get_field_index("train")).to_numpy(zero_copy_only=False)
        rare = np.flatnonzero(rank < 0)
        word, at, back = np.unique(w.hash[rare], return_index=True, return_inverse=True)
        found.append((word, cls[rare][at], np.bincount(back, train[w.row[rare]], len(word))))
    if not found:
        return np.zeros(0, fp.U), np.zeros(0, np.int16), np.zeros(0, np.int64)
    word, cls, count = map(np.concatenate, zip(*found))
    word, at, back = np.unique(word, return_index=True, return_inverse=True)
    return word, cls[at], np.bincount(back, count, len(word)).astype(np.int64)


def _dictionary(shared):
    """The rows of `_counted` of a chunk."""

    def run(table: pa.Table) -> pa.Table:
        word, cls, count = _counted(_parsed(shared.value, table))
        chunk = table.column("chunk")[0].as_py()
        return pa.table([pa.array(np.full(len(word), chunk, np.int32)), pa.array(word.view(np.int64)), pa.array(cls.astype(np.int16)), pa.array(count)], schema=_DICTIONARY)

    return run


_DICTIONARY = pa.schema([("chunk", pa.int32()), ("word", pa.int64()), ("cls", pa.int16()), ("n", pa.int64())])


def _scores(shared, total: int, kinds: int, ends: int, inside: np.ndarray, distinct: np.ndarray, kind: pa.DataType):
    """inside, distinct: training tokens and words of each class."""

    def run(docs: pa.Table, totals: pa.Table) -> pa.Table:
        model = shared.value
        given = np.asarray(totals.column("word").combine_chunks()).view(fp.U) if totals.num_rows else np.zeros(0, fp.U)
        many = np.asarray(totals.column("total").combine_chunks()) if totals.num_rows else np.zeros(0, np.int64)
        order = np.argsort(given)
        given, many = given[order], many[order]
        parts = _parsed(model, docs) if docs.num_rows else []
        known, _, count = _counted(parts)
        if len(given):
            at = np.searchsorted(known, given)
            at[at == len(known)] = 0
            same = known[at] == given
            count[at[same]] = many[same]
        out = []
        for part, w, cls, rank in parts:
            token, one, two, inner, place = model.outputs(w, cls, rank)
            rare = np.flatnonzero(rank < 0)
            c = np.zeros(len(rank))
            if len(model.words):
                c = model.count[np.maximum(rank, 0)].astype(np.float64)
            c[rare] = count[np.searchsorted(known, w.hash[rare])]
            doc = np.repeat(np.arange(w.rows), np.diff(w.at) + 1)
            base = np.log10((c + 1) / (total + kinds + 1))
            score = model.log10(token, one, two, inner)
            score[place[rare]] += np.log10((c[rare] + 1) / (inside[cls[rare]] + distinct[cls[rare]] + 1))
            end = np.log10((ends + 1) / (total + kinds + 1))
            out.append(
                pa.table(
                    [
                        part.column(part.schema.get_field_index("doc_id")),
                        pa.array(np.diff(w.at).astype(np.int64) + 1),
                        pa.array(np.bincount(w.row, c > 0, w.rows).astype(np.int64) + (ends > 0)),
                        pa.array(np.bincount(w.row, base, w.rows) + end),
                        pa.array(np.bincount(doc, score, w.rows)),
                    ],
                    names=["doc_id", "n_tokens", "n_known", "base_score", "score"],
                )
            )
        schema = pa.schema([("doc_id", kind), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])
        return pa.concat_tables([t.cast(schema) for t in out]) if out else schema.empty_table()

    return run


def fit(train: DataFrame, n_bytes: int, ends: int, vocabulary: int = VOCABULARY, dim: int = DIM) -> tuple[Model, np.ndarray]:
    """The model of texts (column text), and the training tokens outside of its vocabulary by class."""
    spark = train.sparkSession
    part = F.pmod(F.xxhash64("text"), F.lit(ROUNDS))
    seen = Observation()
    counted = train.mapInArrow(_words, "word long, cls short, n long").groupBy("word").agg(F.sum("n").alias("n"), F.min("cls").alias("cls"))
    counted = counted.observe(seen, *(F.sum(F.when(F.col("cls") == i, F.col("n")).otherwise(0)).alias(f"c{i}") for i in range(CLASSES)))
    top = counted.where(F.col("n") >= MIN_COUNT).orderBy(F.desc("n"), "word").limit(vocabulary).collect()  # a row a word of the vocabulary
    got = seen.get
    del counted
    freed(spark)
    words = np.array([r.word for r in top], np.int64).view(fp.U)
    count = np.array([r.n for r in top], np.int64)
    rest = np.array([got.get(f"c{i}") or 0 for i in range(CLASSES)], np.int64)
    np.subtract.at(rest, np.array([r.cls for r in top], np.int64), count)
    order = np.argsort(words)
    model = Model(words[order], order, count, ends, rest, dim)
    salts = max(1, int(np.sqrt(n_bytes / 32_000_000)))  # so that no mean is taken over many tasks at once
    kind = "i int, salt int, n long, x binary"
    for i in range(ROUNDS):
        own = train.where(part == i).mapInArrow(_train(spark.sparkContext.broadcast(model), i, salts), kind)
        some = own.groupBy("i", "salt").applyInArrow(_mean, kind)
        rows = (some.groupBy("i").applyInArrow(_mean, kind) if salts > 1 else some).select("i", "x").collect()
        if not rows:
            continue
        flat, at, new = np.concatenate([np.frombuffer(r.x, np.float32) for r in sorted(rows)]), 0, []
        for p in model.params + (model.seen if i < ROUNDS - 1 else []):
            new.append(flat[at : at + p.size].reshape(p.shape).copy())
            at += p.size
        model.params, model.seen = new[: len(model.params)], new[len(model.params) :] or model.seen
    return model, rest


def score(docs: DataFrame, train, doc_id: str = "doc_id", text: str = "text", vocabulary: int = VOCABULARY, dim: int = DIM) -> DataFrame:
    """Per document: doc_id, n_tokens, n_known, base_score, score, train_tokens.

    train: a column, true for texts to learn from.
    """
    spark = docs.sparkSession
    doc = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"), F.coalesce(train, F.lit(False)).alias("train"))
    n_bytes, ends = doc.agg(F.sum(F.octet_length("text")), F.count_if("train")).first()
    model, inside = fit(doc.where("train").select("text"), n_bytes or 0, ends, vocabulary, dim)
    shared = spark.sparkContext.broadcast(model)

    # exact counts of all other words: a row for each distinct one of a chunk, summed by word
    chunks = int((n_bytes or 0) // CHUNK_BYTES) + 1
    dealt = doc.withColumn("chunk", F.pmod(F.xxhash64(F.col("doc_id").cast("string"), "text"), F.lit(chunks)).cast("int"))
    local = dealt.groupBy("chunk").applyInArrow(_dictionary(shared), "chunk int, word long, cls short, n long")
    of_word = Window.partitionBy("word")
    summed = local.withColumn("total", F.sum("n").over(of_word)).withColumn("first", F.min("chunk").over(of_word) == F.col("chunk"))
    seen = Observation()
    once = F.col("first") & (F.col("total") > 0)
    summed = summed.observe(seen, *(F.sum(F.when(once & (F.col("cls") == i), 1).otherwise(0)).alias(f"v{i}") for i in range(CLASSES)))
    totals = written(summed.where("total <> n").select("chunk", "word", "total"))
    got = seen.get
    freed(spark)
    distinct = np.array([got.get(f"v{i}") or 0 for i in range(CLASSES)], np.int64)
    total = int(inside.sum() + model.count.sum()) + ends
    kinds = int(distinct.sum() + (model.count > 0).sum()) + (ends > 0)

    kind = doc.schema["doc_id"].dataType
    from pyspark.sql.pandas.types import to_arrow_type

    fn = _scores(shared, total, kinds, ends, inside, distinct, to_arrow_type(kind))
    out = dealt.groupBy("chunk").cogroup(totals.groupBy("chunk")).applyInArrow(fn, f"doc_id {kind.simpleString()}, n_tokens long, n_known long, base_score double, score double")
    return out.withColumn("train_tokens", F.lit(total).cast("long"))
