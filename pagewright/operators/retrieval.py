"""Retrieval: BM25 over an inverted index, and rank fusion (vectors: `nearest`).

The index is made once from one reading of the corpus, as a table that can be kept: a row a shard of documents, with the terms
of each document, and for each term its documents in blocks of falling impact (what the term adds to a score before the
query's weight), each block with its largest impact.  Queries go to all tasks in blocks of bounded bytes.  A shard scores a
query block by block, those that may add most first, until what is left can bring no other document into the best k; the
few documents that may be among these are then scored exactly.  So the result is that of scoring every document.  What leaves a
task is its own top k of each query.  Terms are hashes of windows or words over flat arrays of characters, without a loop over tokens.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions.batches import slices
from ..storage import bounded_batches, dropped, write_wide, written

K1, B = 1.5, 0.75  # fixed values
#: Characters of a shard, documents of a block of postings, bytes of a block of queries.
SHARD, BLOCK, QUERY_BYTES = 1_000_000, 64, 16_000_000
#: Scores are compared to so many places, so that the order of additions decides nothing, and shown to so many.
PLACES, SHOWN = 10, 6
_WORD = re.compile(r"[^\W]+")
_MULT = np.uint64(0x9E3779B97F4A7C15)
#: Of each code point whether it belongs to words (0, 1), or that this was not asked yet (2).
_KINDS = np.full(0x110000, 2, np.uint8)


def _letters(code: np.ndarray) -> np.ndarray:
    """Which characters belong to words."""
    kinds = _KINDS[code]
    if (kinds == 2).any():
        new = np.unique(code[kinds == 2])
        _KINDS[new] = [not 0xD800 <= c < 0xE000 and bool(_WORD.match(chr(c))) for c in new.tolist()]
        kinds = _KINDS[code]
    return kinds == 1


def _distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values in order, and the place of each value among them: `np.unique` without sorting all values."""
    found = pa.array(values).dictionary_encode()
    kinds = np.asarray(found.dictionary)
    order = np.argsort(kinds)
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return kinds[order], place[np.asarray(found.indices)]


def _flat(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts (null: empty), and the row of each."""
    code = np.frombuffer("".join(t or "" for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    return code, np.repeat(np.arange(len(texts)), [len(t or "") for t in texts])


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (h ^ (h >> np.uint64(32))).view(np.int64)


def bigrams(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """Windows of two characters over letters and digits: hash, row."""
    code, row = _flat(texts)
    keep = _letters(code)
    code, row = code[keep].astype(np.uint64), row[keep]
    both = row[1:] == row[:-1] if len(row) else np.zeros(0, bool)
    return _mix((code[:-1] << np.uint64(32) | code[1:])[both] * _MULT), row[1:][both]


def words(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """Runs of letters and digits in lower case: hash, row."""
    code, row = _flat([(t or "").lower() for t in texts])
    inside = _letters(code)
    edge = np.r_[True, row[1:] != row[:-1]] if len(row) else np.zeros(0, bool)
    first = np.flatnonzero(inside & (edge | ~np.r_[False, inside[:-1]]))
    if not len(first):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    # a word's place weighs its characters; sums between starts of words leave out what is no letter
    place = np.arange(len(code)) - np.repeat(np.r_[0, first], np.diff(np.r_[0, first, len(code)]))
    each = np.where(inside, _mix((code.astype(np.uint64) << np.uint64(24) | place.astype(np.uint64)) * _MULT).view(np.uint64), np.uint64(0))
    return _mix(np.add.reduceat(each, first) * _MULT), row[first]


TERMS = {"bigram": bigrams, "word": words}


_FORWARD = "docs array<long>, sizes array<int>, first array<int>, terms array<long>, term array<int>, times array<int>"
_INVERTED = "docs array<long>, first array<int>, terms array<long>, term array<int>, impact array<double>, blocks array<int>, rows array<int>, most array<double>"


def _row(values: dict) -> pa.RecordBatch:
    """One row of lists."""
    columns = [pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), pa.array(v)) for v in values.values()]
    return pa.RecordBatch.from_arrays(columns, list(values))


def _cell(batch: pa.RecordBatch, name: str, row: int) -> np.ndarray:
    return np.asarray(batch.column(batch.schema.get_field_index(name))[row].values)


def _forward(terms: str):
    """Shards: documents, their sizes, and for each its distinct terms and how often it has them."""

    def row(docs: list, texts: list):
        h, of = TERMS[terms](texts)
        kinds, term = _distinct(h)
        both, times = np.unique(of * max(len(kinds), 1) + term, return_counts=True)
        doc, term = np.divmod(both, max(len(kinds), 1))
        size = np.bincount(of, minlength=len(texts))
        return _row({
            "docs": np.array(docs, np.int64), "sizes": size.astype(np.int32), "first": np.searchsorted(doc, np.arange(len(texts) + 1)).astype(np.int32),
            "terms": kinds, "term": term.astype(np.int32), "times": times.astype(np.int32),
        })

    def run(batches):
        docs, held, size = [], [], 0
        for batch in batches:
            for a, b in slices(batch.column(1)):
                for d, t in zip(*(c.slice(a, b - a).to_pylist() for c in batch.columns[:2])):
                    docs.append(d)
                    held.append(t)
                    size += len(t or "")
                    if size >= SHARD:
                        yield row(docs, held)
                        docs, held, size = [], [], 0
        if docs:
            yield row(docs, held)

    return run


def _inverted(average: float):
    """Adds to the shards the impacts, and each term's documents in blocks of falling impact."""

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                docs, size, first, kinds, term, f = (_cell(batch, n, i) for n in ("docs", "sizes", "first", "terms", "term", "times"))
                doc = np.repeat(np.arange(len(docs), dtype=np.int32), np.diff(first))
                impact = f * (K1 + 1) / (f + K1 * (1 - B + B * size[doc] / average))
                order = np.lexsort((doc, -impact, term))
                start = np.searchsorted(term[order], np.arange(len(kinds) + 1))
                blocks = -(-np.diff(start) // BLOCK)  # of each term
                head = np.repeat(start[:-1] - BLOCK * np.r_[0, np.cumsum(blocks)[:-1]], blocks) + BLOCK * np.arange(blocks.sum()) if len(kinds) else np.zeros(0, np.int64)
                # rows: the postings in that order; a block is told by its first posting, of the term that starts there or before
                yield _row({
                    "docs": docs, "first": first, "terms": kinds, "term": term, "impact": impact, "blocks": np.r_[head, len(order)].astype(np.int32),
                    "rows": order.astype(np.int32), "most": impact[order][head],
                })

    return run


def _vocabulary(batches):
    """Of each shard's terms the number of documents; under null the documents and terms of the shard."""
    for batch in batches:
        for i in range(batch.num_rows):
            kinds, term, size = (_cell(batch, n, i) for n in ("terms", "term", "sizes"))
            n = np.bincount(term, minlength=len(kinds))
            columns = [pa.array([*kinds.tolist(), None], pa.int64()), pa.array(np.r_[n, len(size)]), pa.array(np.r_[np.zeros(len(n), np.int64), int(size.sum())])]
            yield pa.RecordBatch.from_arrays(columns, ["term", "n", "total"])


class Index:
    """An inverted index: shards (a row each), term statistics, number of documents."""

    def __init__(self, shards: DataFrame, terms: DataFrame, kind: str, size: int):
        self.shards, self.terms, self.kind, self.size = shards, terms, kind, size


def index(docs: DataFrame, terms: str = "bigram", path: str | None = None) -> Index:
    """The index of docs (doc_id, text), at a path (two tables; `open_index` reads it again) or in the shared folder.  Null texts
    are empty; rows without an id are left out."""
    bounded_batches(docs.sparkSession)  # a shard has megabytes
    corpus = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).where("doc_id is not null")
    forward = written(corpus.mapInArrow(_forward(terms), _FORWARD), wide=True)
    counted = forward.select("terms", "term", "sizes").mapInArrow(_vocabulary, "term long, n long, total long").groupBy("term").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    counted = written(counted)
    every = counted.where("term is null").first()
    size, total = (every.n, every.total) if every else (0, 0)
    shards = forward.mapInArrow(_inverted(max(total / max(size, 1), 1e-9)), _INVERTED)
    if path is None:
        shards = written(shards, wide=True)
        dropped(forward)
        return Index(shards, counted, terms, size)
    write_wide(shards, f"{path}/shards")
    dropped(forward)
    counted.write.parquet(f"{path}/terms")
    return open_index(docs.sparkSession, path, terms)


def open_index(spark, path: str, terms: str = "bigram") -> Index:
    counted = spark.read.parquet(f"{path}/terms")
    every = counted.where("term is null").first()
    return Index(spark.read.parquet(f"{path}/shards"), counted, terms, every.n if every else 0)


def _query_terms(terms: str):
    def run(batches):
        for batch in batches:
            h, row = TERMS[terms](batch.column(1).to_pylist())
            if len(h):
                order = np.lexsort((h, row))
                h, row = h[order], row[order]
                new = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (row[1:] != row[:-1])])
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row[new])), pa.array(h[new]), pa.array(np.diff(np.r_[new, len(h)]))], ["query_id", "term", "times"])

    return run


class Shard:
    """A shard of the index, for searching."""

    def __init__(self, batch: pa.RecordBatch, row: int):
        self.docs, self.first, self.terms, self.term, self.impact, self.blocks, self.rows, self.most = (_cell(batch, n, row) for n in ("docs", "first", "terms", "term", "impact", "blocks", "rows", "most"))
        self.doc = np.repeat(np.arange(len(self.docs)), np.diff(self.first))[self.rows]  # as the postings lie
        self.adds = self.impact[self.rows]
        self.of = self.term[self.rows[self.blocks[:-1]]] if len(self.rows) else np.zeros(0, np.int32)  # term of each block
        self.at = np.searchsorted(self.of, np.arange(len(self.terms) + 1))  # first block of each term
        self.weight = np.zeros(len(self.terms))  # of the query that is searched; else 0
        self.read = 0  # postings that were looked at

    def best(self, terms: np.ndarray, weight: np.ndarray, k: int, least: float) -> tuple[np.ndarray, np.ndarray]:
        """Documents (by place) that may be among the k best, with exact scores.  terms: sorted; least: a score that the k-th
        best reaches elsewhere."""
        at = np.searchsorted(self.terms, terms)
        here = np.flatnonzero(self.terms[np.minimum(at, len(self.terms) - 1)] == terms) if len(self.terms) else np.zeros(0, np.int64)
        of, w = at[here], self.weight
        w[of] = weight[here]
        a = self.at[of]
        n = self.at[of + 1] - a
        block = np.repeat(a - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum()) if len(of) else np.zeros(0, np.int64)
        bound = w[self.of[block]] * self.most[block]
        order = np.argsort(-bound, kind="stable")
        block, bound = block[order], bound[order]
        score = np.zeros(len(self.docs))
        done, some = 0, max(16, len(block) // 8)
        left = int((self.blocks[block + 1] - self.blocks[block]).sum())  # postings not read yet
        while True:
            now = block[done : done + some]
            size = self.blocks[now + 1] - self.blocks[now]
            place = np.repeat(self.blocks[now] - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(size.sum()) if len(now) else np.zeros(0, np.int64)
            self.read += len(place)
            left -= len(place)
            score += np.bincount(self.doc[place], np.repeat(w[self.of[now]], size) * self.adds[place], len(score))
            done += len(now)
            # what a document may still get: of each term the largest block that is left
            _, first = np.unique(self.of[block[done:]], return_index=True)
            rest = bound[done:][first].sum()
            kth = max(least, np.partition(score, -k)[-k]) if len(score) >= k else least
            may = np.flatnonzero(score + rest >= kth - 1e-9)
            size = self.first[may + 1] - self.first[may]
            if done == len(block) or len(may) <= 4 * k or size.sum() <= left:  # or to score these is less work than to read on
                break
            some *= 2
        if done == len(block) and len(may) > 4 * k:
            # all is known but for rounding: of many equals the larger ids
            near = np.round(score[may], PLACES)
            may = may[np.lexsort((-self.docs[may], -near))[: 4 * k]]
            size = self.first[may + 1] - self.first[may]
        place = np.repeat(self.first[may] - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(size.sum())
        exact = np.round(np.bincount(np.repeat(np.arange(len(may)), size), w[self.term[place]] * self.impact[place], len(may)), PLACES)
        w[of] = 0
        if len(may) > k:
            first = np.lexsort((-self.docs[may], -exact))[:k]
            may, exact = may[first], exact[first]
        return may, exact


def _search(shared, k: int):
    def run(batches):
        ids, start, terms, weight = shared.value
        best: list[list[tuple]] = [[] for _ in ids]
        for batch in batches:
            for row in range(batch.num_rows):
                shard = Shard(batch, row)
                for j in range(len(ids)):
                    own = best[j]
                    may, score = shard.best(terms[start[j] : start[j + 1]], weight[start[j] : start[j + 1]], k, own[-1][0] if len(own) == k else -np.inf)
                    best[j] = sorted([*own, *zip(score.tolist(), shard.docs[may].tolist())], reverse=True)[:k]
        rows = [(ids[j], d, s) for j, own in enumerate(best) for s, d in own]
        if rows:
            q, d, s = zip(*rows)
            yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(d, pa.int64()), pa.array(s, pa.float64())], ["query_id", "doc_id", "score"])

    return run


def ranked(found: DataFrame, k: int) -> DataFrame:
    """The best k of each query, by score, then by the larger id; scores to SHOWN places."""
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("doc_id"))
    found = found.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k)
    return found.withColumn("score", F.round("score", SHOWN))


def search(queries: DataFrame, index: Index, k: int) -> DataFrame:
    """query_id, doc_id, score, rank (from 1): the best k documents; of equal scores the larger id first.

    queries: query_id, text (of rows that share an id the terms add up).  A term counts as often as the query has it;
    documents without any of a query's terms score 0 and may fill its k.
    """
    spark = index.shards.sparkSession
    bounded_batches(spark)
    asked = queries.select(F.col("query_id").cast("long").alias("query_id"), F.col("text").cast("string").alias("text")).where("query_id is not null")
    has = asked.mapInArrow(_query_terms(index.kind), "query_id long, term long, times long").groupBy("query_id", "term").agg(F.sum("times").alias("times"))
    idf = F.log(1 + (F.lit(index.size) - F.col("n") + 0.5) / (F.col("n") + 0.5))
    has = has.join(index.terms.where("term is not null").select("term", "n"), "term").select("query_id", "term", (F.col("times") * idf).alias("weight"))
    # a row a query: its terms and weights (none, if it has none that the corpus has)
    lists = has.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("term", "weight"))).alias("x"))
    lists = written(asked.select("query_id").distinct().join(lists, "query_id", "left").select("query_id", F.coalesce(F.col("x.term"), F.array()).alias("terms"), F.coalesce(F.col("x.weight"), F.array()).alias("weights")))
    blocks = max(1, -(-(lists.agg(F.sum(16 * F.size("terms") + 32)).first()[0] or 0) // QUERY_BYTES))
    out = None
    for b in range(blocks):
        rows = lists.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b).toArrow()  # QUERY_BYTES about
        start = np.r_[0, np.cumsum(np.asarray(rows.column("terms").combine_chunks().value_lengths()).astype(np.int64))]
        flat = [np.asarray(rows.column(c).combine_chunks().flatten()) for c in ("terms", "weights")]
        shared = spark.sparkContext.broadcast((rows.column("query_id").to_pylist(), start, flat[0].astype(np.int64), flat[1].astype(float)))
        found = index.shards.mapInArrow(_search(shared, k), "query_id long, doc_id long, score double")
        out = found if out is None else out.union(found)
    return ranked(out, k)


def bm25(queries: DataFrame, docs: DataFrame, k: int, terms: str = "bigram") -> DataFrame:
    """`search` in an index made for it; docs: doc_id, text."""
    return search(queries, index(docs, terms), k)


def fused(rankings: list[DataFrame], k: int, c: int = 60) -> DataFrame:
    """Reciprocal rank fusion of rankings (query_id, doc_id, rank): query_id, doc_id, score, rank.

    Equal scores keep the order of the first ranking that has them.
    """
    tagged = [r.select("query_id", "doc_id", F.col("rank").cast("long").alias("r"), F.lit(i).alias("by")) for i, r in enumerate(rankings)]
    every = tagged[0]
    for t in tagged[1:]:
        every = every.unionByName(t)
    s = every.groupBy("query_id", "doc_id").agg(F.round(F.sum(F.lit(1.0) / (c + F.col("r"))), 9).alias("score"), F.min(F.struct("by", "r")).alias("first"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "first")
    return s.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k).drop("first")
