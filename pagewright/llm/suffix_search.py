"""Benchmark decontamination through suffix arrays of the training text.

Documents are cut into shards of bounded bytes, as they are scanned: nothing is shuffled.  Each shard gets a
suffix array over its words (prefix doubling); suffixes whose first word is in no benchmark item cannot
match and are left out.  Every suffix of every benchmark item is binary-searched in every shard: its
insertion point gives its longest verbatim match, and the range that shares its window gives all locations.
Comparisons use prefix hashes, so that one costs the logarithm of the match, whatever an item's length.

The items travel to the executors in blocks of about BLOCK_BYTES of text.  A worker holds all blocks if they are HELD at
most; of a larger benchmark table it holds one at a time, read anew from its local copy for each shard, so its memory is
bounded for any number of items.

Defined results: a null or blank text has no words and no hit; a null or blank item has no window; an item of
fewer words than the window is one window; items with equal words all count; repeated documents are searched
one by one, whatever their ids, null ones too; a null item_id is no item; extra columns are ignored by `search` and kept by
`decontaminate`, whatever their names; a very long text is a shard alone (about 100 bytes of a worker's memory a byte);
empty tables give empty results (documents) or clean documents (items).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import fingerprints as fp

SHARD_BYTES = 3_000_000
BLOCK_BYTES = 8_000_000
HELD = 4
U = fp.U


class _Text:
    """Word numbers (0: no word of any item) with prefix hashes."""

    def __init__(self, ids: np.ndarray):
        self.ids = np.r_[ids, 0, 0]
        n = len(self.ids)
        self.up, self.down = fp.powers(n + 1)
        self.run = np.zeros(n + 1, U)
        np.cumsum(fp.mix(self.ids.astype(U)) * self.up[:n], out=self.run[1:])

    def span(self, at: np.ndarray, length: np.ndarray) -> np.ndarray:
        return (self.run[at + length] - self.run[at]) * self.down[at]


class Items:
    """Benchmark items of a block, made once on the driver."""

    def __init__(self, ids: list, texts: list, window: int):
        raw, off = fp.flat(pa.array(texts, pa.large_string()))
        w = fp.Words(raw, off, fp.ALNUM)
        self.ids = ids
        self.vocab, number = np.unique(w.hash, return_inverse=True)
        number = number.astype(np.int64) + 1
        gap = np.zeros(len(number) + w.rows, np.int64)  # each item ends with a zero
        place = np.arange(len(number)) + w.row
        gap[place] = number
        self.words = gap
        self.at = place  # suffixes
        size = np.diff(w.at)[w.row]
        self.left = w.at[w.row + 1] - np.arange(len(number))  # words from here to the item's end
        self.item = w.row
        self.width = np.minimum(window, size)
        self.longest = int(self.left.max()) if len(self.left) else 0


def _lcp(a: _Text, i: np.ndarray, b: _Text, j: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Length of the common prefix of suffixes i of a and j of b, `most` words at most."""
    low, high = np.zeros(len(i), np.int64), np.minimum(most, np.minimum(len(a.ids) - i, len(b.ids) - j)).astype(np.int64)
    while (low < high).any():
        mid = (low + high + 1) // 2
        same = a.span(i, mid) == b.span(j, mid)
        low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
    return low


def suffix_array(ids: np.ndarray, depth: int) -> np.ndarray:
    """Positions with a word number above 0, sorted by their next `depth` words (prefix doubling)."""
    pos = np.flatnonzero(ids)
    rank = ids.astype(np.int64)
    step, last = 1, int(rank.max(initial=0))
    while step < depth and len(pos):
        ahead = np.zeros(len(pos), np.int64)
        inside = pos + step < len(rank)
        ahead[inside] = rank[pos[inside] + step]
        order, new = np.unique(rank[pos] * (last + 1) + ahead, return_inverse=True)
        rank = np.zeros_like(rank)
        rank[pos] = new + 1
        last, step = len(order), step * 2
        if last == len(pos):
            break
    return pos[np.argsort(rank[pos], kind="stable")]


def _bound(test: _Text, at: np.ndarray, train: _Text, sa: np.ndarray, most: np.ndarray, after: bool) -> np.ndarray:
    """First place in the suffix array that is not below (after: above) the test suffix, over `most` words."""
    low, high = np.zeros(len(at), np.int64), np.full(len(at), len(sa), np.int64)
    while (busy := np.flatnonzero(low < high)).size:
        mid = (low[busy] + high[busy]) // 2
        i, j, m = at[busy], sa[mid], most[busy]
        n = _lcp(test, i, train, j, m)
        whole = n >= m
        x, y = test.ids[np.minimum(i + n, len(test.ids) - 1)], train.ids[np.minimum(j + n, len(train.ids) - 1)]
        right = np.where(whole, after, y < x)  # the place lies behind mid
        low[busy] = np.where(right, mid + 1, low[busy])
        high[busy] = np.where(right, high[busy], mid)
    return low


def _shard(w: fp.Words, items: Items, window: int):
    """Occurrences of windows in a shard: document row, first word, width, item row, longest match from there."""
    none = np.zeros(0, np.int64)
    if not len(items.words) or not len(w.hash):
        return none, none, none, none, none
    slot = np.searchsorted(items.vocab, w.hash)
    slot[slot == len(items.vocab)] = 0
    number = np.where(items.vocab[slot] == w.hash, slot + 1, 0)
    ids = np.zeros(len(number) + w.rows, np.int64)
    place = np.arange(len(number)) + w.row
    ids[place] = number
    train, test = _Text(ids), _Text(items.words)
    sa = suffix_array(ids, items.longest)
    if not len(sa):
        return none, none, none, none, none
    # longest verbatim match of every test suffix: with one of its two neighbours
    near = _bound(test, items.at, train, sa, items.left, False)
    best = np.maximum(_lcp(test, items.at, train, sa[np.minimum(near, len(sa) - 1)], items.left), _lcp(test, items.at, train, sa[np.maximum(near - 1, 0)], items.left))
    hit = np.flatnonzero((best >= items.width) & (items.left >= items.width))
    if not len(hit):
        return none, none, none, none, none
    at, width = items.at[hit], items.width[hit]
    low, high = _bound(test, at, train, sa, width, False), _bound(test, at, train, sa, width, True)
    many = high - low
    t = np.repeat(np.arange(len(hit)), many)
    j = sa[np.repeat(low - np.r_[0, many.cumsum()[:-1]], many) + np.arange(many.sum())]
    length = _lcp(test, at[t], train, j, items.left[hit][t])
    order = np.searchsorted(place, j)
    return w.row[order], order, width[t], items.item[hit][t], length


def _search(blocks, window: int):
    def run(batches):
        for batch in batches:
            for part, raw, off in fp.chunks(batch, "text", SHARD_BYTES):
                w = fp.Words(raw, off, fp.ALNUM)
                change = np.zeros(len(w.hash) + 1, np.int64)
                found: list[dict] = [{} for _ in range(w.rows)]
                longest = np.zeros(w.rows, np.int64)
                for block in blocks:
                    items = block.value
                    row, first, width, item, length = _shard(w, items, window)
                    np.add.at(change, first, 1)
                    np.add.at(change, first + width, -1)
                    np.maximum.at(longest, row, length)
                    for r, i in np.unique(np.stack([row, item], 1), axis=0).tolist():
                        found[r][items.ids[i]] = None
                    del items
                    if len(blocks) > HELD:
                        block.__dict__.pop("_value", None)  # the worker reads it again from its file
                covered = np.r_[0, np.cumsum(np.cumsum(change[:-1]) > 0)]
                hit = covered[w.at[1:]] - covered[w.at[:-1]]
                spans = [[] for _ in range(w.rows)]
                on = np.cumsum(change[:-1]) > 0
                for r in np.flatnonzero(hit):
                    a, b = w.at[r], w.at[r + 1]
                    edge = np.flatnonzero(np.diff(np.r_[0, on[a:b].astype(np.int8), 0]))
                    spans[r] = [{"first": int(x), "end": int(y)} for x, y in edge.reshape(-1, 2)]
                yield pa.RecordBatch.from_arrays(
                    [*part.drop_columns(["text"]).columns, pa.array(np.diff(w.at).astype(np.int64)), pa.array(hit.astype(np.int64)), pa.array(longest), pa.array([sorted(x) for x in found], pa.list_(pa.string())), pa.array(spans, pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())])))],
                    [*[c for c in part.schema.names if c != "text"], "n_words", "n_hit", "longest", "items", "spans"],
                )

    return run


def search(docs: DataFrame, items: DataFrame, window: int = 10, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """Per document: doc_id, n_words, n_hit (words inside a window's occurrence), longest (words of its longest
    verbatim match with an item), items (ids, as sorted strings), spans (hit words, half-open)."""
    spark = docs.sparkSession
    it = items.select(F.col(item_id).cast("string").alias("i"), F.col(item_text).cast("string").alias("t")).where("i is not null and t is not null")
    total = it.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    n = int(total // BLOCK_BYTES) + 1
    blocks = []
    for b in range(n):
        rows = sorted((it if n == 1 else it.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == b)).toLocalIterator())
        blocks.append(spark.sparkContext.broadcast(Items([r.i for r in rows], [r.t for r in rows], window)))
    doc = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    kind = doc.schema["doc_id"].dataType.simpleString()
    return doc.mapInArrow(_search(blocks, window), f"doc_id {kind}, n_words long, n_hit long, longest long, items array<string>, spans array<struct<first:long,end:long>>")


def decontaminate(docs: DataFrame, items: DataFrame, window: int = 10, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents without those that hold any window of an item; all their columns stay.

    Affected rows are found from two columns only and taken out by an anti-join on the id and a digest of the text, so
    that one scan of the texts is all that the search needs and rows that share an id, or have none, are told apart.
    """
    from .shared import small, written

    names = docs.columns
    base = docs.toDF(*(f"c{i}" for i in range(len(names))))
    own, body = F.col(f"c{names.index(doc_id)}"), F.col(f"c{names.index(text)}").cast("string")
    rows = base.select(F.struct(own.alias("id"), F.md5(body).alias("digest")).alias("key"), body.alias("text"))
    hit = search(rows, items, window, "key", "text").where("n_hit > 0")
    hit = written(hit.select(F.col("doc_id.id").alias("hit"), F.col("doc_id.digest").alias("digest")).distinct())
    same = F.col("hit").eqNullSafe(own) & (F.col("digest") == F.md5(body))
    return base.join(small(hit), same, "left_anti").toDF(*names)
