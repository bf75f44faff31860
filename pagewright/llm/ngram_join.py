"""N-gram Jaccard join: an exact similarity self-join of documents' shingle sets, by set-relation skipping.

Sets with equal content are one class.  Every class representative lists the first part of its set under a
global order (rare shingles first) in an inverted index: token -> (size, position, representative).

* Index-level skipping.  Long lists are stored in blocks by set size, so that a probe meets only the blocks
  that can hold a partner, and an entry is skipped when its position in the set leaves too few shingles
  behind it.
* Answer-level skipping.  Highly similar sets are found first, each against the leader of its signature
  groups, and verified.  What a leader's group has already answered (the members' common component) is not
  computed again: the index is probed only for partners outside it, and what is verified there extends it.

A candidate pair then has to pass its signatures: a digest for each of about |set| / 2 ranges of fingerprints.  Ranges
whose digests differ hold a shingle of one set alone, so their number bounds the overlap from above.

The order only affects speed.  Shingles seen twice or more within a task are counted and the most frequent
go last; all others follow by fingerprint.  Candidates are verified on whole texts, so no pair is lost to a
sketch.  Nothing is enumerated within a group: leaders are grouped minima and the rest are equi-joins, whose
long keys adaptive execution splits.

Defined results: null, empty or blank text gives the empty set, which links with nothing; fewer than k words
give one shingle; a row with a null id has its size and no component, and links nothing; repeated rows of one
doc_id with the same text each get their row; ids are whole numbers (others raise a TypeError); extra columns are
ignored, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import fingerprints as fp
from .shared import components, dropped, small, whole_number, written

#: Shingles that are moved to the end of the order; a bound on a broadcast, not on what is joined.
ORDER_ROWS = 60_000
ORDER_LEAST = 24
#: A shingle this frequent has its index list split into blocks by size.
BINS, BANDS = 32, 8


def _column(doc: DataFrame, doc_id: str, text: str) -> DataFrame:
    return doc.select(F.col(doc_id).cast("long").alias("id"), F.col(text).cast("string").alias("text"))


def _sketch(k: int):
    """Per document: set size, set digest, and band signatures of one-permutation minima."""

    def run(batches):
        for batch in batches:
            for part, raw, off in fp.chunks(batch, "text"):
                n, d1, d2, bands, sigs = [], [], [], [], []
                for s in fp.shingle_sets(fp.Words(raw, off), k):
                    n.append(len(s))
                    m = fp.mix(s + fp.U(7))
                    d1.append(int(np.bitwise_xor.reduce(m)) if len(s) else 0)
                    d2.append(int(m.sum(dtype=fp.U)) if len(s) else 0)
                    sigs.append(_signature(s, m))
                    if len(s) < 2:
                        bands.append([])
                        continue
                    at = np.searchsorted(s, _EDGES)
                    low = np.where(at < len(s), s[np.minimum(at, len(s) - 1)], s[0])  # an empty bin borrows from the next
                    low = low.reshape(BANDS, -1)
                    sig = fp.mix(np.arange(BANDS, dtype=fp.U))
                    for c in low.T:
                        sig = fp.mix(sig * fp.U(31) + c)
                    bands.append(sig.view(np.int64))
                lens = np.array([0, *map(len, bands)]).cumsum().astype(np.int32)
                flat = np.concatenate([np.asarray(b, np.int64) for b in bands]) if bands else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(n, pa.int64()), pa.array(np.array(d1, fp.U).view(np.int64)), pa.array(np.array(d2, fp.U).view(np.int64)), pa.ListArray.from_arrays(pa.array(lens), pa.array(flat)), pa.array(sigs, pa.binary())],
                    ["id", "n", "d1", "d2", "bands", "sig"],
                )

    return run


def _signature(s: np.ndarray, mixed: np.ndarray) -> bytes:
    """A byte for each of 2**g equal ranges: exclusive or of one byte of each member's hash."""
    if not len(s):
        return b""
    g = max(3, int(len(s) - 1).bit_length() - 1)
    group = (s >> fp.U(64 - g)).astype(np.int64)
    first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    out = np.zeros(1 << g, np.uint8)
    out[group[first]] = np.bitwise_xor.reduceat((mixed & fp.U(255)).astype(np.uint8), first)
    return out.tobytes()


def _possible(percent: int):
    """Of pairs with sizes and signatures, those whose differing ranges still allow the threshold."""

    def run(batches):
        for batch in batches:
            a, b, na, nb = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            keep = np.zeros(batch.num_rows, bool)
            for i in range(batch.num_rows):
                x, y = (np.frombuffer(batch.column(c)[i].as_buffer(), np.uint8) for c in (4, 5))
                while len(x) > len(y):
                    x = x[::2] ^ x[1::2]
                while len(y) > len(x):
                    y = y[::2] ^ y[1::2]
                keep[i] = (100 + percent) * np.count_nonzero(x != y) <= (100 - percent) * (na[i] + nb[i])
            yield pa.RecordBatch.from_arrays([pa.array(a[keep]), pa.array(b[keep])], ["a", "b"])

    return run


_EDGES = np.arange(BINS, dtype=fp.U) * fp.U((1 << 64) // BINS)


def _frequent(k: int):
    """Shingles that are in two or more sets of a task's chunk, with their count there."""

    def run(batches):
        for batch in batches:
            for _, raw, off in fp.chunks(batch, "text", 2 * fp.CHUNK_BYTES):
                sets = list(fp.shingle_sets(fp.Words(raw, off), k))
                every = np.sort(np.concatenate(sets)) if sets else np.zeros(0, fp.U)
                first = np.flatnonzero(np.r_[True, every[1:] != every[:-1]]) if len(every) else np.zeros(0, int)
                count = np.diff(np.r_[first, len(every)])
                keep = count >= 3
                yield pa.RecordBatch.from_arrays([pa.array(every[first[keep]].view(np.int64)), pa.array(count[keep].astype(np.int64))], ["token", "seen"])

    return run


def _prefixes(k: int, percent: int, common):
    """Index entries of every set: token, the two before it, position, size, and a flag: 1 if the entry serves as the
    shorter side, 2 if its token is known to be frequent."""

    def run(batches):
        tokens, weight = common.value
        for batch in batches:
            for part, raw, off in fp.chunks(batch, "text"):
                ids = part.column(0).to_numpy(zero_copy_only=False)
                out = [[], [], [], [], [], [], []]
                for i, s in zip(ids, fp.shingle_sets(fp.Words(raw, off), k)):
                    n = len(s)
                    if not n:
                        continue
                    probe = n - (percent * n + 99) // 100 + 1
                    index = n - (2 * percent * n + 99 + percent) // (100 + percent) + 1
                    at = np.searchsorted(tokens, s)
                    at[at == len(tokens)] = 0
                    hot = tokens[at] == s if len(tokens) else np.zeros(n, bool)
                    cold = s[~hot]
                    w = np.zeros(probe, np.int64)
                    if len(cold) >= probe:
                        p = cold[:probe]
                    else:
                        order = np.argsort(weight[at[hot]], kind="stable")
                        p = np.concatenate([cold, s[hot][order]])[:probe]
                        w[len(cold) :] = weight[at[hot]][order][: probe - len(cold)]
                    out[0].append(p)
                    out[1].append(np.arange(probe, dtype=np.int32))
                    out[2].append(np.full(probe, n, np.int32))
                    out[3].append(np.full(probe, i, np.int64))
                    out[4].append((np.arange(probe) < index) + 2 * (w > 0))
                    out[5].append(np.r_[fp.U(0), p[:-1]])
                    out[6].append(np.r_[fp.U(0), fp.U(0), p[:-2]][:probe])
                if out[0]:
                    t, p, n, i, f, t1, t2 = map(np.concatenate, out)
                    yield pa.RecordBatch.from_arrays([pa.array(t.view(np.int64)), pa.array(p), pa.array(n), pa.array(i), pa.array(f.astype(np.int8)), pa.array(t1.view(np.int64)), pa.array(t2.view(np.int64))], ["token", "pos", "n", "id", "flag", "t1", "t2"])

    return run


def _verify(k: int, percent: int):
    def run(batches):
        for batch in batches:
            a, b = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
            keep = np.zeros(batch.num_rows, bool)
            last: dict = {}  # rows of one pair side often follow each other
            for i in range(batch.num_rows):
                x = _one(last, "a", a[i], batch, 2, i, k)
                y = _one(last, "b", b[i], batch, 3, i, k)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep[i] = 100 * both >= percent * (len(x) + len(y) - both) > 0
            yield pa.RecordBatch.from_arrays([pa.array(a[keep]), pa.array(b[keep])], ["a", "b"])

    return run


def _one(last, side, key, batch, column, i, k):
    """The set of a row's text; that of the row before, if it is the same text (an id may have several)."""
    text = batch.column(column)[i].as_buffer()
    if side not in last or last[side][0] != key or not last[side][1].equals(text):
        raw, off = fp.flat(batch.column(column).slice(i, 1))
        last[side] = (key, text, next(fp.shingle_sets(fp.Words(raw, off), k)))
    return last[side][2]


def verified(pairs: DataFrame, texts: DataFrame, sigs: DataFrame, k: int, percent: int) -> DataFrame:
    """Pairs (a, b) of ids whose whole texts' sets reach the threshold; sigs: id, n, sig."""
    x = sigs.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("sig").alias("x"))
    y = sigs.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("sig").alias("y"))
    pairs = pairs.join(x, "a").join(y, "b").select("a", "b", "na", "nb", "x", "y")
    pairs = written(pairs.mapInArrow(_possible(percent), "a long, b long"))
    ids = written(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct())
    have = written(texts.join(small(ids), "id", "left_semi"))
    x = have.select(F.col("id").alias("a"), F.col("text").alias("x"))
    y = have.select(F.col("id").alias("b"), F.col("text").alias("y"))
    out = written(pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(_verify(k, percent), "a long, b long"))
    for t in (pairs, ids, have):
        dropped(t)
    return out


def ngram_jaccard_join(docs: DataFrame, k: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: doc_id, n_shingles, class_id (smallest id with an equal set), component_id.

    Two documents link when 100 * |A & B| >= percent * |A | B|; component_id is the smallest id reachable.
    """
    spark = docs.sparkSession
    whole_number(docs, doc_id)
    every = _column(docs, doc_id, text)
    texts = every.where("id is not null")
    doc = written(every.mapInArrow(_sketch(k), "id long, n long, d1 long, d2 long, bands array<long>, sig binary"))
    key = ["n", "d1", "d2"]
    classes = doc.where("n > 0 and id is not null").groupBy(key).agg(F.min("id").alias("rep"))
    member = written(doc.select("id", *key).join(classes, key, "left").select("id", "n", F.when(F.col("id").isNotNull(), F.coalesce("rep", "id")).alias("rep")))
    sigs = doc.select("id", "n", "sig")
    heads = doc.join(member.where("id = rep and n > 0").select("id").distinct(), "id", "left_semi")

    # Answers of highly similar sets first: each set against the smallest member of its signature groups.
    sig = heads.select("id", F.posexplode("bands").alias("band", "sig"))
    lead = sig.groupBy("band", "sig").agg(F.min("id").alias("a"), F.count(F.lit(1)).alias("m")).where("m > 1").select("band", "sig", "a")
    near = verified(sig.join(lead, ["band", "sig"]).where("a <> id").select("a", F.col("id").alias("b")).distinct(), texts, sigs, k, percent)
    known = written(components(near))

    # The rest through the index, skipping whatever is answered.
    seen = texts.mapInArrow(_frequent(k), "token long, seen long").groupBy("token").agg(F.sum("seen").alias("seen")).where(F.col("seen") >= ORDER_LEAST)
    rows = sorted((int(np.array(r.token).view(np.uint64)), r.seen) for r in seen.orderBy(F.desc("seen"), "token").limit(ORDER_ROWS).collect())
    common = spark.sparkContext.broadcast((np.array([t for t, _ in rows], fp.U), np.array([s for _, s in rows], np.int64)))
    entry = texts.mapInArrow(_prefixes(k, percent, common), "token long, pos int, n int, id long, flag byte, t1 long, t2 long")
    entry = entry.join(small(written(member.where("id <> rep").select("id").distinct())), "id", "left_anti").join(small(known), F.col("id") == F.col("node"), "left")
    # Blocks by size, of lists known to be long: a partner's size differs by at most one block.
    step = float(np.log(100 / percent))
    block = F.when(F.col("flag") >= 2, F.floor(F.log(F.col("n").cast("double")) / step).cast("int") + 1).otherwise(0)
    entry = entry.select("token", "t1", "t2", "pos", "n", "id", F.coalesce("component", "id").alias("comp"), (F.col("flag") % 2).cast("int").alias("short"), block.alias("own"))
    entry = entry.select("*", F.explode(F.expr("if(own = 0, array(0), array(own - 1, own))")).alias("block"))
    # both sides are the same rows under other names, so that one exchange serves both; only an entry in its own block
    # may be the shorter side (asked for in terms of both sides, or the filter would part the exchanges)
    cols = ["token", "block", "t1", "t2", "pos", "n", "id", "comp", F.when(F.col("own") == F.col("block"), F.col("short")).otherwise(0).alias("role")]
    a = entry.select(*cols).toDF("token", "block", "a1", "a2", "ap", "an", "a", "ac", "ar")
    b = entry.select(*cols).toDF("token", "block", "b1", "b2", "bp", "bn", "b", "bc", "br")
    # a pair that also shares one of the tokens before was met there; 0 stands for none before
    met = "(a1 <> 0 and (a1 = b1 or a1 = b2)) or (a2 <> 0 and (a2 = b1 or a2 = b2))"
    fits = F.expr(f"ar + br >= br + 1 and ac <> bc and not ({met}) and (an < bn or (an = bn and a < b)) and 100L * an >= {percent}L * bn and {100 + percent}L * least(an - ap, bn - bp) >= {percent}L * (an + bn)")
    found = a.join(b, (a.token == b.token) & (a.block == b.block) & fits).select("a", "b").distinct()
    far = verified(found, texts, sigs, k, percent)
    all_edges = near.union(far)
    comp = components(all_edges)
    out = member.join(comp, F.col("rep") == F.col("node"), "left")
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("rep").alias("class_id"), F.coalesce("component", "rep").alias("component_id"))
