"""Line dedup by pairwise alignment.

A document is its sequence of lines that are not blank, each the hash of its words.  A run is the shortest stretch of
consecutive lines, from some line on or up to some line, that has `min_words` words; a line that long is a run alone.
Two documents overlap where they share a run.

* Documents with equal texts are one, its first; every other copy goes as a whole (its alignment is trivial).
* A run that RARE documents or fewer hold is rare.  All pairs of its holders (a bounded number) are aligned with patience
  diff: lines that are unique on both sides anchor the alignment, in their longest increasing order, and what lies between
  anchors is aligned in the same way.  Moved or repeated blocks, which no alignment in order can hold, follow by
  their runs.  Aligned blocks of `min_words` words or more leave the later document.
* A run that more documents hold gives no pairs, as they would grow with the square of its holders: each holder but the
  earliest loses the run itself.

So a line goes if and only if an earlier document has, too, a block of `min_words` words or more around it: whatever two
documents share is a row of runs, each of which is rare, and aligned, or frequent, and looked up.

Defined results: "earlier" goes by id; null and empty texts stay as they are; lines are compared by their words; a blank
line goes with the lines next to it, if both go; documents with the same id are not aligned with each other, and rows that
share an id lose lines of their own text only; a null id takes no part; ids of any type with an order will do; a text
whose lines all go becomes empty; ties on runs go to the smallest id; extra columns stay, whatever their names (one
called `lines_deleted` is replaced); an empty table gives an empty one; a very long text is one row of line
hashes (12 bytes a line), and takes about 40 bytes of a worker's memory a byte of text.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import fingerprints as fp
from .shared import written

#: Holders of a run of which all pairs are aligned.
RARE = 4
#: Pairs that a worker lays out at once.
PAIRS = 500


def _lines(batches):
    """Per document: the hash (0: blank) and the words of each line."""
    for batch in batches:
        for part, raw, off in fp.chunks(batch, "text"):
            w = fp.Words(raw, off, fp.SPACED, fold=False)
            ends = np.flatnonzero(raw == 10)
            # the line of a word: newlines before it, counted from the row's first byte
            before = np.searchsorted(ends, off)
            line = np.searchsorted(ends, w.start) - before[w.row]
            first = np.flatnonzero(np.r_[True, (np.diff(w.row) != 0) | (np.diff(line) != 0)]) if len(line) else np.zeros(0, int)
            many = np.diff(np.r_[first, len(line)])
            place = np.arange(len(line)) - np.repeat(first, many)
            up, _ = fp.powers(int(many.max(initial=0)) + 1)
            sums = np.add.reduceat(w.hash * up[place], first) if len(first) else np.zeros(0, fp.U)
            code = fp.mix(sums + many.astype(fp.U)) | fp.U(1)  # never 0
            start = np.r_[0, np.cumsum(np.diff(before) + 1)]
            at = start[w.row[first]] + line[first]
            h, k = np.zeros(start[-1], fp.U), np.zeros(start[-1], np.int32)
            h[at], k[at] = code, many
            lens = pa.array(start.astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.ListArray.from_arrays(lens, pa.array(h.view(np.int64))), pa.ListArray.from_arrays(lens, pa.array(k))],
                ["id", "digest", "lines", "words"],
            )


class _Sequences:
    """The lines that are not blank of a list column's rows, as flat arrays: hash, words, row, and number in the text."""

    def __init__(self, lines: pa.Array, words: pa.Array | None = None):
        size = np.asarray(lines.value_lengths(), np.int64)
        code = np.asarray(lines.flatten()).view(fp.U)
        row = np.repeat(np.arange(len(size)), size)
        number = np.arange(len(code)) - np.repeat(np.cumsum(size) - size, size)
        keep = code != 0
        self.code, self.row, self.number = code[keep], row[keep], number[keep]
        self.words = None if words is None else np.asarray(words.flatten(), np.int64)[keep]
        self.at = np.searchsorted(self.row, np.arange(len(size) + 1))

    def runs(self, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hash, first and last place (in the flat arrays) of all shortest runs of `least` words."""
        n = len(self.code)
        total = np.r_[0, np.cumsum(self.words)]
        found = []
        h = fp.mix(self.code + fp.U(1))
        for size in range(1, least + 1):
            m = n - size + 1
            if m <= 0:
                break
            if size > 1:
                h = fp.mix(h[:m] * fp.U(0x9E3779B97F4A7C15) + self.code[size - 1 :])
            i = np.arange(m)
            j = i + size - 1
            enough = (self.row[i] == self.row[j]) & (total[j + 1] - total[i] >= least)
            short = (total[j] - total[i] < least) | (total[j + 1] - total[i + 1] < least)
            pick = np.flatnonzero(enough & short)
            found.append((h[pick], i[pick], j[pick]))
        if not found:
            return np.zeros(0, fp.U), np.zeros(0, np.int64), np.zeros(0, np.int64)
        return tuple(map(np.concatenate, zip(*found)))


def _runs(least: int):
    """Every run of every document: hash, first and last line of it in the text, and whether the document has it for the
    first time."""

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 1_000):
                part = batch.slice(start, 1_000)
                s = _Sequences(part.column(2), part.column(3))
                key, i, j = s.runs(least)
                row = s.row[i]
                order = np.lexsort((i, key, row))
                key, i, j, row = key[order], i[order], j[order], row[order]
                new = np.r_[True, (key[1:] != key[:-1]) | (row[1:] != row[:-1])] if len(key) else np.zeros(0, bool)
                of = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(of), part.column(1).take(of), pa.array(key.view(np.int64)), pa.array(s.number[i].astype(np.int32)), pa.array(s.number[j].astype(np.int32)), pa.array(new)],
                    ["id", "digest", "run", "lo", "hi", "new"],
                )

    return run


def _increasing(anchors: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest run of anchors (sorted by their first place) whose second places increase, too."""
    tops: list[int] = []
    at: list[int] = []
    back: list[int] = []
    for n, (_, j) in enumerate(anchors):
        k = bisect_left(tops, j)
        if k == len(tops):
            tops.append(j)
            at.append(n)
        else:
            tops[k], at[k] = j, n
        back.append(at[k - 1] if k else -1)
    chain, n = [], at[-1] if at else -1
    while n >= 0:
        chain.append(anchors[n])
        n = back[n]
    return chain[::-1]


def patience_blocks(a: list[int], b: list[int]) -> list[tuple[int, int, int]]:
    """Common blocks (start in a, start in b, length) of two sequences by patience diff, in order, as long as they go."""
    same: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        alo, ahi, blo, bhi = todo.pop()
        while alo < ahi and blo < bhi and a[alo] == b[blo]:
            same.append((alo, blo))
            alo, blo = alo + 1, blo + 1
        while alo < ahi and blo < bhi and a[ahi - 1] == b[bhi - 1]:
            ahi, bhi = ahi - 1, bhi - 1
            same.append((ahi, bhi))
        if alo == ahi or blo == bhi:
            continue
        where: dict[int, int] = {}
        for j in range(blo, bhi):
            where[b[j]] = -1 if b[j] in where else j
        seen: dict[int, int] = {}
        for i in range(alo, ahi):
            seen[a[i]] = -1 if a[i] in seen else i
        anchors = [(i, where[x]) for x, i in seen.items() if i >= 0 and where.get(x, -1) >= 0]
        chain = _increasing(sorted(anchors))
        for (i, j), (k, m) in zip([(alo - 1, blo - 1), *chain], [*chain, (ahi, bhi)]):
            if chain and i + 1 < k and j + 1 < m:
                todo.append((i + 1, k, j + 1, m))
        same += chain
    blocks: list[list[int]] = []
    for i, j in sorted(same):
        if blocks and i == blocks[-1][0] + blocks[-1][2] and j == blocks[-1][1] + blocks[-1][2]:
            blocks[-1][2] += 1
        else:
            blocks.append([i, j, 1])
    return [tuple(x) for x in blocks]


def _align(least: int):
    """Per pair of documents: the stretches of lines (first and last number in the text) that leave the later one."""

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, PAIRS):
                part = batch.slice(start, PAIRS)
                x, y = _Sequences(part.column(1), part.column(2)), _Sequences(part.column(3), part.column(4))
                gone = np.zeros(len(x.code) + 1, np.int64)
                for r in range(part.num_rows):
                    p, q = x.at[r], x.at[r + 1]
                    words = np.r_[0, np.cumsum(x.words[p:q])]
                    for i, _, n in patience_blocks(x.code[p:q].tolist(), y.code[y.at[r] : y.at[r + 1]].tolist()):
                        if words[i + n] - words[i] >= least:
                            gone[p + i] += 1
                            gone[p + i + n] -= 1
                # moved or repeated blocks: runs that both of a pair have
                one, i, j = x.runs(least)
                two, k, _ = y.runs(least)
                with_row = lambda h, row: fp.mix(h + row.astype(fp.U) * fp.U(0xD6E8FEB86659FD93))
                both = np.flatnonzero(np.isin(with_row(one, x.row[i]), with_row(two, y.row[k])))
                np.add.at(gone, i[both], 1)
                np.add.at(gone, j[both] + 1, -1)
                off = np.flatnonzero(np.cumsum(gone[:-1]) > 0)
                lists = np.searchsorted(x.row[off], np.arange(part.num_rows + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(lists), pa.array(x.number[off].astype(np.int32)))], ["digest", "gone"])

    return run


def _kept(batches):
    """Per text: which of its lines stay, from the numbers of those that go."""
    for batch in batches:
        out = []
        for lines, lists in zip(batch.column(1), batch.column(2)):
            code = lines.values.to_numpy(zero_copy_only=False)
            stays = code != 0
            for x in lists.values or ():
                if len(x):
                    stays[x.values.to_numpy(zero_copy_only=False)] = False
            # a blank line stays with a line that stays before or behind it
            solid = np.flatnonzero(code != 0)
            blank = np.flatnonzero(code == 0)
            behind = np.searchsorted(solid, blank)
            last = len(solid) - 1
            stays[blank] = (behind > 0) & stays[solid[np.maximum(behind - 1, 0)]] | (behind <= last) & stays[solid[np.minimum(behind, last)]]
            out.append(pa.array(stays))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.to_pylist() for x in out], pa.list_(pa.bool_()))], ["digest", "kept"])


def overlaps(lines: DataFrame, min_words: int, kind: str) -> tuple[DataFrame, DataFrame]:
    """Pairs of documents (later, earlier: digests) that share a rare run, and per holder of a frequent run that is not
    its earliest: digest, gone (the numbers of the run's lines).  lines: id, digest, lines, words; a row a text."""
    each = written(lines.mapInArrow(_runs(min_words), f"id {kind}, digest binary, run long, lo int, hi int, new boolean"))
    held = each.groupBy("run").agg(F.count_if("new").alias("holders"), F.min("id").alias("lead"), F.max("id").alias("last")).where("last > lead")
    held = written(held.select("run", "holders", "lead"))  # a table, so that the join below can split a frequent run
    # written as well, so that only the rows of rare runs are grouped by run
    shared = written(each.join(held.hint("merge"), "run").where("new or lead < id"))
    rare = shared.where((F.col("holders") <= RARE) & F.col("new")).groupBy("run").agg(F.collect_list(F.struct("id", "digest")).alias("docs"))
    one = rare.select("docs", F.explode("docs").alias("x")).select("x", F.explode("docs").alias("y")).where("y.id < x.id")
    pairs = one.select(F.col("x.digest").alias("later"), F.col("y.digest").alias("earlier")).distinct()
    frequent = shared.where((F.col("holders") > RARE) & (F.col("lead") < F.col("id"))).select("digest", F.sequence("lo", "hi").alias("gone"))
    return pairs, frequent


def deletions(docs: DataFrame, min_words: int = 8, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per text that loses lines in some row: digest, first (the id that keeps it, if more have it), kept (of that id's row:
    which lines stay, in order; null: all) and again (whether rows of other ids go)."""
    kind = docs.select(F.col(doc_id).alias("id")).schema["id"].dataType.simpleString()
    rows = docs.select(F.col(doc_id).alias("id"), F.unhex(F.md5(F.col(text).cast("string"))).alias("digest"), F.col(text).cast("string").alias("text"))
    parsed = rows.where("id is not null and text is not null").mapInArrow(_lines, f"id {kind}, digest binary, lines array<long>, words array<int>")
    # the digest decides on the lines: of equal texts one row stays, already within a task
    lines = written(parsed.groupBy("digest").agg(F.min("id").alias("id"), F.max("id").alias("last"), F.first("lines").alias("lines"), F.first("words").alias("words")))
    heads = lines.select("id", "digest", "lines", "words")
    pairs, frequent = overlaps(heads, min_words, kind)
    later = heads.select(F.col("digest").alias("later"), F.col("lines").alias("x"), F.col("words").alias("xw"))
    earlier = heads.select(F.col("digest").alias("earlier"), F.col("lines").alias("y"), F.col("words").alias("yw"))
    both = pairs.join(later, "later").join(earlier, "earlier").select("later", "x", "xw", "y", "yw")
    aligned = both.mapInArrow(_align(min_words), "digest binary, gone array<int>").where(F.size("gone") > 0)
    gone = aligned.union(frequent).groupBy("digest").agg(F.collect_list("gone").alias("gone"))
    kept = lines.select("digest", "lines").join(gone, "digest").mapInArrow(_kept, "digest binary, kept array<boolean>")
    words = F.aggregate("words", F.lit(0).cast("long"), lambda s, x: s + x)
    again = lines.select("digest", F.col("id").alias("first"), ((F.col("last") > F.col("id")) & (words >= min_words)).alias("again"))
    return again.join(kept, "digest", "left").where("again or kept is not null")


def line_dedup(docs: DataFrame, min_words: int = 8, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents with aligned common blocks taken out of the later one's text, and `lines_deleted` (int)."""
    names = docs.columns
    base = docs.toDF(*(f"c{i}" for i in range(len(names))))
    own, body = F.col(f"c{names.index(doc_id)}"), F.col(f"c{names.index(text)}")
    gone = written(deletions(docs, min_words, doc_id, text))
    rows = base.withColumn("digest", F.unhex(F.md5(body.cast("string")))).join(gone.hint("merge"), "digest", "left")
    lines = F.split(body.cast("string"), "\n", -1)
    copy = F.coalesce(F.col("again") & (own > F.col("first")), F.lit(False))
    part = F.coalesce(F.col("kept").isNotNull() & (own == F.col("first")), F.lit(False))
    left = F.filter(lines, lambda x, i: F.col("kept")[i])
    cut = F.when(copy, F.lit("")).when(part, F.array_join(left, "\n")).otherwise(body)
    many = F.when(copy, F.size(lines)).when(part, F.size(F.filter("kept", lambda x: ~x))).otherwise(F.lit(0)).cast("int")
    out = [(cut if n == text else F.col(f"c{i}")).alias(n) for i, n in enumerate(names) if n != "lines_deleted"]
    return rows.select(*out, many.alias("lines_deleted"))
