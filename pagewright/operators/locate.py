"""Where quoted text stands in a corpus, and how exactly: verbatim, punctuation aside, script aside, or not at all.

`locate` reads the pages once: the windows of a page that may be segments, told by a bitmap of all segments, leave the task as text
and are joined with the segments.  `standing` answers what scores ask, the best level of each segment and whether it stands on certain pages:
what leaves a task is each window once, not once a page that has it.  A corpus that is asked often can be indexed: its pages are gathered to shards of about SHARD
characters, each with the suffix array of its text without punctuation and in one script.  An index is a table (a row a shard)
that can be kept and read again.  `search` looks up segments in it in blocks of bounded bytes: a block goes to all tasks, which look
up all its segments in a shard together; only pages that hold a segment are looked at for punctuation and script.  No page and
no position is shuffled.
"""

from __future__ import annotations

from collections.abc import Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.batches import mapped
from ..functions.script import Converter, Forms, bare, squeezed
from ..storage import bounded_batches, write_wide, written
from . import suffixes as sx
from . import windows as win

# The bands, best first; a place in this list is a level.
BANDS = VERBATIM, PUNCTUATION, SCRIPT, MISSING = "逐字", "去标点", "繁简", "未命中"
#: Characters of a shard (a longer page is a shard of its own), bytes of a block of segments, matches laid out at once.
SHARD, BLOCK_BYTES, MATCHES = 1 << 20, 32_000_000, 1 << 21
#: Windows of a form that a task remembers, so as to send them once.
SEEN = 1 << 18
_BETWEEN = "\0"  # no bare text holds it


def _kind(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


def _shards(table: Mapping[str, str] | None, size: int):
    convert = Converter(table)

    def row(keys, texts, flat):
        joined = _BETWEEN.join(flat)
        code = sx.codes(joined)
        code[code == 1] = 0
        order = sx.suffix_array(sx.keys(code))
        keys = pa.concat_arrays(keys)
        cells = [pa.ListArray.from_arrays(pa.array([0, len(keys)], pa.int32()), keys), pa.array([texts], pa.list_(pa.string())), pa.array([joined]), pa.array([order.astype("<i4").tobytes()], pa.binary())]
        return pa.RecordBatch.from_arrays(cells, ["keys", "texts", "flat", "places"])

    def run(batches):
        keys, texts, flat, held = [], [], [], 0
        for batch in batches:
            for i, text in enumerate(batch.column(1).to_pylist()):
                keys.append(batch.column(0).slice(i, 1))
                texts.append(text)
                flat.append(bare(convert(text)))
                held += len(flat[-1]) + 1
                if held >= size:
                    yield row(keys, texts, flat)
                    keys, texts, flat, held = [], [], [], 0
        if keys:
            yield row(keys, texts, flat)

    return run


def index(pages: DataFrame, page_key: str, text: str, table: Mapping[str, str] | None = None, path: str | None = None, shard: int = SHARD) -> DataFrame:
    """The suffix index of pages, at a path or in the shared folder: `spark.read.parquet` opens it again.  Null texts are left out.

    table: phrases and characters of the other script (default: `quotes`).
    """
    p = pages.select(F.col(page_key).alias("key"), F.col(text).alias("text")).where("text is not null")
    rows = p.mapInArrow(_shards(table, shard), f"keys array<{_kind(p, 'key')}>, texts array<string>, flat string, places binary")
    if path is None:
        return written(rows, wide=True)
    write_wide(rows, path)
    return pages.sparkSession.read.parquet(path)


def _found(shared):
    """(key, page, level) of the segments of a block in each shard."""

    def run(batches):
        block, (squeezed_, bare_), patterns = shared.value
        for batch in batches:
            for i in range(batch.num_rows):
                flat = batch.column(2)[i].as_py()
                code = sx.codes(flat)
                code[code == 1] = 0
                order = np.frombuffer(batch.column(3)[i].as_py(), "<i4")
                lo, hi = sx.ranges(sx.keys(code), order, patterns)
                hits = np.flatnonzero(lo < hi)
                if not len(hits):
                    continue
                page_of = np.cumsum(code == 0)
                keys, texts, seen = batch.column(0)[i].values, batch.column(1)[i].values, {}
                many = np.cumsum(hi[hits] - lo[hits])
                start = 0
                while start < len(hits):
                    stop = max(start + 1, int(np.searchsorted(many, (many[start - 1] if start else 0) + MATCHES)))
                    some = hits[start:stop]
                    n = hi[some] - lo[some]
                    ranks = np.repeat(lo[some] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
                    pairs = np.unique(np.repeat(some, n) * (len(keys) + 1) + page_of[order[ranks]])
                    who, where = np.divmod(pairs, len(keys) + 1)
                    level = np.full(len(who), 2, np.int32)
                    for j, (s, p) in enumerate(zip(who.tolist(), where.tolist())):
                        if p not in seen:
                            t = texts[p].as_py()
                            seen[p] = squeezed(t), bare(t)
                        if bare_[s] in seen[p][1]:
                            level[j] = 0 if squeezed_[s] in seen[p][0] else 1
                    yield pa.RecordBatch.from_arrays([block.take(pa.array(who)), keys.take(pa.array(where)), pa.array(level)], ["k", "p", "level"])
                    start = stop

    return run


def search(segments: DataFrame, index: DataFrame, key: str, segment: str, page_key: str, table: Mapping[str, str] | None = None) -> DataFrame:
    """(key, page_key, level, band) for every page that holds a segment: level 0 verbatim but for spacing, 1 but for punctuation
    as well, 2 but for the script as well.  Blank and null segments are nowhere; table: as for `index`."""
    spark = index.sparkSession
    bounded_batches(spark)  # a shard has megabytes
    s = written(segments.select(F.col(key).alias("k"), F.col(segment).alias("s")).where("s is not null").distinct())
    blocks = max(1, -(-(s.agg(F.sum(4 * F.length("s") + 40)).first()[0] or 0) // BLOCK_BYTES))
    convert = Converter(table)
    page = index.schema["keys"].dataType.elementType.simpleString()
    out = None
    for b in range(blocks):
        rows = s.where(F.pmod(F.xxhash64("s"), F.lit(blocks)) == b).toArrow()  # BLOCK_BYTES about
        texts = rows.column("s").to_pylist()
        patterns = sx.Patterns([bare(convert(t)) for t in texts])
        keys = rows.column("k").combine_chunks()
        shared = spark.sparkContext.broadcast((keys, ([squeezed(t) for t in texts], [bare(t) for t in texts]), patterns))
        found = index.mapInArrow(_found(shared), f"k {_kind(s, 'k')}, p {page}, level int")
        out = found if out is None else out.unionByName(found)
    return _best(out, key, page_key)


def _normal(convert: Converter):
    """Adds to segments (k, s) what they are without spacing, without punctuation, and that in one script; and whether they are
    regular: each of these forms gives those behind it."""

    def regular(t):
        a, b, c = squeezed(t), bare(t), bare(convert(t))
        return b != "" and bare(a) == b and bare(convert(a)) == c and bare(convert(b)) == c

    def run(batches):
        for batch in batches:
            s = batch.column(1)
            more = [mapped(s, f, pa.string()) for f in (squeezed, bare, lambda t: bare(convert(t)))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *more, mapped(s, regular, pa.bool_())], ["k", "squeezed", "bare", "flat", "regular"])

    return run


def _forms(segments: DataFrame, convert: Converter) -> DataFrame:
    """Of segments (k, s) their forms, without those of which nothing is left."""
    rows = segments.where("s is not null").distinct()
    return written(rows.mapInArrow(_normal(convert), f"k {_kind(rows, 'k')}, squeezed string, bare string, flat string, regular boolean").where("flat <> ''"))


def _windows(shared, convert: Converter):
    """(page, row, kind, window): windows of the pages, in each of the three forms (kind), that may be segments."""

    def run(batches):
        known = shared.value
        for batch in batches:
            for a, texts in win.pieces(batch.column(2)):
                hits = known.windows([bare(convert(t)) for t in texts])
                # a page without a segment in one script has none in its own either; of most pages both forms are one
                some = sorted({i for i, _ in hits})
                own = {i: bare(texts[i]) for i in some}
                other = [i for i in some if own[i] != bare(convert(texts[i]))]
                apart = set(other)
                rows = [(i, 2, w) for i, w in hits] + [(i, 1, w) for i, w in hits if i not in apart]
                rows += [(other[i], 1, w) for i, w in known.windows([own[i] for i in other])]
                rows += [(some[i], 0, w) for i, w in known.windows([squeezed(texts[i]) for i in some])]
                if rows:
                    at, kind, window = zip(*rows)
                    at = pa.array([a + i for i in at], pa.int64())
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(kind, pa.int32()), pa.array(window, pa.string())], ["p", "row", "kind", "w"])

    return run


def locate(segments: DataFrame, pages: DataFrame, key: str, segment: str, page_key: str, text: str, table: Mapping[str, str] | None = None) -> DataFrame:
    """What `search` gives in an index of the pages, from one reading of them: without an index, and for any number of segments."""
    spark, convert = pages.sparkSession, Converter(table)
    bounded_batches(spark)
    s = _forms(segments.select(F.col(key).alias("k"), F.col(segment).alias("s")), convert)
    forms = s.select(F.explode(F.array("squeezed", "bare", "flat")).alias("w")).where("w <> ''").distinct()
    shared = spark.sparkContext.broadcast(win.patterns(forms))
    p = pages.select(F.col(page_key).alias("p"), F.monotonically_increasing_id().alias("row"), F.col(text).alias("t")).where("t is not null")
    found = written(p.mapInArrow(_windows(shared, convert), f"p {_kind(p, 'p')}, row long, kind int, w string"))
    shared.destroy()
    form = lambda kind, name: found.where(F.col("kind") == kind).select(F.col("row").alias(f"{name}_row"), F.col("w").alias(f"{name}_w"))
    at = found.where("kind = 2").join(s, F.col("w") == F.col("flat")).select("k", "p", "row", "squeezed", "bare")
    at = at.join(form(1, "bare"), (F.col("row") == F.col("bare_row")) & (F.col("bare") == F.col("bare_w")), "left")
    at = at.join(form(0, "squeezed"), (F.col("row") == F.col("squeezed_row")) & (F.col("squeezed") == F.col("squeezed_w")), "left")
    # a form of which nothing is left stands on every page
    level = F.when(F.col("bare_row").isNull() & (F.col("bare") != ""), 2).when(F.col("squeezed_row").isNull() & (F.col("squeezed") != ""), 1).otherwise(0)
    return _best(at.withColumn("level", level), key, page_key)


def _apart(own: str, flat: str, most: int) -> str:
    """The part of a page with all windows of up to `most` characters that differ between its forms, place for place."""
    differ = np.flatnonzero(np.frombuffer(own.encode("utf-32-le", "surrogatepass"), np.uint32) != np.frombuffer(flat.encode("utf-32-le", "surrogatepass"), np.uint32))
    return own[max(int(differ[0]) - most + 1, 0) : int(differ[-1]) + most]


def _hits(shared, convert: Converter):
    """(place, kind, window): windows of the pages, in each of the three forms (kind), that may be regular segments and stand on a page
    with the forms behind them.  Each is sent once without a place, and with its page's place if it may be asked for there; what a
    task has sent it sends again only when it has forgotten it."""

    def run(batches):
        known, asked = shared.value
        forms, longest = Forms(convert), known.longest
        seen, told = ([win.Remembered(SEEN) for _ in BANDS[:3]] for _ in range(2))
        for batch in batches:
            place = np.asarray(batch.column(1))
            for a, texts in win.pieces(batch.column(2)):
                spaced, own, flat = forms(texts)
                out: list[tuple] = []

                def send(kind: int, page: np.ndarray, within: list[str], row: np.ndarray, at: np.ndarray, n: np.ndarray, h: np.ndarray, first: np.ndarray) -> None:
                    """Windows of `within` (row, at, n), which is text of the pages."""
                    where = place[a + page]
                    both = win.pair(h, where)
                    new, here = seen[kind].lacks(h, first), np.zeros(len(h), bool)
                    here[asked.has(both)] = True
                    here &= told[kind].lacks(both, first)
                    some = np.flatnonzero(new | here)
                    once, there, kept = set(), set(), []
                    for k, i, r, p, m, x in zip(some.tolist(), page[some].tolist(), row[some].tolist(), at[some].tolist(), n[some].tolist(), where[some].tolist()):
                        w = within[r][p : p + m]
                        send_new, send_here = new[k] and w not in once, here[k] and (x, w) not in there
                        if not (send_new or send_here):
                            continue
                        if kind < 2 and (w not in own[i] if kind else not ((b := bare(w)) and b in own[i])) or kind < 2 and bare(convert(w)) not in flat[i]:
                            continue
                        kept.append(k)
                        if send_new:
                            once.add(w)
                            out.append((None, kind, w))
                        if send_here:
                            there.add((x, w))
                            out.append((a + i, kind, w))
                    seen[kind].add(h[kept], first[kept])
                    kept = [k for k in kept if here[k]]
                    told[kind].add(both[kept], first[kept])

                row, at, n, h, first, covered = known.places(flat)
                # a page without a segment in one script has none in its own either
                some = np.unique(row).tolist()
                other = [i for i in some if own[i] != flat[i]]
                send(2, row, flat, row, at, n, h, first)
                if forms.aligned:  # windows that are alike in both forms are found already
                    send(1, row, flat, row, at, n, h, first)
                    parts = [_apart(own[i], flat[i], longest) for i in other]
                    near, around = forms.around(texts, covered)
                else:
                    alike = ~np.isin(row, other)
                    send(1, row[alike], flat, *(c[alike] for c in (row, at, n, h, first)))
                    parts = [own[i] for i in other]
                    near, around = some, [spaced[i] for i in some]
                for kind, of, within in ((1, other, parts), (0, near, around)):
                    if of:
                        row, *rest, _ = known.places(within)
                        send(kind, np.array(of, np.int64)[row], within, row, *rest)
                if out:
                    at, kind, window = zip(*out)
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(kind, pa.int32()), pa.array(window, pa.string())], ["p", "kind", "w"])

    return run


def standing(segments: DataFrame, pages: DataFrame, asked: DataFrame, segment: str, place: str, text: str, table: Mapping[str, str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(segment, level) on the best page of each segment that some page holds; and (segment, place, level) of what is asked, if the
    place has a page that holds the segment, on the best of these.

    asked: segments and places (of the type of the pages'; several pages may share one).  Rows do not grow with the number of pages
    that hold a segment.  Segments that are not regular (`_normal`), few in any text, are looked up by `locate` and so page by page.
    """
    spark, convert = pages.sparkSession, Converter(table)
    bounded_batches(spark)
    s = _forms(segments.select(F.col(segment).alias("k"), F.col(segment).alias("s")), convert)
    forms = s.where("regular").select("k", F.posexplode(F.array("squeezed", "bare", "flat")).alias("kind", "w"))
    wanted = written(asked.select(F.col(segment).alias("k"), F.col(place).alias("p")).where("k is not null and p is not null").distinct())
    known = win.patterns(forms.select("w").distinct())
    pairs = win.pairs(wanted.join(forms, "k").select("w", F.xxhash64("p").alias("h")))
    shared = spark.sparkContext.broadcast((known, pairs))
    p = pages.select(F.col(place).alias("p"), F.xxhash64(place).alias("h"), F.col(text).alias("t")).where("t is not null")
    found = written(p.mapInArrow(_hits(shared, convert), f"p {_kind(p, 'p')}, kind int, w string").distinct())
    shared.destroy()
    best = found.where("p is null").join(forms, ["kind", "w"]).select("k", F.col("kind").alias("level"))
    there = found.where("p is not null").join(wanted.join(forms, "k"), ["p", "kind", "w"]).select("k", "p", F.col("kind").alias("level"))
    odd = s.where("not regular")
    if not odd.isEmpty():
        apart = written(locate(odd.select("k"), pages.select(F.col(place).alias("p"), F.col(text).alias("t")), "k", "k", "p", "t", table))
        best = best.unionByName(apart.select("k", "level"))
        there = there.unionByName(apart.join(wanted, ["k", "p"]).select("k", "p", "level"))
    return (
        written(best.groupBy(F.col("k").alias(segment)).agg(F.min("level").alias("level"))),
        written(there.groupBy(F.col("k").alias(segment), F.col("p").alias(place)).agg(F.min("level").alias("level"))),
    )


def _best(out: DataFrame, key: str, page_key: str) -> DataFrame:
    band = F.element_at(F.array(*map(F.lit, BANDS)), F.col("level") + 1)
    return out.groupBy(F.col("k").alias(key), F.col("p").alias(page_key)).agg(F.min("level").alias("level")).withColumn("band", band)
