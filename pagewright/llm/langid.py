"""Language identification by Bayesian fusion of evidence.

Four kinds of evidence are multiplied for every language:

* the text: a character trigram model for every labelled language, learned here from a bounded sample of labelled texts
  (the `per_language` different ones of each language, of 200 to MAX_BYTES bytes each, smallest by a hash of id and text;
  a language without texts of that length has whole shorter or longer ones).  A long text
  counts as at most STRENGTH independent trigrams, as neighbouring ones say much the same;
* the language that markup declares (right with probability TRUST);
* the host, and the suffix of its address: priors counted by grouped aggregation of the first two, where a host is smoothed by
  its suffix and a suffix by all rows (SMOOTH pseudo-rows each), so a host with few rows says little.

A further class, `und`, has a flat trigram model: text that fits no language better than chance.  A row is rejected if
`und` wins, if its best language stays under `least`, or if neither text nor markup says anything.

Only sums per host leave the scan; a host with a third of all rows is one row of sums from each task.

Defined results: null, empty and letterless texts have flat text evidence; a null or unknown declared language, host or
suffix has none; ties go to the alphabetically first language; repeated rows each count; extra columns are ignored
and kept by callers that join; an empty table gives an empty result; without labelled texts every row is `und`; a
label none of whose texts has a letter is no language.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from . import fingerprints as fp
from .shared import small, written

BUCKETS = 1 << 16
MAX_BYTES = 20_000
STRENGTH, TRUST, SMOOTH, OTHER = 60.0, 0.9, 20.0, 0.01

_LETTER = np.full(256, 32, np.uint8)
_LETTER[97:123] = np.arange(97, 123)
_LETTER[65:91] = np.arange(97, 123)
_LETTER[128:] = np.arange(128, 256)


def trigrams(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of byte trigrams with a letter, lower-cased, other bytes as spaces; and each one's row."""
    x = _LETTER[raw].astype(np.uint32)
    if len(x) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    code = ((x[:-2] * 40503 + x[1:-1]) * 40503 + x[2:]) * np.uint32(2654435761) >> np.uint32(16)
    row = np.repeat(np.arange(len(off) - 1), np.diff(off))
    keep = (row[:-2] == row[2:]) & ((x[:-2] != 32) | (x[1:-1] != 32) | (x[2:] != 32))
    return code[keep].astype(np.int64), row[:-2][keep]


def _counts(batches):
    """Trigram counts of a batch's texts by label: l, code, n."""
    for batch in batches:
        for part, raw, off in fp.chunks(batch, "t"):
            code, row = trigrams(raw, off)
            labels = part.column(part.schema.get_field_index("l")).dictionary_encode()
            of = labels.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            both, n = np.unique(of[row] * BUCKETS + code, return_counts=True)
            yield pa.RecordBatch.from_arrays([labels.dictionary.take(pa.array(both // BUCKETS)), pa.array((both % BUCKETS).astype(np.int32)), pa.array(n.astype(np.int64))], ["l", "code", "n"])


def _table(counts: pa.Table) -> pa.Table:
    """A label's log-probabilities: of the buckets that it has, and of any other.  Half a count is added to each bucket,
    or less where that would outweigh the counts, so that a label with little text is not taken for a flat one."""
    code, n = (np.asarray(counts.column(c).combine_chunks()) for c in ("code", "n"))
    order = np.argsort(code)
    add = min(0.5, n.sum() / BUCKETS)
    total = n.sum() + add * BUCKETS
    logs = np.log((n[order] + add) / total).astype(np.float32)
    return pa.table([counts.column("l").slice(0, 1), pa.array([code[order].astype(np.uint16).tobytes()]), pa.array([logs.tobytes()]), pa.array([np.log(add / total)])], names=["l", "code", "logs", "other"])


def fit(docs: DataFrame, label: str = "lang", per_language: int = 400, doc_id: str = "doc_id", text: str = "text") -> dict[str, tuple]:
    """Log-probability tables (buckets, their float32 values, the value of all other buckets) of every language that is
    labelled, by name.  Texts are counted where they are read; a language takes one row of at most BUCKETS entries from there.
    """
    doc = docs.select(F.col(doc_id).alias("id"), F.col(text).cast("string").alias("t"), F.col(label).cast("string").alias("l"))
    doc = doc.where(F.col("l").isNotNull() & (F.octet_length("t") >= 3) & F.col("t").rlike(r"[A-Za-z]|[^\x00-\x7F]"))
    doc = doc.withColumn("h", F.pmod(F.xxhash64("id", "t"), F.lit(1 << 40))).withColumn("fits", F.octet_length("t").between(200, MAX_BYTES))
    sizes = doc.groupBy("l").agg(F.approx_count_distinct(F.when(F.col("fits"), F.col("h"))).alias("some"), F.approx_count_distinct("h").alias("every"))
    sizes = small(written(sizes.select("l", (F.col("some") == 0).alias("short"), F.when(F.col("some") > 0, F.col("some")).otherwise(F.col("every")).alias("n"))))
    doc = doc.join(sizes, "l").where("fits OR short")
    # of a label with many texts about twice as many as needed are ranked
    first = doc.where((F.col("n") <= 4 * per_language) | (F.col("h") < F.lit(float(1 << 40)) * 2 * per_language / F.col("n"))).select("l", "h").distinct()
    first = first.withColumn("place", F.row_number().over(Window.partitionBy("l").orderBy("h"))).where(F.col("place") <= per_language)
    last = small(written(first.groupBy("l").agg(F.max("h").alias("last"))))
    counts = doc.join(last, "l").where("h <= last").select("l", "t").mapInArrow(_counts, "l string, code int, n long")
    tables = counts.groupBy("l", "code").agg(F.sum("n").alias("n")).groupBy("l").applyInArrow(_table, "l string, code binary, logs binary, other double")
    return {r.l: (np.frombuffer(r.code, np.uint16), np.frombuffer(r.logs, np.float32), r.other) for r in tables.toLocalIterator()}


def _softmax(logs: np.ndarray) -> np.ndarray:
    e = np.exp(logs - logs.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def _likelihoods(model, names: list[str]):
    """Adds per row: n (trigrams), stated (the declared language is known), own (log evidence of text and markup for each
    language and `und`) and p (their posterior under equal priors)."""

    def run(batches):
        tables, k = model.value, len(names)
        flat = float(np.log(1 / BUCKETS))
        equal = np.log(np.r_[np.full(k, (1 - OTHER) / max(k, 1)), OTHER])
        number = {x: i for i, x in enumerate(names)}
        for batch in batches:
            for part, raw, off in fp.chunks(batch, "text"):
                code, row = trigrams(raw, off)
                n = np.bincount(row, minlength=part.num_rows).astype(float)
                weight = np.where(n > 0, STRENGTH / (n + STRENGTH), 0)
                sums = []
                for x in names:
                    at, logs, other = tables[x]
                    table = np.full(BUCKETS, other, np.float32)
                    table[at] = logs
                    sums.append(np.bincount(row, table[code], part.num_rows) * weight)
                declared = part.column(part.schema.get_field_index("declared")).to_pylist()
                own = np.stack([*sums, n * flat * weight], 1)
                said = np.array([number.get(x, -1) for x in declared], np.int64)
                r = np.flatnonzero(said >= 0)
                true = own[r, said[r]] + np.log(TRUST)
                own[r] += np.log(np.r_[np.full(k, (1 - TRUST) / max(k - 1, 1)), 1 / max(k, 1)])
                own[r, said[r]] = true
                lists = [pa.array(x.tolist(), pa.list_(pa.float64())) for x in (own, _softmax(own + equal))]
                cols = [part.column(i) for i, c in enumerate(part.schema.names) if c in ("key", "host")]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(n.astype(np.int64)), pa.array(said >= 0), *lists], ["key", "host", "n", "stated", "own", "p"])

    return run


def identify(rows: DataFrame, model: dict[str, tuple], keys: list[str], text: str = "text", declared: str | None = None, host: str | None = None, least: float = 0.5) -> DataFrame:
    """Per row: `keys`, language, confidence, accepted.

    declared: column of the language that markup states ('de' or 'de-AT'); host: column of the host's name,
    whose suffix is what follows its last dot.
    """
    spark = rows.sparkSession
    names = sorted(model)
    none = F.lit(None).cast("string")
    given = F.lower(F.regexp_extract(F.col(declared).cast("string"), "^[A-Za-z]+", 0)) if declared else none
    where = F.nullif(F.lower(F.col(host).cast("string")), F.lit("")) if host else none
    key = F.struct(*(F.col(k) for k in keys)).alias("key")
    base = rows.select(key, F.col(text).cast("string").alias("text"), given.alias("declared"), where.alias("host"))
    kind = base.schema["key"].dataType.simpleString()
    shared = spark.sparkContext.broadcast(model)
    seen = written(base.mapInArrow(_likelihoods(shared, names), f"key {kind}, host string, n long, stated boolean, own array<double>, p array<double>"))
    seen = seen.withColumn("suffix", F.nullif(F.regexp_extract("host", r"\.([^.]+)$", 1), F.lit("")))

    # priors: expected rows of each language, for all rows, each suffix and each host
    k = len(names)
    array = lambda c, x: F.array(*(x(F.col(f"{c}{i}"), i) for i in range(k)))
    hosts = written(seen.groupBy("host", "suffix").agg(*(F.sum(F.col("p")[i]).alias(f"c{i}") for i in range(k)), F.count(F.lit(1)).alias("rows")))
    world = hosts.agg(F.count(F.lit(1)), *(F.sum(f"c{i}") for i in range(k))).first()[1:]
    n = sum(x or 0.0 for x in world)
    every = [((x or 0.0) + 1) / (n + k) for x in world]
    suffixes = hosts.where("suffix is not null").groupBy("suffix").agg(*(F.sum(f"c{i}").alias(f"c{i}") for i in range(k)), F.sum("rows").alias("rows"))
    suffixes = suffixes.select("suffix", array("c", lambda c, i: c + F.lit(SMOOTH * every[i])).cast("array<double>").alias("of_suffix"))
    suffixes = suffixes.select("suffix", _share("of_suffix").alias("of_suffix"))
    hosts = hosts.where("host is not null").join(suffixes, "suffix", "left")
    above = F.coalesce("of_suffix", F.array(*map(F.lit, every)).cast("array<double>"))
    hosts = hosts.select("host", F.zip_with(array("c", lambda c, i: c).cast("array<double>"), above, lambda c, a: c + SMOOTH * a).alias("of_host"))
    hosts = small(written(hosts.select("host", _share("of_host").alias("of_host"))))

    prior = F.concat(F.transform(F.coalesce("of_host", F.array(*map(F.lit, every)).cast("array<double>")), lambda x: F.ln(x * (1 - OTHER))), F.array(F.lit(float(np.log(OTHER)))))
    out = seen.join(hosts, "host", "left").select("key", "n", "stated", F.zip_with("own", prior, lambda x, y: x + y).alias("logs"))
    out = out.select("key", "n", "stated", F.transform("logs", lambda x: F.exp(x - F.array_max("logs"))).alias("e"))
    out = out.select("key", "n", "stated", F.transform(_share("e"), lambda x: F.round(x, 9)).alias("p"))
    place = F.array_position("p", F.array_max("p")).cast("int")
    language = F.element_at(F.array(*map(F.lit, [*names, "und"])), place)
    out = out.select("key", language.alias("language"), F.array_max("p").alias("confidence"), "n", "stated")
    accepted = (F.col("language") != "und") & (F.col("confidence") >= least) & ((F.col("n") > 0) | F.col("stated"))
    results = ("language", "confidence", "accepted")
    own = [F.col("key")[k].alias(f"key_{k}" if k in results else k) for k in keys]
    return out.select(*own, "language", "confidence", accepted.alias("accepted"))


def _share(values: str) -> Column:
    return F.transform(values, lambda x: x / F.aggregate(values, F.lit(0.0), lambda a, b: a + b))


def page_text(html: Column) -> Column:
    """Visible text of a page: no scripts, styles, comments or tags."""
    return F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>", " ")


def page_language(html: Column) -> Column:
    """The language that the html tag declares, or null."""
    return F.nullif(F.regexp_extract(html, r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z]+)", 1), F.lit(""))


def page_host(url: Column) -> Column:
    return F.nullif(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1)), F.lit(""))
