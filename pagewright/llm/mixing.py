"""Mixing sources to target weights by temperature.

A source's weight is its token share to the power t, normalised.  t is bisected until the mixture meets a
target: at least a given entropy, or at most a given number of passes over any source.  The weights are then
realised: a source's stream is a row of passes, each a fresh permutation of all its documents, cut where the
source's token budget ends; the streams are dealt out to blocks by their relative position, so that every
block holds every source at its weight.

DataFrame functions only.  The cut needs each document's place in its pass as a running token sum.  It is taken
in two steps, over ranges of the permutation key and within each range, so a source with a third of all rows
is spread over RANGES windows.  The exponent takes a few grouped aggregates over one row per source.

Defined results: a null source is the source ''; a null or blank text has no tokens and stands where the
permutation puts it, in the first pass even behind the budget's end (it takes nothing from it); a source without tokens has
weight 0 and its documents are dealt once, to block 0; rows that share an id stand next to each other; equal keys are
ordered by id; extra columns are dropped by `plan` and kept by `mix`, whatever their names (`pass` and `block` are
replaced), which takes rows with a null id by their own number and joins by it where ids are null or repeated; a very
long text is one row with its count; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .shared import keyed, small, written

#: Ranges of the permutation key: three hexadecimal digits.
RANGES = 16**3
SECTIONS, ROUNDS = 64, 5


def tokens(text: str = "text"):
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def exponent(sources: DataFrame, budget: int | None, entropy: float | None, repeats: float | None) -> float:
    """The largest t in 0..1 of at least the entropy (nats), or the least t of at most `repeats` passes.

    sources: share (above 0).  Each pass over it tries the borders of SECTIONS equal parts of what is left.
    """
    low, high = 0.0, 1.0
    for _ in range(ROUNDS):
        grid = [low + (high - low) * i / SECTIONS for i in range(SECTIONS + 1)]
        at = sources.select("share", F.posexplode(F.array(*map(F.lit, grid))).alias("i", "t"))
        power = F.pow("share", F.col("t"))
        rows = at.groupBy("i").agg(
            F.sum(power).alias("z"), F.sum(power * F.ln("share")).alias("s"), F.max(F.pow("share", F.col("t") - 1)).alias("most"), F.min(F.pow("share", F.col("t") - 1)).alias("least"), F.max("t").alias("t"),
        ).select("i", (F.ln("z") - F.col("t") * F.col("s") / F.col("z")).alias("entropy"), (F.col("most") / (F.col("least") if budget is None else F.col("z"))).alias("passes")).orderBy("i").collect()
        if not rows:
            return 1.0
        if entropy is not None:  # entropy falls with t
            k = max((r.i for r in rows if r.entropy >= entropy - 1e-12), default=0)
            low, high = grid[k], grid[min(k + 1, SECTIONS)]
        else:  # passes fall with t
            k = min((r.i for r in rows if r.passes * (1.0 if budget is None else budget) <= repeats + 1e-12), default=SECTIONS)
            low, high = grid[max(k - 1, 0)], grid[k]
    return low if entropy is not None else high


def counted(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text", row: str | None = None) -> DataFrame:
    """doc_id, row, source and n_tokens of every document: the one reading of the texts."""
    number = F.col(row) if row else F.lit(None).cast("long")
    return docs.select(F.col(doc_id).alias("doc_id"), number.alias("row"), F.coalesce(F.col(source).cast("string"), F.lit("")).alias("source"), tokens(text).alias("n_tokens"))


def weights(docs: DataFrame, budget: int | None = None, entropy: float | None = None, repeats: float | None = 2.0, source: str = "source", text: str = "text") -> DataFrame:
    """Per source: source, docs, tokens, share, weight, budget (tokens of it in the mixture), passes.

    budget None: the smallest at which no document is left out.  Without a target the shares stay (t = 1).
    """
    return _weights(docs.select(F.coalesce(F.col(source).cast("string"), F.lit("")).alias("source"), tokens(text).alias("n_tokens")), budget, entropy, repeats)


def _weights(rows: DataFrame, budget: int | None, entropy: float | None, repeats: float | None) -> DataFrame:
    per = written(rows.groupBy("source").agg(F.count(F.lit(1)).alias("docs"), F.sum("n_tokens").alias("tokens")))
    total = per.agg(F.sum("tokens")).first()[0] or 0
    per = per.withColumn("share", F.col("tokens") / F.lit(float(max(total, 1))))
    live = per.where("share > 0")
    scale = None if budget is None else budget / max(total, 1)
    t = exponent(live, scale, entropy, repeats) if entropy is not None or repeats is not None else 1.0
    z, largest = live.agg(F.sum(F.pow("share", F.lit(t))), F.max(F.pow("share", F.lit(1 - t)))).first()
    z, largest = z or 1.0, largest or 1.0
    all_tokens = float(budget) if budget is not None else total * largest * z
    weight = F.when(F.col("share") > 0, F.pow("share", F.lit(t)) / z).otherwise(0.0)
    out = per.withColumn("weight", weight).withColumn("budget", F.round(F.col("weight") * all_tokens).cast("long"))
    return out.withColumn("passes", F.when(F.col("tokens") > 0, F.ceil(F.col("budget") / F.col("tokens"))).otherwise(1).cast("int"))


def plan(docs: DataFrame, blocks: int = 64, seed: int = 1, budget: int | None = None, entropy: float | None = None, repeats: float | None = 2.0, doc_id: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """The mixture, a row per use of a document: doc_id, source, pass (from 0), block (from 0), n_tokens."""
    return _uses(written(counted(docs, doc_id, source, text)), blocks, seed, budget, entropy, repeats).drop("row")


def _uses(rows: DataFrame, blocks: int = 64, seed: int = 1, budget: int | None = None, entropy: float | None = None, repeats: float | None = 2.0) -> DataFrame:
    """The plan over the rows of `counted`, with their `row`, which tells rows of one id apart."""
    per = small(written(_weights(rows, budget, entropy, repeats)))
    use = rows.join(per.select("source", "passes", F.col("budget").alias("most"), "tokens"), "source").where("passes > 0 or n_tokens = 0")
    use = use.withColumn("pass", F.explode(F.sequence(F.lit(0), F.greatest(F.col("passes"), F.lit(1)) - 1)))
    key = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("pass").cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("row "), F.col("row").cast("string")))))
    use = written(use.select("doc_id", "row", "source", "pass", "n_tokens", "most", "tokens", key.alias("key")).withColumn("part", F.conv(F.substring("key", 1, 3), 16, 10).cast("int")))
    ranges = use.groupBy("source", "pass", "part").agg(F.sum("n_tokens").alias("n"))
    ahead = Window.partitionBy("source", "pass").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select("source", "pass", "part", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("before"))
    inside = Window.partitionBy("source", "pass", "part").orderBy("key", "doc_id", "row").rowsBetween(Window.unboundedPreceding, -1)
    placed = use.withColumn("inner", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).join(ranges, ["source", "pass", "part"])
    start = F.col("pass") * F.col("tokens") + F.col("before") + F.col("inner")
    placed = placed.withColumn("start", start).where("start < most OR tokens = 0 OR (n_tokens = 0 AND pass = 0)")
    block = F.when(F.col("tokens") == 0, 0).otherwise(F.least(F.lit(blocks - 1), F.floor(F.col("start") * F.lit(blocks) / F.greatest(F.col("most"), F.lit(1))))).cast("int")
    return placed.select("doc_id", "source", "pass", block.alias("block"), "n_tokens", "row")


def mix(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text", **how) -> DataFrame:
    """The documents, each as often as the plan uses it, with pass and block."""
    names = docs.columns
    base = docs.toDF(*(f"c{i}" for i in range(len(names))))
    own, of, body = (f"c{names.index(x)}" for x in (doc_id, source, text))
    if keyed(docs, doc_id):
        uses = _uses(written(counted(base, own, of, body)), **how).select(F.col("doc_id").alias("use"), "pass", "block")
        out = base.join(uses, F.col("use") == F.col(own))
    else:
        base = written(base.withColumn("number", F.monotonically_increasing_id()))
        uses = _uses(written(counted(base, own, of, body, row="number")), **how).select(F.col("row").alias("use"), "pass", "block")
        out = base.join(uses, F.col("use") == F.col("number"))
    return out.select(*(F.col(f"c{i}").alias(n) for i, n in enumerate(names) if n not in ("pass", "block")), "pass", "block")
