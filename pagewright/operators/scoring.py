"""Scores of answers on their axes: figures, format and citations; their summaries; the audit of sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import figures as fg
from ..functions import quotes as q
from ..functions.text import let, rounded
from ..storage import written
from . import locate as loc

# Characters of a citation, and of a missing quotation, that a report shows.
CITES_CHARS, EXAMPLE_CHARS = 120, 60


def numeric_score(prediction: Column, reference: Column, question: Column) -> Column:
    """struct<n, hit, echo, net, ratio, net_ratio, missing>: figures of the reference found, and of these the ones that
    the question already gave; null if the reference has none."""
    found = F.struct(*(fg.key_figures(q.without_marks(x)).alias(n) for n, x in (("ref", reference), ("pred", prediction), ("asked", question))))

    def score(x: Column) -> Column:
        n, h, e = (F.size(x[c]).cast("long") for c in ("ref", "hit", "echo"))
        missing = F.array_join(F.array_sort(F.transform(F.array_except(x["ref"], x["hit"]), fg.figure_text)), "、")
        parts = F.struct(n.alias("n"), h.alias("hit"), e.alias("echo"), (h - e).alias("net"), rounded(h / n, 3).alias("ratio"), rounded((h - e) / n, 3).alias("net_ratio"), missing.alias("missing"))
        return F.when(n > 0, parts)

    # each step is computed once a row
    with_hit = let(found, lambda x: F.struct(x["ref"], x["asked"], fg.match_figures(x["ref"], x["pred"]).alias("hit")))
    return let(let(with_hit, lambda x: F.struct(x["ref"].alias("ref"), x["hit"].alias("hit"), fg.match_figures(x["hit"], x["asked"]).alias("echo"))), score)


def verdicts(answers: DataFrame, pages: DataFrame, key: str, answer: str, asked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Per quotation with a segment: key, at (its place), level (of its worst segment) and first (its first segment); and which
    quotations have a segment where it is asked for: key, at, name.  pages: doc, page, text; asked: key, name, doc, page."""
    said = answers.select(key, F.posexplode(q.quotes(F.col(answer))).alias("at", "quote"))
    parts = written(said.select(key, "at", F.posexplode(q.segments(F.col("quote"))).alias("s", "segment")))
    place = F.struct("doc", F.col("page").cast("long").alias("page")).alias("place")
    at = written(parts.select(key, "at", "segment").join(asked.where("doc is not null"), key).select(key, "at", "segment", "name", place))
    found, there = loc.standing(parts.select("segment").distinct(), pages.select(place, "text"), at, "segment", "place", "text")
    best = found.withColumnRenamed("level", "best")
    level = F.coalesce("best", F.lit(loc.BANDS.index(loc.MISSING)))
    per = parts.join(best, "segment", "left").groupBy(key, "at").agg(F.max(level).alias("level"), F.min(F.struct("s", "segment"))["segment"].alias("first"))
    there = there.join(best, "segment").where("level <= 1 or best = 2").select("segment", "place")
    return per, at.join(there, ["segment", "place"], "left_semi").select(key, "at", "name").distinct()


def _quotation_counts(answers: DataFrame, pages: DataFrame, key: str, answer: str, ranges: dict[str, Column]) -> DataFrame:
    """Per answer with quotations: its key as `__k`, their counts by band, first_missing, and for each named array<struct<lo, hi>> of
    pages how many quotations stand there, in the answer's own `doc`."""
    asked = None
    for name, spans in ranges.items():
        rows = answers.select(key, "doc", F.explode(spans).alias("x")).where("x.hi >= x.lo")
        rows = rows.select(key, F.lit(name).alias("name"), "doc", F.explode(F.sequence(F.col("x.lo").cast("long"), F.col("x.hi").cast("long"))).alias("page")).distinct()
        asked = rows if asked is None else asked.unionByName(rows)
    per, there = verdicts(answers.select(key, answer), pages, key, answer, asked)
    out = per.groupBy(F.col(key).alias("__k")).agg(
        F.count(F.lit(1)).alias("quotes"), F.count_if(F.col("level") <= 1).alias("exact"), F.count_if(F.col("level") == 2).alias("script"), F.count_if(F.col("level") == 3).alias("missing"),
        F.substring(F.min(F.when(F.col("level") == 3, F.struct("at", "first")))["first"], 1, EXAMPLE_CHARS).alias("first_missing"),
    )
    return out.join(there.groupBy(F.col(key).alias("__k")).agg(*(F.count_if(F.col("name") == n).alias(n) for n in ranges)), "__k", "left")


def _counted(a: DataFrame, per: DataFrame, key: str, names: list[str]) -> DataFrame:
    out = a.join(per, F.col(key) == F.col("__k"), "left").drop("__k")
    for c in names:
        out = out.withColumn(c, F.coalesce(c, F.lit(0)))
    return out.withColumn("first_missing", F.coalesce("first_missing", F.lit("")))


def _cited(answers: DataFrame, answer: str) -> DataFrame:
    """The answers with the reports (docs), page ranges (spans) and texts (cites) of their citations."""
    return answers.withColumn("__found", q.citations(F.col(answer))).select(
        *answers.columns,
        F.flatten(F.transform("__found", lambda c: c["docs"])).alias("__docs"),
        F.flatten(F.transform("__found", lambda c: c["pages"])).alias("__spans"),
        F.substring(F.array_join(F.transform("__found", lambda c: c["raw"]), "；"), 1, CITES_CHARS).alias("cites"),
    )


def _all_same(docs: str, doc: str) -> Column:
    return ((F.size(docs) > 0) & F.forall(docs, lambda d: d == F.col(doc))).cast("int")


def citation_score(answers: DataFrame, pages: DataFrame, key: str = "qa_id", answer: str = "prediction") -> DataFrame:
    """Adds to the answers (doc, page: where the question comes from) the parts of the citation score, 0 to 3, and
    counts of its quotations."""
    a = written(_cited(answers, answer))
    a = a.withColumn("doc_ok", _all_same("__docs", "doc"))
    a = a.withColumn("page_ok", F.exists("__spans", lambda s: (s["lo"] - 1 <= F.col("page")) & (F.col("page") <= s["hi"] + 1)).cast("int"))
    own = F.array(F.struct(F.col("page").alias("lo"), F.col("page").alias("hi")))
    per = _quotation_counts(a, pages, key, answer, {"on_cited": F.col("__spans"), "on_source": own})
    out = _counted(a, per, key, ["quotes", "exact", "script", "missing", "on_cited", "on_source"])
    out = out.withColumn("quotes_ok", ((F.col("quotes") > 0) & (F.col("exact") == F.col("quotes"))).cast("int"))
    return out.withColumn("citation", F.col("doc_ok") + F.col("page_ok") + F.col("quotes_ok")).drop("__docs", "__spans")


def scored(answers: DataFrame, pages: DataFrame) -> DataFrame:
    """All axes for answers with qa_id, doc, page, question, answer and prediction."""
    out = citation_score(answers, pages)
    num = numeric_score(F.col("prediction"), F.col("answer"), F.col("question"))
    return out.withColumn("num", num).withColumn("format", q.format_score(F.col("prediction")))


def cell_summary(rows: DataFrame, *by: str) -> DataFrame:
    """Means per cell: figure ratios over rows that have one (0 if none), judge scores over judged rows (null if none)."""
    return rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.avg("judge"), 6).alias("judge"),
        F.round(F.avg((F.col("judge") == 2).cast("double")), 6).alias("accuracy"),
        F.round(F.coalesce(F.avg("num.ratio"), F.lit(0.0)), 6).alias("hit_rate"),
        F.round(F.coalesce(F.avg("num.net_ratio"), F.lit(0.0)), 6).alias("net_rate"),
        F.round(F.avg("format"), 6).alias("format"),
        F.round(F.avg("citation"), 6).alias("citation"),
    )


def diagnosis(rows: DataFrame, *by: str) -> DataFrame:
    """What the quotations of a group of scored answers are worth."""
    has, full = F.col("quotes") > 0, F.col("format") == 2
    return rows.groupBy(*by).agg(
        F.count_if(has).alias("with_quotes"), *(F.sum(c).alias(c) for c in ("quotes", "exact", "script", "missing", "on_cited", "on_source")), F.count_if(full).alias("format_full"),
        F.count_if(full & (F.col("missing") > 0)).alias("full_but_missing"), F.count_if(has & (F.col("exact") == 0)).alias("none_exact"),
        F.count_if(has & (F.col("citation") == 0)).alias("quoted_zero"),
    )


def macro_average(cells: DataFrame, value: str, *by: str) -> DataFrame:
    """Mean over the cells that are there, whatever their sizes."""
    return cells.groupBy(*by).agg(F.round(F.avg(value), 6).alias(value), F.count(value).alias("cells"))


def audit(records: DataFrame, pages: DataFrame, key: str = "key") -> DataFrame:
    """Whether the citations and quotations of reference answers agree with where the answers come from.

    records: key, source, doc, lo, hi (pages that the record comes from), answer.  A cited range agrees if it is at most one
    page off that range.  on_source: 1 if all quotations stand on the record's own pages, null without quotations.
    """
    a = written(_cited(records, "answer"))
    a = a.withColumn("doc_ok", _all_same("__docs", "doc"))
    a = a.withColumn("page_ok", F.exists("__spans", lambda s: ~((s["hi"] < F.col("lo") - 1) | (s["lo"] > F.col("hi") + 1))).cast("int"))
    own = F.array(F.struct(F.col("lo").alias("lo"), F.col("hi").alias("hi")))
    out = _counted(a, _quotation_counts(a, pages, key, "answer", {"placed": own}), key, ["quotes", "exact", "script", "missing", "placed"])
    pages_text = F.when(F.col("lo") == F.col("hi"), F.col("lo").cast("string")).otherwise(F.concat_ws("-", F.col("lo").cast("string"), F.col("hi").cast("string")))
    out = out.withColumn("pages", pages_text).withColumn("on_source", F.when(F.col("quotes") > 0, (F.col("placed") == F.col("quotes")).cast("int")))
    return out.drop("__docs", "__spans", "placed")


def audit_summary(rows: DataFrame, by: str = "source") -> DataFrame:
    return rows.groupBy(by).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("cites") != "").alias("with_cites"), F.sum("doc_ok").alias("doc_ok"), F.sum("page_ok").alias("page_ok"),
        F.count_if(F.col("quotes") > 0).alias("with_quotes"), *(F.sum(c).alias(c) for c in ("quotes", "exact", "script", "missing")), F.count_if(F.col("on_source") == 1).alias("on_source"),
    )
