"""Numbers in text, as native columns: plain numbers, telling numbers, and figures with a unit."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import DIGIT, SPACE, let, matches, narrow, rounded

# Patterns, units with their scale in yuan, characters of either script.
NUMBER = rf"{DIGIT}+(?:,{DIGIT}{{3}})*(?:\.{DIGIT}+)?"
TELLING = rf"{DIGIT}[{DIGIT},]*(?:\.{DIGIT}+)?%?"
FIGURE = rf"({DIGIT}[{DIGIT},]*(?:\.{DIGIT}+)?)[{SPACE}]*(百万元|亿元|万元|千元|元|%)"
SCALE = {"元": 1.0, "千元": 1e3, "万元": 1e4, "百万元": 1e6, "亿元": 1e8}
TRADITIONAL, SIMPLIFIED = "億萬", "亿万"


def plain_number(x: Column) -> Column:
    """Half-width, without separators, without zeros at the end of a fraction."""
    x = F.translate(narrow(x), ",", "")
    return F.when(x.contains("."), F.regexp_replace(x, r"\.?0*$", "")).otherwise(x)


def numbers_in(text: Column) -> Column:
    """Distinct numbers of three digits or more, sorted."""
    found = F.transform(matches(text, NUMBER), plain_number)
    return F.array_sort(F.array_distinct(F.filter(found, lambda x: F.length(F.translate(x, ".", "")) >= 3)))


def big_numbers(text: Column) -> Column:
    """Distinct percentages of four characters or more and integers of five digits or more (so no years), sorted."""
    found = F.transform(matches(text, TELLING), lambda x: F.translate(x, ",", ""))
    keep = lambda x: (x.endswith("%") & (F.length(x) >= 4)) | x.rlike(rf"^{DIGIT}{{5,}}$")
    return F.array_sort(F.array_distinct(F.filter(found, keep)))


def key_figures(text: Column) -> Column:
    """Distinct (kind, value): money in yuan, percentages to two places (half to even)."""
    text = F.translate(F.coalesce(text, F.lit("")), TRADITIONAL, SIMPLIFIED)
    both = F.zip_with(matches(text, FIGURE, 1), matches(text, FIGURE, 2), lambda n, u: F.struct(F.translate(narrow(n), ",", "").try_cast("double").alias("n"), u.alias("u")))
    scale = lambda u: F.element_at(F.create_map(*(F.lit(x) for kv in SCALE.items() for x in kv)), u)
    value = lambda x: F.when(x["u"] == "%", rounded(x["n"], 2)).otherwise(x["n"] * scale(x["u"]))
    both = F.filter(both, lambda x: x["n"].isNotNull())
    return F.array_distinct(F.transform(both, lambda x: F.struct(F.when(x["u"] == "%", "pct").otherwise("yuan").alias("kind"), value(x).alias("value"))))


def match_figures(ref: Column, pred: Column, rel: float = 0.01, pct: float = 0.05) -> Column:
    """The figures of `ref` that `pred` has: money within `rel` of the larger, percentages within `pct` points."""

    def near(r: Column, p: Column) -> Column:
        apart = F.abs(r["value"] - p["value"])
        return (r["kind"] == p["kind"]) & F.when(r["kind"] == "pct", apart <= pct).otherwise(apart <= F.greatest(F.abs(r["value"]), F.abs(p["value"])) * rel)

    return F.filter(ref, lambda r: F.exists(pred, lambda p: near(r, p)))


def general(x: Column) -> Column:
    """Six significant digits, without zeros at the end; with an exponent from a million on."""
    plain = F.when(x >= 99999.95, F.format_string("%.0f", x)).when(x >= 9999.995, F.format_string("%.1f", x)).otherwise(F.format_string("%.2f", x))
    plain = F.when(plain.contains("."), F.regexp_replace(plain, r"\.?0+$", "")).otherwise(plain)
    return F.when(x >= 999999.5, F.regexp_replace(F.format_string("%.5e", x), r"\.?0*e", "e")).otherwise(plain)


def figure_text(x: Column) -> Column:
    """A figure for readers: percent, or yuan with separators."""
    return F.when(x["kind"] == "pct", F.concat(general(x["value"]), F.lit("%"))).otherwise(F.concat(F.format_number(x["value"], 0), F.lit(" 元")))


def is_leading(question: Column, answer: Column) -> Column:
    return F.arrays_overlap(big_numbers(question), big_numbers(answer))


def unsupported_numbers(answer: Column, source: Column) -> Column:
    """struct<quoted, body>: numbers within quotations that the source lacks; numbers outside of them that neither has."""
    said = F.regexp_replace(F.coalesce(answer, F.lit("")), "【[^】]*】", "")
    quoted = F.array_distinct(F.flatten(F.transform(matches(said, "「([^」]*)」", 1), numbers_in)))
    body = numbers_in(F.regexp_replace(said, "「[^」]*」", ""))
    parts = F.struct(numbers_in(source).alias("have"), quoted.alias("quoted"), body.alias("body"))
    lacks = lambda x: F.struct(
        F.array_sort(F.array_except(x["quoted"], x["have"])).alias("quoted"),
        F.array_sort(F.array_except(F.array_except(x["body"], x["have"]), x["quoted"])).alias("body"),
    )
    return let(parts, lacks)
