"""Quotations and citations in answers, as native columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import DIGIT, SPACE, given, matches, narrow, stripped

# Characters that formatting may change, phrases that refuse an answer, patterns, and characters of the
# traditional script (those of annual reports) with their simplified forms.
PUNCTUATION = "「」『』【】《》〈〉（）()［］[]｛｝{}＜＞<>" "，,。.、；;：:！!？?…—－~～·•｜|/＼\\" "\"'“”‘’′″　 \t\r\n\x00​﻿"
REFUSALS = ["材料未涉及", "材料未提及", "材料未披露", "原文未涉及", "材料中没有", "材料未涵盖", "无法回答"]
HALF_REFUSALS = ["材料未涉及", "材料未提及", "材料未披露", "原文未涉及"]
BLOCK = r"【([^】]{0,300})】"
TITLE = r"《([^》]{1,80})》"
LOOSE_TITLE = r"([一-鿿A-Za-z0-9_]{2,40}?(?:年报|中报))"
PAGES = rf"第[{SPACE}]*({DIGIT}{{1,4}})[{SPACE}]*(?:[-–~～至][{SPACE}]*({DIGIT}{{1,4}})[{SPACE}]*)?页"
BARE = rf"依据[:：][{SPACE}]*([^。；\n]{{1,90}})"
QUOTE = r"「([^」]{0,600})」"
ELLIPSIS = r"…+|\.{3,}|·{3,}|。{3,}|\*{3,}"
MIN_SEGMENT = 6


TRADITIONAL = "億萬個為與這業務營業額頁報園國會計師審計財產負債權資現銀險價貨幣實際變動員費總損潤稅項結應該買賣證監時間車電動銷售較數據經發開關於無從樣長門問題"
SIMPLIFIED = "亿万个为与这业务营业额页报园国会计师审计财产负债权资现银险价货币实际变动员费总损润税项结应该买卖证监时间车电动销售较数据经发开关于无从样长门问题"
NOT_SIMPLE = "個為與這"


def squeezed(text: Column) -> Column:
    """Without white space, of any script."""
    return F.regexp_replace(given(text), f"[{SPACE}]+", "")


def bare(text: Column) -> Column:
    """Without punctuation and spacing."""
    return F.translate(given(text), PUNCTUATION, "")


def simplified(text: Column) -> Column:
    """In simplified characters, one by one (other characters and phrases stay)."""
    pairs = {t: s for t, s in zip(TRADITIONAL, SIMPLIFIED) if t != s}
    return F.translate(given(text), "".join(pairs), "".join(pairs.values()))


def without_marks(text: Column) -> Column:
    """Without citation blocks and quotation marks."""
    return F.translate(F.regexp_replace(given(text), "【[^】]*】", ""), "「」", "")


def citations(text: Column) -> Column:
    """array<struct<raw, docs, pages array<struct<lo, hi>>>>: bracketed ones, then unbracketed ones; only those that
    name a report or a page."""
    text = given(text)
    blocks = F.concat(matches(text, BLOCK, 1), matches(F.regexp_replace(text, BLOCK, " "), BARE, 1))

    def one(inner: Column) -> Column:
        titles, loose = matches(inner, TITLE, 1), matches(inner, LOOSE_TITLE, 1)
        number = lambda x: narrow(x).try_cast("int")
        pages = F.zip_with(matches(inner, PAGES, 1), matches(inner, PAGES, 2), lambda a, b: F.struct(number(a).alias("lo"), number(F.when(b == "", a).otherwise(b)).alias("hi")))
        return F.struct(stripped(inner).alias("raw"), F.when(F.size(titles) > 0, titles).otherwise(loose).alias("docs"), pages.alias("pages"))

    return F.filter(F.transform(blocks, one), lambda c: (F.size(c["docs"]) > 0) | (F.size(c["pages"]) > 0))


def quotes(text: Column) -> Column:
    """Trimmed quotations that are neither empty nor a refusal (either one containing the other, punctuation aside)."""
    said = [F.translate(F.lit(r), PUNCTUATION, "") for r in REFUSALS]

    def refuses(q: Column) -> Column:
        b = F.translate(q, PUNCTUATION, "")
        hit = F.lit(False)
        for r in said:
            hit = hit | b.contains(r) | F.contains(r, b)
        return (b != "") & hit

    return F.filter(F.transform(matches(text, QUOTE, 1), stripped), lambda q: (q != "") & ~refuses(q))


def segments(quote: Column) -> Column:
    """The quotation's parts between ellipses, of MIN_SEGMENT characters at least, punctuation aside."""
    return F.filter(F.transform(F.split(quote, ELLIPSIS), stripped), lambda s: F.length(bare(s)) >= MIN_SEGMENT)


def short_segments(quote: Column) -> Column:
    parts = F.transform(F.split(quote, ELLIPSIS), stripped)
    return F.size(F.filter(parts, lambda s: (s != "") & (F.length(bare(s)) < MIN_SEGMENT)))


def format_score(text: Column) -> Column:
    """0 to 2: a bracketed citation, and a quotation."""
    text = given(text)
    return text.rlike("【依据[:：]").cast("int") + (F.size(quotes(text)) > 0).cast("int")


def format_flags(text: Column) -> Column:
    """struct<cite, quote, simple, chars>: what the shape of an answer shows."""
    text = given(text)
    return F.struct(
        text.contains("【依据").alias("cite"), (text.contains("「") & text.contains("」")).alias("quote"),
        (~text.rlike(f"[{NOT_SIMPLE}]")).alias("simple"), F.length(text).alias("chars"),
    )


def is_half_refusal(text: Column) -> Column:
    return given(text).rlike("|".join(HALF_REFUSALS))
