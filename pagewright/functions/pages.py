"""Page text: cleaning, flags, and text idioms around model input and output."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .batches import mapped
from .text import DIGIT, SPACE, given, lines, stripped

# Lines that are page numbers, lines of a table, report names, code fences and JSON in replies, prompt limits.
PAGE_NUMBER = rf"^[{SPACE}]*[-—–{SPACE}]*(?:第[{SPACE}]*)?{DIGIT}{{1,4}}[{SPACE}]*(?:页)?[-—–{SPACE}]*$"
TABLE_LINE = rf"^[{SPACE}(（]*-?[{DIGIT},，.]+[)）%]?[{SPACE}]*$"
REPORT = r"(\d{4})(年报|中报)"
FENCE = r"(?m)^```(?:json)?\s*|\s*```$"
JSON_LIST, JSON_OBJECT = r"(?s)\[.*\]", r"(?s)\{.*\}"
LEAST_CHARS, CONTEXT_CHARS, CORPUS_CHARS = 20, 6000, 80


def clean_page(text: Column) -> Column:
    """Without blank lines, page-number lines and runs of blanks."""
    kept = F.filter(F.transform(lines(text), lambda x: F.regexp_replace(x, f"[{SPACE}]+$", "")), lambda x: (x != "") & ~x.rlike(PAGE_NUMBER))
    return stripped(F.regexp_replace(F.array_join(kept, "\n"), r"[ \t]{2,}", " "))


def is_near_blank(text: Column) -> Column:
    return F.length(text) < LEAST_CHARS


def in_corpus(text: Column) -> Column:
    """Whether a page is long enough to be searched."""
    return F.coalesce(F.length(text) > CORPUS_CHARS, F.lit(False))


def is_table(text: Column) -> Column:
    """Four lines or more, and over a quarter of them are numbers alone."""
    filled = F.filter(lines(text), lambda x: stripped(x) != "")
    numeric = F.filter(filled, lambda x: x.rlike(TABLE_LINE))
    return (F.size(filled) >= 4) & (F.size(numeric) * 4 > F.size(filled))


def report_of(name: Column) -> tuple[Column, Column]:
    """Year and kind of a report's name, or 'unknown'."""
    year, kind = F.regexp_extract(name, REPORT, 1), F.regexp_extract(name, REPORT, 2)
    return F.when(year == "", "unknown").otherwise(year), F.when(kind == "", "unknown").otherwise(kind)


def html_text(html: Column) -> Column:
    """The lines of a page: block ends as line ends, no scripts, styles, comments or tags."""
    bare = F.regexp_replace(given(html), r"(?is)<(script|style)\b.*?</(script|style)\s*>|<!--.*?-->", " ")
    return F.regexp_replace(F.regexp_replace(bare, r"(?i)</(p|div|li|tr|h[1-6]|title)\s*>|<br\s*/?>", "\n"), r"<[^>]*>", " ")


@F.arrow_udf(StringType())
def _canonical(column: pa.Array) -> pa.Array:
    def one(text: str) -> str | None:
        try:
            return json.dumps(json.loads(text), ensure_ascii=False, sort_keys=True)
        except ValueError:
            return None

    return mapped(column, one, pa.string())


def canonical(value: Column) -> Column:
    """A value of any nesting (JSON text, or a VARIANT as `to_json` renders it) as JSON with sorted keys at every level, blanks behind
    commas and colons, characters as they are, and escapes and numbers as the usual Python serialiser writes them; null where
    the text is no JSON.  Of a repeated key the last value counts."""
    return _canonical(value)


def payload(model: str, system: Column, user: Column, temperature: Column) -> Column:
    """A chat request in canonical JSON."""
    named = lambda **x: F.named_struct(*(y for k, v in x.items() for y in (F.lit(k), v)))
    messages = F.array(named(role=F.lit("system"), content=given(system)), named(role=F.lit("user"), content=given(user)))
    return canonical(F.to_json(named(model=F.lit(model), messages=messages, temperature=temperature, response_format=named(type=F.lit("json_object")))))


def cache_key(request: Column) -> Column:
    """A content hash: 32 hexadecimal digits."""
    return F.substring(F.sha2(request, 256), 1, 32)


def json_part(text: Column) -> Column:
    """The JSON in a reply: without code fences, whole if it parses, else the widest [..] or {..} that does; else null."""
    bared = F.trim(F.regexp_replace(text, FENCE, ""))
    ok = lambda x: F.when(F.try_parse_json(x).isNotNull() & (F.trim(x) != ""), x)
    return F.coalesce(ok(bared), ok(F.regexp_extract(bared, JSON_LIST, 0)), ok(F.regexp_extract(bared, JSON_OBJECT, 0)))


def passage(doc: Column, page: Column, text: Column) -> Column:
    """A passage as it stands in a prompt."""
    return F.concat(F.lit("【"), doc, F.lit(" 第 "), page.cast("string"), F.lit(" 页】\n"), text)


def context(passages: Column) -> Column:
    """Passages in order, a blank line between them, cut to what a prompt takes."""
    return F.substring(F.array_join(passages, "\n\n"), 1, CONTEXT_CHARS)


def masked_labels(prompt_ids: Column, answer_ids: Column, most: int = 1024) -> Column:
    """Training labels of a prompt and its answer: -100 for each prompt token, cut to `most`."""
    return F.slice(F.concat(F.array_repeat(F.lit(-100), F.size(prompt_ids)), answer_ids), 1, most)


def yes_no(flag: Column) -> Column:
    return F.when(flag, "是").otherwise("否")


def filled(*columns: Column) -> Column:
    """How many of the cells are not blank."""
    return sum(((stripped(given(c)) != "").cast("int") for c in columns), F.lit(0))
