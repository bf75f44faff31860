"""Chunks of page text: pages of wanted sections, merged and split to a target size, in page order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.pages import is_table
from ..functions.text import stripped
from ..storage import written
from .ordering import numbered, running_sum

# Sizes in characters and in shares of the target, and the sections that are wanted.
LEAST_PAGE, SHORT_PAGE, LONG_PAGE, LONG_PIECE = 40, 400, 1.7, 1.4
SECTIONS = "摘要|業務回顧|业务回顾|管理層討論|管理层讨论"
_CHUNK = "struct<section:string,page_start:bigint,page_end:bigint,text:string,open:boolean>"


def _joined(parts: Column, fits) -> Column:
    """Strings put together, a line end between them, for as long as `fits` (what there is, what comes) allows."""
    last = lambda out: F.element_at(out, -1)

    def step(out: Column, x: Column) -> Column:
        more = F.concat(F.slice(out, 1, F.size(out) - 1), F.array(F.concat(last(out), F.lit("\n"), x)))
        return F.when((F.size(out) > 0) & fits(F.coalesce(F.try_element_at(out, F.lit(-1)), F.lit("")), x), more).otherwise(F.concat(out, F.array(x)))

    return F.aggregate(parts, F.array().cast("array<string>"), step)


def pieces(text: Column, target: int) -> Column:
    """The paragraphs of a long page, packed; one that is too long by itself stays whole."""
    paragraphs = F.filter(F.transform(F.split(text, "\n\n"), stripped), lambda x: x != "")
    return _joined(paragraphs, lambda out, x: F.length(out) + F.length(x) <= target * LONG_PIECE)


def chunk(pages: DataFrame, wanted: str = SECTIONS, target: int = 650) -> DataFrame:
    """doc, seq (from 0 in each doc), section, page_start, page_end, text, chars, has_table.

    pages: doc, page, section, text; ties on the page go by a hash of the text.  What was gathered so far matters to short pages only:
    a page of an unwanted section, a long one and one of SHORT_PAGE characters all end it.  So a document falls into stretches
    of one such page and the short pages behind it, which are folded one by one, each over its own few rows.  Stretches and chunks
    are numbered without their texts, in ranges, so that a document may have any share of the pages.
    """
    p = pages.select("doc", F.col("page").cast("long").alias("page"), F.coalesce("section", F.lit("")).alias("section"), F.coalesce("text", F.lit("")).alias("text"))
    size = F.length("text")
    kind = F.when(~F.col("section").rlike(wanted), "out").when(size < LEAST_PAGE, "skip").when(size > target * LONG_PAGE, "long").when(size >= SHORT_PAGE, "start").otherwise("short")
    p = p.withColumn("kind", kind).where("kind <> 'skip'")
    p = written(p.withColumn("digest", F.md5("text")).withColumn("row", F.monotonically_increasing_id()))
    starts = p.select("row", "doc", "page", "digest", (F.col("kind") != "short").cast("int").alias("starts"))
    p = p.join(running_sum(starts, ["doc"], ["page", "digest", "row"], "starts", "stretch").select("row", "stretch"), "row")
    whole = lambda text, ready: F.struct("section", F.col("page").alias("page_start"), F.col("page").alias("page_end"), text.alias("text"), ready.alias("open"))
    parts = F.when(F.col("kind") == "out", F.array().cast(f"array<{_CHUNK}>")).when(F.col("kind") == "long", F.transform(pieces(F.col("text"), target), lambda x: whole(x, F.lit(False))))
    parts = parts.otherwise(F.array(whole(F.col("text"), F.length("text") < target)))
    groups = p.select("doc", "stretch", "page", "digest", "row", parts.alias("parts")).groupBy("doc", "stretch").agg(F.array_sort(F.collect_list(F.struct("page", "digest", "row", "parts"))).alias("rows"))

    def step(out: Column, x: Column) -> Column:
        last = F.try_element_at(out, F.lit(-1))
        text = stripped(F.concat(last["text"], F.lit("\n"), x["text"]))
        grown = F.struct(last["section"].alias("section"), F.least(last["page_start"], x["page_start"]).alias("page_start"), F.greatest(last["page_end"], x["page_end"]).alias("page_end"), text.alias("text"), (F.length(text) < target).alias("open"))
        return F.when(F.coalesce(last["open"], F.lit(False)), F.concat(F.slice(out, 1, F.size(out) - 1), F.array(grown))).otherwise(F.concat(out, F.array(x)))

    folded = F.aggregate(F.flatten(F.transform("rows", lambda r: r["parts"])), F.array().cast(f"array<{_CHUNK}>"), step)
    out = groups.select("doc", "stretch", F.posexplode(folded).alias("pos", "x")).select("doc", "stretch", "pos", "x.*")
    out = written(out.withColumn("text", stripped(F.col("text"))).where("text <> ''"))
    place = numbered(out.select("doc", "stretch", "pos"), "doc", "stretch", "pos")
    place = written(place.select("doc", "stretch", "pos", "i"))
    place = place.join(place.groupBy("doc").agg(F.min("i").alias("first")), "doc").select("doc", "stretch", "pos", (F.col("i") - F.col("first")).alias("seq"))
    out = out.join(place, ["doc", "stretch", "pos"]).select("doc", "seq", "section", "page_start", "page_end", "text")
    return out.withColumn("chars", F.length("text").cast("long")).withColumn("has_table", is_table(F.col("text")))


def with_ids(chunks: DataFrame) -> DataFrame:
    """The chunks with chunk_id: document, first page, and a running number (from 0000) over all documents in their order."""
    chunks = written(chunks)
    number = numbered(chunks.select("doc", "seq"), "doc", "seq").drop("n")
    out = chunks.join(number, ["doc", "seq"]).select(*chunks.columns, "i")
    return out.withColumn("chunk_id", F.format_string("%s_p%d_%04d", "doc", "page_start", "i")).drop("i")


def question_ids(chunks: DataFrame, questions: str) -> DataFrame:
    """A row per question of a chunk (an array column): chunk_id, qa_id, question."""
    rows = chunks.select("chunk_id", F.posexplode(questions).alias("at", "question"))
    return rows.select("chunk_id", F.concat("chunk_id", F.lit("_q"), (F.col("at") + 1).cast("string")).alias("qa_id"), "question")
