"""Queries over written copies of the test tables: sources and sinks there and back, and what else has no table of its own."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import pages as pg
from ..functions import script as sc
from ..functions import tokens as tk
from ..sources import files
from ..sources.replies import read_replies
from ..storage import shared_dir
from . import build, sql
from .tables import PAGES_SQL, pages, table


def _path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/cut-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def csv_foreign(spark: SparkSession, d: str) -> DataFrame:
    """Documents as CSV in GB 18030, read back in ranges."""
    path = _path(spark, "csv")
    files.write_csv_as(table(spark, d, "documents").select("doc_id", "source", "text"), path, "gb18030")
    back, encoding = files.read_csv(spark, path)
    return back.select(F.col("doc_id").cast("long").alias("doc_id"), "source", F.length("text").cast("long").alias("chars"), F.md5("text").alias("digest"), F.lit(encoding).alias("encoding"))


def json_lines(spark: SparkSession, d: str) -> DataFrame:
    """Pages as JSON lines with null fields, read back by their schema."""
    path = _path(spark, "jsonl")
    p = pages(spark, d).select("doc", pg.report_of(F.col("doc"))[0].alias("year"), F.lit(None).cast("string").alias("doc_type"), F.col("page").cast("int").alias("page"), F.length("text").alias("chars"), "text")
    files.write_json_lines(p, path)
    back = files.read_json_lines(spark, path)
    return back.select("doc", "year", "doc_type", "page", "chars", F.md5("text").alias("digest"))


def resume_table(spark: SparkSession, d: str) -> DataFrame:
    """A table computed in parts, after a run over some of the documents that ended early."""
    docs, path = table(spark, d, "documents").select("doc_id", "text"), _path(spark, "resumed")
    compute = lambda df: df.select("doc_id", F.length("text").cast("long").alias("chars"))
    files.resumed(docs.where("doc_id % 3 = 0"), path, "doc_id", compute)
    return files.resumed(docs, path, "doc_id", compute, parts=2)


def label_mask(spark: SparkSession, d: str) -> DataFrame:
    """Training labels of prompts and answers of made-up ids, cut to 64."""
    docs = table(spark, d, "documents").select("doc_id", F.sequence(F.lit(1), (F.col("doc_id") % 40 + 1).cast("int")).alias("prompt"), F.sequence((F.col("doc_id") % 9).cast("int"), (F.col("doc_id") % 9 + F.col("n_chars") % 90).cast("int")).alias("answer"))
    return docs.select("doc_id", F.array_join(pg.masked_labels(F.col("prompt"), F.col("answer"), 64).cast("array<string>"), ",").alias("labels"))


_PHRASES = {"本頁": "本页面", "營業額": "营业总额", "資產負債": "资产与负债"}


def script_convert(spark: SparkSession, d: str) -> DataFrame:
    """Pages in simplified characters, by phrases first."""
    return pages(spark, d).select("doc", "page", F.md5(sc.converted(F.col("text"), sc.CHARACTERS | _PHRASES)).alias("digest"))


def stock_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Ids of codes in search replies, each within a call of a function, two entries of some codes."""
    p = table(spark, d, "pages").where("page_id > 0")
    entry = F.struct(F.lpad(F.col("page_id").cast("string"), 7, "0").alias("code"), F.md5("url").alias("stockId"))
    again = F.when(F.col("page_id") % 3 == 0, F.array(entry, F.struct(F.col("page_id").cast("string").alias("code"), F.lit("second").alias("stockId")))).otherwise(F.array(entry))
    replies = p.select(F.concat(F.lit("cb("), F.to_json(F.struct(again.alias("stockInfo"))), F.lit(");")).alias("reply"))
    return files.stock_ids(replies, p.where("page_id % 2 = 0").select(F.col("page_id").cast("string").alias("code")))


def saved_reports(spark: SparkSession, d: str) -> DataFrame:
    """Report links of stored replies, a file each, through the data source."""
    path = _path(spark, "replies")
    build.search_replies(spark, d).write.option("maxRecordsPerFile", 1).text(path)
    return read_replies(spark, path).select("year", "date", "title_cn", "url")


def contents_read(spark: SparkSession, d: str) -> DataFrame:
    """Bookmarks of pages, a JSON object for ten pages, three bookmarks a page at most."""
    path = _path(spark, "contents")
    p = table(spark, d, "pages")
    mark = lambda i: F.struct(F.lit(1).alias("level"), F.concat(F.lit("第"), i.cast("string"), F.lit("节 \""), "url").alias("title"), (F.col("page_id") + i).cast("int").alias("page"))
    marks = F.transform(F.sequence(F.lit(0), (F.col("page_id") % 3).cast("int")), mark)
    files_ = p.groupBy(F.floor(F.col("page_id") / 10)).agg(F.map_from_entries(F.collect_list(F.struct(F.col("page_id").cast("string"), marks))).alias("x"))
    files_.select(F.to_json("x")).write.option("maxRecordsPerFile", 1).text(path)
    return files.read_contents(spark, path)


def pdf_check(spark: SparkSession, d: str) -> DataFrame:
    """Which stored files, of ten pages each, are whole PDF files by their first bytes and size."""
    path = _path(spark, "pdf")
    p = table(spark, d, "pages")
    content = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_id", "html"))), lambda x: x["html"]), "")
    made = p.groupBy(F.floor(F.col("page_id") / 10).alias("b")).agg(content.alias("x"))
    text = F.when(F.col("b") % 3 == 0, F.concat(F.lit("%PDF-1.7 "), "x")).when(F.col("b") % 3 == 1, F.concat(F.lit("%PDF"), F.substring("x", 1, 500))).otherwise(F.col("x"))
    made.select(text).write.option("maxRecordsPerFile", 1).text(path)
    return files.pdf_files(spark, path).select("length", "valid")


def summary_export(spark: SparkSession, d: str) -> DataFrame:
    """A summary by language and half of the sources, exported as one nested JSON object and read back."""
    path = _path(spark, "summary") + ".json"
    half = F.when(F.substring(F.md5("source"), 1, 1) < "8", "h0").otherwise("h1")
    s = table(spark, d, "documents").groupBy("lang", half.alias("half")).agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"))
    files.export_json(s, path, "lang", "half")
    back = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,map<string,struct<n:long,chars:long>>>")).alias("lang", "x"))
    return back.select("lang", F.explode("x").alias("half", "y")).select("lang", "half", "y.n", "y.chars")


def cut_by_tokens(spark: SparkSession, d: str) -> DataFrame:
    """Which documents, as prompts, reach 512 tokens."""
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    return table(spark, d, "documents").select("doc_id", tk.is_cut(F.col("text"), path, 512).alias("cut"))


def _convert(x: str) -> str:
    for a, b in _PHRASES.items():
        x = f"replace({x}, {sql.lit(a)}, {sql.lit(b)})"
    return sql.simple(x)


ORACLE_SQL = {
    "csv_foreign": "SELECT doc_id, source, length(nullif(text, '')) AS chars, md5(nullif(text, '')) AS digest, 'gb18030' AS encoding FROM documents",
    "json_lines": f"WITH {PAGES_SQL} SELECT doc, regexp_extract(doc, '(\\d{{4}})(年报|中报)', 1) AS year, NULL::VARCHAR AS doc_type, page::INT AS page, length(text)::INT AS chars, md5(text) AS digest FROM pages_",
    "resume_table": "SELECT doc_id, length(text) AS chars FROM documents",
    "label_mask": """
WITH x AS (SELECT doc_id, list_concat(list_transform(range(doc_id % 40 + 1), lambda i: -100), range(doc_id % 9, doc_id % 9 + n_chars % 90 + 1)) AS l FROM documents)
SELECT doc_id, array_to_string(l[:64], ',') AS labels FROM x""",
    "script_convert": f"WITH {PAGES_SQL} SELECT doc, page, md5({_convert('text')}) AS digest FROM pages_",
    "saved_reports": build.ORACLE_SQL["report_list"].replace("'年报' AS doc_type, ", "").replace("CASE WHEN starts_with(link, '/') THEN concat('https://b.example', link) ELSE link END", "link"),
    "contents_read": """
SELECT page_id::VARCHAR AS doc, i::INT AS pos, 1::INT AS level, concat('第', i, '节 "', url) AS title, (page_id + i)::INT AS page FROM (SELECT *, unnest(range(page_id % 3 + 1)) AS i FROM pages)""",
    "pdf_check": """
WITH x AS (SELECT page_id // 10 AS b, string_agg(html, '' ORDER BY page_id) AS x FROM pages GROUP BY 1),
f AS (SELECT CASE b % 3 WHEN 0 THEN concat('%PDF-1.7 ', x) WHEN 1 THEN concat('%PDF', substring(x, 1, 500)) ELSE x END AS x FROM x)
SELECT strlen(x) + 1 AS length, starts_with(x, '%PDF') AND strlen(x) + 1 > 1024 AS valid FROM f""",
    "summary_export": """
SELECT lang, CASE WHEN substring(md5(source), 1, 1) < '8' THEN 'h0' ELSE 'h1' END AS half, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY 1, 2""",
    "stock_lookup": "SELECT page_id::VARCHAR AS code, md5(url) AS stock_id FROM pages WHERE page_id % 2 = 0 AND page_id > 0",
}

QUERIES = {f.__name__: f for f in (csv_foreign, json_lines, resume_table, label_mask, script_convert, stock_lookup, saved_reports, contents_read, pdf_check, summary_export, cut_by_tokens)}
