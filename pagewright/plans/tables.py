"""Input tables, and a question-and-answer grid that is made from `documents` alike in any SQL engine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..storage import spread

#: The grid: a question, a reference answer (of some the whole text before it), and a prediction of one of eight kinds (one
#: with the whole text) for each document, as SQL that Spark
#: and the oracle engine both run over `documents`.  `lead` is a passage of the text, at a place that differs by document.
GRID = """
SELECT qa_id, doc_id, n_chars, doc, page, cell, label, judge, lead, question, answer, CASE doc_id % 8
    WHEN 0 THEN answer
    WHEN 1 THEN concat('收入 ', n_chars * 7 + 5000, ' 千元。「', replace(lead, ' ', '， '), '」【依据：《', doc, '》第 ', page + 1, ' 页】')
    WHEN 2 THEN concat('占 ', doc_id % 97, '.545%，「zz', lead, 'zz」。依据：', doc, ' 第　', page, ' 页')
    WHEN 3 THEN ''
    WHEN 4 THEN '材料未涉及相关内容「材料未涉及」'
    WHEN 5 THEN concat('「　本页营业额为 ', n_chars, ' 万元，资产负债已审计', chr(10), '」【依据：《', doc, '》第 ', page - 1, '～', page, ' 页】')
    WHEN 6 THEN concat(text, chr(10), answer)
    ELSE concat('约 １．５ 亿元，「', substring(lead, 1, 18), '……', substring(lead, 22, 18), '」【依据：《其他_2024年报》第 ', page + 3, '-', page + 5, ' 页】')
  END AS prediction
FROM (
  SELECT b.*,
    concat('去年收入 ', n_chars * 7, ' 千元，占 ', doc_id % 90, '.25%，员工 ', doc_id + 10000, ' 人，今年如何？') AS question,
    concat(CASE WHEN doc_id % 11 = 5 THEN concat(text, chr(10)) ELSE '' END, '收入为 ', n_chars * 7 + 5000, ' 千元，占 ', doc_id % 97, '.535%，员工 ', doc_id + doc_id % 2 + 10000, ' 人。「', lead, '」【依据：《', doc, '》第 ', page, ' 页】') AS answer
  FROM (
    SELECT concat('q', doc_id) AS qa_id, doc_id, n_chars, concat(source, '_2025年报') AS doc, doc_id % 50 + 1 AS page,
      concat('cell', doc_id % 4) AS cell, concat('arm', doc_id % 3) AS label,
      CASE WHEN doc_id % 5 = 0 THEN NULL ELSE doc_id % 3 END AS judge,
      replace(substring(text, 1 + CAST(doc_id * 37 % greatest(n_chars - 40, 1) AS INT), 40), chr(10), ' ') AS lead, text
    FROM documents WHERE text IS NOT NULL) b) g"""
#: The documents as a page table: their whole text, and a line in the traditional script.
PAGES = """
SELECT concat(source, '_2025年报') AS doc, doc_id % 50 + 1 AS page, concat(text, chr(10), '本頁營業額為 ', n_chars, ' 萬元，資產負債已審計') AS text
FROM documents WHERE text IS NOT NULL"""
GRID_SQL, PAGES_SQL = f"grid AS ({GRID})", f"pages_ AS ({PAGES})"


#: Tables of whole texts, whose rows cost more to work on than to deal out.
TEXTS = ("documents", "pages")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df) if name in TEXTS else df


def query(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """A query over `documents` alone."""
    return spark.sql(sql.replace("FROM documents", "FROM {documents}"), documents=table(spark, sf_dir, "documents"))


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return query(spark, sf_dir, GRID)


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return query(spark, sf_dir, PAGES)
