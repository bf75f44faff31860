"""The corpus pipeline: stages over `documents`, each written as Parquet and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.llm import langid, mixing, ngram_join, suffix_search
from pagewright.llm import line_dedup as lines
from pagewright.llm.queries import table
from pagewright.llm.shared import freed, keyed, small, whole_texts, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in no known language go: rows are judged by text and source, so equal rows, and rows that share an id, go or stay
    by what they hold; null and empty texts go, as nothing tells their language; ties and labels as in `langid`; an empty
    table stays empty."""
    whole_texts(spark)
    keys = ["doc_id", "source", "digest"]  # text and source decide, so that equal rows go or stay together
    docs = docs.withColumn("digest", F.md5("text"))
    found = langid.identify(docs, langid.fit(docs), keys, host="source")
    gone = written(found.where("NOT accepted").select(*(F.col(k).alias(f"__{k}") for k in keys)).distinct())
    same = [F.col(f"__{k}").eqNullSafe(docs[k]) for k in keys]
    return docs.join(small(gone), same, "left_anti").select(COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated blocks of lines leave the later document; a document of which nothing is left goes.  Rows of one id lose lines of
    their own text each; rows with a null id, and null texts, stay as they are; n_chars follows the text."""
    whole_texts(spark)
    out = lines.line_dedup(docs).where("lines_deleted = 0 OR trim(text) <> ''")
    return out.withColumn("n_chars", F.when(F.col("lines_deleted") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each component of the n-gram join stays; rows are told apart by a number of
    their own where ids are null (then last) or repeated, and one of equal repeated rows stays.  Texts without words link with
    nothing and stay."""
    whole_texts(spark)
    if keyed(docs, "doc_id"):
        found = ngram_join.ngram_jaccard_join(docs)
        gone = written(found.where("doc_id <> component_id").select("doc_id").distinct())
        return docs.join(small(gone), "doc_id", "left_anti").select(COLUMNS)
    docs = written(docs.select(*COLUMNS, F.monotonically_increasing_id().alias("row")))
    found = written(ngram_join.ngram_jaccard_join(docs, doc_id="row").select(F.col("doc_id").alias("row"), "component_id"))
    rows = found.join(docs.select("row", "doc_id", F.md5("text").alias("digest")), "row")
    first = rows.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row", "digest")).alias("x")).select("x.*")
    # texts without words link with nothing: of equal ones that share an id one stays
    stays = first.groupBy("doc_id", "digest", F.when(F.col("doc_id").isNull(), F.col("row"))).agg(F.min("row").alias("row"))
    gone = written(found.select("row").join(stays.select("row"), "row", "left_anti"))
    return docs.join(small(gone), "row", "left_anti").select(COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go; equal rows go or stay together, rows of one id by their own text; null
    and empty texts stay; without items all stay."""
    whole_texts(spark)
    return suffix_search.decontaminate(docs, table(spark, sf_dir, "benchmark")).select(COLUMNS)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document once at least, small sources up to twice, in 64 blocks of equal mixture: a row for each use, with pass and
    block.  Null sources are one; rows of one id, or without one, are mixed each by itself."""
    whole_texts(spark)
    return mixing.mix(docs, blocks=64, seed=1, repeats=2.0).select(*COLUMNS, "pass", "block")


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixture", mixture),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole of `documents`."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
        freed(spark)
    return STAGES[-1][1](spark, docs, sf_dir)
