"""Question-and-answer records: what is kept and where it goes, the evaluation grid, cached requests and their replay."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import figures as fg
from ..functions import pages as pg
from ..functions import quotes as q
from ..functions.text import given, stripped
from . import ordering as o

# What reviewers write, the reason that a log gives.
DROP_ACTIONS = ("删除", "改写")
DROP_WORDS = ("删除", "删掉", "不宜作测试", "重复", "改写")
LEADING_REASON = "测试集不得含引导性提问（题干已报出答案数字）"


def review_verdict(action: Column, note: Column) -> Column:
    """Why a reviewed record goes, or null."""
    action, note = stripped(given(action)), stripped(given(note))
    by_action = F.concat(F.lit("人工复核："), action, F.lit("（"), F.when(note == "", "无备注").otherwise(note), F.lit("）"))
    return F.when(action.isin(*DROP_ACTIONS), by_action).when(note.rlike("|".join(DROP_WORDS)), F.concat(F.lit("人工复核备注："), note))


def split(records: DataFrame, reviews: DataFrame, test_docs: list[str]) -> DataFrame:
    """The records (qa_id, seq, doc, question, answer) with pool (train or test), kept, reason, leading and half_refusal.

    reviews: qa_id, line, action, note (of an id's the last counts).  In this order: reviewed ones go, leading questions of the test pool go, and of questions
    that are equal but for punctuation the first stays, over both pools.
    """
    why = o.latest(reviews.select(stripped(given(F.col("qa_id"))).alias("qa_id"), "line", review_verdict(F.col("action"), F.col("note")).alias("review")).where("review is not null and qa_id <> ''"), ["qa_id"], "line").drop("line")
    r = records.join(why, "qa_id", "left").withColumn("pool", F.when(F.col("doc").isin(*test_docs), "test").otherwise("train"))
    r = r.withColumn("leading", fg.is_leading(F.col("question"), F.col("answer"))).withColumn("half_refusal", q.is_half_refusal(F.col("answer")))
    r = r.withColumn("early", F.coalesce("review", F.when((F.col("pool") == "test") & F.col("leading"), LEADING_REASON)))
    digest = F.md5(F.regexp_replace(given(F.col("question")), r"[^\p{L}\p{N}_]", ""))
    first = r.where("early is null").groupBy(digest.alias("digest")).agg(F.min(F.struct("seq", "qa_id")).alias("first"))
    r = r.withColumn("digest", digest).join(first, "digest", "left")
    again = F.when(F.col("seq") > F.col("first.seq"), F.concat(F.lit("与 "), F.col("first.qa_id"), F.lit(" 重复")))
    r = r.withColumn("reason", F.coalesce("early", again, F.lit(""))).withColumn("kept", F.col("reason") == "")
    return r.drop("review", "early", "digest", "first")


def backfilled(records: DataFrame, reviews: DataFrame, key: str, **columns: str) -> DataFrame:
    """The records with columns overwritten by what a review says: column=review column.  A blank one (white space of any
    script), and a record without a review, leave it as it is."""
    said = reviews.select(F.col(key).alias("__key"), *(F.nullif(stripped(F.col(v)), F.lit("")).alias(f"__{c}") for c, v in columns.items()))
    out = records.join(said, F.col(key) == F.col("__key"), "left")
    return out.select(*(F.coalesce(f"__{c}", c).alias(c) if c in columns else c for c in records.columns))


def accepts(candidate: str, question: str, answer: str) -> Column:
    """Whether another wording is one: not empty, not the same, and not leading where the question wasn't."""
    c, asked = stripped(given(F.col(candidate))), F.col(question)
    newly = fg.is_leading(c, F.col(answer)) & ~fg.is_leading(asked, F.col(answer))
    return (c != "") & (c != asked) & ~newly


def grid(train: DataFrame, test: DataFrame, tries: DataFrame, probes: int) -> DataFrame:
    """The evaluation grid: qa_id, cell, question, answer, question_eval.

    train, test: qa_id, seq, question, answer, leading.  tries: qa_id, try, candidate: other wordings, of which the first
    accepted one counts.  Of the training pool the first `probes` questions that are not leading are asked, in both
    wordings or not at all; test questions always in their own.
    """
    probe = o.first_rows(train.where("not leading"), "seq", probes).drop("place")
    asked = probe.select("qa_id", "question", "answer", F.lit("trained").alias("side")).unionByName(test.select("qa_id", "question", "answer", F.lit("untrained").alias("side")))
    said = o.first_accepted(asked.join(tries, "qa_id"), "qa_id", "try", accepts("candidate", "question", "answer"), "candidate")
    g = asked.join(said, "qa_id", "left").withColumn("candidate", stripped(given(F.col("candidate"))))
    both = F.array(F.struct(F.lit("original").alias("way"), F.col("question").alias("q")), F.struct(F.lit("rephrased").alias("way"), F.col("candidate").alias("q")))
    g = g.where("side = 'untrained' or candidate <> ''").withColumn("x", F.explode(both)).where("x.way = 'original' or x.q <> ''")
    return g.select("qa_id", F.concat_ws("_", "side", "x.way").alias("cell"), "question", "answer", F.col("x.q").alias("question_eval"))


def join_predictions(predictions: DataFrame, grid: DataFrame, order: str) -> DataFrame:
    """Predictions (qa_id, cell, prediction) with their grid row: of repeated keys of the grid the last in the order counts,
    predictions without one are dropped.  Adds `asked` (the evaluation's wording, or the question) and `silent` (nothing
    was predicted: the judge's score is 0)."""
    g = o.latest(grid, ["qa_id", "cell"], order).drop(order)
    out = predictions.join(g, ["qa_id", "cell"])
    out = out.withColumn("asked", F.coalesce(F.nullif("question_eval", F.lit("")), "question"))
    return out.withColumn("silent", stripped(given(F.col("prediction"))) == "")


def with_source(records: DataFrame, chunks: DataFrame) -> DataFrame:
    """The records with source_text, the text of their chunk ('' without one)."""
    return records.join(chunks.select("chunk_id", F.col("text").alias("source_text")), "chunk_id", "left").withColumn("source_text", given(F.col("source_text")))


def read_through(requests: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Requests (request: JSON text) answered from a cache (key, content), and those that are still to be sent, each once."""
    keyed = requests.withColumn("key", pg.cache_key(F.col("request")))
    return keyed.join(cache.select("key", "content"), "key"), keyed.select("key", "request").dropDuplicates(["key"]).join(cache, "key", "left_anti")


def replayed(records: DataFrame, cache: DataFrame, index: str = "q_index") -> DataFrame:
    """Whether the cached replies still give a record: questions_ok, answer_ok, checks_ok, all_ok.

    records: qa_id, q_request, a_request, c_request, q_index (from 1), question, answer, checks (map of string).  A missing reply,
    or one that holds no JSON, does not.
    """
    r = records
    for c in ("q", "a", "c"):
        found = cache.select(F.col("key").alias(f"{c}_key"), pg.json_part(F.col("content")).alias(f"{c}_reply"))
        r = r.withColumn(f"{c}_key", pg.cache_key(F.col(f"{c}_request"))).join(found, f"{c}_key", "left")
    asked = F.from_json(F.get_json_object("q_reply", "$.questions"), "array<string>")
    same = lambda a, b: F.coalesce(stripped(a) == stripped(b), F.lit(False))
    checks = F.from_json("c_reply", "map<string,string>")
    keys = F.map_keys("checks")
    agree = F.forall(keys, lambda k: F.coalesce(F.try_element_at(checks, k) == F.element_at("checks", k), F.lit(False)))
    out = r.withColumn("questions_ok", same(F.try_element_at(asked, F.col(index)), F.col("question"))).withColumn("answer_ok", same(F.get_json_object("a_reply", "$.answer"), F.col("answer")))
    out = out.withColumn("checks_ok", F.coalesce(F.col("c_reply").isNotNull() & agree, F.lit(False)))
    out = out.withColumn("all_ok", F.col("questions_ok") & F.col("answer_ok") & F.col("checks_ok"))
    return out.drop("q_key", "a_key", "c_key", "q_reply", "a_reply", "c_reply")


def listed_reports(replies: DataFrame, kind: str, base: str) -> DataFrame:
    """The reports of a search service's replies (column `reply`: JSON that holds its result as JSON text): year, doc_type,
    date, title_cn, url; rows without a link go."""
    row = "array<struct<TITLE:string,DATE_TIME:string,FILE_LINK:string,FILE_INFO:struct<fileLink:string>>>"
    r = replies.select(F.explode(F.from_json(F.get_json_object("reply", "$.result"), row)).alias("r")).select("r.*")
    title, link = given(F.col("TITLE")), F.coalesce(F.nullif("FILE_LINK", F.lit("")), "FILE_INFO.fileLink", F.lit(""))
    year = F.regexp_extract(title, r"(20\d{2})", 1)
    out = r.select(F.when(year == "", "unknown").otherwise(year).alias("year"), F.lit(kind).alias("doc_type"), given(F.col("DATE_TIME")).alias("date"), title.alias("title_cn"), link.alias("link")).where("link <> ''")
    return out.withColumn("url", F.when(F.col("link").startswith("/"), F.concat(F.lit(base), F.col("link"))).otherwise(F.col("link"))).drop("link")
