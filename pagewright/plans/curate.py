"""Queries: page cleaning, filters, numbers, dedupe, samples, review merge."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions import figures as fg
from ..functions import pages as pg
from ..functions import quotes as q
from ..operators import ordering as o
from ..operators import records as rec
from ..operators.degenerate import most_repeated
from ..storage import written
from . import sql
from .tables import GRID_SQL, grid, table

TOTAL = "合计"


def _summarised(p: DataFrame) -> DataFrame:
    """Per doc, and in total: pages, chars, blank ones, and the first eight of these.  p: doc, page, text.

    The texts are read once: what is kept of them is written, a narrow row a page.
    """
    p = written(p.select("doc", "page", F.length("text").alias("chars"), pg.is_near_blank(F.col("text")).alias("blank")))
    per = p.rollup("doc").agg(F.count(F.lit(1)).alias("pages"), F.sum("chars").alias("chars"), F.count_if("blank").alias("blank"), F.grouping("doc").alias("total"))
    # eight of each document at most leave a task, and eight of these make the total
    few = p.where("blank").select("doc", "page").withColumn("r", F.row_number().over(Window.partitionBy("doc").orderBy("page"))).where("r <= 8")
    listed = lambda x: F.array_join(F.array_sort(F.collect_list("page")).cast("array<string>"), ",").alias(x)
    first = few.groupBy("doc").agg(listed("first_blank")).select(F.col("doc").alias("d"), "first_blank", F.lit(0).alias("t"))
    first = first.unionByName(few.orderBy("page").limit(8).agg(listed("first_blank")).select(F.lit(None).cast("string").alias("d"), "first_blank", F.lit(1).alias("t")))
    out = per.join(first, F.col("doc").eqNullSafe(F.col("d")) & (F.col("total") == F.col("t")), "left")
    return out.select(F.when(F.col("total") == 1, TOTAL).otherwise(F.col("doc")).alias("doc"), "pages", "chars", "blank", F.coalesce("first_blank", F.lit("")).alias("first_blank"))


def page_clean_summary(spark: SparkSession, d: str) -> DataFrame:
    return _summarised(table(spark, d, "documents").select(F.col("doc_id").alias("page"), F.col("source").alias("doc"), pg.clean_page(F.col("text")).alias("text")))


def html_summary(spark: SparkSession, d: str) -> DataFrame:
    """Raw web pages as a page table: cleaned text of each, with its length and whether it is near blank or a table."""
    p = table(spark, d, "pages").select("page_id", pg.clean_page(pg.html_text(F.col("html"))).alias("text"))
    return p.select("page_id", F.length("text").cast("long").alias("chars"), F.md5("text").alias("digest"), pg.is_near_blank(F.col("text")).alias("blank"), pg.is_table(F.col("text")).alias("is_table"))


def _judged(spark: SparkSession, d: str) -> DataFrame:
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    j = docs.join(labels, "doc_id")
    start = F.col("doc_id") % 8
    some = F.substring("text", (F.lit(1) + F.col("doc_id") * 31 % F.greatest(F.col("n_chars") - 50, F.lit(1))).cast("int"), F.lit(50))
    answer = (
        F.when(start == 0, "").when(start == 1, F.concat(F.lit("材料未涉及。"), some))
        .when(start == 2, F.concat(F.lit("材料未提及。"), F.col("text"))).otherwise(F.col("text"))
    )
    return j.select("doc_id", answer.alias("answer"), "quality", "toxic", (start != 3).alias("simplified"), (start != 4).alias("named"))


# Why an answer goes, in the order of the rules, and the name of the total.
REASONS = ("回答为空", "整条只在说材料未涉及", "开头即拒绝作答", "质检判定编造", "质检判定无据", "正文混入繁体", "依据里的报告名不一致")


def classified(rows: DataFrame) -> DataFrame:
    """keep and reason of judged answers; the first rule that applies decides."""
    head = F.substring("answer", 1, 45).rlike("|".join(q.HALF_REFUSALS))
    reason = (
        F.when(F.coalesce("answer", F.lit("")) == "", REASONS[0])
        .when(head & (F.length("answer") < 120), REASONS[1])
        .when(head, REASONS[2])
        .when(F.col("toxic") == 1, REASONS[3])
        .when(F.coalesce("quality", F.lit(0)) == 0, REASONS[4])
        .when(~F.col("simplified"), REASONS[5])
        .when(~F.col("named"), REASONS[6])
        .otherwise("")
    )
    return rows.withColumn("reason", reason).withColumn("keep", F.col("reason") == "")


def classify_keep(spark: SparkSession, d: str) -> DataFrame:
    return classified(_judged(spark, d)).select("doc_id", "keep", "reason")


def drop_reasons(spark: SparkSession, d: str) -> DataFrame:
    return classified(_judged(spark, d)).groupBy("reason").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "reason")


def norm_dedupe(spark: SparkSession, d: str) -> DataFrame:
    labels = table(spark, d, "labels")
    docs = table(spark, d, "documents").join(labels.where("quality = 0").select("doc_id"), "doc_id", "left_anti")
    return o.first_wins(docs.select("doc_id", "text"), F.col("text"), "doc_id").select("doc_id", "copies")


_NUMBERED = "concat(text, ' 收入 ', doc_id * 1234 + 1000000, '.50 千元，', doc_id % 97, '.50%，１２３４', doc_id, ' 人，', doc_id, ',123,456.700')"


def number_sets(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents").select("doc_id", F.expr(_NUMBERED).alias("t"))
    return t.select("doc_id", F.array_join(fg.numbers_in(F.col("t")), ",").alias("numbers"), F.array_join(fg.big_numbers(F.col("t")), ",").alias("big"))


def check_numbers(spark: SparkSession, d: str) -> DataFrame:
    """Numbers of an answer that its source lacks, within quotations and outside of them."""
    t = table(spark, d, "documents").where("text is not null").selectExpr("doc_id", f"{_CHECKED} AS answer", f"{_NUMBERED} AS source")
    x = fg.unsupported_numbers(F.col("answer"), F.col("source"))
    return t.select("doc_id", x.alias("x")).select("doc_id", F.array_join("x.quoted", ",").alias("quoted"), F.array_join("x.body", ",").alias("body"))


_CHECKED = "concat('收入 ', doc_id * 1234 + 1000000, '.5 千元「', doc_id % 7 + 100, ' 与 ', doc_id + 5000, '」「', doc_id, '123456.7」又 ', doc_id % 5 + 200, '【第 999 页】 ', doc_id % 7 + 100)"


def leading_flag(spark: SparkSession, d: str) -> DataFrame:
    g = grid(spark, d)
    return g.select("qa_id", fg.is_leading(F.col("question"), F.col("answer")).alias("leading"), q.is_half_refusal(F.col("prediction")).alias("half_refusal"))


def strat_sample(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id"), "doc_id")
    return o.stratified(rows, "quality", "doc_id", 60).select("doc_id", "quality")


def stride_sample(spark: SparkSession, d: str) -> DataFrame:
    return o.stride_sample(table(spark, d, "documents").select("doc_id", "lang"), "doc_id", 60)


_VERDICT = "CASE WHEN quality = 0 THEN concat(' bad', toxic, '　') WHEN toxic = 1 THEN '  ' WHEN doc_id % 5 = 0 THEN '　' END"


def review_backfill(spark: SparkSession, d: str) -> DataFrame:
    """Source, overwritten by a review's non-blank one; and whether the reviews agree."""
    docs = table(spark, d, "documents").select("doc_id", "source")
    review = table(spark, d, "labels").selectExpr("doc_id", f"{_VERDICT} AS verdict", "quality = 1 - toxic AS agree")
    filled = rec.backfilled(docs, review, "doc_id", source="verdict")
    return filled.join(review.select("doc_id", "agree"), "doc_id", "left").select("doc_id", "source", F.coalesce("agree", F.lit(False)).alias("agree"))


def agreement(spark: SparkSession, d: str) -> DataFrame:
    j = table(spark, d, "labels").join(table(spark, d, "documents"), "doc_id")
    return j.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg((F.col("quality") == 1 - F.col("toxic")).cast("int")), 6).alias("rate"))


def asof_section(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    left = e.where("event_type <> 'signup'").select("event_id", "user_id", "ts")
    right = e.where("event_type = 'signup'").select("user_id", "ts", F.concat(F.lit("s"), F.col("event_id").cast("string")).alias("section"), F.col("event_id").alias("pos"))
    return o.asof(left, right, ["user_id"], "ts", "section", "pos", "（无章节）").select("event_id", "section")


def rotate_selfjoin(spark: SparkSession, d: str) -> DataFrame:
    return o.rotated(table(spark, d, "documents").select("doc_id", "n_chars"), "doc_id", "n_chars")


def even_limit_order(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", "lang", "n_chars", F.substring("text", 1, 60).alias("head")).orderBy(F.desc("n_chars"), "doc_id").limit(100)


def degenerate_4gram(spark: SparkSession, d: str) -> DataFrame:
    """Whether a text repeats itself: a window of four characters (or all of a shorter text) over eight times, or it is blank."""
    out = most_repeated(table(spark, d, "documents"), 4)
    return out.select("doc_id", "most", ((F.col("most") > 8) | (F.col("most") == 0)).alias("degenerate"))


_JUDGED = """j AS (
  SELECT d.doc_id, CASE d.doc_id % 8 WHEN 0 THEN '' WHEN 1 THEN concat('材料未涉及。', substring(text, 1 + CAST(d.doc_id * 31 % greatest(n_chars - 50, 1) AS INT), 50)) WHEN 2 THEN concat('材料未提及。', text) ELSE text END AS answer,
    quality, toxic, d.doc_id % 8 <> 3 AS simplified, d.doc_id % 8 <> 4 AS named FROM documents d JOIN labels l ON l.doc_id = d.doc_id),
c AS (SELECT doc_id, CASE
    WHEN coalesce(answer, '') = '' THEN '回答为空'
    WHEN regexp_matches(substring(answer, 1, 45), '材料未涉及|材料未提及|材料未披露|原文未涉及') AND length(answer) < 120 THEN '整条只在说材料未涉及'
    WHEN regexp_matches(substring(answer, 1, 45), '材料未涉及|材料未提及|材料未披露|原文未涉及') THEN '开头即拒绝作答'
    WHEN toxic = 1 THEN '质检判定编造' WHEN coalesce(quality, 0) = 0 THEN '质检判定无据'
    WHEN NOT simplified THEN '正文混入繁体' WHEN NOT named THEN '依据里的报告名不一致' ELSE '' END AS reason FROM j)"""
_HTML = r"regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''), '(?is)<(script|style)\b.*?</(script|style)\s*>|<!--.*?-->', ' ', 'g'), '(?i)</(p|div|li|tr|h[1-6]|title)\s*>|<br\s*/?>', chr(10), 'g'), '<[^>]*>', ' ', 'g')"

ORACLE_SQL = {
    "page_clean_summary": f"""
WITH p AS (SELECT doc_id, source AS doc, {sql.clean('text')} AS text FROM documents)
SELECT CASE WHEN grouping(doc) = 1 THEN '{TOTAL}' ELSE doc END AS doc, count(*) AS pages, sum(length(text))::BIGINT AS chars, count(*) FILTER (length(text) < 20) AS blank,
  coalesce(array_to_string(list_slice(list_sort(list(doc_id) FILTER (length(text) < 20)), 1, 8), ','), '') AS first_blank
FROM p GROUP BY ROLLUP (doc)""",
    "html_summary": f"""
WITH p AS (SELECT page_id, {sql.clean(_HTML)} AS text FROM pages),
l AS (SELECT page_id, text, list_filter({sql.lines('text')}, lambda x: {sql.strip('x')} <> '') AS filled FROM p)
SELECT page_id, length(text) AS chars, md5(text) AS digest, length(text) < 20 AS blank,
  len(filled) >= 4 AND 4 * len(list_filter(filled, lambda x: regexp_matches(x, {sql.lit(pg.TABLE_LINE)}))) > len(filled) AS is_table FROM l""",
    "classify_keep": f"WITH {_JUDGED} SELECT doc_id, reason = '' AS keep, reason FROM c",
    "drop_reasons": f"WITH {_JUDGED} SELECT reason, count(*) AS n FROM c GROUP BY reason",
    "norm_dedupe": """
WITH d AS (
  SELECT doc_id, md5(regexp_replace(coalesce(text, ''), '[^\\p{L}\\p{N}_]', '', 'g')) AS k FROM documents
  WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0))
SELECT min(doc_id) AS doc_id, count(*) AS copies FROM d GROUP BY k""",
    "number_sets": f"WITH t AS (SELECT doc_id, {_NUMBERED} AS t FROM documents) SELECT doc_id, array_to_string({sql.numbers('t')}, ',') AS numbers, array_to_string({sql.big('t')}, ',') AS big FROM t",
    "check_numbers": f"""
WITH t AS (SELECT doc_id, regexp_replace({_CHECKED}, '【[^】]*】', '', 'g') AS a, {sql.numbers(_NUMBERED)} AS have FROM documents WHERE text IS NOT NULL),
n AS (SELECT doc_id, have, {sql.numbers("array_to_string(regexp_extract_all(a, '「([^」]*)」', 1), '|')")} AS quoted, {sql.numbers("regexp_replace(a, '「[^」]*」', '', 'g')")} AS body FROM t)
SELECT doc_id, array_to_string(list_filter(quoted, lambda x: NOT list_contains(have, x)), ',') AS quoted,
  array_to_string(list_filter(body, lambda x: NOT list_contains(have, x) AND NOT list_contains(quoted, x)), ',') AS body FROM n""",
    "leading_flag": f"""
WITH {GRID_SQL}
SELECT qa_id, {sql.leading('question', 'answer')} AS leading, regexp_matches(prediction, '材料未涉及|材料未提及|材料未披露|原文未涉及') AS half_refusal FROM grid""",
    "strat_sample": """
WITH r AS (SELECT l.doc_id, quality FROM labels l JOIN documents d ON d.doc_id = l.doc_id),
s AS (SELECT quality, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, quality) AS o, sum(count(*)) OVER () AS t, count(*) OVER () AS k FROM r GROUP BY quality),
q AS (SELECT quality, o, k, round_even(60 * n / t::DOUBLE, 0)::BIGINT AS q FROM s),
f AS (SELECT quality, CASE WHEN o = k THEN 60 - coalesce(sum(q) OVER (ORDER BY o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) ELSE q END AS q FROM q),
k AS (SELECT doc_id, quality, md5(concat('s', doc_id)) AS h, row_number() OVER (PARTITION BY quality ORDER BY md5(concat('s', doc_id)), doc_id) AS i FROM r)
SELECT doc_id, k.quality FROM k JOIN f ON f.quality = k.quality ORDER BY i > q, h, doc_id LIMIT 60""",
    "stride_sample": """
WITH k AS (SELECT doc_id, lang, row_number() OVER (ORDER BY doc_id) - 1 AS i, count(*) OVER () AS n FROM documents)
SELECT doc_id, lang FROM k WHERE n <= 60 OR i IN (SELECT j * (SELECT count(*) FROM documents) // 60 FROM range(60) t(j))""",
    "review_backfill": f"""
WITH l AS (SELECT doc_id, quality, toxic, trim({_VERDICT}, ' 　') AS verdict FROM labels)
SELECT d.doc_id, coalesce(nullif(verdict, ''), source) AS source, coalesce(quality = 1 - toxic, false) AS agree FROM documents d LEFT JOIN l ON l.doc_id = d.doc_id""",
    "agreement": """
SELECT source, count(*) AS n, round(avg((quality = 1 - toxic)::INT), 6) AS rate FROM labels l JOIN documents d ON d.doc_id = l.doc_id GROUP BY source""",
    "asof_section": """
SELECT event_id, coalesce((SELECT concat('s', r.event_id) FROM events r WHERE r.event_type = 'signup' AND r.user_id = l.user_id AND r.ts <= l.ts
  ORDER BY r.ts DESC, r.event_id DESC LIMIT 1), '（无章节）') AS section FROM events l WHERE event_type <> 'signup'""",
    "rotate_selfjoin": """
WITH k AS (SELECT doc_id, n_chars, row_number() OVER (ORDER BY doc_id) - 1 AS i, count(*) OVER () AS n FROM documents)
SELECT a.doc_id, a.n_chars, b.n_chars AS rotated FROM k a JOIN k b ON (a.i + 37) % a.n = b.i""",
    "even_limit_order": "SELECT doc_id, lang, n_chars, substring(text, 1, 60) AS head FROM documents ORDER BY n_chars DESC, doc_id LIMIT 100",
    "degenerate_4gram": f"""
WITH t AS (SELECT doc_id, string_split({sql.strip("coalesce(text, '')")}, '') AS t FROM documents),
g AS (SELECT doc_id, unnest(CASE WHEN len(t) < 4 THEN [array_to_string(t, '')] ELSE list_transform(list_zip(t[1:len(t) - 3], t[2:len(t) - 2], t[3:len(t) - 1], t[4:]), lambda x: concat(x[1], x[2], x[3], x[4])) END) AS g FROM t),
c AS (SELECT doc_id, g, count(*) AS n FROM g WHERE g <> '' GROUP BY doc_id, g),
m AS (SELECT doc_id, max(n) AS most FROM c GROUP BY doc_id)
SELECT d.doc_id, coalesce(most, 0)::BIGINT AS most, coalesce(most, 0) > 8 OR coalesce(most, 0) = 0 AS degenerate FROM documents d LEFT JOIN m ON m.doc_id = d.doc_id""",
}

QUERIES = {f.__name__: f for f in (page_clean_summary, html_summary, check_numbers, classify_keep, drop_reasons, norm_dedupe, number_sets, leading_flag, strat_sample, stride_sample, review_backfill, agreement, asof_section, rotate_selfjoin, even_limit_order, degenerate_4gram)}
