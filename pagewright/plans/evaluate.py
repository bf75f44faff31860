"""Queries: quote location, figures, citations, scores and their summaries, the source audit, retrieval."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import pages as pg
from ..functions import quotes as q
from ..operators import locate as loc
from ..operators import nearest
from ..operators import ordering as o
from ..operators import records as rec
from ..operators import retrieval as r
from ..operators import scoring as s
from ..storage import small, written
from . import sql
from .tables import GRID_SQL, PAGES_SQL, grid, pages, table


def quote_locate(spark: SparkSession, d: str) -> DataFrame:
    """Benchmark passages, as they are, without commas and full stops, and with a foreign end, in the corpus."""
    b = table(spark, d, "benchmark").where("text is not null")
    variants = b.select("item_id", F.explode(F.map_from_arrays(F.array(F.lit("as is"), F.lit("no stops"), F.lit("altered")), F.array("text", F.translate("text", ",.", ""), F.concat("text", F.lit("zq"))))).alias("variant", "segment"))
    variants = variants.withColumn("key", F.struct("item_id", "variant"))
    found = loc.locate(variants, table(spark, d, "documents").where("text is not null"), "key", "segment", "doc_id", "text")
    return found.select("key.item_id", "key.variant", "doc_id", "band")


def figure_match(spark: SparkSession, d: str) -> DataFrame:
    g = grid(spark, d)
    out = g.select("qa_id", s.numeric_score(F.col("prediction"), F.col("answer"), F.col("question")).alias("x"))
    return out.select("qa_id", *(F.col(f"x.{c}").alias(c) for c in ("n", "hit", "echo", "net", "ratio", "net_ratio", "missing")))


def citation_parse(spark: SparkSession, d: str) -> DataFrame:
    c = grid(spark, d).select("qa_id", q.citations(F.col("prediction")).alias("c"))
    docs = F.flatten(F.transform("c", lambda x: x["docs"]))
    spans = F.transform(F.flatten(F.transform("c", lambda x: x["pages"])), lambda x: F.concat(x["lo"].cast("string"), F.lit("-"), x["hi"].cast("string")))
    raw = F.array_join(F.transform("c", lambda x: x["raw"]), "；")
    return c.select("qa_id", F.size("c").cast("long").alias("cites"), F.substring(raw, 1, 120).alias("raw"), F.array_join(docs, ";").alias("docs"), F.array_join(spans, ";").alias("pages"))


def format_score(spark: SparkSession, d: str) -> DataFrame:
    x = q.format_flags(F.col("prediction"))
    g = grid(spark, d).select("qa_id", q.format_score(F.col("prediction")).alias("format"), x.alias("x"))
    return g.select("qa_id", "format", "x.cite", "x.quote", "x.simple", F.col("x.chars").cast("long").alias("chars"))


def citation_score(spark: SparkSession, d: str) -> DataFrame:
    out = s.citation_score(grid(spark, d), pages(spark, d))
    return out.select("qa_id", "cites", "doc_ok", "page_ok", "quotes_ok", "citation", "quotes", "exact", "script", "missing", "on_cited", "on_source", "first_missing")


def cell_summary(spark: SparkSession, d: str) -> DataFrame:
    return s.cell_summary(s.scored(grid(spark, d), pages(spark, d)), "label", "cell")


def macro_average(spark: SparkSession, d: str) -> DataFrame:
    g = grid(spark, d).withColumn("format", q.format_score(F.col("prediction")))
    out = s.macro_average(g.groupBy("label", "cell").agg(F.avg("format").alias("format")), "format", "label")
    return o.in_order(out, "label", ["arm2", "arm0"])


def diagnose_counts(spark: SparkSession, d: str) -> DataFrame:
    return s.diagnosis(s.scored(grid(spark, d), pages(spark, d)), "label")


def _union(g: DataFrame) -> DataFrame:
    one = g.select(F.concat(F.lit("g"), "qa_id").alias("key"), F.lit("generated").alias("source"), "doc", F.col("page").alias("lo"), (F.col("page") + F.col("doc_id") % 3).alias("hi"), "answer")
    off = F.col("page") + F.col("doc_id") % 4
    return one.unionByName(g.select(F.concat(F.lit("e"), "qa_id").alias("key"), F.lit("evaluated").alias("source"), "doc", off.alias("lo"), off.alias("hi"), F.col("prediction").alias("answer")))


def _audited(spark: SparkSession, d: str) -> DataFrame:
    """The grid's own answers with a range of pages, and its predictions with one page."""
    return s.audit(_union(grid(spark, d)), pages(spark, d))


def source_audit(spark: SparkSession, d: str) -> DataFrame:
    out = _audited(spark, d)
    return out.select("key", "source", "doc", "pages", "cites", "doc_ok", "page_ok", "quotes", "exact", "script", "missing", "on_source", "first_missing")


def audit_summary(spark: SparkSession, d: str) -> DataFrame:
    return s.audit_summary(_audited(spark, d))


_PREDICTED = """
SELECT qa_id, cell, prediction FROM grid UNION ALL
SELECT concat(qa_id, 'x'), cell, prediction FROM grid WHERE doc_id % 9 = 0 UNION ALL
SELECT qa_id, 'cell9', prediction FROM grid WHERE doc_id % 11 = 0"""
_ASKED = """
SELECT qa_id, cell, 0 AS line, question, answer, CASE WHEN doc_id % 2 = 0 THEN '' ELSE concat(question, '！') END AS question_eval FROM grid UNION ALL
SELECT qa_id, cell, 1, question, concat(answer, '（二）'), NULL FROM grid WHERE doc_id % 5 = 0"""


def pred_join(spark: SparkSession, d: str) -> DataFrame:
    """Predictions, some of them for no question, with a grid that has some keys twice."""
    g = grid(spark, d)
    predictions, asked = (spark.sql(x.replace("FROM grid", "FROM {grid}"), grid=g) for x in (_PREDICTED, _ASKED))
    return rec.join_predictions(predictions, asked, "line").select("qa_id", "cell", "asked", "answer", "prediction", "silent")


def _queries(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select(F.col("item_id").cast("long").alias("query_id"), "text")


def _corpus(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where(pg.in_corpus(F.col("text")))


def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    return r.bm25(_queries(spark, d), _corpus(spark, d), 8)


def bm25_words_topk(spark: SparkSession, d: str) -> DataFrame:
    return r.bm25(_queries(spark, d), table(spark, d, "documents"), 8, terms="word")


def vector_topk(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "embeddings")
    return nearest.vector_topk(v.where("vec_id % 20 = 0"), v, 10)


def rrf_fuse(spark: SparkSession, d: str) -> DataFrame:
    queries, docs = _queries(spark, d), _corpus(spark, d)
    return r.fused([r.bm25(queries, docs, 32), r.bm25(queries, docs, 32, terms="word")], 8)


def rag_context(spark: SparkSession, d: str) -> DataFrame:
    """The prompt context of each benchmark item: its best pages in order, cut to what a prompt takes."""
    docs = _corpus(spark, d)
    top = written(r.bm25(_queries(spark, d), docs, 8))  # a few rows, which go to the texts and not the texts to them
    top = docs.select("doc_id", "source", "text").join(small(top), "doc_id")
    part = pg.passage(F.concat("source", F.lit("_2025年报")), F.col("doc_id") % 50 + 1, F.col("text"))
    top = top.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", part.alias("part")))).alias("parts"))  # eight of them
    out = top.select("query_id", pg.context(F.transform("parts", lambda x: x["part"])).alias("context"))
    return out.select("query_id", F.length("context").cast("long").alias("chars"), F.md5("context").alias("digest"))


_WITH = f"WITH {GRID_SQL}, {PAGES_SQL}"
_SCORED = f"""{_WITH}, {sql.NUM}, {sql.SCORED},
sc AS (SELECT g.label, g.cell, g.judge, num.ratio, num.net_ratio, cs.*, doc_ok + page_ok + quotes_ok AS citation, {sql.FORMAT} AS format FROM grid g JOIN cs ON cs.qa_id = g.qa_id LEFT JOIN num ON num.qa_id = g.qa_id)"""
_AUDIT = f"""{_WITH},
recs AS (SELECT concat('g', qa_id) AS key, 'generated' AS source, doc, page AS lo, page + doc_id % 3 AS hi, answer FROM grid UNION ALL
  SELECT concat('e', qa_id), 'evaluated', doc, page + doc_id % 4, page + doc_id % 4, prediction FROM grid),
{sql.citations('recs', 'key', 'answer')}, {sql.verdicts('recs', 'key', 'answer', 'pages_')},
os AS (SELECT DISTINCT pl.key, pos FROM pl JOIN recs g ON g.key = pl.key WHERE pl.doc = g.doc AND pl.page BETWEEN g.lo AND g.hi),
vq AS (SELECT v.key, count(*) AS quotes, count(*) FILTER (worst < 2) AS exact, count(*) FILTER (worst = 2) AS script, count(*) FILTER (worst = 3) AS missing, count(os.pos) AS placed,
  substring(first(first ORDER BY v.pos) FILTER (worst = 3), 1, 60) AS first_missing FROM v LEFT JOIN os ON os.key = v.key AND os.pos = v.pos GROUP BY v.key),
au AS (SELECT g.key, source, doc, CASE WHEN lo = hi THEN lo::VARCHAR ELSE concat(lo, '-', hi) END AS pages, cite.raw AS cites,
  (len(cite.docs) > 0 AND len(list_filter(cite.docs, lambda x: x <> g.doc)) = 0)::INT AS doc_ok, (len(list_filter(cite.pages, lambda s: NOT (s.hi < g.lo - 1 OR s.lo > g.hi + 1))) > 0)::INT AS page_ok,
  {', '.join(f'coalesce({c}, 0)::BIGINT AS {c}' for c in ('quotes', 'exact', 'script', 'missing'))}, CASE WHEN quotes > 0 THEN (placed = quotes)::INT END AS on_source, coalesce(first_missing, '') AS first_missing
  FROM recs g JOIN cite ON cite.key = g.key LEFT JOIN vq ON vq.key = g.key)"""
_CORPUS = "corpus AS (SELECT * FROM documents WHERE length(text) > 80)"

ORACLE_SQL = {
    "quote_locate": f"""
WITH v AS (SELECT item_id, 'as is' AS variant, text AS seg FROM benchmark UNION ALL SELECT item_id, 'no stops', translate(text, ',.', '') FROM benchmark UNION ALL SELECT item_id, 'altered', concat(text, 'zq') FROM benchmark),
s AS (SELECT item_id, variant, {sql.squeeze('seg')} AS n1, {sql.bare('seg')} AS n2, {sql.bare(sql.simple('seg'))} AS n3 FROM v),
d AS (SELECT doc_id, {sql.squeeze('text')} AS t1, {sql.bare('text')} AS t2, {sql.bare(sql.simple('text'))} AS t3 FROM documents)
SELECT item_id, variant, doc_id, CASE WHEN contains(t2, n2) AND contains(t1, n1) THEN '逐字' WHEN contains(t2, n2) THEN '去标点' ELSE '繁简' END AS band FROM s JOIN d ON contains(t3, n3) WHERE n3 <> ''""",
    "figure_match": f"WITH {GRID_SQL}, {sql.NUM} SELECT g.qa_id, n, hit, echo, net, ratio, net_ratio, missing FROM grid g LEFT JOIN num ON num.qa_id = g.qa_id",
    "citation_parse": f"WITH {GRID_SQL}, {sql.citations('grid', 'qa_id', 'prediction')} SELECT qa_id, cites, raw, array_to_string(docs, ';') AS docs, array_to_string(list_transform(pages, lambda x: concat(x.lo, '-', x.hi)), ';') AS pages FROM cite",
    "format_score": f"""WITH {GRID_SQL} SELECT qa_id, {sql.FORMAT} AS format, contains(prediction, '【依据') AS cite, contains(prediction, '「') AND contains(prediction, '」') AS quote,
  NOT regexp_matches(prediction, '[{q.NOT_SIMPLE}]') AS simple, length(prediction) AS chars FROM grid""",
    "citation_score": f"{_WITH}, {sql.SCORED} SELECT qa_id, cites, doc_ok, page_ok, quotes_ok, doc_ok + page_ok + quotes_ok AS citation, quotes, exact, script, missing, on_cited, on_source, first_missing FROM cs",
    "cell_summary": f"""{_SCORED}
SELECT label, cell, count(*) AS n, round(avg(judge), 6) AS judge, round(avg((judge = 2)::INT), 6) AS accuracy, round(coalesce(avg(ratio), 0), 6) AS hit_rate, round(coalesce(avg(net_ratio), 0), 6) AS net_rate,
  round(avg(format), 6) AS format, round(avg(citation), 6) AS citation FROM sc GROUP BY label, cell""",
    "macro_average": f"""WITH {GRID_SQL}, c AS (SELECT label, cell, avg({sql.FORMAT}) AS f FROM grid GROUP BY label, cell), m AS (SELECT label, round(avg(f), 6) AS format, count(*) AS cells FROM c GROUP BY label)
SELECT *, row_number() OVER (ORDER BY CASE label WHEN 'arm2' THEN 1 WHEN 'arm0' THEN 2 ELSE 3 END, label) AS place FROM m""",
    "diagnose_counts": f"""{_SCORED}
SELECT label, count(*) FILTER (quotes > 0) AS with_quotes, {', '.join(f'sum({c})::BIGINT AS {c}' for c in ('quotes', 'exact', 'script', 'missing', 'on_cited', 'on_source'))},
  count(*) FILTER (format = 2) AS format_full, count(*) FILTER (format = 2 AND missing > 0) AS full_but_missing, count(*) FILTER (quotes > 0 AND exact = 0) AS none_exact, count(*) FILTER (quotes > 0 AND citation = 0) AS quoted_zero
FROM sc GROUP BY label""",
    "source_audit": f"{_AUDIT} SELECT * FROM au",
    "audit_summary": f"""{_AUDIT}
SELECT source, count(*) AS n, count(*) FILTER (cites <> '') AS with_cites, sum(doc_ok)::BIGINT AS doc_ok, sum(page_ok)::BIGINT AS page_ok, count(*) FILTER (quotes > 0) AS with_quotes,
  {', '.join(f'sum({c})::BIGINT AS {c}' for c in ('quotes', 'exact', 'script', 'missing'))}, count(*) FILTER (on_source = 1) AS on_source FROM au GROUP BY source""",
    "pred_join": f"""
WITH {GRID_SQL}, p AS ({_PREDICTED}), a AS ({_ASKED}),
l AS (SELECT *, row_number() OVER (PARTITION BY qa_id, cell ORDER BY line DESC) AS r FROM a)
SELECT p.qa_id, p.cell, coalesce(nullif(question_eval, ''), question) AS asked, answer, prediction, {sql.strip('prediction')} = '' AS silent FROM p JOIN l ON l.qa_id = p.qa_id AND l.cell = p.cell AND r = 1""",
    "bm25_topk": f"WITH {_CORPUS}, {sql.bm25('b', 'bigram', 8, 'corpus')} SELECT query_id, doc_id, score, rank FROM b",
    "bm25_words_topk": f"WITH {sql.bm25('w', 'word', 8, 'documents')} SELECT query_id, doc_id, score, rank FROM w",
    "rrf_fuse": f"""
WITH {_CORPUS}, {sql.bm25('b', 'bigram', 32, 'corpus')}, {sql.bm25('w', 'word', 32, 'corpus')},
u AS (SELECT query_id, doc_id, rank AS r, 0 AS arm FROM b UNION ALL SELECT query_id, doc_id, rank, 1 FROM w),
f AS (SELECT query_id, doc_id, round(sum(1.0::DOUBLE / (60 + r)), 9) AS score, min(arm * 1000 + r) AS first FROM u GROUP BY query_id, doc_id),
k AS (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, first) AS rank FROM f)
SELECT query_id, doc_id, score, rank FROM k WHERE rank <= 8""",
    "rag_context": f"""
WITH {_CORPUS}, {sql.bm25('b', 'bigram', 8, 'corpus')},
c AS (SELECT query_id, substring(string_agg(concat('【', source, '_2025年报 第 ', b.doc_id % 50 + 1, ' 页】', chr(10), text), chr(10) || chr(10) ORDER BY rank), 1, 6000) AS t FROM b JOIN corpus d ON d.doc_id = b.doc_id GROUP BY query_id)
SELECT query_id, length(t) AS chars, md5(t) AS digest FROM c""",
    "vector_topk": """
WITH p AS (SELECT a.vec_id AS query_id, b.vec_id AS doc_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 10) AS score FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id DESC) AS rank FROM p) SELECT query_id, doc_id, round(score, 6) AS score, rank FROM k WHERE rank <= 10""",
}

QUERIES = {
    f.__name__: f
    for f in (
        quote_locate, figure_match, citation_parse, format_score, citation_score, cell_summary, macro_average, diagnose_counts, source_audit, audit_summary, pred_join,
        bm25_topk, bm25_words_topk, vector_topk, rrf_fuse, rag_context,
    )
}
