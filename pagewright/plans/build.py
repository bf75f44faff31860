"""Queries: chunks and their ids, the split into training and test records, the evaluation grid, cached requests, report lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import pages as pg
from ..functions import quotes as q
from ..operators import chunks as ch
from ..operators import ordering as o
from ..operators import records as rec
from . import sql
from .tables import query, table

#: Pages of the documents' sources: a passage of each text, at a place and of a length that differ by document; of every
#: fourth its whole text, a paragraph a line.
_PAGED = """
SELECT concat(source, '_2025年报') AS doc, doc_id AS page, CASE doc_id % 7 WHEN 0 THEN '其他' ELSE concat('管理層討論', doc_id % 3) END AS section,
  CASE WHEN doc_id % 4 = 0 THEN replace(text, chr(10), concat(chr(10), chr(10))) ELSE
    regexp_replace(substring(text, 1 + CAST(doc_id * 37 % greatest(n_chars - 1500, 1) AS INT), 20 + CAST(doc_id * 131 % 1500 AS INT)), '[^A-Za-z]+', ' '{g}) END AS text
FROM documents WHERE text IS NOT NULL"""
#: Records: questions some of which are equal but for punctuation, or hold the answer's number.
_RECORDS = """
SELECT concat('q', doc_id) AS qa_id, doc_id AS seq, concat(source, '_2025年报') AS doc,
  CASE WHEN doc_id % 3 = 0 THEN concat('收入 ', 10000 + doc_id % 50, ' 元？') WHEN doc_id % 3 = 1 THEN concat('为何 ', doc_id % 200, ' 如何！') ELSE concat('为何', doc_id % 200, '，如何') END AS question,
  concat('是 ', 10000 + doc_id % 40, ' 元，', CASE WHEN doc_id % 8 = 0 THEN '其余材料未涉及' ELSE '如上' END) AS answer
FROM documents"""
_REVIEWS = """
SELECT concat(CASE doc_id % 2 WHEN 0 THEN ' q' ELSE '　q' END, doc_id, CASE doc_id % 3 WHEN 0 THEN ' ' ELSE ' 　' END) AS qa_id, doc_id AS line, CASE WHEN quality = 0 THEN ' 删除' WHEN toxic = 1 THEN '保留' END AS action,
  CASE WHEN doc_id % 3 = 0 THEN '' WHEN doc_id % 3 = 1 THEN '与别条重复　' ELSE '好' END AS note FROM labels"""
TEST_DOCS = ["src0_2025年报", "src1_2025年报", "src2_2025年报"]
#: Other wordings: the same, a leading one, one that may be empty.
_TRIES = """
SELECT qa_id, 1 AS try, question AS candidate FROM r UNION ALL
SELECT qa_id, 2, CASE WHEN seq % 4 < 3 THEN concat(question, answer) ELSE ' ' END FROM r UNION ALL
SELECT qa_id, 3, CASE WHEN seq % 5 < 4 THEN concat(' 请问', question) ELSE NULL END FROM r"""
PROBES = 30


def _pages(spark: SparkSession, d: str) -> DataFrame:
    return query(spark, d, _PAGED.replace("{g}", ""))


def chunk_pages(spark: SparkSession, d: str) -> DataFrame:
    out = ch.with_ids(ch.chunk(_pages(spark, d)))
    return out.select("chunk_id", "doc", "seq", "section", "page_start", "page_end", "chars", F.md5("text").alias("digest"))


def chunk_questions(spark: SparkSession, d: str) -> DataFrame:
    """Three questions a chunk with their ids, and the chunk's text looked up again."""
    chunks = ch.with_ids(ch.chunk(_pages(spark, d)))
    asked = F.transform(F.sequence(F.lit(1), (F.col("page_start") % 3 + 1).cast("int")), lambda i: F.concat(F.lit("问 "), i.cast("string")))
    qa = ch.question_ids(chunks.withColumn("questions", asked), "questions")
    return rec.with_source(qa, chunks.where("page_start % 2 = 0")).select("qa_id", "question", F.length("source_text").cast("long").alias("chars"))


def _split(spark: SparkSession, d: str) -> DataFrame:
    reviews = spark.sql(_REVIEWS.replace("FROM labels", "FROM {labels}"), labels=table(spark, d, "labels"))
    return rec.split(query(spark, d, _RECORDS), reviews, TEST_DOCS)


def final_split(spark: SparkSession, d: str) -> DataFrame:
    return _split(spark, d).select("qa_id", "pool", "kept", "reason", "leading", "half_refusal")


def eval_grid(spark: SparkSession, d: str) -> DataFrame:
    kept = _split(spark, d).where("kept")
    tries = spark.sql(_TRIES.replace("FROM r", "FROM {r}"), r=kept)
    return rec.grid(kept.where("pool = 'train'"), kept.where("pool = 'test'"), tries, PROBES)


def pool_docs(spark: SparkSession, d: str) -> DataFrame:
    """Distinct documents of the kept records whose name has '1', with their year and kind, in order."""
    kept = _split(spark, d).where("kept and contains(doc, '1')").select("doc").distinct()
    year, kind = pg.report_of(F.col("doc"))
    return kept.select("doc", year.alias("year"), kind.alias("kind"), pg.yes_no(F.col("doc").isin(*TEST_DOCS)).alias("test")).orderBy("doc")


def review_columns(spark: SparkSession, d: str) -> DataFrame:
    """A review sheet: how many cells are filled, flags in words, whether the text is cut."""
    r = table(spark, d, "labels").join(table(spark, d, "documents"), "doc_id").withColumn("note", F.expr("CASE WHEN doc_id % 3 = 0 THEN '　' WHEN doc_id % 3 = 1 THEN lang END"))
    return r.select("doc_id", pg.filled(F.col("note"), F.col("source"), F.col("text")).cast("int").alias("filled"), pg.yes_no(F.col("quality") == 1).alias("合格"), (F.length("text") >= 2000).alias("cut"))


_SYSTEM = "你是董秘\n只用\"材料\""


def _requests(rows: DataFrame) -> DataFrame:
    user = lambda kind: F.concat(F.lit(kind), F.lit("："), "text")
    for c, kind, t in (("q", "问", 0.7), ("a", "答", 0.3), ("c", "查", 0.0)):
        rows = rows.withColumn(f"{c}_request", pg.payload("m", F.lit(_SYSTEM), user(kind), F.lit(t)))
    return rows


def _cache(rows: DataFrame) -> DataFrame:
    """Stored replies of most requests; some of other answers, some within a code fence."""
    q_reply = F.to_json(F.struct(F.array(F.lit("别的"), F.concat(F.lit(" "), "question")).alias("questions")))
    a_reply = F.to_json(F.struct(F.when(F.col("doc_id") % 4 == 1, "别的").otherwise(F.col("answer")).alias("answer")))
    c_reply = F.to_json(F.struct(F.lit(2).alias("grounded"), (F.col("doc_id") % 6 == 5).alias("simplified")))
    fence = lambda x: F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("```json\n"), x, F.lit("\n```"))).otherwise(x)
    pairs = F.array(*(F.struct(pg.cache_key(F.col(f"{c}_request")).alias("key"), fence(x).alias("content")) for c, x in (("q", q_reply), ("a", a_reply), ("c", c_reply))))
    return rows.where("doc_id % 7 <> 3").select(F.explode(pairs).alias("x")).select("x.*")


def _recorded(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "text"), "doc_id").where("text is not null")
    r = r.withColumn("text", F.concat(F.col("doc_id").cast("string"), F.lit(" "), "text", F.lit("\x1b")))
    r = r.withColumn("question", F.concat(F.lit("问"), F.col("doc_id").cast("string"))).withColumn("answer", F.concat(F.lit("答"), F.col("doc_id").cast("string")))
    return _requests(r)


def cache_replay(spark: SparkSession, d: str) -> DataFrame:
    """Which records the cached replies still give."""
    r = _recorded(spark, d)
    checks = F.create_map(F.lit("grounded"), F.lit("2"), F.lit("simplified"), F.lit("false"))
    out = rec.replayed(r.withColumn("qa_id", F.col("doc_id")).withColumn("q_index", F.lit(2)).withColumn("checks", checks), _cache(r))
    return out.select("qa_id", "questions_ok", "answer_ok", "checks_ok", "all_ok")


def cache_read(spark: SparkSession, d: str) -> DataFrame:
    """Requests for answers: which have a stored reply, and which are to be sent."""
    r = _recorded(spark, d)
    found, missing = rec.read_through(r.select("doc_id", F.col("a_request").alias("request")), _cache(r))
    return found.select("key", F.lit(True).alias("cached")).unionByName(missing.select("key", F.lit(False).alias("cached")))


def search_replies(spark: SparkSession, d: str) -> DataFrame:
    """Search replies, JSON within JSON, one for ten pages: column reply."""
    null = F.lit(None).cast("string")
    p = table(spark, d, "pages").withColumn("n", F.col("page_id"))
    title = F.when(F.col("n") % 4 == 0, null).otherwise(F.concat(F.lit("年报 "), (F.lit(1990) + F.col("n") % 40).cast("string")))
    path = F.regexp_replace("url", "^https?://[^/]*", "")
    row = F.struct(
        title.alias("TITLE"), F.concat((F.col("n") % 28).cast("string"), F.lit("/08/2025 17:00")).alias("DATE_TIME"),
        F.when(F.col("n") % 3 == 0, path).when(F.col("n") % 3 == 1, "").otherwise(null).alias("FILE_LINK"),
        F.when(F.col("n") % 5 > 0, F.struct(F.col("url").alias("fileLink"))).alias("FILE_INFO"),
    )
    return p.groupBy(F.floor(F.col("n") / 10).alias("b")).agg(F.to_json(F.collect_list(row)).alias("rows")).select(F.to_json(F.struct(F.col("rows").alias("result"))).alias("reply"))


def report_list(spark: SparkSession, d: str) -> DataFrame:
    """Report links of search replies."""
    return rec.listed_reports(search_replies(spark, d), "年报", "https://b.example")


def zip_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """Records and judgements side by side, by their place."""
    jobs = table(spark, d, "labels").select("doc_id", "quality")
    return o.zipped(jobs, jobs.select("doc_id", (2 * F.col("quality")).alias("score")), "doc_id")


_RECS = f"""r0 AS ({_RECORDS}), v0 AS ({_REVIEWS}),
v AS (SELECT trim(qa_id, ' 　') AS qa_id, line, {sql.strip("coalesce(action, '')")} AS action, {sql.strip("coalesce(note, '')")} AS note FROM v0),
w AS (SELECT qa_id, CASE WHEN action IN ('删除', '改写') THEN concat('人工复核：', action, '（', CASE WHEN note = '' THEN '无备注' ELSE note END, '）') ELSE concat('人工复核备注：', note) END AS review
  FROM v WHERE action IN ('删除', '改写') OR regexp_matches(note, '删除|删掉|不宜作测试|重复|改写')),
l AS (SELECT r0.*, review, doc IN ({', '.join(map(sql.lit, TEST_DOCS))}) AS is_test, {sql.leading('question', 'answer')} AS gives, regexp_replace(question, '[^\\p{{L}}\\p{{N}}_]', '', 'g') AS k FROM r0 LEFT JOIN w ON w.qa_id = r0.qa_id),
n AS (SELECT *, coalesce(review, CASE WHEN is_test AND gives THEN '{rec.LEADING_REASON}' END) AS early FROM l),
s AS (SELECT n.*, min(CASE WHEN early IS NULL THEN seq END) OVER (PARTITION BY k) AS first FROM n),
sp AS (SELECT qa_id, seq, question, answer, CASE WHEN is_test THEN 'test' ELSE 'train' END AS pool, gives, regexp_matches(answer, '{'|'.join(q.HALF_REFUSALS)}') AS half_refusal, doc,
  coalesce(early, CASE WHEN seq > first THEN concat('与 q', first, ' 重复') END, '') AS reason FROM s)"""
_PARAGRAPHS = f"list_filter(list_transform(string_split(one.t, chr(10) || chr(10)), lambda t: {sql.strip('t')}), lambda t: t <> '')"
_PIECES = f"""CASE WHEN len({_PARAGRAPHS}) = 0 THEN [] ELSE list_reduce(list_transform({_PARAGRAPHS}, lambda t: [t]),
  lambda a, b: CASE WHEN length(a[len(a)]) + length(b[1]) <= 650 * 1.4::DOUBLE THEN list_append(a[1:len(a) - 1], concat(a[len(a)], chr(10), b[1])) ELSE list_append(a, b[1]) END) END"""
_FOLD = f"""p0 AS ({_PAGED.replace('{g}', ", 'g'")}),
p AS (SELECT *, length(text) AS n, row_number() OVER (PARTITION BY doc ORDER BY page, text) AS i FROM p0),
f AS (
  SELECT doc, 0::BIGINT AS i, NULL::STRUCT(section VARCHAR, s BIGINT, e BIGINT, t VARCHAR) AS h, []::STRUCT(section VARCHAR, s BIGINT, e BIGINT, t VARCHAR)[] AS emit FROM (SELECT DISTINCT doc FROM p)
  UNION ALL
  SELECT doc, i,
    CASE WHEN kind = 'skip' THEN h WHEN kind IN ('out', 'long') THEN NULL WHEN length(one.t) >= 650 THEN NULL ELSE one END,
    CASE WHEN kind = 'skip' THEN [] WHEN kind = 'merge' THEN CASE WHEN length(one.t) >= 650 THEN [one] ELSE [] END
      WHEN kind = 'out' THEN CASE WHEN h IS NULL THEN [] ELSE [h] END
      WHEN kind = 'long' THEN list_concat(CASE WHEN h IS NULL THEN [] ELSE [h] END, list_transform({_PIECES}, lambda t: {{'section': one.section, 's': one.s, 'e': one.e, 't': t}}))
      WHEN length(one.t) >= 650 THEN CASE WHEN h IS NULL THEN [one] ELSE [h, one] END
      WHEN h IS NULL THEN [] ELSE [h] END
  FROM (
    SELECT doc, i, h, kind, CASE WHEN kind = 'merge' THEN {{'section': h.section, 's': least(h.s, page), 'e': greatest(h.e, page), 't': {sql.strip("concat(h.t, chr(10), text)")}}}
      ELSE {{'section': section, 's': page, 'e': page, 't': text}} END AS one
    FROM (SELECT f.doc, p.i, f.h, p.page, p.section, p.text, CASE WHEN NOT regexp_matches(section, '摘要|業務回顧|业务回顾|管理層討論|管理层讨论') THEN 'out' WHEN n < 40 THEN 'skip' WHEN n > 650 * 1.7 THEN 'long'
      WHEN n < 400 AND h IS NOT NULL THEN 'merge' ELSE 'start' END AS kind FROM f JOIN p ON p.doc = f.doc AND p.i = f.i + 1) x) y),
z0 AS (SELECT doc, i, unnest(emit) AS c, generate_subscripts(emit, 1) AS j FROM f UNION ALL SELECT doc, i + 1, h, 1 FROM f WHERE h IS NOT NULL AND i = (SELECT max(i) FROM p WHERE p.doc = f.doc)),
z AS (SELECT doc, i, j, c, {sql.strip('c.t')} AS t FROM z0),
ck AS (SELECT doc, c.section, c.s, c.e, t, row_number() OVER (PARTITION BY doc ORDER BY i, j) - 1 AS seq, row_number() OVER (ORDER BY doc, i, j) - 1 AS g FROM z WHERE t <> ''),
ci AS (SELECT *, concat(doc, '_p', s, '_', format('{{:04d}}', g)) AS chunk_id FROM ck)"""


def _key(kind: str, temperature: float) -> str:
    """The key of a request: the hash of its sorted JSON, which has escapes in lower case."""
    said = lambda x: f"replace(to_json({x}), '\\u001B', '\\u001b')"
    return f"""substring(sha256(concat('{{"messages": [{{"content": ', {said(sql.lit(_SYSTEM))}, ', "role": "system"}}, {{"content": ', {said(f"concat('{kind}：', text)")},
    ', "role": "user"}}], "model": "m", "response_format": {{"type": "json_object"}}, "temperature": {temperature}}}')), 1, 32)"""


_SENT = f"""r AS (SELECT l.doc_id, concat(l.doc_id, ' ', text, chr(27)) AS text FROM labels l JOIN documents d ON d.doc_id = l.doc_id WHERE text IS NOT NULL),
k AS (SELECT doc_id, {_key('问', 0.7)} AS q, {_key('答', 0.3)} AS a, {_key('查', 0.0)} AS c FROM r)"""
_REPLIES = f"""{_SENT},
said AS (
  SELECT q AS key, concat('{{"questions": ["别的", " 问', doc_id, '"]}}') AS j, doc_id FROM k UNION ALL
  SELECT a, concat('{{"answer": "', CASE WHEN doc_id % 4 = 1 THEN '别的' ELSE concat('答', doc_id) END, '"}}'), doc_id FROM k UNION ALL
  SELECT c, concat('{{"grounded": 2, "simplified": ', doc_id % 6 = 5, '}}'), doc_id FROM k),
kept AS (SELECT key, CASE WHEN doc_id % 2 = 0 THEN concat('```json', chr(10), j, chr(10), '```') ELSE j END AS content FROM said WHERE doc_id % 7 <> 3),
cache AS (SELECT key, regexp_replace(content, '^```(json)?\\s*|\\s*```$', '', 'g')::JSON AS j FROM kept)"""

ORACLE_SQL = {
    "chunk_pages": f"WITH RECURSIVE {_FOLD} SELECT chunk_id, doc, seq, section, s AS page_start, e AS page_end, length(t) AS chars, md5(t) AS digest FROM ci",
    "chunk_questions": f"""
WITH RECURSIVE {_FOLD}, x AS (SELECT chunk_id, s, t, unnest(range(1, s % 3 + 2)) AS k FROM ci)
SELECT concat(chunk_id, '_q', k) AS qa_id, concat('问 ', k) AS question, CASE WHEN s % 2 = 0 THEN length(t) ELSE 0 END AS chars FROM x""",
    "final_split": f"WITH {_RECS} SELECT qa_id, pool, reason = '' AS kept, reason, gives AS leading, half_refusal FROM sp",
    "eval_grid": f"""
WITH {_RECS}, r AS (SELECT * FROM sp WHERE reason = ''),
pb AS (SELECT *, 'trained' AS side FROM r WHERE pool = 'train' AND NOT gives ORDER BY seq LIMIT {PROBES}),
a AS (SELECT * FROM pb UNION ALL SELECT *, 'untrained' FROM r WHERE pool = 'test'),
t AS ({_TRIES}),
c AS (SELECT a.qa_id, min_by({sql.strip('candidate')}, try) AS said FROM t JOIN a ON a.qa_id = t.qa_id
  WHERE {sql.strip("coalesce(candidate, '')")} NOT IN ('', question) AND NOT ({sql.leading('candidate', 'answer')} AND NOT gives) GROUP BY a.qa_id)
SELECT a.qa_id, concat(side, '_', way) AS cell, question, answer, CASE way WHEN 'original' THEN question ELSE said END AS question_eval
FROM a LEFT JOIN c ON c.qa_id = a.qa_id, (VALUES ('original'), ('rephrased')) w(way) WHERE said IS NOT NULL OR (side = 'untrained' AND way = 'original')""",
    "pool_docs": f"""
WITH {_RECS} SELECT DISTINCT doc, regexp_extract(doc, '(\\d{{4}})(年报|中报)', 1) AS year, regexp_extract(doc, '(\\d{{4}})(年报|中报)', 2) AS kind, CASE WHEN pool = 'test' THEN '是' ELSE '否' END AS test
FROM sp WHERE reason = '' AND contains(doc, '1')""",
    "review_columns": f"""
SELECT l.doc_id, ((l.doc_id % 3 = 1)::INT + ({sql.strip("coalesce(source, '')")} <> '')::INT + ({sql.strip("coalesce(text, '')")} <> '')::INT)::INT AS filled,
  CASE WHEN quality = 1 THEN '是' ELSE '否' END AS "合格", length(text) >= 2000 AS cut FROM labels l JOIN documents d ON d.doc_id = l.doc_id""",
    "cache_replay": f"""
WITH {_REPLIES},
x AS (
  SELECT doc_id, coalesce(trim(y.j->>'$.questions[1]') = concat('问', doc_id), false) AS questions_ok, coalesce(trim(z.j->>'$.answer') = concat('答', doc_id), false) AS answer_ok,
    coalesce(w.j->>'$.grounded' = '2' AND w.j->>'$.simplified' = 'false', false) AS checks_ok
  FROM k LEFT JOIN cache y ON y.key = k.q LEFT JOIN cache z ON z.key = k.a LEFT JOIN cache w ON w.key = k.c)
SELECT doc_id AS qa_id, *  EXCLUDE (doc_id), questions_ok AND answer_ok AND checks_ok AS all_ok FROM x""",
    "cache_read": f"WITH {_REPLIES} SELECT k.a AS key, cache.key IS NOT NULL AS cached FROM k LEFT JOIN cache ON cache.key = k.a",
    "report_list": """
WITH x AS (SELECT *, page_id AS n, regexp_replace(url, '^https?://[^/]*', '') AS path FROM pages),
y AS (SELECT *, CASE WHEN n % 4 = 0 THEN '' ELSE concat('年报 ', 1990 + n % 40) END AS title, CASE WHEN n % 3 = 0 AND path <> '' THEN path WHEN n % 5 > 0 THEN url ELSE '' END AS link FROM x)
SELECT CASE WHEN regexp_matches(title, '20\\d{2}') THEN regexp_extract(title, '20\\d{2}') ELSE 'unknown' END AS year, '年报' AS doc_type, concat(n % 28, '/08/2025 17:00') AS date, title AS title_cn,
  CASE WHEN starts_with(link, '/') THEN concat('https://b.example', link) ELSE link END AS url FROM y WHERE link <> ''""",
    "zip_verdicts": "SELECT doc_id, quality, 2 * quality AS score FROM labels",
}

QUERIES = {f.__name__: f for f in (chunk_pages, chunk_questions, final_split, eval_grid, pool_docs, review_columns, cache_replay, cache_read, report_list, zip_verdicts)}
