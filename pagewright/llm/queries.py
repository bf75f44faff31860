"""The registered queries of this subpackage, each a thin reading of its operator's output, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ball_clusters, itq, langid, licences, line_dedup, logbilinear, mixing, ngram_join, packing, quality, suffix_search, token_counts, whitening
from .shared import spread, whole_texts


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = whole_texts(spark).read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df) if name in ("documents", "pages") else df


def _remainder(of: int):
    """crc32 of the id as text (null: the text ''), modulo `of`."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % of


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_jaccard_join(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    remainder = _remainder(5)
    model = quality.fit(docs, labels.where(remainder != 0))
    out = quality.score(docs, model)
    return out.select("doc_id", (remainder == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.line_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "text", "lines_deleted")


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = _remainder(7) == 2
    out = logbilinear.score(table(spark, sf_dir, "documents"), ~held_out)
    return out.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"))


def op5_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return itq.near_vectors(table(spark, sf_dir, "embeddings")).select("vec_id", "n_links", "component_id", "kept")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.plan(table(spark, sf_dir, "documents"), blocks=64, seed=1, repeats=2.0)


def op9_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = licences.licence_scan(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "digest", "licence", F.array_join("notices", ",").alias("notices"), "notice_lines")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents (host: their source) and pages (declared language and host of their address) together."""
    docs, pages = table(spark, sf_dir, "documents"), table(spark, sf_dir, "pages")
    null = F.lit(None)
    rows = docs.select("doc_id", null.cast("long").alias("page_id"), "text", null.cast("string").alias("declared"), F.col("source").alias("host")).union(
        pages.select(null.cast("long"), "page_id", langid.page_text(F.col("html")), langid.page_language(F.col("html")), langid.page_host(F.col("url")))
    )
    return langid.identify(rows, langid.fit(docs), ["doc_id", "page_id"], declared="declared", host="host")


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ball_clusters.cluster(table(spark, sf_dir, "embeddings"), k=8, rounds=10, seed=3, dim=64)
    return out.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", F.sha2(F.array_join(F.col("centroid").cast("array<string>"), ","), 256).alias("centroid_sha256"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"), components=32)


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), size=2_048)


QUERIES = {
    "op1_ngram_jaccard": op1_ngram_jaccard,
    "op2_decontamination": op2_decontamination,
    "op3_lm_scoring": op3_lm_scoring,
    "op4_token_counts": op4_token_counts,
    "op5_embedding_near_dedup": op5_embedding_near_dedup,
    "op6_quality": op6_quality,
    "op7_line_dedup": op7_line_dedup,
    "op8_mixing": op8_mixing,
    "op9_licence_scan": op9_licence_scan,
    "op10_language_id": op10_language_id,
    "op11_centroid_clustering": op11_centroid_clustering,
    "op12_whitening": op12_whitening,
    "op13_packing": op13_packing,
}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"



def _text(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _replaced(x: str, pairs) -> str:
    for old, new in pairs:
        x = f"replace({x}, {_text(old)}, {_text(new)})"
    return x


def _canonical_lines(x: str) -> str:
    x = f"regexp_replace(replace(regexp_replace(lower({x}), {_text(licences.COPYRIGHT_LINE)}, ' ', 'g'), '&', ' and '), '[^\\p{{L}}\\p{{N}}\\n]+', ' ', 'g')"
    return _replaced(x, licences.EQUIVALENT)


def _canonical(x: str) -> str:
    """Of lines in canonical form."""
    return f"nullif(trim({_replaced(f"regexp_replace({x}, '[ \\n]+', ' ', 'g')", [p for p in licences.EQUIVALENT if ' ' in p[0].strip()])}), '')"


def _k_means(k: int, rounds: int, seed: int, dim: int) -> str:
    """Every vector against every centroid, a round after the other."""
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""a{r} AS MATERIALIZED (
  SELECT i, vec_id, x, arg_min(c, (d, c)) AS c, min(d) AS d FROM (
    SELECT v.i, v.vec_id, v.x, c.c, list_sum(list_transform(list_zip(v.x, c.x), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d FROM v, c{r} c) GROUP BY ALL)""")
        if r < rounds:
            steps.append(f"""c{r + 1} AS MATERIALIZED (
  SELECT c.c, coalesce(m.x, c.x) AS x FROM c{r} c LEFT JOIN (
    SELECT c, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY p) AS x FROM (
      SELECT c, p, sum(x) AS s, count(*) AS n FROM (SELECT c, unnest(x) AS x, generate_subscripts(x, 1) AS p FROM a{r}) GROUP BY c, p) GROUP BY c) m ON m.c = c.c)""")
    last = f"a{rounds}"
    return f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS i, vec_id, list_transform(embedding, lambda e: floor(1024 * e::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE len(embedding) = {dim} AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0),
c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY h, vec_id, x) - 1 AS c, x FROM (
    SELECT *, sha256(concat('{seed}:', vec_id)) AS h FROM v WHERE vec_id IS NOT NULL ORDER BY h, vec_id, x LIMIT {k})),
{", ".join(steps)},
t AS (SELECT c, sum(d)::BIGINT AS d FROM {last} GROUP BY c)
SELECT vec_id, a.c::INT AS cluster, a.d AS distance, t.d AS cluster_inertia, (SELECT sum(d) FROM t)::BIGINT AS inertia,
  sha256(array_to_string(z.x, ',')) AS centroid_sha256
FROM {last} a JOIN t ON t.c = a.c JOIN c{rounds} z ON z.c = a.c"""


ORACLE_SQL = {
    "op11_centroid_clustering": _k_means(k=8, rounds=10, seed=3, dim=64),
    "op1_ngram_jaccard": f"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all({_LOWER}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (
  SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END) AS g FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * c >= 80 * (x.n + y.n - c)),
r AS (SELECT doc_id, doc_id AS m FROM documents UNION SELECT r.doc_id, e.b FROM r JOIN e ON r.m = e.a)
SELECT r.doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(r.m) AS component_id
FROM r LEFT JOIN n ON n.doc_id = r.doc_id GROUP BY r.doc_id""",
    "op2_decontamination": f"""
WITH iw AS (
  SELECT CAST(item_id AS VARCHAR) AS id, regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
win AS (
  SELECT DISTINCT id, least(10, len(w)) AS k,
    unnest(list_transform(range(1, len(w) - least(10, len(w)) + 2), lambda i: array_to_string(w[i:i + least(10, len(w)) - 1], ' '))) AS g
  FROM iw WHERE len(w) > 0),
dw AS (
  SELECT doc_id, regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
pl AS (
  SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM dw, (SELECT DISTINCT k FROM win) WHERE len(w) >= k),
m AS (
  SELECT DISTINCT doc_id, p, pl.k, id FROM pl JOIN win ON win.k = pl.k AND win.g = array_to_string(w[p:p + pl.k - 1], ' ')),
h AS (SELECT doc_id, count(DISTINCT x) AS n FROM (SELECT doc_id, unnest(range(p, p + k)) AS x FROM m) GROUP BY doc_id),
i AS (SELECT doc_id, count(DISTINCT id) AS n, string_agg(DISTINCT id, ',' ORDER BY id) AS ids FROM m GROUP BY doc_id)
SELECT dw.doc_id, len(w)::BIGINT AS n_words, coalesce(h.n, 0)::BIGINT AS n_hit, coalesce(i.n, 0)::BIGINT AS n_items,
  sha256(coalesce(i.ids, '')) AS items_sha256, coalesce(h.n, 0) > 0 AS contaminated
FROM dw LEFT JOIN h ON h.doc_id = dw.doc_id LEFT JOIN i ON i.doc_id = dw.doc_id""",
    "op5_embedding_near_dedup": """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings WHERE embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
e AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.v, b.v) >= 0.95),
r AS (SELECT vec_id, vec_id AS m FROM embeddings UNION SELECT r.vec_id, e.b FROM r JOIN e ON r.m = e.a)
SELECT r.vec_id, (SELECT count(*) FROM e WHERE e.a = r.vec_id) AS n_links, min(r.m) AS component_id, r.vec_id = min(r.m) AS kept
FROM r GROUP BY r.vec_id""",
    "op7_line_dedup": """
WITH l AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS j FROM documents WHERE text IS NOT NULL),
w AS (SELECT doc_id, j, raw, array_to_string(v, ' ') AS t, len(v) AS k FROM (SELECT *, regexp_extract_all(raw, '[^\\x20\\x09-\\x0D]+') AS v FROM l)),
s AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY j) AS p FROM w WHERE k > 0),
d AS (SELECT doc_id, list(t ORDER BY p) AS ts, list(k ORDER BY p) AS ks FROM s GROUP BY doc_id),
q AS (SELECT doc_id, ts, ks, z, unnest(range(1, len(ts) - z + 2)) AS p FROM d, range(1, 9) r(z)),
r AS (
  SELECT doc_id, p, z, array_to_string(ts[p:p + z - 1], chr(10)) AS g FROM q WHERE list_sum(ks[p:p + z - 1]) >= 8
    AND (z = 1 OR list_sum(ks[p:p + z - 2]) < 8 OR list_sum(ks[p + 1:p + z - 1]) < 8)),
f AS (SELECT g, min(doc_id) AS lead FROM r GROUP BY g),
c AS (SELECT DISTINCT doc_id, unnest(range(p, p + z)) AS p FROM r JOIN f ON f.g = r.g WHERE lead < doc_id),
m AS (
  SELECT w.doc_id, w.j, w.raw, CASE WHEN w.k > 0 THEN c.p IS NULL END AS stays FROM w LEFT JOIN s ON s.doc_id = w.doc_id AND s.j = w.j
    LEFT JOIN c ON c.doc_id = s.doc_id AND c.p = s.p WHERE w.doc_id IN (SELECT doc_id FROM c)),
n AS (
  SELECT doc_id, j, raw, coalesce(stays, coalesce(last_value(stays IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY j ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), false)
    OR coalesce(first_value(stays IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY j ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), false)) AS stays FROM m),
o AS (SELECT doc_id, coalesce(string_agg(raw, chr(10) ORDER BY j) FILTER (stays), '') AS text, (count(*) FILTER (NOT stays))::INT AS lines_deleted FROM n GROUP BY doc_id)
SELECT x.doc_id, CASE WHEN o.doc_id IS NULL THEN x.text ELSE o.text END AS text, coalesce(lines_deleted, 0)::INT AS lines_deleted
FROM documents x LEFT JOIN o ON o.doc_id = x.doc_id""",
    "op8_mixing": """
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS n FROM documents),
s AS (SELECT source, sum(n)::BIGINT AS tokens FROM d GROUP BY source),
p AS (SELECT source, tokens, tokens / sum(tokens) OVER () AS p, sum(tokens) OVER () AS total FROM s),
x AS (SELECT greatest(0, 1 - ln(2) / nullif(ln(max(p) / min(p)), 0)) AS t, max(p) AS most FROM p WHERE p > 0),
b AS (SELECT source, tokens, CASE WHEN p > 0 THEN round(total * pow(p, coalesce(t, 0)) * pow(x.most, 1 - coalesce(t, 0))) ELSE 0 END::BIGINT AS most FROM p, x),
u AS (
  SELECT doc_id, d.source, n, tokens, most, unnest(range(0, CASE WHEN tokens > 0 THEN ceil(most / tokens) ELSE 1 END::BIGINT)) AS pass
  FROM d JOIN b ON b.source = d.source),
o AS (
  SELECT *, pass * tokens + coalesce(sum(n) OVER (PARTITION BY source, pass ORDER BY md5(concat('1|', pass, '|', doc_id)), doc_id
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM u)
SELECT doc_id, source, pass::INT AS pass, CASE WHEN tokens = 0 THEN 0 ELSE least(63, floor(start * 64 / most)) END::INT AS block, n AS n_tokens
FROM o WHERE start < most OR tokens = 0 OR (n = 0 AND pass = 0)""",
    "op9_licence_scan": f"""
WITH t AS (SELECT licence, {_canonical(_canonical_lines('t'))} AS t FROM (VALUES {', '.join(f"({_text(x)}, {_text(t)})" for x, t in licences.known_texts())}) v(licence, t)),
k AS (SELECT md5(t) AS digest, min(licence) AS licence FROM t GROUP BY 1),
a AS (SELECT digest, min(licence) AS licence FROM (SELECT * FROM k UNION ALL VALUES {', '.join(f"({_text(d)}, {_text(x)})" for x, d in licences.FULL_DIGESTS)}) u(digest, licence) GROUP BY 1),
d AS (SELECT row_number() OVER () AS i, doc_id, {_canonical_lines('text')} AS lines FROM documents),
w AS (SELECT i, doc_id, lines, md5({_canonical('lines')}) AS digest FROM d),
l AS (SELECT i, md5(trim(line)) AS digest FROM (SELECT i, unnest(string_split(lines, chr(10))) AS line FROM d)),
n AS (SELECT i, count(*) AS lines, array_to_string(list_sort(list_distinct(list(licence))), ',') AS notices FROM l JOIN k ON k.digest = l.digest GROUP BY i)
SELECT doc_id, w.digest, a.licence, coalesce(notices, '') AS notices, coalesce(n.lines, 0)::INT AS notice_lines
FROM w LEFT JOIN a ON a.digest = w.digest LEFT JOIN n ON n.i = w.i""",
}
