"""The text rules as SQL for an independent engine, from the same fixed values."""

from __future__ import annotations

from ..functions import figures as fg
from ..functions import pages as pg
from ..functions import quotes as q
from ..functions import text as tx


# The rules that the SQL checks are written out here, and not taken from the engine's columns.
_GAP = r"[\x{9}-\x{D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]*"
NUMBER = r"\p{Nd}+(?:,\p{Nd}{3})*(?:\.\p{Nd}+)?"
TELLING = r"\p{Nd}[\p{Nd},]*(?:\.\p{Nd}+)?%?"
FIGURE = rf"(\p{{Nd}}[\p{{Nd}},]*(?:\.\p{{Nd}}+)?){_GAP}(百万元|亿元|万元|千元|元|%)"
PAGES = rf"第{_GAP}(\p{{Nd}}{{1,4}}){_GAP}(?:[-–~～至]{_GAP}(\p{{Nd}}{{1,4}}){_GAP})?页"
BARE = rf"依据[:：]{_GAP}([^。；\n]{{1,90}})"
BLOCK, TITLE, QUOTE = "【([^】]{0,300})】", "《([^》]{1,80})》", "「([^」]{0,600})」"
LOOSE_TITLE = "([一-鿿A-Za-z0-9_]{2,40}?(?:年报|中报))"
ELLIPSIS = r"…+|\.{3,}|·{3,}|。{3,}|\*{3,}"


def lit(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def strip(x: str) -> str:
    return f"regexp_replace({x}, {lit(f'^[{tx.SPACE}]+|[{tx.SPACE}]+$')}, '', 'g')"


def squeeze(x: str) -> str:
    return f"regexp_replace(coalesce({x}, ''), {lit(f'[{tx.SPACE}]+')}, '', 'g')"


_MARKS = "".join(dict.fromkeys(q.PUNCTUATION)).replace("\x00", "")


def bare(x: str) -> str:
    return f"translate(coalesce({x}, ''), {lit(_MARKS)}, '')"


def simple(x: str) -> str:
    pairs = {a: b for a, b in zip(q.TRADITIONAL, q.SIMPLIFIED) if a != b}
    return f"translate(coalesce({x}, ''), '{''.join(pairs)}', '{''.join(pairs.values())}')"


def narrow(x: str) -> str:
    return f"translate({x}, '{tx.WIDE}', '{tx.NARROW}')"


def every(x: str, pattern: str, group: int = 0) -> str:
    return f"regexp_extract_all(coalesce({x}, ''), {lit(pattern)}, {group})"


def lines(x: str) -> str:
    return f"string_split_regex(coalesce({x}, ''), {lit(tx.LINE_END)})"


def clean(x: str) -> str:
    kept = f"list_filter(list_transform({lines(x)}, lambda x: regexp_replace(x, {lit(f'[{tx.SPACE}]+$')}, '')), lambda x: x <> '' AND NOT regexp_matches(x, {lit(pg.PAGE_NUMBER)}))"
    return strip(f"regexp_replace(array_to_string({kept}, chr(10)), '[ \\t]{{2,}}', ' ', 'g')")


def numbers(x: str) -> str:
    plain = f"replace({narrow('x')}, ',', '')"
    found = f"list_transform({every(x, NUMBER)}, lambda x: CASE WHEN contains({plain}, '.') THEN regexp_replace({plain}, '\\.?0*$', '') ELSE {plain} END)"
    return f"list_sort(list_distinct(list_filter({found}, lambda x: length(replace(x, '.', '')) >= 3)))"


def big(x: str) -> str:
    found = f"list_transform({every(x, TELLING)}, lambda x: replace(x, ',', ''))"
    return f"list_sort(list_distinct(list_filter({found}, lambda x: (suffix(x, '%') AND length(x) >= 4) OR regexp_full_match(x, {lit(tx.DIGIT + '{5,}')}))))"


def leading(question: str, answer: str) -> str:
    return f"list_has_any({big(question)}, {big(answer)})"


def unmarked(x: str) -> str:
    return f"regexp_replace(coalesce({x}, ''), '【[^】]*】|[「」]', '', 'g')"


def figures(x: str) -> str:
    t = f"translate(coalesce({x}, ''), '{fg.TRADITIONAL}', '{fg.SIMPLIFIED}')"
    value = f"TRY_CAST(replace({narrow('x[1]')}, ',', '') AS DOUBLE)"
    scale = " ".join(f"WHEN '{u}' THEN {s!r}" for u, s in fg.SCALE.items())
    one = f"{{'k': CASE WHEN x[2] = '%' THEN 'pct' ELSE 'yuan' END, 'v': CASE WHEN x[2] = '%' THEN format('{{:.2f}}', {value})::DOUBLE ELSE {value} * CASE x[2] {scale} END END}}"
    return f"list_distinct(list_transform(list_zip({every(t, FIGURE, 1)}, {every(t, FIGURE, 2)}), lambda x: {one}))"


def matched(ref: str, pred: str) -> str:
    near = "CASE WHEN r.k = 'pct' THEN abs(r.v - p.v) <= 0.05 ELSE abs(r.v - p.v) <= greatest(abs(r.v), abs(p.v)) * 0.01 END"
    return f"list_filter({ref}, lambda r: len(list_filter({pred}, lambda p: p.k = r.k AND {near})) > 0)"


NUM = f"""f AS (SELECT qa_id, {figures(unmarked('answer'))} AS rs, {figures(unmarked('prediction'))} AS ps, {figures(unmarked('question'))} AS asked FROM grid),
h AS (SELECT qa_id, rs, asked, {matched('rs', 'ps')} AS hs FROM f),
e AS (SELECT qa_id, rs, hs, {matched('hs', 'asked')} AS es FROM h),
num AS (SELECT qa_id, len(rs) AS n, len(hs) AS hit, len(es) AS echo, len(hs) - len(es) AS net, format('{{:.3f}}', len(hs) / len(rs)::DOUBLE)::DOUBLE AS ratio, format('{{:.3f}}', (len(hs) - len(es)) / len(rs)::DOUBLE)::DOUBLE AS net_ratio,
  array_to_string(list_sort(list_transform(list_filter(rs, lambda x: NOT list_contains(hs, x)), lambda x: CASE WHEN x.k = 'pct' THEN concat(format('{{:g}}', x.v), '%') ELSE concat(format('{{:,}}', x.v::BIGINT), ' 元') END)), '、') AS missing
  FROM e WHERE len(rs) > 0)"""


def citations(rows: str, key: str, answer: str) -> str:
    """cite: key, cites, raw, docs, pages of a table's answers."""
    found = f"list_concat({every(answer, BLOCK, 1)}, {every(f'regexp_replace({answer}, {lit(BLOCK)}, {lit(chr(32))}, {lit(chr(103))})', BARE, 1)})"
    number = lambda x: f"TRY_CAST({narrow(x)} AS INT)"
    return f"""raw AS (SELECT {key}, unnest({found}) AS c, generate_subscripts({found}, 1) AS i FROM {rows}),
part AS (
  SELECT {key}, i, {strip('c')} AS raw, CASE WHEN regexp_matches(c, {lit(TITLE)}) THEN {every('c', TITLE, 1)} ELSE {every('c', LOOSE_TITLE, 1)} END AS docs,
    list_transform(list_zip({every('c', PAGES, 1)}, {every('c', PAGES, 2)}), lambda x: {{'lo': {number('x[1]')}, 'hi': {number("CASE WHEN coalesce(x[2], '') = '' THEN x[1] ELSE x[2] END")}}}) AS pages FROM raw),
cite AS (
  SELECT g.{key}, count(i) AS cites, coalesce(substring(string_agg(raw, '；' ORDER BY i) FILTER (i IS NOT NULL), 1, 120), '') AS raw,
    coalesce(flatten(list(docs ORDER BY i) FILTER (i IS NOT NULL)), []) AS docs, coalesce(flatten(list(pages ORDER BY i) FILTER (i IS NOT NULL)), []) AS pages
  FROM {rows} g LEFT JOIN (SELECT * FROM part WHERE len(docs) > 0 OR len(pages) > 0) p ON p.{key} = g.{key} GROUP BY g.{key})"""


_SAID = "[" + ", ".join(map(lit, q.REFUSALS)) + "]"


def quotes(x: str) -> str:
    refuses = f"{bare('x')} <> '' AND len(list_filter({_SAID}, lambda r: contains({bare('x')}, r) OR contains(r, {bare('x')}))) > 0"
    return f"list_filter(list_transform({every(x, QUOTE, 1)}, lambda x: {strip('x')}), lambda x: x <> '' AND NOT ({refuses}))"


def verdicts(rows: str, key: str, answer: str, pages: str) -> str:
    """v: key, pos, worst, first of each quotation; pl: its places (key, pos, doc, page)."""
    return f"""quo AS (SELECT {key}, unnest(qs) AS quote, generate_subscripts(qs, 1) AS pos FROM (SELECT {key}, {quotes(answer)} AS qs FROM {rows})),
seg0 AS (SELECT {key}, pos, unnest(ss) AS seg, generate_subscripts(ss, 1) AS s FROM (SELECT {key}, pos, list_filter(list_transform(string_split_regex(quote, {lit(ELLIPSIS)}), lambda x: {strip('x')}), lambda x: length({bare('x')}) >= 6) AS ss FROM quo)),
pg AS (SELECT doc, page, {squeeze('text')} AS t1, {bare('text')} AS t2, {bare(simple('text'))} AS t3 FROM {pages}),
sg AS (SELECT DISTINCT seg, {squeeze('seg')} AS n1, {bare('seg')} AS n2, {bare(simple('seg'))} AS n3 FROM seg0),
hit0 AS (SELECT seg, doc, page, CASE WHEN contains(t2, n2) AND contains(t1, n1) THEN 0 WHEN contains(t2, n2) THEN 1 ELSE 2 END AS level FROM sg JOIN pg ON contains(t3, n3)),
best AS (SELECT seg, min(level) AS best FROM hit0 GROUP BY seg),
hit AS (SELECT hit0.* FROM hit0 JOIN best ON best.seg = hit0.seg WHERE level <= 1 OR best = 2),
v AS (SELECT {key}, pos, max(coalesce(best, 3)) AS worst, first(seg0.seg ORDER BY s) AS first FROM seg0 LEFT JOIN best ON best.seg = seg0.seg GROUP BY {key}, pos),
pl AS (SELECT DISTINCT {key}, pos, doc, page FROM seg0 JOIN hit ON hit.seg = seg0.seg)"""


SCORED = f"""{citations('grid', 'qa_id', 'prediction')}, {verdicts('grid', 'qa_id', 'prediction', 'pages_')},
oc AS (SELECT DISTINCT pl.qa_id, pos FROM pl JOIN cite ON cite.qa_id = pl.qa_id JOIN grid g ON g.qa_id = pl.qa_id WHERE pl.doc = g.doc AND len(list_filter(cite.pages, lambda s: pl.page BETWEEN s.lo AND s.hi)) > 0),
os AS (SELECT DISTINCT pl.qa_id, pos FROM pl JOIN grid g ON g.qa_id = pl.qa_id WHERE pl.doc = g.doc AND pl.page = g.page),
vq AS (SELECT v.qa_id, count(*) AS quotes, count(*) FILTER (worst < 2) AS exact, count(*) FILTER (worst = 2) AS script, count(*) FILTER (worst = 3) AS missing, count(oc.pos) AS on_cited, count(os.pos) AS on_source,
  substring(first(first ORDER BY v.pos) FILTER (worst = 3), 1, 60) AS first_missing FROM v LEFT JOIN oc ON oc.qa_id = v.qa_id AND oc.pos = v.pos LEFT JOIN os ON os.qa_id = v.qa_id AND os.pos = v.pos GROUP BY v.qa_id),
cs AS (SELECT g.qa_id, cite.raw AS cites, (len(cite.docs) > 0 AND len(list_filter(cite.docs, lambda x: x <> g.doc)) = 0)::INT AS doc_ok, (len(list_filter(cite.pages, lambda s: s.lo - 1 <= g.page AND g.page <= s.hi + 1)) > 0)::INT AS page_ok,
  (coalesce(quotes, 0) > 0 AND exact = quotes)::INT AS quotes_ok, {', '.join(f'coalesce({c}, 0)::BIGINT AS {c}' for c in ('quotes', 'exact', 'script', 'missing', 'on_cited', 'on_source'))}, coalesce(first_missing, '') AS first_missing
  FROM grid g JOIN cite ON cite.qa_id = g.qa_id LEFT JOIN vq ON vq.qa_id = g.qa_id)"""
FORMAT = f"regexp_matches(prediction, '【依据[:：]')::INT + (len({quotes('prediction')}) > 0)::INT"


def bm25(name: str, terms: str, k: int, docs: str) -> str:
    """name: query_id, doc_id, score, rank.  Only the queries' terms are counted in documents."""
    if terms == "bigram":
        letters = "string_split(regexp_replace(coalesce(text, ''), '[^\\p{L}\\p{N}\\p{M}_]', '', 'g'), '')"
        cut = lambda t: f"list_transform(list_zip({t}[1:len({t}) - 1], {t}[2:]), lambda x: concat(x[1], x[2]))"
        rows = lambda i, of: f"SELECT id, CASE WHEN len(t) < 2 THEN [] ELSE {cut('t')} END AS w FROM (SELECT {i} AS id, {letters} AS t FROM {of})"
    else:
        cut = "list_filter(string_split(regexp_replace(lower(coalesce(text, '')), '[^\\p{L}\\p{N}_]+', ' ', 'g'), ' '), lambda x: x <> '')"
        rows = lambda i, of: f"SELECT {i} AS id, {cut} AS w FROM {of}"
    return f"""{name}_t AS MATERIALIZED ({rows('doc_id', docs)}),
{name}_q AS MATERIALIZED (SELECT query_id, w, count(*) AS c FROM (SELECT id AS query_id, unnest(w) AS w FROM ({rows('item_id', 'benchmark')})) GROUP BY query_id, w),
{name}_s AS (SELECT count(*) AS n, sum(len(w)) / count(*) AS a FROM {name}_t),
{name}_f AS MATERIALIZED (SELECT doc_id, u.w, any_value(size) AS size, count(*) AS f FROM (SELECT id AS doc_id, unnest(w) AS w, len(w) AS size FROM {name}_t) u SEMI JOIN {name}_q q ON q.w = u.w GROUP BY doc_id, u.w),
{name}_d AS (SELECT w, count(*) AS df FROM {name}_f GROUP BY w),
{name}_p AS (SELECT query_id, f.doc_id, sum(c * ln(1 + (n - df + 0.5) / (df + 0.5)) * f * 2.5 / (f + 1.5 * (0.25 + 0.75 * size / a))) AS score
  FROM {name}_q q JOIN {name}_f f ON f.w = q.w JOIN {name}_d x ON x.w = q.w, {name}_s GROUP BY query_id, f.doc_id),
{name} AS (SELECT query_id, doc_id, score, rank FROM (SELECT item_id AS query_id, d.doc_id, round(coalesce(score, 0), 6) AS score, row_number() OVER (PARTITION BY item_id ORDER BY round(coalesce(score, 0), 10) DESC, d.doc_id DESC) AS rank
  FROM benchmark b CROSS JOIN {docs} d LEFT JOIN {name}_p p ON p.query_id = item_id AND p.doc_id = d.doc_id) WHERE rank <= {k})"""
