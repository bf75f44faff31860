"""Literal cases of the text functions, and the order operators against plain Python."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from pagewright.functions import figures as fg
from pagewright.functions import pages as pg
from pagewright.functions import quotes as q
from pagewright.functions import text as tx
from pagewright.operators import chunks, degenerate, locate, ordering, records, retrieval, scoring


@pytest.fixture(scope="module")
def value(spark):
    one = spark.createDataFrame([(1,)], "x int")
    return lambda c: one.select(c.alias("v")).first().v


def test_numbers(value):
    assert value(fg.numbers_in(F.lit("第 12 页 1,234"))) == ["1234"]
    assert value(fg.numbers_in(F.lit("100 和 1.50 与 2.500"))) == ["100"]
    assert value(fg.numbers_in(F.lit(None).cast("string"))) == []
    assert value(fg.numbers_in(F.lit("１２３４ 与 １,２３４．５"))) == ["1234"]
    assert value(fg.big_numbers(F.lit("2025 年 12345 辆 8.5% 7% 2,025 99999999999999999999"))) == ["12345", "8.5%", "99999999999999999999"]


def test_figures(value):
    figures = lambda t: {(f.kind, f.value) for f in value(fg.key_figures(F.lit(t)))}
    assert figures("2,760,242 千元") == {("yuan", 2760242000.0)}
    assert figures("12.345%，2025") == {("pct", 12.34)} or figures("12.345%，2025") == {("pct", 12.35)}
    assert figures("1.5 億元") == {("yuan", 1.5e8)}
    assert figures("１２３４万元　和 １２．５　%") == {("yuan", 12340000.0), ("pct", 5.0)} and figures("１２.５　%") == {("pct", 12.5)}
    texts = {99.5: "99.5%", 12345.67: "12345.7%", 0.1: "0.1%", 1234567.0: "1.23457e+06%", 100.0: "100%", 0.0: "0%", 999999.9: "1e+06%"}
    for x, want in texts.items():
        assert value(fg.figure_text(F.struct(F.lit("pct").alias("kind"), F.lit(x).alias("value")))) == want == f"{x:g}%"
    match = fg.match_figures(fg.key_figures(F.lit("106,683,100 千元")), fg.key_figures(F.lit("1,066.8 亿元")))
    assert len(value(match)) == 1
    near = fg.match_figures(fg.key_figures(F.lit("8.50%")), fg.key_figures(F.lit("8.56% 8.5 元")))
    assert value(near) == []
    assert value(scoring.numeric_score(F.lit("1 亿元"), F.lit("没有"), F.lit(""))) is None
    s = value(scoring.numeric_score(F.lit("1 亿元，20%"), F.lit("1.001 亿元，20%，7 元"), F.lit("涨了 20% 吗")))
    assert (s.n, s.hit, s.echo, s.net, s.ratio, s.net_ratio, s.missing) == (3, 2, 1, 1, 0.667, 0.333, "7 元")


def test_leading(value):
    assert value(fg.is_leading(F.lit("收入 12345 吗"), F.lit("是 12,345")))
    assert not value(fg.is_leading(F.lit("2025 年呢"), F.lit("2025 年")))


def test_unsupported_numbers(value):
    x = value(fg.unsupported_numbers(F.lit("共 1,234 元，又 500「700 与 88」「1234」【第 999 页】"), F.lit("一二 1234.0")))
    assert (x.quoted, x.body) == (["700"], ["500"])


def test_white_space_and_digits_of_any_script(value):
    assert value(q.quotes(F.lit("「　真的引文\n」"))) == ["真的引文"]
    c = value(q.citations(F.lit("【　依据：《甲》第　１２～１４　页\u2009】")))
    assert [(x.raw, [(p.lo, p.hi) for p in x.pages]) for x in c] == [("依据：《甲》第　１２～１４　页", [(12, 14)])]
    assert value(pg.clean_page(F.lit("\u3000第　３　页\fx  y\u3000\x0b- 12 -\u2028z"))) == "x y\nz"
    assert value(pg.is_table(F.lit("a\n\u3000\nb\u2028c\f１２"))) is False and value(pg.is_table(F.lit("a\x0bb\f３　\n１２"))) is True
    assert value(tx.stripped(F.lit("\u3000\x1f x \u00a0"))) == "x" and value(q.squeezed(F.lit("a\u2009b\x1cc"))) == "abc"
    assert value(q.simplified(F.lit("營業額與車"))) == "营业额与车"
    assert value(pg.filled(F.lit("　"), F.lit(None).cast("string"), F.lit("x"))) == 1 and value(pg.yes_no(F.lit(None).cast("boolean"))) == "否"
    f = value(q.format_flags(F.lit("【依据 為")))
    assert (f.cite, f.quote, f.simple, f.chars) == (True, False, False, 5)


def test_quotes(value):
    assert value(q.quotes(F.lit("「材料未涉及」「材料」「 」「真的引文」"))) == ["真的引文"]
    assert value(q.segments(F.lit("本公司……截至二零二五年末…… 现金及等价物"))) == ["截至二零二五年末", "现金及等价物"]
    assert value(q.short_segments(F.lit("本公司……截至二零二五年末"))) == 1
    c = value(q.citations(F.lit("【注】【依据：《甲》第 5-7 页】依据：乙_2025年报 第 6 页。")))
    assert [(x.docs, [(p.lo, p.hi) for p in x.pages]) for x in c] == [(["甲"], [(5, 7)]), (["乙_2025年报"], [(6, 6)])]
    assert value(q.format_score(F.lit("依据：《A》第 5 页"))) == 0 and value(q.format_score(F.lit("【依据：A】「原文在此」"))) == 2
    assert value(q.squeezed(F.lit("a　b\n c"))) == "abc" and value(q.bare(F.lit("「a，b」…c"))) == "abc"
    assert value(q.without_marks(F.lit("x【y】「z」"))) == "xz"


def test_pages(value):
    assert value(pg.clean_page(F.lit(" 第 3 页 \na  b \n\n-12-\nc\t\td"))) == "a b\nc d"
    assert not value(pg.is_table(F.lit("a\nb\nc\n1"))) and value(pg.is_table(F.lit("a\nb\n(2)\n1")))
    year, kind = pg.report_of(F.lit("甲_2025年报"))
    assert (value(year), value(kind), value(pg.report_of(F.lit("x"))[0])) == ("2025", "年报", "unknown")
    request = json.dumps({"model": "m", "messages": [{"role": "system", "content": 'a"\n'}, {"role": "user", "content": "问"}], "temperature": 0.7, "response_format": {"type": "json_object"}}, ensure_ascii=False, sort_keys=True)
    built = pg.payload("m", F.lit('a"\n'), F.lit("问"), F.lit(0.7))
    assert value(built) == request and value(pg.cache_key(built)) == hashlib.sha256(request.encode()).hexdigest()[:32]
    assert value(pg.context(F.array(pg.passage(F.lit("甲"), F.lit(3), F.lit("x")), F.lit("y" * 9000)))) == ("【甲 第 3 页】\nx\n\n" + "y" * 9000)[:6000]
    assert value(pg.html_text(F.lit("<p>a<script>b</p></script>c</P>d<br/>e<!-- f -->"))).split("\n") == [" a c", "d", "e "]
    assert value(pg.json_part(F.lit('```json\n{"a": 1}\n```'))) == '{"a": 1}'
    assert value(pg.json_part(F.lit('so: {"a": 1} ok'))) == '{"a": 1}' and value(pg.json_part(F.lit("none"))) is None
    assert value(pg.masked_labels(F.array(F.lit(1), F.lit(2)), F.array(F.lit(7)))) == [-100, -100, 7]


def test_chunks(spark):
    long = "\n\n".join(["p" * 500, "q" * 500, "r" * 200])
    rows = [(1, "摘要", "a" * 500), (2, "摘要", "b" * 100), (3, "摘要", "c" * 39), (4, "其他", "d" * 500), (5, "摘要", long), (6, "摘要", "e" * 700)]
    got = chunks.chunk(spark.createDataFrame([("r", *x) for x in rows], "doc string, page long, section string, text string"), "摘要").orderBy("seq").collect()
    assert [(r.page_start, r.page_end, r.chars) for r in got] == [(1, 2, 601), (5, 5, 500), (5, 5, 701), (6, 6, 700)]


def test_ordering(spark):
    keys = [5, 4096, 4097, 9000, 123456789, 7, 8, 50000]
    df = spark.createDataFrame([(k, f"v{k}") for k in keys], "k long, v string")
    rank = {k: i for i, k in enumerate(sorted(keys))}
    assert {r.k: (r.i, r.n) for r in ordering.numbered(df, "k").collect()} == {k: (i, len(keys)) for k, i in rank.items()}
    assert sorted(r.k for r in ordering.stride_sample(df, "k", 3).collect()) == [sorted(keys)[int(j * len(keys) / 3)] for j in range(3)]
    turned = {r.k: r.rotated for r in ordering.rotated(df, "k", "v", by=3).collect()}
    assert all(turned[k] == f"v{sorted(keys)[(rank[k] + 3) % len(keys)]}" for k in keys)
    t = spark.createDataFrame([("a", 1, 1), ("A!", 0, 2), ("b", 3, 3), (None, 5, 4)], "t string, o int, x int")
    assert sorted(r.x for r in ordering.first_wins(t, F.lower("t"), "o").collect()) == [2, 3, 4]
    picked = ordering.stratified(spark.range(100).withColumn("s", F.col("id") % 10 == 0), "s", "id", 20).groupBy("s").count().collect()
    assert {r.s: r["count"] for r in picked} == {True: 2, False: 18}
    strata = spark.createDataFrame([(i, "abcde"[min(i // 5, 4)]) for i in range(21)], "id long, s string")  # of 5, 5, 5, 5 and 1
    assert ordering.stratified(strata, "s", "id", 2).count() == 2 and ordering.stratified(strata, "s", "id", 99).count() == 21
    arms = spark.createDataFrame([("b",), ("z",), ("a",), ("y",)], "arm string")
    assert [r.arm for r in ordering.in_order(arms, "arm", ["z", "q", "b"]).collect()] == ["z", "b", "a", "y"]
    two = ordering.zipped(spark.createDataFrame([(5, "x"), (9, "y")], "k long, a string"), spark.createDataFrame([(70, 1), (71, 2)], "k long, b int"), "k")
    assert sorted(map(tuple, two.collect())) == [(5, "x", 1), (9, "y", 2)]


def test_asof(spark):
    left = spark.createDataFrame([("d", 1), ("d", 3), ("d", 9), ("e", 1)], "doc string, page long")
    toc = spark.createDataFrame([("d", 2, "first", 0), ("d", 3, "x", 1), ("d", 3, "last listed", 2)], "doc string, page long, title string, pos long")
    got = {(r.doc, r.page): r.title for r in ordering.asof(left, toc, ["doc"], "page", "title", "pos", "（无章节）").collect()}
    assert got == {("d", 1): "（无章节）", ("d", 3): "last listed", ("d", 9): "last listed", ("e", 1): "（无章节）"}


def test_location(spark):
    pages = spark.createDataFrame([(1, "The quick, brown fox jumps over the lazy dog; twice."), (2, "the quick brown fox"), (3, None), (4, "本頁營業額為 12 萬元"), (5, "abc abcabc")], "p long, text string")
    segs = [(1, "quick, brown"), (2, "quick brown fox"), (3, "fox jumps over the lazy dog twice"), (4, "absent text"), (5, "营业额为12万元"), (6, "營業額"), (7, "bc"), (8, "，。"), (9, None), (10, "x")]
    got = locate.locate(spark.createDataFrame(segs, "k long, s string"), pages, "k", "s", "p", "text").select("k", "p", "band").collect()
    want = [(1, 1, "逐字"), (1, 2, "去标点"), (2, 1, "去标点"), (2, 2, "逐字"), (3, 1, "去标点"), (5, 4, "繁简"), (6, 4, "逐字"), (7, 5, "逐字"), (10, 1, "逐字"), (10, 2, "逐字")]
    assert sorted(map(tuple, got)) == want


def test_identity_scores_full_and_rotation_low(spark):
    """Answers as their own predictions score in full; other answers score low."""
    rows = [(f"q{i}", f"r{i}_2025年报", i, "问？", f"收入 {i * 1000 + 7} 元。「第{i}页的原文内容{i * i}」【依据：《r{i}_2025年报》第 {i} 页】") for i in range(1, 40)]
    g = spark.createDataFrame(rows, "qa_id string, doc string, page long, question string, answer string").withColumn("prediction", F.col("answer"))
    pages = spark.createDataFrame([(r[1], r[2], f"开头 第{r[2]}页的 原文内容{r[2] * r[2]} 结尾") for r in rows], "doc string, page long, text string")
    same = scoring.scored(g, pages).agg(F.avg("citation").alias("c"), F.avg("num.ratio").alias("n")).first()
    assert (same.c, same.n) == (3.0, 1.0)
    turned = ordering.rotated(g.withColumn("i", F.col("page")).withColumnRenamed("i", "k"), "k", "answer").drop("prediction").withColumnRenamed("rotated", "prediction")
    other = scoring.scored(turned, pages).agg(F.avg("doc_ok").alias("d"), F.avg("num.ratio").alias("n")).first()
    assert other.d == 0 and other.n < 0.5


def test_retrieval_and_repetition(spark):
    docs = spark.createDataFrame([(1, "abab"), (2, "abab"), (3, "zz"), (4, None)], "doc_id long, text string")
    got = retrieval.bm25(spark.createDataFrame([(7, "ab")], "query_id long, text string"), docs, 3).orderBy("rank").collect()
    assert [r.doc_id for r in got] == [2, 1, 4] and got[2].score == 0  # ties: the larger id first; zeros fill up
    rows = lambda f, t: [f(t)[1].tolist(), len(set(f(t)[0].tolist()))]
    assert rows(retrieval.bigrams, ["a", "a，b c", None, "bc"]) == [[1, 1, 3], 2]
    assert rows(retrieval.words, ["Ab ab,c_1", "", "c_1 Cab ba"]) == [[0, 0, 0, 2, 2, 2], 4]
    most = degenerate.most_repeated(spark.createDataFrame([(1, "abcd" * 3), (2, "abc"), (3, None), (4, " \u3000"), (5, " a ")], "doc_id long, text string"), 4)
    assert {r.doc_id: r.most for r in most.collect()} == {1: 3, 2: 1, 3: 0, 4: 0, 5: 1}
    one = spark.createDataFrame([(1, 10, 1), (1, 11, 2)], "query_id long, doc_id long, rank int")
    two = spark.createDataFrame([(1, 12, 1), (1, 11, 2)], "query_id long, doc_id long, rank int")
    assert [r.doc_id for r in retrieval.fused([one, two], 3).orderBy("rank").collect()] == [11, 10, 12]


def test_pieces(value):
    assert value(chunks.pieces(F.lit("a" * 10 + "\n\n" + "b" * 10), 10)) == ["a" * 10, "b" * 10]
    assert value(chunks.pieces(F.lit("a\n\n \n\nb\nc\n\n" + "d" * 9), 5)) == ["a\nb\nc", "d" * 9]


def test_chunk_ids(spark):
    rows = [("b", 1, "摘要", "x" * 700), ("a", 2, "摘要", "y" * 700), ("a", 3, "摘要", "z" * 700)]
    got = chunks.with_ids(chunks.chunk(spark.createDataFrame(rows, "doc string, page long, section string, text string")))
    assert sorted(r.chunk_id for r in got.collect()) == ["a_p2_0000", "a_p3_0001", "b_p1_0002"]
    asked = chunks.question_ids(got.withColumn("qs", F.array(F.lit("甲"), F.lit("乙"))), "qs").where("chunk_id = 'b_p1_0002'")
    assert sorted(map(tuple, asked.collect())) == [("b_p1_0002", "b_p1_0002_q1", "甲"), ("b_p1_0002", "b_p1_0002_q2", "乙")]
    found = records.with_source(asked, got.where("doc = 'a'"))
    assert {r.source_text for r in found.collect()} == {""}


def test_records(spark):
    recs = [("1", 1, "t", "多少 12345？", "12,345 元"), ("2", 2, "d", "多少 12345！", "12345"), ("3", 3, "d", "多少，12345", "x"), ("4", 4, "d", "另", "材料未提及"), ("5", 5, "d", "再", "y"), ("6", 6, "t", "新", "z")]
    reviews = [("4", 1, " 删除", None), ("4", 2, "保留", "可"), (" 5 ", 1, None, "内容重复 "), ("6", 1, "保留", "")]
    out = records.split(spark.createDataFrame(recs, "qa_id string, seq int, doc string, question string, answer string"), spark.createDataFrame(reviews, "qa_id string, line int, action string, note string"), ["t"])
    got = {r.qa_id: (r.pool, r.reason, r.half_refusal) for r in out.collect()}
    assert got == {
        "1": ("test", records.LEADING_REASON, False), "2": ("train", "", False), "3": ("train", "与 2 重复", False),
        "4": ("train", "人工复核：删除（无备注）", True), "5": ("train", "人工复核备注：内容重复", False), "6": ("test", "", False),
    }
    old = spark.createDataFrame([("q", "c", 0, "a", "问", ""), ("q", "c", 1, "b", "问", "换"), ("r", "c", 0, "a", "问", None)], "qa_id string, cell string, line int, answer string, question string, question_eval string")
    pred = spark.createDataFrame([("q", "c", " \u3000"), ("r", "c", "p"), ("s", "c", "p"), ("q", "d", "p")], "qa_id string, cell string, prediction string")
    got = {r.qa_id: (r.answer, r.asked, r.silent) for r in records.join_predictions(pred, old, "line").collect()}
    assert got == {"q": ("b", "换", True), "r": ("a", "问", False)}


@pytest.mark.parametrize("x,places,want", [(2.675, 2, 2.67), (1.005, 2, 1.0), (0.125, 2, 0.12), (0.375, 2, 0.38), (12.345, 2, 12.35), (-2.675, 2, -2.67), (2.5, 0, 2.0), (0.0625, 3, 0.062), (1e12, 2, 1e12)])
def test_rounding_is_that_of_the_binary_value(value, x, places, want):
    assert value(tx.rounded(F.lit(x), places)) == want == round(x, places)


def test_percentages_round_the_double(value):
    assert [tuple(f) for f in value(fg.key_figures(F.lit("2.675% 12.345％ 0.125%")))] == [("pct", 2.67), ("pct", 0.12)]


@pytest.mark.parametrize("v", [{"b": {"z": 1, "a": [1.0, 1e300, -0.5, 12345678901234567890]}, "a": None, "é": "\x1b\x7f \"\\/\n\x0b"}, [], "x", 0.1, {"k": {"k": {}}}])
def test_canonical_is_sorted_json(value, v):
    text = json.dumps(v)
    assert value(pg.canonical(F.lit(text))) == json.dumps(v, ensure_ascii=False, sort_keys=True)


def test_canonical_of_variants_and_of_no_json(value):
    assert value(pg.canonical(F.to_json(F.parse_json(F.lit('{"b": [1, {"d": 2.5, "c": true}], "a": "\\u001B"}'))))) == '{"a": "\\u001b", "b": [1, {"c": true, "d": 2.5}]}'
    assert value(pg.canonical(F.lit("{no"))) is None and value(pg.canonical(F.lit(None).cast("string"))) is None


def test_payload_is_what_the_serialiser_writes(value):
    system, user = "系\x1b统\"", "问\\u001B\n"
    want = {"model": "m", "messages": [{"role": "system", "content": system}, {"role": "user", "content": user}], "temperature": 0.7, "response_format": {"type": "json_object"}}
    assert value(pg.payload("m", F.lit(system), F.lit(user), F.lit(0.7))) == json.dumps(want, ensure_ascii=False, sort_keys=True)


def test_reviews_strip_white_space_of_any_script(spark):
    recs = spark.createDataFrame([("1", 1, "d", "甲", "x"), ("2", 2, "d", "乙", "y")], "qa_id string, seq int, doc string, question string, answer string")
    reviews = spark.createDataFrame([("　1　", 1, "删除", None)], "qa_id string, line int, action string, note string")
    assert {r.qa_id: r.kept for r in records.split(recs, reviews, []).collect()} == {"1": False, "2": True}
    base = spark.createDataFrame([(1, "a", "p"), (2, "b", "q"), (3, "c", "r")], "id int, x string, y string")
    said = spark.createDataFrame([(1, "　", "k"), (2, " new　", None)], "id int, v string, w string")
    assert sorted(map(tuple, records.backfilled(base, said, "id", x="v", y="w").collect())) == [(1, "a", "k"), (2, "new", "q"), (3, "c", "r")]
