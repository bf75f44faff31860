import csv
import io
import json
import random

import pytest

from pyspark.sql import functions as F

from pagewright.functions import tokens
from pagewright.sources import files, staged
from pagewright.sources.staged import StagedTable


def test_csv_encodings(spark, tmp_path):
    text = '名,注\n"甲","一\n二"\n乙,\n'
    for name, data, want in (("a.csv", text.encode("utf-8-sig"), "utf-8"), ("b.csv", text.encode("utf-8"), "utf-8"), ("c.csv", text.encode("gb18030"), "gb18030")):
        (tmp_path / name).write_bytes(data)
        df, encoding = files.read_csv(spark, f"file://{tmp_path}/{name}")
        assert (df.columns, [tuple(r) for r in df.collect()], encoding) == (["名", "注"], [("甲", "一\n二"), ("乙", None)], want)
    assert spark.conf.get("spark.sql.legacy.javaCharsets") == "false"


def test_json_and_contents(spark, tmp_path):
    (tmp_path / "p.jsonl").write_text('{"doc": "d", "page": 1, "text": "x"}\n', "utf-8")
    r = files.read_json_lines(spark, f"file://{tmp_path}/p.jsonl").first()
    assert (r.doc, r.page, r.chars, r.text) == ("d", 1, None, "x")
    files.write_json_lines(files.read_json_lines(spark, f"file://{tmp_path}/p.jsonl"), f"file://{tmp_path}/out")
    assert [tuple(x) for x in files.read_json_lines(spark, f"file://{tmp_path}/out").collect()] == [tuple(r)]
    (tmp_path / "toc.json").write_text('{"d": [{"level": 1, "title": "t", "page": 3},\n {"level": 1, "title": "u", "page": 5}]}', "utf-8")
    assert [tuple(r) for r in files.read_contents(spark, f"file://{tmp_path}/toc.json").orderBy("pos").collect()] == [("d", 0, 1, "t", 3), ("d", 1, 1, "u", 5)]


def test_exports(spark, tmp_path, monkeypatch):
    df = spark.createDataFrame([("甲", "x", 1.5, None), ("甲", "y|z", float("nan"), 2)], "a string, b string, c double, d int")
    files.export_csv(df, f"file://{tmp_path}/t.csv")
    assert (tmp_path / "t.csv").read_bytes().startswith(b"\xef\xbb\xbf")
    back, _ = files.read_csv(spark, f"file://{tmp_path}/t.csv")
    assert back.columns == df.columns and [r.b for r in back.collect()] == ["x", "y|z"]
    files.export_markdown(df, f"file://{tmp_path}/t.md", "T")
    assert (tmp_path / "t.md").read_text("utf-8").splitlines()[:5] == ["# T", "", "| a | b | c | d |", "| --- | --- | --- | --- |", "| 甲 | x | 1.5 | — |"]
    files.export_json(df, f"file://{tmp_path}/t.json", "a", "b")
    assert json.loads((tmp_path / "t.json").read_text("utf-8")) == {"甲": {"x": {"c": 1.5, "d": None}, "y|z": {"c": None, "d": 2}}}
    monkeypatch.setattr(files, "EXPORT_ROWS", 1)
    with pytest.raises(ValueError):
        files.export_csv(df, f"file://{tmp_path}/u.csv")


@pytest.mark.parametrize("data,ok", [(b"%PDF" + b"x" * 2000, True), (b"%PDF", False), (b"<html" + b"x" * 2000, False)])
def test_pdf(spark, tmp_path, data, ok):
    (tmp_path / "f.pdf").write_bytes(data)
    assert files.pdf_files(spark, f"file://{tmp_path}/f.pdf").first().valid is ok


def test_missing_and_resumed(spark, tmp_path):
    a = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "i int, s string")
    assert [r.i for r in files.missing(a, a.where("i <> 2"), "i").collect()] == [2]
    path, seen = f"file://{tmp_path}/v", []

    def compute(df):
        seen.extend(r.i for r in df.collect())
        return df.selectExpr("i", "upper(s) AS v")

    files.resumed(a.where("i < 3"), path, "i", compute, parts=2)
    assert sorted((r.i, r.v) for r in files.resumed(a, path, "i", compute, parts=2).collect()) == [(1, "A"), (2, "B"), (3, "C")]
    assert sorted(seen) == [1, 2, 3]


@pytest.mark.parametrize("encoding", ["utf-8", "gb18030"])
def test_csv_in_ranges_is_the_single_reader(spark, tmp_path, encoding):
    rng = random.Random(encoding)
    cell = lambda: "".join(rng.choice(["年报", "乙\n丙", '"', ",", "x", "\r\n", "〇", "é", " "]) for _ in range(rng.randrange(0, 9)))
    rows = [[str(i), cell(), cell()] for i in range(3000)]
    out = io.StringIO(newline="")
    csv.writer(out).writerows([["id", "名", "注"], *rows])
    (tmp_path / "t.csv").write_bytes(out.getvalue().encode(encoding))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "7k")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        assert spark.read.option("lineSep", "\n").text(f"file://{tmp_path}/t.csv").rdd.getNumPartitions() > 5
        df, found = files.read_csv(spark, f"file://{tmp_path}/t.csv")
        got = [tuple(r) for r in df.collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    want = list(csv.reader(io.StringIO(out.getvalue(), newline="")))[1:]
    assert found == encoding and got == [tuple(x or None for x in r) for r in want]


def test_several_files_with_a_header_each(spark, tmp_path):
    for i, text in enumerate(["a,b\n1,x\n\n2,\"y\nz\"", "a,b\r\n3,w\r\n", "a,b\n"]):
        (tmp_path / f"{i}.csv").write_text(text, "utf-8", newline="")
    df, _ = files.read_csv(spark, f"file://{tmp_path}/*.csv")
    assert sorted(map(tuple, df.collect())) == [("1", "x"), ("2", "y\nz"), ("3", "w")]


def test_a_killed_run_loses_and_doubles_nothing(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    table = StagedTable(spark, path)
    assert table.read() is None
    a = spark.range(10)
    assert table.commit(a.where("id < 5"), "0") and not table.commit(a, "0")
    table.stage(a.where("id >= 5"))  # killed before it was published
    broken = tmp_path / "t" / "data" / "half"
    broken.mkdir()
    (broken / "part-0.parquet").write_bytes(b"PAR1 no")  # killed while it was written
    assert sorted(r.id for r in table.read().collect()) == list(range(5))
    assert sorted(r.id for r in files.resumed(a, path, "id", lambda df: df, parts=3).collect()) == list(range(10))
    # two that publish the same batch: one of them counts
    one, two = table.stage(spark.range(100, 101)), table.stage(spark.range(100, 101))
    assert table.publish(one, "x") and not table.publish(two, "x")
    assert table.read().where("id = 100").count() == 1


def test_a_stream_is_appended_once(spark, tmp_path):
    source, path, checkpoint = (f"file://{tmp_path}/{x}" for x in ("in", "out", "checkpoint"))
    spark.range(5).write.parquet(source)
    run = lambda: staged.append_stream(spark.readStream.schema("id long").parquet(source), path, checkpoint).awaitTermination()
    run()
    spark.range(5, 8).write.mode("append").parquet(source)
    run()
    # as after a failure between the sink and the stream's own log: the last batch is run again
    last = max((tmp_path / "checkpoint" / "commits").glob("[0-9]*"), key=lambda f: int(f.name))
    last.unlink()
    (last.parent / f".{last.name}.crc").unlink(missing_ok=True)
    run()
    assert sorted(r.id for r in StagedTable(spark, path).read().collect()) == list(range(8))


def test_stock_ids(spark):
    replies = ['cb({"stockInfo": [{"code": "00700", "stockId": 7}, {"code": "0070", "stockId": 8}]});', '{"stockInfo": [{"code": "700", "stockId": "9"}, {"code": "5", "stockId": "x)"}]}', "cb()", None]
    codes = spark.createDataFrame([("700",), ("00005",), ("12",)], "code string")
    found = files.stock_ids(spark.createDataFrame([(r,) for r in replies], "reply string").coalesce(1), codes)
    assert {r.code: r.stock_id for r in found.collect()} == {"700": "7", "00005": "x)"}


def test_cut_by_tokens(spark):
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = ["one two three", "", None, "wörd " * 40, "x" * 500]
    t = tokens.tokenizer(path)
    found = spark.createDataFrame([(x,) for x in texts], "t string").select("t", tokens.token_count(F.col("t"), path).alias("n"), tokens.is_cut(F.col("t"), path, 40).alias("cut")).collect()
    assert all(r.n == len(t.encode(r.t or "", add_special_tokens=False).ids) and r.cut == (r.n >= 40) for r in found) and {r.cut for r in found} == {True, False}
