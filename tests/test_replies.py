"""The data source of stored search replies, on literal files."""

import json

import pytest

from pagewright.sources import replies


@pytest.fixture
def folder(spark, tmp_path):
    rows = [{"TITLE": "年报 2024", "DATE_TIME": "01/02/2025 17:00", "FILE_LINK": "/a.pdf"}, {"TITLE": None, "FILE_INFO": {"fileLink": "https://x/b.pdf"}}, {"TITLE": "2023", "FILE_LINK": ""}]
    (tmp_path / "r1.json").write_text(json.dumps({"result": json.dumps(rows)}), "utf-8")
    (tmp_path / "r2.json").write_text(json.dumps({"result": json.dumps(rows[:1])}), "utf-8")
    (tmp_path / "r3.json").write_text("<html>busy</html>", "utf-8")
    (tmp_path / "s.js").write_text('cb({"stockInfo": [{"code": "00700", "stockId": 7}, {"code": "5", "stockId": null}]});\n', "utf-8")
    (tmp_path / "_SUCCESS").write_text("", "utf-8")
    return tmp_path


@pytest.mark.parametrize("push", ["true", "false"])
@pytest.mark.parametrize("scheme", ["", "file://"])
def test_reports_and_stocks(spark, folder, push, scheme):
    spark.conf.set("spark.sql.python.filterPushdown.enabled", push)
    try:
        read = lambda kind: replies.read_replies(spark, f"{scheme}{folder}", kind)
        found = sorted((r.file.rsplit("/", 1)[1], r.year, r.date, r.url) for r in read("reports").collect())
        one = ("2024", "01/02/2025 17:00", "/a.pdf")
        assert found == [("r1.json", *one), ("r1.json", "unknown", "", "https://x/b.pdf"), ("r2.json", *one)]
        assert [(r.code, r.stock_id) for r in read("stocks").collect()] == [("00700", "7"), ("5", None)]
        assert read("reports").where("year = '2024'").count() == 2 and read("reports").where("year in ('unknown', '1999')").count() == 1
        assert read("reports").where(f"file = '{scheme}{folder}/r2.json'").count() == 1
        assert read("reports").where("year = '2024' and title_cn like '%报%' and url <> ''").count() == 2
        assert read("stocks").where("stock_id is null").count() == 1
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_files_are_dealt_out_and_pruned(folder, monkeypatch):
    from pyspark.sql.datasource import EqualTo, GreaterThan

    monkeypatch.setattr(replies, "FILES", 1)
    reader = replies.PushedReader({"path": str(folder)}, ["file", "year", "date", "title_cn", "url"])
    assert len(reader.partitions()) == 4
    rest = GreaterThan(("date",), "0")
    assert list(reader.pushFilters([EqualTo(("file",), f"{folder}/r1.json"), EqualTo(("year",), "2024"), rest])) == [rest]
    (part,) = reader.partitions()
    assert [r[1] for r in reader.read(part)] == ["2024"]
