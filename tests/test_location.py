"""The suffix index and the phrase converter against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagewright.functions import quotes as q
from pagewright.functions import script as sc
from pagewright.operators import locate as loc
from pagewright.operators import suffixes as sx


@pytest.mark.parametrize("seed", range(30))
def test_suffix_array_and_ranges(seed):
    rng = random.Random(seed)
    text = "".join(rng.choice("ab中z\0" if seed % 3 else "a") for _ in range(rng.randrange(0, 80)))
    code = sx.codes(text)
    code[code == 1] = 0
    order = sx.suffix_array(sx.keys(code))
    shown = ["".join(chr(c) for c in code[i:].tolist()) for i in range(len(text))]
    assert order.tolist() == sorted(range(len(text)), key=lambda i: shown[i])
    patterns = ["".join(rng.choice("ab中z") for _ in range(rng.randrange(0, 8))) for _ in range(40)] + [t for t in text.split("\0")]
    lo, hi = sx.ranges(sx.keys(code), order, sx.Patterns(patterns))
    for p, a, b in zip(patterns, lo, hi):
        assert sorted(order[a:b].tolist()) == [i for i in range(len(text)) if p and text.startswith(p, i)]


def brute_convert(text, table):
    out, i = "", 0
    while i < len(text):
        best = max((k for k in table if k and text.startswith(k, i)), key=len, default=None)
        out += text[i] if best is None else table[best]
        i += len(best) if best else 1
    return out


@pytest.mark.parametrize("seed", range(50))
def test_converter_takes_the_longest_entry(seed):
    rng = random.Random(seed)
    word = lambda n: "".join(rng.choice("abc") for _ in range(n))
    table = {word(rng.randrange(1, 5)): word(rng.randrange(0, 4)).upper() for _ in range(8)}
    convert = sc.Converter(table)
    for _ in range(20):
        text = word(rng.randrange(0, 30)) + rng.choice(["", "x", "中"]) + word(3)
        assert convert(text) == brute_convert(text, table)


def test_converted_column(spark):
    rows = spark.createDataFrame([("乾隆年間的乾燥營業額",), (None,), ("",), ("plain",)], "t string").repartition(2)
    table = {"乾": "干", "燥": "燥", "乾隆": "乾隆", "年間": "年间", "營": "营", "業": "业", "額": "额"}
    found = {r.t: r.x for r in rows.select("t", sc.converted(F.col("t"), table).alias("x")).collect()}
    assert found == {"乾隆年間的乾燥營業額": "乾隆年间的干燥营业额", None: None, "": "", "plain": "plain"}


def test_python_rules_are_the_native_ones(spark):
    text = "".join(map(chr, [*range(1, 0x3100), *range(0xFEFF, 0xFFEF), 0x1F600])) + q.TRADITIONAL + "\0"
    text = "".join(c for c in text if not 0xD800 <= ord(c) < 0xE000)
    row = spark.createDataFrame([(text,)], "t string").select(q.squeezed(F.col("t")).alias("a"), q.bare(F.col("t")).alias("b"), q.simplified(F.col("t")).alias("c")).first()
    assert (row.a, row.b, row.c) == (sc.squeezed(text), sc.bare(text), sc.Converter()(text))


@pytest.mark.parametrize("shard,block,matches", [(loc.SHARD, loc.BLOCK_BYTES, loc.MATCHES), (300, 400, 7)])
def test_location_is_brute_force(spark, monkeypatch, shard, block, matches):
    monkeypatch.setattr(loc, "BLOCK_BYTES", block)
    rng = random.Random(7)
    table = {"營": "营", "營業額": "营业总额", "業": "业"}
    alphabet = ["營業額", "營", "業", "营业总额", "a", "b", "，", " ", "。", "　", "\x0b", "\n", "「"]
    pages = [(i, "".join(rng.choice(alphabet) for _ in range(rng.randrange(0, 60)))) for i in range(80)] + [(80, None), (81, ""), (3, "營業額 a,b"), (82, "a" * 2000)]
    segments = []
    for i in range(150):
        text = rng.choice(pages)[1] or "x"
        start = rng.randrange(len(text) or 1)
        part = text[start : start + rng.randrange(1, 12)]
        segments.append((i, rng.choice([part, part.replace("，", ""), sc.Converter(table)(part), part + "b", part.replace(" ", "  ")])))
    segments += [(900, None), (901, ""), (902, " ，。"), (903, "a" * 1000), (904, "a" * 2001)]
    found = loc.search(
        spark.createDataFrame(segments, "id long, s string"),
        loc.index(spark.createDataFrame(pages, "page long, t string").repartition(3), "page", "t", table, shard=shard), "id", "s", "page", table,
    )
    found = {(r.id, r.page): r.level for r in found.collect()}
    convert, want = sc.Converter(table), {}
    for i, s in segments:
        for p, t in pages:
            if s and t and sc.bare(convert(s)) and sc.bare(convert(s)) in sc.bare(convert(t)):
                level = 2 if sc.bare(s) not in sc.bare(t) else 1 if sc.squeezed(s) not in sc.squeezed(t) else 0
                want[i, p] = min(level, want.get((i, p), 2))
    assert found == want and len(want) > 200 and set(want.values()) == {0, 1, 2}


def test_index_is_kept_at_a_path(spark, tmp_path):
    pages = spark.createDataFrame([("d", 1, "one two three"), ("d", 2, "two")], "doc string, page int, t string").select(F.struct("doc", "page").alias("at"), "t")
    path = f"file://{tmp_path}/index"
    loc.index(pages, "at", "t", path=path)
    segments = spark.createDataFrame([(1, "two"), (2, "two,three")], "id long, s string")
    found = loc.search(segments, spark.read.parquet(path), "id", "s", "at").collect()
    assert sorted((r.id, r.at.page, r.band) for r in found) == [(1, 1, loc.VERBATIM), (1, 2, loc.VERBATIM), (2, 1, loc.PUNCTUATION)]
    assert np.frombuffer(spark.read.parquet(path).first().places, "<i4").size > 0
