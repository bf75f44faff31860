"""Numbering, running sums and the as-of join against brute force: sparse, hashed, string, repeated, null and hot keys."""

import random
from bisect import bisect_right
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from pagewright.operators import chunks, ordering


@pytest.mark.parametrize("kind", ["sparse", "string", "repeated", "hot", "none"])
def test_numbered(spark, kind):
    rng = random.Random(kind)
    make = {"sparse": lambda: rng.getrandbits(62), "string": lambda: f"{rng.getrandbits(40):x}", "repeated": lambda: rng.randrange(20), "hot": lambda: 7 if rng.random() < 0.6 else rng.randrange(1000), "none": int}[kind]
    rows = [(None if i % 97 == 5 else make(), i, "x") for i in range(0 if kind == "none" else 2000)]
    df = spark.createDataFrame(rows, f"k {'string' if kind == 'string' else 'long'}, v long, i_ string").repartition(5)
    found = sorted(ordering.numbered(df, "k", "v").collect(), key=lambda r: r.i)
    assert [r.i for r in found] == list(range(len(rows))) and {r.n for r in found} <= {len(rows)}
    assert [(r.k, r.v) for r in found] == [(k, v) for k, v, _ in sorted(rows, key=lambda r: (r[0] is not None, r[0] if r[0] is not None else 0, r[1]))]


def test_a_hot_key_is_in_many_ranges(spark):
    df = spark.range(4000).select(F.lit(1).alias("k"), "id")
    assert ordering._ranges(df.withColumn("h", F.xxhash64("id")), "k", "h").select("__p").distinct().count() > 1


@pytest.mark.parametrize("seed", range(3))
def test_running_sum(spark, seed):
    rng = random.Random(seed)
    rows = [(rng.choice(["a", "a", "a", "b", None]), i, rng.randrange(5)) for i in range(1500)]
    found = ordering.running_sum(spark.createDataFrame(rows, "k string, i long, v long").repartition(4), ["k"], ["i"], "v", "total").collect()
    total, want = defaultdict(int), {}
    for k, i, v in rows:
        total[k] += v
        want[i] = total[k]
    assert {r.i: r.total for r in found} == want


@pytest.mark.parametrize("seed", range(4))
def test_asof_is_brute_force(spark, seed):
    rng = random.Random(seed)
    key = lambda: rng.choice(["hot", "hot", "hot", "b", "c", None])
    span = [10, 10, 5000, 5000][seed]
    left = [(i, key(), None if rng.random() < 0.02 else rng.randrange(span)) for i in range(1200)]
    right = [(key(), None if rng.random() < 0.02 else rng.randrange(span), None if rng.random() < 0.1 else f"v{j}", j) for j in range([300, 5, 300, 20][seed])]
    frame = spark.createDataFrame(left, "id long, k string, at long").repartition(3)
    found = ordering.asof(frame, spark.createDataFrame(right, "k string, at long, v string, seq long").repartition(3), ["k"], "at", "v", "seq", "none")
    by = defaultdict(list)
    place = lambda x: -1 if x is None else x
    for k, at, v, seq in right:
        if v is not None:
            by[k].append((place(at), seq, v))
    want = {}
    for i, k, at in left:
        own = sorted(by[k])
        n = bisect_right(own, (place(at), float("inf"), ""))
        want[i] = own[n - 1][2] if n else "none"
    assert {r.id: r.v for r in found.collect()} == want and found.columns == ["id", "k", "at", "v"]


def test_chunks_of_repeated_pages(spark):
    rows = [("d", 1, "摘要", "a" * 450), ("d", 1, "摘要", "a" * 450), ("d", 1, "摘要", "b" * 450), ("d", 2, "摘要", "c" * 50), ("e", 1, None, "x" * 700), (None, 3, "摘要", "z" * 700)]
    pages = spark.createDataFrame(rows, "doc string, page long, section string, text string").repartition(3)
    got = sorted(((r.doc or "", r.seq, r.chars) for r in chunks.chunk(pages, "摘要").collect()))
    assert [x[2] for x in got if x[0] == "d"][:2] == [450, 450] and [x[1] for x in got if x[0] == "d"] == [0, 1, 2] and sum(x[2] for x in got if x[0] == "d") == 1401
