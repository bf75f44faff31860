"""The inverted index and the vector clusters against brute force, with ties, empty texts, repeated rows and small blocks."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pagewright.operators import nearest
from pagewright.operators import retrieval as r


def brute(queries, docs, k, terms):
    def cut(text):
        text = text or ""
        if terms == "word":
            return "".join(c if c.isalnum() or c == "_" else " " for c in text.lower()).split()
        text = "".join(c for c in text if c.isalnum() or c == "_")
        return [text[i : i + 2] for i in range(len(text) - 1)]

    bags = [(d, Counter(cut(t)), len(cut(t))) for d, t in docs]
    average = sum(n for _, _, n in bags) / max(len(bags), 1)
    df = Counter(w for _, b, _ in bags for w in b)
    out = []
    for q, text in queries:
        scores = []
        for d, bag, n in bags:
            s = sum(m * np.log(1 + (len(bags) - df[w] + 0.5) / (df[w] + 0.5)) * bag[w] * 2.5 / (bag[w] + 1.5 * (0.25 + 0.75 * n / average)) for w, m in Counter(cut(text)).items() if w in bag)
            scores.append((-round(s, 9), -d))
        out += [(q, i + 1, -d, round(-s, 6)) for i, (s, d) in enumerate(sorted(scores)[:k])]
    return out


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(2)
    words = [f"w{i}" for i in range(60)] + ["état", "Zoë", "中文", "a_b", "x"]
    weight = [1 / (i + 1) for i in range(len(words))]
    texts = [" ".join(rng.choices(words, weight, k=rng.choice([0, 1, 5, 40, 200]))) for _ in range(150)]
    texts += [None, "", "，。", texts[3], texts[3], texts[3], "w1 w2 w3", "w1 w2 w3"]
    return list(enumerate(texts))


@pytest.mark.parametrize("terms", ["bigram", "word"])
@pytest.mark.parametrize("shard,block,query_bytes", [(r.SHARD, r.BLOCK, r.QUERY_BYTES), (1500, 3, 900)])
def test_bm25_is_brute_force(spark, monkeypatch, corpus, terms, shard, block, query_bytes):
    monkeypatch.setattr(r, "QUERY_BYTES", query_bytes)
    monkeypatch.setattr(r, "SHARD", shard)
    monkeypatch.setattr(r, "BLOCK", block)
    rng = random.Random(4)
    queries = [(i, rng.choice(corpus)[1]) for i in range(25)] + [(100, None), (101, "zzz qqq"), (102, "w1"), (103, "w59 w59 w58")]
    docs = spark.createDataFrame([*corpus, (None, "w1 w2")], "doc_id long, text string").repartition(3)
    found = r.bm25(spark.createDataFrame(queries, "query_id long, text string").repartition(2), docs, 6, terms).collect()
    assert sorted((x.query_id, x["rank"], x.doc_id, x.score) for x in found) == sorted(brute(queries, corpus, 6, terms))


def test_few_and_no_documents(spark):
    queries = spark.createDataFrame([(1, "w1 w2"), (2, "")], "query_id long, text string")
    few = spark.createDataFrame([(5, "w1"), (6, "w2 w2")], "doc_id long, text string")
    assert sorted((x.query_id, x.doc_id) for x in r.bm25(queries, few, 8, "word").collect()) == [(1, 5), (1, 6), (2, 5), (2, 6)]
    assert r.bm25(queries, few.limit(0), 8).count() == 0
    assert r.bm25(queries.limit(0), few, 8).count() == 0


def shards_of(texts):
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], ["d", "t"])
    sizes = r.TERMS["word"](texts)[1]
    (out,) = r._inverted(max(len(sizes) / len(texts), 1e-9))(r._forward("word")([batch]))
    return r.Shard(out, 0)


def test_postings_are_skipped():
    rng = random.Random(9)
    words = [f"w{i}" for i in range(4000)]
    weight = [1 / (i + 1) for i in range(len(words))]
    texts = [" ".join(rng.choices(words, weight, k=60)) for _ in range(3000)]
    shard = shards_of(texts)
    has = [set(r.TERMS["word"]([t])[0].tolist()) for t in texts]
    df = Counter(w for own in has for w in own)
    terms = np.array(sorted(has[7]))
    idf = np.array([np.log(1 + (3000 - df[t] + 0.5) / (df[t] + 0.5)) for t in terms.tolist()])
    may, score = shard.best(terms, idf, 1, -np.inf)
    assert shard.docs[may[score.argmax()]] == 7 and shard.read < sum(df[t] for t in terms.tolist()) / 3
    # a score that is reached elsewhere rules out the whole shard before most is read
    shard.read = 0
    assert not len(shard.best(terms, idf, 1, 1e6)[0]) and shard.read < sum(df[t] for t in terms.tolist()) / 3


def test_index_is_kept_at_a_path(spark, tmp_path, corpus):
    docs = spark.createDataFrame(corpus, "doc_id long, text string")
    queries = spark.createDataFrame([(1, "w1 w7"), (2, "état")], "query_id long, text string")
    made = r.index(docs, "word", f"file://{tmp_path}/index")
    again = r.open_index(spark, f"file://{tmp_path}/index", "word")
    a, b = (sorted(map(tuple, r.search(queries, x, 5).collect())) for x in (made, again))
    assert a == b == sorted(map(tuple, r.bm25(queries, docs, 5, "word").collect()))


def brute_vectors(queries, vectors, k, dim):
    good = lambda v: v is not None and len(v) == dim and all(x is not None and np.isfinite(x) for x in v) and any(v)
    unit = lambda v: np.array(v) / np.linalg.norm(v)
    out = []
    for q, v in queries:
        if good(v):
            scores = sorted((-round(float(unit(v) @ unit(w)), 9), -i) for i, w in vectors if good(w) and i != q)
            out += [(q, j + 1, -i, round(-s, 6)) for j, (s, i) in enumerate(scores[:k])]
    return out


@pytest.mark.parametrize("dim,chunk", [(3, 1024), (16, 20)])
def test_vector_topk_is_brute_force(spark, monkeypatch, dim, chunk):
    monkeypatch.setattr(nearest, "CHUNK", chunk)
    monkeypatch.setattr(nearest, "QUERIES", 7)
    rng = np.random.default_rng(dim)
    centres = rng.standard_normal((8, dim))
    x = (centres[rng.integers(0, 8, 400)] + 0.2 * rng.standard_normal((400, dim))).tolist()
    vectors = list(enumerate(x)) + [(400 + i, x[0]) for i in range(20)] + [(500, None), (501, []), (502, [0.0] * dim), (503, [float("nan")] * dim), (504, [None] * dim), (505, [1.0] * (dim + 1))]
    queries = vectors[::15] + vectors[-6:]
    frame = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    found = nearest.vector_topk(frame(queries), frame(vectors), 7).collect()
    assert sorted((r.query_id, r["rank"], r.doc_id, r.score) for r in found) == sorted(brute_vectors(queries, vectors, 7, dim))


def test_vector_edges(spark):
    frame = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    two = [(1, [1.0, 0.0]), (2, [0.0, 1.0])]
    assert [(r.query_id, r.doc_id, r.score) for r in nearest.vector_topk(frame(two[:1]), frame(two), 5).collect()] == [(1, 2, 0.0)]
    assert nearest.vector_topk(frame(two), frame([]), 5).count() == 0
    assert nearest.vector_topk(frame([]), frame(two), 5).count() == 0


def test_few_vectors_are_compared():
    rng = np.random.default_rng(1)
    centres = rng.standard_normal((40, 32))
    x = centres[rng.integers(0, 40, 4000)] + 0.1 * rng.standard_normal((4000, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    centre = nearest.pivots_of(x)
    of = (x @ centre.T).argmax(1)
    away = nearest.angles(x, centre)
    many = np.bincount(of, minlength=len(centre))
    radius = np.array([away[of == p, p].max(initial=0) for p in range(len(centre))])
    compared = 0
    for j in range(0, 4000, 200):
        first = nearest.first_pivots(away[j : j + 1], many, 11)[0]
        near = np.flatnonzero(first[of])
        reach = np.arccos(np.sort(x[near] @ x[j])[-11] - 1e-12) + 1e-7
        again = ~first & (away[j] - radius <= reach) & (many > 0)
        compared += len(near)
        for p in np.flatnonzero(again):
            own = np.flatnonzero(of == p)
            own = own[np.argsort(away[own, p])]
            some, _ = nearest.within(x[own], away[own, p], x[j], away[j, p], reach)
            compared += some.stop - some.start
    assert compared < 0.1 * 20 * 4000


def test_blocks_of_queries_are_not_broadcast(spark):
    """Before, the blocks were taken to have the bytes of the queries, and went through the driver: a query goes to many pivots."""
    rng = np.random.default_rng(4)
    vectors = spark.createDataFrame([(i, rng.normal(size=8).tolist()) for i in range(300)], "vec_id long, embedding array<double>")
    found = nearest.vector_topk(vectors.where("vec_id % 20 = 0"), vectors, 5)
    assert found.count() == 75
    plan = found._jdf.queryExecution().executedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join [pivot#" in line]
    assert joins and all("SortMergeJoin" in line for line in joins)
