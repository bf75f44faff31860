"""The corpus operators against brute force on small fixtures, with nulls, empty texts, ties, repeated rows, empty tables
and extra columns."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagewright.llm import itq, langid, licences, logbilinear, mixing, ngram_join, quality, suffix_search, token_counts

DOCS = "doc_id long, text string, lang string, source string, n_chars long, token string"


def words(rng, n, vocab=400):
    return [f"w{rng.randrange(vocab)}" for _ in range(n)]


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(4)
    texts = []
    for _ in range(12):
        base = words(rng, 60)
        texts.append(" ".join(base))
        for edits in (0, 1, 2, 3, 9):
            other = list(base)
            for _ in range(edits):
                other[rng.randrange(len(other))] = "x" + str(rng.randrange(99))
            texts.append(" ".join(other))
    texts += [None, "", "  ", "one two", "One TWO", "a b c d e", "A b c d e", "über Straße " * 9, "z " * 30, "y " * 30]
    return [(i, t, "en", f"s{i % 3}", 0, "extra") for i, t in enumerate(texts)]


def components(ids, links):
    up = {i: i for i in ids}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def test_ngram_join_is_brute_force(spark, corpus):
    def shingles(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({i: i + 32 for i in range(65, 91)}))
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()

    sets = {r[0]: shingles(r[1]) for r in corpus}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    want = components(sets, links)
    got = ngram_join.ngram_jaccard_join(spark.createDataFrame(corpus, DOCS)).collect()
    assert {r.doc_id: r.component_id for r in got} == want
    assert {r.doc_id: r.n_shingles for r in got} == {i: len(s) for i, s in sets.items()}
    assert len(set(want.values())) < len(want)


def test_ngram_join_edges(spark):
    assert ngram_join.ngram_jaccard_join(spark.createDataFrame([], DOCS)).count() == 0
    rows = [(None, "a b c d e f", "", "", 0, ""), (1, "a b c d e f", "", "", 0, ""), (1, "a b c d e f", "", "", 0, "")]
    got = ngram_join.ngram_jaccard_join(spark.createDataFrame(rows, DOCS)).collect()
    assert sorted((r.doc_id or 0, r.n_shingles, r.component_id or 0) for r in got) == [(0, 2, 0), (1, 2, 1), (1, 2, 1)]


def test_ngram_join_of_ids_with_several_texts(spark):
    """Every id has two unrelated texts, each with a near copy under an id of its own: no link is lost."""
    rng = random.Random(8)
    rows = []
    for i in range(25):
        for j in range(2):
            base = words(rng, 60, 4000)
            other = [*base[:-1], "changed"]
            rows += [(i, " ".join(base), "", "", 0, ""), (1000 + 2 * i + j, " ".join(other), "", "", 0, "")]
    rng.shuffle(rows)
    got = ngram_join.ngram_jaccard_join(spark.createDataFrame(rows, DOCS).repartition(4)).collect()
    assert all(r.component_id == (r.doc_id if r.doc_id < 1000 else (r.doc_id - 1000) // 2) for r in got) and len(got) == 100


def test_signature_never_rejects_a_link():
    rng = np.random.default_rng(1)
    for n in (1, 5, 40, 700):
        for share in (0.0, 0.05, 0.1):
            a = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2))
            b = np.unique(np.concatenate([a[int(len(a) * share) :], rng.integers(0, 2**63, int(n * share), dtype=np.uint64)]))
            x, y = (np.frombuffer(ngram_join._signature(s, ngram_join.fp.mix(s)), np.uint8) for s in (a, b))
            while len(x) != len(y):
                x, y = (x[::2] ^ x[1::2], y) if len(x) > len(y) else (x, y[::2] ^ y[1::2])
            both = len(np.intersect1d(a, b))
            if 100 * both >= 80 * (len(a) + len(b) - both):
                assert 180 * np.count_nonzero(x != y) <= 20 * (len(a) + len(b))


def brute_hits(docs, items, window=10):
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate({i: i + 32 for i in range(65, 91)}))
    out = {}
    for i, t in docs:
        w, hit, found = cut(t), set(), set()
        for item, it in items:
            v = cut(it)
            k = min(window, len(v))
            grams = {tuple(v[j : j + k]) for j in range(len(v) - k + 1)} if k else set()
            for p in range(len(w) - k + 1) if k else ():
                if tuple(w[p : p + k]) in grams:
                    hit |= set(range(p, p + k))
                    found.add(str(item))
        out[i] = (len(w), len(hit), sorted(found))
    return out


def test_suffix_search_is_brute_force(spark, monkeypatch):
    rng = random.Random(9)
    items = [(i, " ".join(words(rng, n, 50))) for i, n in enumerate((12, 30, 10, 4, 1, 25))] + [(6, None), (7, " .. "), (8, "w1 w2 w3"), (10, "w1 w2 w3")]
    docs = [(i, " ".join(words(rng, 80, 50))) for i in range(10)]
    for i, (_, t) in enumerate(items[:6]):
        docs.append((20 + i, f"start, {t}! " + " ".join(words(rng, 9, 50)) + f" {t.upper()} {t}"))
    docs += [(40, None), (41, ""), (42, "W1 w2\nW3"), (43, " ".join(items[1][1].split()[3:14])), (44, "é" * 9)]
    want = brute_hits(docs, items)
    for block in (suffix_search.BLOCK_BYTES, 60):  # one block of items, and several
        monkeypatch.setattr(suffix_search, "BLOCK_BYTES", block)
        got = suffix_search.search(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
        assert {r.doc_id: (r.n_words, r.n_hit, r["items"]) for r in got} == want
        assert {r.doc_id: sum(s.end - s.first for s in r.spans) for r in got} == {i: x[1] for i, x in want.items()}
    clean = suffix_search.decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {r.doc_id for r in clean.collect()} == {i for i, x in want.items() if not x[1]}
    assert suffix_search.search(spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).count() == 0
    none = suffix_search.search(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string"))
    assert {r.n_hit for r in none.collect()} == {0}


def test_suffix_array_is_sorted():
    ids = np.array([3, 1, 2, 1, 2, 0, 1, 2, 3, 0, 0])
    sa = suffix_search.suffix_array(ids, 16)
    tail = lambda i: ids[i:].tolist()
    assert [tail(i) for i in sa] == sorted(tail(i) for i in range(len(ids)) if ids[i])


def test_lm_counts_and_normalisation(spark):
    rng = random.Random(3)
    texts = ["the cat sat on the mat " * rng.randrange(1, 9) + " ".join(words(rng, 9)) for _ in range(150)] + ["", None, "UNSEEN wordé the", "the"]
    docs = [(i, t) for i, t in enumerate(texts)]
    train = [i % 4 != 2 for i in range(len(docs))]
    df = spark.createDataFrame([(i, t, s) for (i, t), s in zip(docs, train)], "doc_id long, text string, t boolean")
    got = {r.doc_id: r for r in logbilinear.score(df, F.col("t")).collect()}
    cut = lambda t: re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({i: i + 32 for i in range(65, 91)})) + [None]
    c = Counter(w for (_, t), s in zip(docs, train) if s for w in cut(t))
    n, v = sum(c.values()), len(c)
    for i, t in docs:
        w = cut(t)
        assert (got[i].n_tokens, got[i].n_known, got[i].train_tokens) == (len(w), sum(c[x] > 0 for x in w), n)
        assert math.isclose(got[i].base_score, sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w), rel_tol=1e-9)
    held = [i for i, s in enumerate(train) if not s]
    assert sum(got[i].score for i in held) > sum(got[i].base_score for i in held)
    assert logbilinear.score(spark.createDataFrame([], df.schema), F.col("t")).count() == 0
    untrained = logbilinear.score(df, F.lit(False)).collect()
    assert len(untrained) == len(docs) and all(math.isfinite(r.score) and r.n_known == 0 for r in untrained)


def test_lm_vocabulary_of_one_text(spark):
    """Copies of a single text, which all fall to one round: their words are the vocabulary."""
    for seed in range(3):
        text = " ".join(words(random.Random(seed), 30))
        docs = spark.createDataFrame([(i, text) for i in range(40)], "doc_id long, text string")
        model, rest = logbilinear.fit(docs.select("text"), 10_000, 40)
        assert len(model.words) == len(set(text.split())) and rest.sum() == 0 and sorted(model.count.tolist()) == sorted(40 * n for n in Counter(text.split()).values())


def test_lm_score_is_brute_force():
    """Each token's probability by plain loops over all outputs, and over its group, of a small model."""
    rng = np.random.default_rng(4)
    size = 200
    m = logbilinear.Model(np.arange(size, dtype=np.uint64), np.arange(size), np.arange(size, 0, -1), 3.0, np.ones(logbilinear.CLASSES))
    m.params = [(p + rng.standard_normal(p.shape)).astype(np.float32) for p in m.params]
    r, q, b, c, q2, b2 = (p.astype(float) for p in m.params)
    rank = rng.integers(-1, size, 300)
    one, two = rng.integers(0, len(r), 300), rng.integers(0, len(r), 300)
    token = np.where(rank >= 0, m.output[rank], m.first_class + 2)
    inner = np.where(rank >= m.short, rank - m.short, -1)
    for got, t, x, y, k in zip(m.log10(token, one, two, inner), token, one, two, inner):
        h = r[x] * c[0] + r[y] * c[1]
        want = math.log10(math.exp(h @ q[t] + b[t]) / sum(math.exp(h @ q[o] + b[o]) for o in range(len(q))))
        if k >= 0:
            own = [j for j in range(size - m.short) if m.output[j + m.short] == t]
            want += math.log10(math.exp(h @ q2[k] + b2[k]) / sum(math.exp(h @ q2[j] + b2[j]) for j in own))
        assert got == pytest.approx(want, rel=1e-4, abs=1e-4)


@pytest.mark.parametrize("size", [0, 9, 700, 1500])
def test_lm_probabilities_sum_to_one(size):
    """Over all outputs, and over the words of each group, after any context."""
    rng = np.random.default_rng(size)
    m = logbilinear.Model(np.arange(size, dtype=np.uint64), np.arange(size), np.arange(size, 0, -1), 3.0, np.ones(logbilinear.CLASSES))
    m.params = [p + rng.standard_normal(p.shape).astype(np.float32) for p in m.params]
    outputs, contexts = len(m.freq), len(m.params[0])
    assert len(m.output) == size and m.edges[-1] == size
    for one, two in ((0, contexts - 1), (contexts - 1, contexts - 1), (contexts // 2, 1)):
        word = np.arange(size)
        rest = np.setdiff1d(np.arange(outputs), m.output)
        token, inner = np.r_[m.output, rest], np.r_[np.maximum(word - m.short, -1), np.full(len(rest), -1)]
        p = 10 ** m.log10(token, np.full(len(token), one), np.full(len(token), two), inner)
        assert abs(p.sum() - 1) < 1e-3


def test_lm_repeated_and_null_ids(spark):
    rows = [(None, "a b a b " * 9), (None, "c d"), (1, "a b"), (1, "a b"), (1, "b a"), (2, None)]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, chunk string, train int")
    got = logbilinear.score(docs, F.lit(True)).collect()
    assert sorted((r.doc_id or 0, r.n_tokens, r.n_known) for r in got) == [(0, 3, 3), (0, 37, 37), (1, 3, 3), (1, 3, 3), (1, 3, 3), (2, 1, 1)]
    assert {r.train_tokens for r in got} == {50}


def test_token_counts(spark):
    rng = random.Random(6)
    texts = [" ".join(words(rng, rng.randrange(900))) for _ in range(60)] + [None, "", "<|endoftext|>", "same", "same"]
    n = sorted(len(token_counts.encoder().encode_ordinary(t)) if t else 0 for t in texts)
    got = token_counts.token_counts(spark.createDataFrame([(t, 1) for t in texts], "text string, length long")).collect()
    for r in got:
        assert (r.docs, r.docs_over, r.docs_upto) == (n.count(r.length), sum(x > r.length for x in n), sum(x <= r.length for x in n))
        assert r.tokens_over == sum(x for x in n if x > r.length) and r.truncated_total == sum(min(x, r.length) for x in n)
    assert {r.length for r in got} == set(n)
    assert token_counts.token_counts(spark.createDataFrame([], "text string")).count() == 0


def test_embedding_near_dedup(spark):
    rng = np.random.default_rng(8)
    base = rng.standard_normal((60, 32))
    x = np.concatenate([base, base[:40] + 0.2 * rng.standard_normal((40, 32)), base[:20] + 0.28 * rng.standard_normal((20, 32)), base[:10]]).astype(np.float32)
    rows = [(i, v.tolist(), i % 3) for i, v in enumerate(x)] + [(900, None, 1), (901, [0.0] * 32, 1), (902, [float("nan")] * 32, 1), (903, [1.0, None] * 16, 1), (904, [1.0], 1), (905, [], 1)]
    got = {r.vec_id: r for r in itq.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, rep int")).collect()}
    y = x.astype(float)
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    near = y @ y.T >= 0.95
    want = int(near.sum()) - len(x)
    assert set(got) == {r[0] for r in rows}
    found = sum(r.n_links for r in got.values())
    assert want * 0.9 <= found <= want
    assert all(got[i].n_links == 0 and got[i].kept for i in (900, 901, 902, 903, 904, 905))
    assert all(got[i + 120].component_id == got[i].component_id for i in range(10))
    assert itq.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def _cosines(x):
    y = np.asarray(x, float)
    y = y / np.linalg.norm(y, axis=1, keepdims=True)
    return y @ y.T


@pytest.mark.parametrize("width,offset", [(w, o) for o in (0.0, 1.0) for w in (8, 24, 32, 40)] + [(w, o) for o in (2.06, 3.04) for w in (24, 32, 40)])
def test_embedding_recall_at_any_width(width, offset):
    """Pairs at exactly the threshold, of vectors around zero and around a common direction (norm of their mean: 0.7, 0.9, 0.95)."""
    rng = np.random.default_rng(5)
    theta = np.arccos(0.95)
    x = rng.standard_normal((6_000, 32)) + offset * np.sqrt(32) * np.eye(32)[0]
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    code, tables, _, _ = itq.fit(x[3_000:], width, theta, most=1024 if offset < 1 else 160)  # few tables: shorter keys
    assert tables >= itq.tables_for(code.width, theta)
    u = rng.standard_normal((3_000, 32))
    u -= (u * x[:3_000]).sum(1, keepdims=True) * x[:3_000]
    y = np.cos(theta) * x[:3_000] + np.sin(theta) * u / np.linalg.norm(u, axis=1, keepdims=True)
    one, two = code(x[:3_000], tables)[0], code(y, tables)[0]
    met = np.vectorize(lambda v: int(v).bit_count() <= 1)(one ^ two).any(1)
    assert met.mean() >= 0.99


def test_embedding_groups_are_counted(spark):
    """Tight groups, loose groups and their borders, in two dimensions, one of them rare: the same as all pairs."""
    rng = np.random.default_rng(3)
    rows = []
    for d, groups in ((16, 6), (5, 1)):
        for _ in range(groups):
            base = rng.standard_normal(d)
            for noise, many in ((0.02, 20), (0.1, 12), (0.2, 12), (0.33, 12)):
                rows += [(base + noise * rng.standard_normal(d)).tolist() for _ in range(many)]
    rows += rows[:15] + rng.standard_normal((200, 16)).tolist() + [[1e200, 0.0, 1e200], [2e200, 0.0, 2e200], [0.5], [7.0], [-7.0]]
    want, up = {i: 0 for i in range(len(rows))}, []
    for d in (16, 5, 3, 1):
        at = [i for i, v in enumerate(rows) if len(v) == d]
        near = np.argwhere(_cosines([np.array(rows[i]) / max(np.abs(rows[i])) for i in at]) >= 0.95)
        up += [(at[i], at[j]) for i, j in near if i != j]
    for i, _ in up:
        want[i] += 1
    vectors = spark.createDataFrame([(i, v, "x") for i, v in enumerate(rows)], "vec_id long, embedding array<double>, rep string")
    got = {r.vec_id: r for r in itq.near_vectors(vectors).collect()}
    wrong = sum(got[i].n_links != n for i, n in want.items())
    assert wrong <= len(rows) * 0.02 and sum(r.n_links for r in got.values()) <= sum(want.values())
    whole = components(want, up)
    assert sum(got[i].component_id != c for i, c in whole.items()) <= len(rows) * 0.02
    assert got[len(rows) - 2].component_id == len(rows) - 3 and got[len(rows) - 1].kept and got[len(rows) - 4].n_links == 1


def test_embedding_edges(spark):
    v = [1.0, 2.0, 3.0]
    rows = [(None, v), (None, v), (1, v), (1, v), (2, [1.0, 2.0, 3.1]), (2, None), (3, [-1.0, 0.0, 0.0])]
    got = itq.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    key = lambda r: (r.vec_id or 0, r.n_links, r.component_id or 0, r.kept)
    assert sorted(map(key, got)) == [(0, 0, 0, True), (0, 0, 0, True), (1, 2, 1, True), (1, 2, 1, True), (2, 0, 2, True), (2, 2, 1, False), (3, 0, 3, True)]
    with pytest.raises(TypeError):
        itq.near_vectors(spark.createDataFrame([("a", v)], "vec_id string, embedding array<double>"))


def test_quality_learns(spark):
    rng = random.Random(1)
    rows, labels = [], []
    for i in range(240):
        w = words(rng, 60)
        bad = i % 3 == 0
        rows.append((i, " ".join(x.upper() + "!!" for x in w) if bad else " ".join(w), "x"))
        labels.append((i, None if i % 10 == 9 else 0 if bad else 1))
    rows += [(900, None, "x"), (901, "", "x"), (902, "ok", "x")]
    docs, known = spark.createDataFrame(rows, "doc_id long, text string, score string"), spark.createDataFrame(labels, "doc_id long, quality int")
    model = quality.fit(docs, known.where("doc_id % 5 <> 0"))
    got = {r.doc_id: r.score for r in quality.score(docs, model).collect()}
    assert len(got) == len(rows) and all(0 <= s <= 1 for s in got.values())
    assert np.mean([(got[i] >= 0.3) == (i % 3 != 0) for i in range(0, 240, 5)]) > 0.95
    assert got[900] == got[901]
    one = quality.fit(docs, known.where("quality = 1"))
    assert all(0 < r.score < 1 for r in quality.score(docs, one).collect())
    assert quality.score(docs.limit(0), model).count() == 0


def test_folded_score_is_the_average():
    raw, off = quality.fp.flat(quality.pa.array(["Some words, some words", "", "é"]))
    f = quality.features(raw, off)
    folded = np.random.default_rng(0).standard_normal(quality.BUCKETS)
    assert np.allclose(f.score(folded), [sum(folded[u] * s) for u, s in f.rows()], atol=1e-5)


def test_mixing_realises_weights(spark):
    rng = random.Random(5)
    rows = [(i, " ".join(["w"] * rng.randrange(1, 60)), "hot" if i % 4 else f"s{i % 5}") for i in range(600)]
    rows += [(900, None, None), (901, "", "empty"), (902, "w w", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    w = {r.source: r for r in mixing.weights(docs).collect()}
    assert abs(sum(r.weight for r in w.values()) - 1) < 1e-9
    most = max(r.budget / r.tokens for r in w.values() if r.tokens)
    assert most <= 2.01 and min(r.budget / r.tokens for r in w.values() if r.tokens) >= 0.999
    uses = mixing.plan(docs, blocks=8).collect()
    by = defaultdict(int)
    for r in uses:
        by[r.source] += r.n_tokens
    for s, r in w.items():
        assert 0 <= by[s] - r.budget < 60
    assert {r.doc_id for r in uses} == {r[0] for r in rows}
    assert len({(r.doc_id, r["pass"]) for r in uses}) == len(uses)
    small = mixing.plan(docs, budget=2000, repeats=None).groupBy("source").agg(F.sum("n_tokens").alias("n")).collect()
    assert sum(r.n for r in small) < 2000 + 60 * len(w)
    even = mixing.weights(docs, entropy=1.5).collect()
    assert -sum(r.weight * math.log(r.weight) for r in even if r.weight) >= 1.5 - 1e-6
    assert mixing.plan(docs.limit(0)).count() == 0
    assert mixing.mix(docs).count() == len(uses)


def test_mixing_edges(spark):
    rng = random.Random(8)
    rows = [(i, "w " * rng.randrange(9), "hot", i) for i in range(80)] + [(100 + i, None if i % 2 else " ", "hot", i) for i in range(30)] + [(200, "w w", "small", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, pass int")
    for seed in range(4):  # texts without tokens stay, also behind the budget's end of the largest source
        assert {r.doc_id for r in mixing.plan(docs, seed=seed).where("pass = 0").collect()} == {r[0] for r in rows}
    same = [(1, "a b", "s", 7, "x"), (1, "a b", "s", 8, "y"), (None, "c", "s", 9, "z"), (None, None, None, 9, "z"), (2, "d e f", "t", 9, "z")]
    docs = spark.createDataFrame(same, "doc_id long, text string, source string, block int, number string")
    out = mixing.mix(docs, blocks=4)
    assert out.columns == ["doc_id", "text", "source", "number", "pass", "block"]
    first = sorted((r.doc_id or 0, r.text or "", r.number) for r in out.where("pass = 0").collect())
    assert first == sorted((r[0] or 0, r[1] or "", r[4]) for r in same)
    assert out.count() == mixing.plan(docs, blocks=4).count()


def test_decontaminate_keeps_columns_and_rows(spark):
    item = " ".join(f"t{i}" for i in range(12))
    rows = [(1, "clean", "a", 1), (1, f"x {item}", "a", 2), (None, item, "b", 3), (None, "clean", "b", 4), (None, None, "b", 5), (2, "clean", "c", 6), (2, "clean", "c", 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, __hit string, digest int")
    out = suffix_search.decontaminate(docs, spark.createDataFrame([("i", item, "x"), ("j", item, "x"), (None, "clean", "x")], "item_id string, text string, n_hit string"))
    assert out.columns == docs.columns and sorted(r.digest for r in out.collect()) == [1, 4, 5, 6, 6]
    assert suffix_search.search(docs, spark.createDataFrame([("i", item), ("j", item)], "item_id string, text string")).where("size(items) = 2").count() == 2


def test_very_long_texts(spark):
    """A text of a few million bytes beside short ones, for each operator that reads whole texts."""
    rng = random.Random(12)
    long = " ".join(f"w{rng.randrange(9000)}" for _ in range(500_000))
    item = " ".join(long.split(" ")[400_000:400_020])
    docs = spark.createDataFrame([(1, "short text of some words here"), (2, long), (3, long + " tail")], "doc_id long, text string")
    hits = {r.doc_id: (r.n_words, r.n_hit) for r in suffix_search.search(docs, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()}
    assert hits == {1: (6, 0), 2: (500_000, 20), 3: (500_001, 20)}
    assert {r.doc_id: r.component_id for r in ngram_join.ngram_jaccard_join(docs).collect()} == {1: 1, 2: 2, 3: 2}
    assert sum(r.n_tokens for r in mixing.plan(docs.withColumn("source", F.lit("s")), repeats=None).collect()) == 1_000_007
    assert token_counts.token_counts(docs).agg(F.sum("docs")).first()[0] == 3
    assert quality.score(docs, (np.zeros(quality.BUCKETS, np.float32), 0.0)).where("score = 0.5").count() == 3
    assert licences.licence_scan(docs).where("notice_lines = 0").count() == 3


def test_licences(spark):
    mit = "Copyright (c) 2020 Someone\n\n" + licences.FULL_TEXTS[0][1].replace("license", "licence").upper().replace(" ", "\n ")
    rows = [(1, mit), (2, "Text.\nReleased under the MIT License.\nMore, all rights reserved"), (3, None), (4, ""), (5, "© 2020 X"), (6, "SPDX-License-Identifier: Apache-2.0"), (7, "released UNDER the   mit licence!\nLicensed under CC BY-NC 4.0."), (7, "plain")]
    got = licences.licence_scan(spark.createDataFrame([(*r, "own") for r in rows], "doc_id long, text string, digest string")).collect()
    assert [(r.doc_id, r.licence, r.notices) for r in got] == [(1, "MIT", []), (2, None, ["MIT"]), (3, None, []), (4, None, []), (5, None, []), (6, "Apache-2.0", ["Apache-2.0"]), (7, None, ["CC-BY-NC-4.0", "MIT"]), (7, None, [])]
    assert [r.digest is None for r in got] == [False, False, True, True, True, False, False, False]
    assert licences.licence_scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_licence_tables(spark):
    """Own texts, spellings that a line end parts, repeated rows and ids, clashing names; and a text that only a digest is known of."""
    own = spark.createDataFrame([("house", "You may use this per cent, for non-commercial ends."), ("void", " .")], "licence string, text string")
    rows = [(1, "© 2001 A\nYOU may use this per\ncent for non\ncommercial ends"), (1, "x\nyou may use this percent; for noncommercial ends!\ny"), (None, "you may use this percent for noncommercial ends"), (2, None)]
    docs = spark.createDataFrame([(*r, 7, "own") for r in rows], "doc_id long, text string, known int, lines string")
    got = licences.licence_scan(docs, texts=own).collect()
    assert [(r.licence, r.notices, r.notice_lines, r.known, r.lines) for r in got] == [("house", [], 0, 7, "own"), (None, ["house"], 1, 7, "own"), ("house", ["house"], 1, 7, "own"), (None, [], 0, 7, "own")]
    licence, digest = licences.FULL_DIGESTS[0]
    assert licences.known(spark).where(F.col("digest") == digest).first().licence == licence


def test_language_id(spark):
    rng = random.Random(2)
    parts = {"en": ["the", "and", "ing", "tion", "with"], "de": ["der", "und", "ung", "schön", "keit"], "fr": ["les", "eau", "ment", "où", "que"]}
    text = lambda x, n: " ".join(rng.choice(parts[x]) + rng.choice(parts[x]) for _ in range(n))
    docs = spark.createDataFrame([(i, text(x, 80), x) for i, x in enumerate(["en", "de", "fr"] * 30)], "doc_id long, text string, lang string")
    model = langid.fit(docs)
    rows = [(i, text(x, 40), None, f"{x}.example.{x}") for i, x in enumerate(["en", "de", "fr"] * 20)]
    rows += [(900, "12 34", "de", None), (901, None, None, "de.example.de"), (902, "", None, None), (903, "12", None, "new.de"), (903, "12", None, "new.de"), (904, "qxz jvk wwq kkj zzx qqj xxv vvk jjq", None, None)]
    got = langid.identify(spark.createDataFrame(rows, "doc_id long, text string, d string, h string"), model, ["doc_id"], declared="d", host="h").collect()
    found = {r.doc_id: r for r in got}
    assert len(got) == len(rows)
    assert all(found[i].language == ["en", "de", "fr"][i % 3] and found[i].accepted for i in range(60))
    assert found[900].language == "de" and found[900].accepted
    assert found[901].language == "de" and not found[901].accepted and found[903].language == "de"
    assert not found[902].accepted and not found[904].accepted
    assert langid.identify(spark.createDataFrame([], "doc_id long, text string"), model, ["doc_id"]).count() == 0
    clash = spark.createDataFrame([(i, text("en", 40), "k", "z") for i in range(3)], "n long, text string, language string, p string")
    assert [(r.n, r.key_language, r.language) for r in langid.identify(clash, model, ["n", "language"]).orderBy("n").collect()] == [(i, "k", "en") for i in range(3)]
    assert langid.fit(docs.limit(0)) == {}
    assert {r.language for r in langid.identify(docs, {}, ["doc_id"]).collect()} == {"und"}


def test_language_id_has_every_label(spark):
    rng = random.Random(6)
    names = [f"l{i:02d}" for i in range(70)]
    parts = {x: ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(5)) for _ in range(6)] for x in names}
    text = lambda x, n: " ".join(rng.choice(parts[x]) for _ in range(n))
    size = lambda x: 20 if x == "l68" else 4000 if x == "l69" else 80  # noqa: E731 (l68: under 200 bytes, l69: over 20,000)
    docs = [(i, text(x, size(x)), x) for i, x in enumerate(names * 2 + names[:66] * 2)]
    docs += [(900, "12 34", "none"), (901, None, "none"), (902, "ab", None)]
    model = langid.fit(spark.createDataFrame(docs, "doc_id long, text string, lang string"))
    assert sorted(model) == names
    rows = [(i, text(x, 40), None) for i, x in enumerate(names)] + [(100 + i, "1", x) for i, x in enumerate(names)] + [(999, "qxz jvk wwq kkj zzx qqj xxv vvk jjq", None)]
    got = {r.doc_id: r for r in langid.identify(spark.createDataFrame(rows, "doc_id long, text string, d string"), model, ["doc_id"], declared="d").collect()}
    assert all(got[i].language == x and got[i].accepted for i, x in enumerate(names))
    assert not got[999].accepted


def test_pages_evidence(spark):
    html = '<html CLASS=x lang="de-AT"><script>if (a<b) x()</script><!-- c --><p>Zu <b>und</b></p>'
    r = spark.createDataFrame([(html, "https://me@www.Example.de:80/x?y#z")], "h string, u string").select(langid.page_language(F.col("h")).alias("l"), langid.page_host(F.col("u")).alias("u"), langid.page_text(F.col("h")).alias("t")).first()
    assert (r.l, r.u, r.t.split()) == ("de", "www.example.de", ["Zu", "und"])


def test_components(spark):
    from pagewright.llm.shared import components as connect

    rng = random.Random(7)
    links = [(i, i + 1) for i in range(100, 140)] + [(rng.randrange(90), rng.randrange(90)) for _ in range(50)] + [(500, 500 + i) for i in range(30)] + [(5, 5)]
    ids = {x for e in links for x in e}
    want = {i: c for i, c in components(ids, links).items() if i != c}
    got = connect(spark.createDataFrame(links, "a long, b long")).collect()
    assert {r.node: r.component for r in got} == want and len(got) == len(want)
