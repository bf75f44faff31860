"""Centroid clustering and whitening against brute force, with nulls, ties, repeated rows, empty tables and clashing names."""

import hashlib
import math

import numpy as np
import pytest

from pagewright.llm import ball_clusters, whitening
from pagewright.llm.vectors import whole

VECTORS = "vec_id long, embedding array<double>, n string, cluster string, component string, id string"


def rows_of(ids, vectors):
    return [(i, v, "x", "y", "z", "w") for i, v in zip(ids, vectors)]


def brute_clusters(ids, x, k, rounds, seed):
    hashes = [(i is None, hashlib.sha256(f"{seed}:{i}".encode()).hexdigest(), i or 0, v) for i, v in zip(ids, map(tuple, x.tolist()))]
    at = [list(h[3]) for h in sorted(hashes)[:k]]
    for last in range(rounds + 1):
        far = [[sum((a - b) ** 2 for a, b in zip(v, c)) for c in at] for v in x.tolist()]
        of = [min(range(len(at)), key=lambda c, d=d: (d[c], c)) for d in far]
        if last == rounds:
            return of, [d[c] for d, c in zip(far, of)], at
        for c in range(len(at)):
            own = [v for v, o in zip(x.tolist(), of) if o == c]
            if own:
                at[c] = [sum(z) // len(own) for z in zip(*own)]


@pytest.mark.parametrize("spread", [0.02, 0.3])
def test_clusters_are_brute_force(spark, spread):
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((6, 8))
    x = centres[rng.integers(0, 6, 300)] + spread * rng.standard_normal((300, 8))
    x[250:260] = x[0]  # equal vectors
    x[260:264] = np.round(x[260:264])
    ids = list(range(290)) + [7, 7, None, None] + list(range(294, 300))
    bad = [(900, None), (901, []), (902, [1.0] * 7), (903, [1.0] * 9), (904, [1.0] * 7 + [None]), (905, [math.nan] + [0.0] * 7), (906, [math.inf] * 8)]
    rows = rows_of(ids, x.tolist()) + rows_of(*zip(*bad))
    found = ball_clusters.cluster(spark.createDataFrame(rows, VECTORS).repartition(3), k=5, rounds=4, dim=8).collect()
    of, far, at = brute_clusters(ids, whole(x, 1024, 1 << 26), 5, 4, 3)
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted(((r.vec_id, r.cluster, r.distance) for r in found), key=key) == sorted(zip(ids, of, far), key=key)
    assert all(r.centroid == at[r.cluster] and r.inertia == sum(far) for r in found)
    assert all(r.cluster_inertia == sum(d for d, c in zip(far, of) if c == r.cluster) and r.cluster_size == of.count(r.cluster) for r in found)


def test_clusters_edges(spark):
    empty = spark.createDataFrame([], VECTORS)
    assert ball_clusters.cluster(empty, dim=2).count() == 0
    few = spark.createDataFrame(rows_of([1, 2], [[0.0, 0.0], [1.0, 1.0]]), VECTORS)
    assert {(r.vec_id, r.distance, r.inertia) for r in ball_clusters.cluster(few, dim=2).collect()} == {(1, 0, 0), (2, 0, 0)}
    same = spark.createDataFrame(rows_of(range(50), [[0.5, -0.5]] * 50), VECTORS)  # all tie: the first centroid gets all
    assert {(r.cluster, r.cluster_size, tuple(r.centroid)) for r in ball_clusters.cluster(same, dim=2).collect()} == {(0, 50, (512, -512))}
    with pytest.raises(Exception, match="not below"):
        ball_clusters.cluster(spark.createDataFrame(rows_of([1], [[1e9, 0.0]]), VECTORS), dim=2)


@pytest.mark.parametrize("seed", range(6))
def test_walk_decides_as_all_distances(seed):
    rng = np.random.default_rng(seed)
    if seed % 2:
        x = rng.integers(-4, 4, (500, 3))  # many ties
    else:
        x = (rng.integers(-3, 4, (20, 16)) * 1000)[rng.integers(0, 20, 900)] + rng.integers(-30, 30, (900, 16))
    tree, order = ball_clusters.build(x, leaf=8)
    assert (tree.x == x[order]).all() and (np.sort(order) == np.arange(len(x))).all()
    centroids = x[rng.choice(len(x), 6, replace=False)]
    of, whole_balls = np.full(len(x), -1), 0
    for balls, to in ball_clusters.walk(tree, centroids):
        for ball, c in zip(balls, to) if np.ndim(balls) else [(balls, to)]:
            assert (of[tree.start[ball] : tree.stop[ball]] == -1).all()
            of[tree.start[ball] : tree.stop[ball]] = c
            whole_balls += bool(np.ndim(balls))
            assert (tree.sums[ball] == tree.x[tree.start[ball] : tree.stop[ball]].sum(0)).all()
    assert (of == ball_clusters.squared(tree.x, centroids).argmin(1)).all()
    assert seed % 2 or 0 < whole_balls < 400  # balls go as a whole


def test_whitening_is_brute_force(spark):
    rng = np.random.default_rng(2)
    c = rng.standard_normal((400, 12)) @ np.diag(np.geomspace(8, 0.05, 12)) @ rng.standard_normal((12, 12)) + 3
    ids = [None, 5, 5, *range(3, 400)]
    bad = [(900, None), (904, [1.0] * 11 + [None]), (905, [math.nan] + [0.0] * 11), (906, [-math.inf] * 12), (907, [])]
    rows = rows_of(ids, c.tolist()) + rows_of(*zip(*bad))
    found = whitening.whiten(spark.createDataFrame(rows, VECTORS).repartition(5), components=7).collect()
    assert len(found) == 400 * 7
    x = np.floor(64 * c).astype(int) + 1_000_000
    sums = x.sum(0)
    deviation = [sum((400 * int(a) - int(s)) ** 2 for a, s in zip(v, sums)) for v in x]
    assert sorted(r.deviation for r in found if r.component == 1) == sorted(deviation)
    z = x - sums / 400
    e, axes = np.linalg.eigh(z.T @ z / 400)
    e, axes = e[::-1], axes[:, ::-1]
    for j in range(7):
        own = {r.deviation: r for r in found if r.component == j + 1}
        w = np.array([own[d].whitened for d in deviation])
        want = z @ axes[:, j] / np.sqrt(e[j])
        assert min(np.abs(w - want).max(), np.abs(w + want).max()) < 1e-8
        assert {r.n for r in own.values()} == {400} and all(abs(r.explained - e[j] / e.sum()) < 1e-12 for r in own.values())
    assert len({r.identity_error for r in found}) == 1 and found[0].identity_error < 1e-9


def test_whitening_edges(spark):
    assert whitening.whiten(spark.createDataFrame([], VECTORS)).count() == 0
    one = whitening.whiten(spark.createDataFrame(rows_of([4], [[1.0, 2.0, 3.0]]), VECTORS)).collect()
    assert [(r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in one] == [(c, 1, 0, None, 0.0, 0.0) for c in (1, 2, 3)]
    # a dimension without variance beside one with, and vectors of another dimension
    rows = rows_of([1, 2, 3], [[0.0, 1.0], [1.0, 1.0], [5.0]])
    found = {(r.vec_id, r.component): r for r in whitening.whiten(spark.createDataFrame(rows, VECTORS)).collect()}
    assert abs(found[1, 1].whitened) == pytest.approx(1) and found[1, 2].whitened is None and found[1, 1].explained == 1
    assert found[1, 1].identity_error < 1e-12 and found[3, 1].n == 1
    with pytest.raises(Exception, match="not below"):
        whitening.whiten(spark.createDataFrame(rows_of([1], [[1e300]]), VECTORS))


def test_deviation_beyond_64_bit_sums():
    fit = whitening.Fit(3, [3 * 10**9, 5], np.array([10**9, 2]), np.array([0.0, -1 / 3]))
    assert fit.deviation(np.array([[10**9 + 5, 2]])).tolist() == [(3 * (10**9 + 5) - 3 * 10**9) ** 2 + 1]
    large = whitening.Fit(10**6, [0], np.array([0]), np.array([0.0]))
    assert large.deviation(np.array([[3000]])).tolist() == [9 * 10**18]
    with pytest.raises(OverflowError):
        large.deviation(np.array([[3100]]))


@pytest.mark.parametrize("d", [0, 1, 2, 7, 30])
def test_jacobi(d):
    rng = np.random.default_rng(d)
    a = rng.standard_normal((d, d))
    a = a + a.T
    e, v = whitening.jacobi(a)
    assert np.allclose(e, np.linalg.eigvalsh(a)[::-1]) and np.allclose(v @ np.diag(e) @ v.T, a) and np.allclose(v.T @ v, np.eye(d))


def test_jacobi_keeps_small_eigenvalues():
    scale = np.geomspace(1e10, 1e-10, 9)
    a = (np.eye(9) + 0.1) * scale * scale[:, None]
    e, _ = whitening.jacobi(a)
    # scaling apart, the matrix is well conditioned: the product of all eigenvalues is known, and so is the smallest one by inversion
    least = np.linalg.inv(np.eye(9) + 0.1) / scale / scale[:, None]
    assert e[-1] == pytest.approx(1 / whitening.jacobi(least)[0][0], rel=1e-12)
    assert np.log(e).sum() == pytest.approx(np.log(1.9) + 2 * np.log(scale).sum(), abs=1e-9)
