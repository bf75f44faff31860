"""Centroid clustering: exact k-means over integer vectors through partition-local ball trees.

Each task cuts its vectors into trees of at most TREE_ROWS.  A ball has its centre, radius, count and exact integer sum; its
vectors are split along the line through two far ones, at the widest gap of the middle half, down to leaves of LEAF
vectors.  The trees are written once, one row each.  In a round the tasks walk their trees: where the triangle inequality
shows that every vector of a ball is strictly nearer to one centroid than to any other, the ball's count and sum go to it as a
whole; else the walk descends, and the vectors of a leaf are compared one by one in whole numbers, ties to the smaller number.  What
leaves a task is a count and a sum a centroid, added up by Spark; the driver holds the centroids alone.

The outcome is that of comparing every vector with every centroid: a bound decides only beyond the rounding error of doubles.

Defined results: rows whose vector is null, has not `dim` components or holds a null or non-finite one are left out; the
centroids start from the rows with the smallest hashes of their ids, equal hashes by id, then by vector, null ids last; with fewer
rows than centroids each row is one; repeated rows all count; empty centroids stay where they are; labels and extra columns are
ignored, whatever their names; an empty table gives an empty result; components of 65,536 or more in size raise a ValueError, as
squared distances would leave 64 bits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import written
from .vectors import dense, whole

LEAF = 32
TREE_ROWS = 4_096
SCALE = 1_024
#: Size of an integer component from which on squares would not fit.
MOST = 1 << 26
_TREES = "ids array<long>, x binary, start array<int>, stop array<int>, child array<int>, radius array<double>, sums array<long>"


class Tree:
    """Balls over the rows x (reordered), by number: rows start to stop, first of two children (-1: leaf), radius, sum."""

    def __init__(self, x, start, stop, child, radius, sums):
        self.x, self.start, self.stop, self.child, self.radius, self.sums = x, start, stop, child, radius, sums
        self.count = stop - start


def build(x: np.ndarray, leaf: int = LEAF) -> tuple[Tree, np.ndarray]:
    """The tree of some integer vectors, and the order in which it holds them."""
    order = np.arange(len(x))
    start, stop, child, radius, sums = [0], [len(x)], [-1], [], []
    at = 0
    while at < len(start):
        a, b = start[at], stop[at]
        own = x[order[a:b]]
        sums.append(own.sum(0))
        off = own - sums[-1] / (b - a)
        from_centre = np.sqrt(np.einsum("ij,ij->i", off, off))
        radius.append(from_centre.max())
        if b - a > leaf and radius[-1] > 0:
            one = off[from_centre.argmax()]
            apart = off - one
            line = off[np.einsum("ij,ij->i", apart, apart).argmax()] - one
            along = off @ line
            sort = np.argsort(along, kind="stable")
            low, high = (b - a) // 4, (b - a) - (b - a) // 4
            cut = low + int(np.diff(along[sort][low - 1 : high]).argmax())
            order[a:b] = order[a:b][sort]
            child[at] = len(start)
            start += [a, a + cut]
            stop += [a + cut, b]
            child += [-1, -1]
        at += 1
    ints = [np.array(v, np.int64) for v in (start, stop, child)]
    return Tree(x[order], *ints, np.array(radius), np.array(sums)), order


def walk(tree: Tree, centroids: np.ndarray):
    """Yields (balls, centroid of each) for balls that belong to one as a whole, and (leaf, centroid of each of its rows)."""
    c = centroids.astype(float)
    most = np.abs(tree.sums[0] / tree.count[0]).max() + tree.radius[0]  # no component is larger
    slack = 1e-9 * (1 + np.abs(c).max() + most) * np.sqrt(c.shape[1])
    front = np.zeros(1, np.int64)
    while len(front):
        centre = tree.sums[front] / tree.count[front, None]
        far = np.stack([np.sqrt(np.einsum("ij,ij->i", centre - p, centre - p)) for p in c], 1)
        best = far.argmin(1)
        nearest = far[np.arange(len(far)), best]
        far[np.arange(len(far)), best] = np.inf
        sure = far.min(1) - nearest > 2 * tree.radius[front] + slack
        if sure.any():
            yield front[sure], best[sure]
        front = front[~sure]
        for leaf in front[tree.child[front] < 0]:
            yield leaf, squared(tree.x[tree.start[leaf] : tree.stop[leaf]], centroids).argmin(1)
        down = tree.child[front[tree.child[front] >= 0]]
        front = np.concatenate([down, down + 1])


def squared(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances of integer vectors to integer centroids, exact."""
    return np.stack([np.einsum("ij,ij->i", x - p, x - p) for p in centroids], 1)


def _planted(dim: int):
    def row(ids: list, x: np.ndarray):
        tree, order = build(x)
        cells = [[ids[i] for i in order], tree.x.astype("<i4").tobytes(), tree.start, tree.stop, tree.child, tree.radius, tree.sums.ravel()]
        kinds = [pa.list_(pa.int64()), pa.binary(), *[pa.list_(pa.int32())] * 3, pa.list_(pa.float64()), pa.list_(pa.int64())]
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(cells, kinds)], ["ids", "x", "start", "stop", "child", "radius", "sums"])

    def run(batches):
        ids, parts = [], []
        for batch in batches:
            at, x = dense(batch.column(1), dim)
            ids += batch.column(0).take(pa.array(at)).to_pylist()
            parts.append(whole(x, SCALE, MOST))
            while len(ids) >= TREE_ROWS:
                x = np.concatenate(parts)
                yield row(ids[:TREE_ROWS], x[:TREE_ROWS])
                ids, parts = ids[TREE_ROWS:], [x[TREE_ROWS:]]
        if ids:
            yield row(ids, np.concatenate(parts))

    return run


def _trees(batches, dim: int):
    for batch in batches:
        for k in range(batch.num_rows):
            ids, x, start, stop, child, radius, sums = (batch.column(j)[k] for j in range(7))
            ints = [np.asarray(v.values).astype(np.int64) for v in (start, stop, child)]
            x = np.frombuffer(x.as_py(), "<i4").astype(np.int64).reshape(-1, dim)
            yield ids.values, Tree(x, *ints, np.asarray(radius.values), np.asarray(sums.values).reshape(-1, dim))


def _totals(centroids: np.ndarray):
    k, dim = centroids.shape

    def run(batches):
        total, count = np.zeros((k, dim), np.int64), np.zeros(k, np.int64)
        for _, tree in _trees(batches, dim):
            for balls, of in walk(tree, centroids):
                if np.ndim(balls):
                    np.add.at(total, of, tree.sums[balls])
                    np.add.at(count, of, tree.count[balls])
                else:
                    np.add.at(total, of, tree.x[tree.start[balls] : tree.stop[balls]])
                    count += np.bincount(of, minlength=k)
        c, i = np.divmod(np.arange(k * dim, dtype=np.int32), np.int32(dim))
        yield pa.RecordBatch.from_arrays([pa.array(c), pa.array(i), pa.array(total.ravel()), pa.array(np.repeat(count, dim))], ["c", "i", "s", "n"])

    return run


def _assigned(centroids: np.ndarray):
    def run(batches):
        for ids, tree in _trees(batches, centroids.shape[1]):
            of = np.zeros(len(tree.x), np.int32)
            for balls, to in walk(tree, centroids):
                if np.ndim(balls):
                    for ball, c in zip(balls, to):
                        of[tree.start[ball] : tree.stop[ball]] = c
                else:
                    of[tree.start[balls] : tree.stop[balls]] = to
            off = tree.x - centroids[of]
            yield pa.RecordBatch.from_arrays([ids, pa.array(of), pa.array(np.einsum("ij,ij->i", off, off))], ["vec_id", "cluster", "distance"])

    return run


def cluster(vectors: DataFrame, k: int = 8, rounds: int = 10, seed: int = 3, dim: int = 64, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """Per vector: vec_id, cluster, distance (squared, in 1/1,024 units), cluster_inertia, inertia, size of the cluster, and its
    final centroid (integers)."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(vec_id).cast("long").alias("id"), F.col(embedding).cast("array<double>").alias("v"))
    trees = written(rows.mapInArrow(_planted(dim), _TREES))
    kept = (F.size("v") == dim) & F.forall("v", lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)) & ~F.isnan(x))
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    first = rows.where(kept).select(key.alias("key"), "id", "v").orderBy(F.asc_nulls_last("key"), "id", "v").limit(k).collect()
    at = whole(np.array([r.v for r in first]).reshape(-1, dim), SCALE, MOST)
    for _ in range(rounds if len(at) else 0):
        sums = trees.mapInArrow(_totals(at), "c int, i int, s long, n long").groupBy("c", "i").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
        at = at.copy()
        for r in sums.where("n > 0").collect():  # a number for each centroid and component
            at[r.c, r.i] = r.s // r.n
    if not len(at):
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, cluster_size long, centroid array<long>")
    found = written(trees.mapInArrow(_assigned(at), "vec_id long, cluster int, distance long"))
    sums = found.groupBy("cluster").agg(F.sum("distance").alias("d"), F.count(F.lit(1)).alias("n")).collect()
    inertia = sum(r.d for r in sums)
    of = [(r.cluster, r.d, inertia, r.n, at[r.cluster].tolist()) for r in sums]
    of = spark.createDataFrame(of, "cluster int, cluster_inertia long, inertia long, cluster_size long, centroid array<long>")
    return found.join(F.broadcast(of), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "cluster_size", "centroid")

