"""Vector top-k by cosine: exact, with clusters that the triangle inequality rules out.

Vectors are put to the nearest of some pivots (learned on a bounded sample) and kept in chunks of one pivot, sorted by their
angle to it.  A query first goes to its nearest pivots, as many as hold k vectors; its k-th best there bounds the angle that
matters.  Then it goes to the other pivots that may hold something within that angle: the pivot's angle less its radius is
not over it.  In a chunk it meets only the vectors whose angle to the pivot differs from its own by that bound at most.
Queries and vectors meet in a join of blocks of queries and chunks of vectors by pivot, so that neither passes through the driver.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..storage import written
from .retrieval import PLACES, ranked

#: Pivots at most, vectors that they are learned on, vectors of a chunk, queries of a block, vectors of one product.
PIVOTS, SAMPLE, CHUNK, QUERIES, TILE = 256, 8_192, 1_024, 512, 2_048
#: Angles this near a bound are not decided by it.
SLACK = 1e-7
_BLOCKS = "pivot int, qids array<long>, q binary, away array<double>, reach array<double>"


def unit(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and directions of the rows that have `dim` components, all finite, not all zero."""
    size = np.asarray(column.value_lengths().fill_null(-1))
    start = np.r_[0, np.cumsum(np.maximum(size, 0))[:-1]]
    values = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    at = np.flatnonzero(size == dim)
    x = values[start[at][:, None] + np.arange(dim)]
    most = np.abs(x).max(1, initial=0)
    good = np.isfinite(most) & (most > 0)
    x = x[good] / most[good, None]
    return at[good], x / np.linalg.norm(x, axis=1, keepdims=True)


def angles(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(x @ y.T, -1, 1))


def pivots_of(sample: np.ndarray, rounds: int = 5) -> np.ndarray:
    """Directions that the sample gathers around; any one, if it is empty."""
    if not len(sample):
        return np.eye(1, sample.shape[1])
    centre = sample[:: max(1, len(sample) // min(PIVOTS, max(1, len(sample) // 8)))][:PIVOTS]
    for _ in range(rounds):
        of = (sample @ centre.T).argmax(1)
        total = np.zeros_like(centre)
        np.add.at(total, of, sample)
        size = np.linalg.norm(total, axis=1)
        centre = np.where(size[:, None] > 1e-12, total / np.maximum(size, 1e-12)[:, None], centre)
    return centre


class Clusters:
    """Chunks of vectors, the pivots, and of each pivot the radius and the number of vectors."""

    def __init__(self, chunks: DataFrame, dim: int, centre: np.ndarray):
        self.chunks, self.dim, self.centre = chunks, dim, centre
        self.radius, self.many = np.zeros(len(centre)), np.zeros(len(centre), np.int64)
        for r in chunks.groupBy("pivot").agg(F.max(F.element_at("away_", -1)).alias("r"), F.sum(F.size("ids")).alias("n")).collect():  # PIVOTS at most
            self.radius[r.pivot], self.many[r.pivot] = r.r, r.n


def _assigned(shared, dim: int):
    """Vectors with their nearest pivot and the angle to it."""

    def run(batches):
        centre = shared.value
        for batch in batches:
            at, x = unit(batch.column(1), dim)
            if len(at):
                of = (x @ centre.T).argmax(1)
                away = np.arccos(np.clip(np.einsum("ij,ij->i", x, centre[of]), -1, 1))
                cells = [pa.array(of.astype(np.int32)), batch.column(0).take(pa.array(at)), pa.array(away), pa.array([v.tobytes() for v in x], pa.binary())]
                yield pa.RecordBatch.from_arrays(cells, ["pivot", "id", "away", "x"])

    return run


def _chunks(batches):
    """Vectors in order of part and angle, in chunks."""

    def rows():
        key, held, many = None, [], 0
        for batch in batches:
            both = np.stack([np.asarray(batch.column(0)), np.asarray(batch.column(1))], 1)
            edges = np.flatnonzero((both[1:] != both[:-1]).any(1)) + 1
            for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(both)]):
                now = tuple(both[a].tolist()) if b > a else key
                if held and (now != key or many >= 2 * CHUNK):
                    yield key[0], held
                    held, many = [], 0
                key = now
                if b > a:
                    held.append(batch.slice(a, b - a))
                    many += b - a
        if held:
            yield key[0], held

    for pivot, held in rows():
        ids, away = (np.concatenate([np.asarray(h.column(i)) for h in held]) for i in (2, 3))
        x = b"".join(v for h in held for v in h.column(4).to_pylist())
        cells = [pa.array([pivot], pa.int32()), *(pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), pa.array(c)) for c in (ids, away)), pa.array([x], pa.binary())]
        yield pa.RecordBatch.from_arrays(cells, ["pivot", "ids", "away_", "x"])


def _gathered(assigned: DataFrame) -> DataFrame:
    """Chunks of vectors of one pivot: a pivot's vectors are dealt out to parts of about CHUNK, however many it has."""
    many = {r.pivot: r.n for r in assigned.groupBy("pivot").agg(F.count(F.lit(1)).alias("n")).collect()}  # PIVOTS at most
    parts = F.array(*(F.lit(-(-many.get(p, 1) // CHUNK)) for p in range(max(many, default=0) + 1)))
    part = F.pmod(F.xxhash64("id", "x"), F.element_at(parts, F.col("pivot") + 1)).cast("int").alias("part")
    rows = assigned.select("pivot", part, "id", "away", "x").repartition("pivot", "part").sortWithinPartitions("pivot", "part", "away")
    return rows.mapInArrow(_chunks, "pivot int, ids array<long>, away_ array<double>, x binary")


def clusters(vectors: DataFrame, dim: int | None = None) -> Clusters:
    """The clusters of vectors (vec_id, embedding).  Rows without an id or a direction, and vectors of another dimension (dim: by
    default that of most vectors of the sample), are left out."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("v")).where("id is not null and v is not null")
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("v").toArrow().column("v").combine_chunks()
    sizes = np.asarray(sample.value_lengths())
    dim = dim or (int(np.bincount(sizes).argmax()) if len(sizes) else 0)
    centre = pivots_of(unit(sample, dim)[1])
    shared = vectors.sparkSession.sparkContext.broadcast(centre)
    assigned = written(rows.mapInArrow(_assigned(shared, dim), "pivot int, id long, away double, x binary"))
    return Clusters(written(_gathered(assigned)), dim, centre)


def first_pivots(away: np.ndarray, many: np.ndarray, k: int) -> np.ndarray:
    """Which pivots (a row a query) are the nearest ones that hold k vectors together."""
    order = np.argsort(away, 1, kind="stable")
    before = np.cumsum(many[order], 1) - many[order]
    first = np.zeros(away.shape, bool)
    np.put_along_axis(first, order, before < k, 1)
    return first & (many > 0)


def _blocks(shared, dim: int, k: int):
    """Queries (id, vector, reach: the angle that matters, null in the first round) in blocks for the pivots they go to."""

    def run(batches):
        centre, radius, many = shared.value
        for batch in batches:
            at, x = unit(batch.column(1), dim)
            if not len(at):
                continue
            ids, reach = np.asarray(batch.column(0).take(pa.array(at))), batch.column(2).take(pa.array(at)).to_numpy(zero_copy_only=False).astype(float)
            away = angles(x, centre)
            to = first_pivots(away, many, k + 1)
            again = ~np.isnan(reach)
            to[again] = ~to[again] & (away[again] - radius <= reach[again, None]) & (many > 0)
            reach = np.where(again, reach, np.inf)
            for p in np.flatnonzero(to.any(0)).tolist():
                for some in np.array_split(own := np.flatnonzero(to[:, p]), -(-len(own) // QUERIES)):
                    cells = [pa.array([p], pa.int32()), *(pa.array([c.tolist()], pa.list_(kind)) for c, kind in ((ids[some], pa.int64()),)), pa.array([x[some].tobytes()], pa.binary())]
                    cells += [pa.array([c.tolist()], pa.list_(pa.float64())) for c in (away[some, p], reach[some])]
                    yield pa.RecordBatch.from_arrays(cells, ["pivot", "qids", "q", "away", "reach"])

    return run


def stretch(away: np.ndarray, low: float, high: float) -> slice:
    """The vectors of a chunk whose angle to its pivot is from low to high."""
    return slice(int(np.searchsorted(away, low - SLACK)), int(np.searchsorted(away, high + SLACK, "right")))


def within(x: np.ndarray, away: np.ndarray, q: np.ndarray, of: float, reach: float) -> tuple[slice, np.ndarray]:
    """The stretch of a chunk (sorted by the angle to its pivot) that may lie within `reach` of a query, and its cosines."""
    some = stretch(away, of - reach, of + reach)
    return some, x[some] @ q


def best_pairs(ids: np.ndarray, x: np.ndarray, away: np.ndarray, qids: np.ndarray, q: np.ndarray, of: np.ndarray, reach: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query (by place), vector (by place) and score of the best k vectors of a chunk (sorted by the angle to its pivot) for each
    query, of those that may lie within its `reach`.  All queries of a block meet a stretch of the chunk in one product."""
    every = stretch(away, (of - reach).min(), (of + reach).max())
    least = np.where(reach < np.pi, np.cos(np.minimum(reach, np.pi)) - SLACK, -np.inf)
    found: list[tuple] = []
    for at in range(every.start, every.stop, TILE):
        some = slice(at, min(at + TILE, every.stop))
        cosine = q @ x[some].T
        own = np.flatnonzero(np.isin(ids[some], qids))  # a query isn't its own answer
        if len(own):
            cosine[:, own] = np.where(ids[some][own] == qids[:, None], -np.inf, cosine[:, own])
        least_here = least
        if cosine.shape[1] > k:
            open_ = np.flatnonzero(np.isinf(least))
            if len(open_):  # a score that rounds to the k-th best still counts
                least_here = least.copy()
                least_here[open_] = np.partition(cosine[open_], -k, axis=1)[:, -k] - 2 * 10.0**-PLACES
        row, column = np.nonzero((cosine >= least_here[:, None]) & (cosine > -np.inf))
        found.append((row, column + at, np.round(cosine[row, column], PLACES)))
    row, column, score = (np.concatenate(c) for c in zip(*found)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
    order = np.lexsort((-ids[column], -score, row))
    row, column, score = row[order], column[order], score[order]
    keep = np.arange(len(row)) - np.searchsorted(row, row) < k
    return row[keep], column[keep], score[keep]


def _compared(dim: int, k: int):
    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                ids, away, qids, of, reach = (np.asarray(batch.column(batch.schema.get_field_index(n))[i].values) for n in ("ids", "away_", "qids", "away", "reach"))
                x, q = (np.frombuffer(batch.column(batch.schema.get_field_index(n))[i].as_py()).reshape(-1, dim) for n in ("x", "q"))
                row, column, score = best_pairs(ids, x, away, qids, q, of, reach, k)
                if len(row):
                    yield pa.RecordBatch.from_arrays([pa.array(qids[row]), pa.array(ids[column]), pa.array(score)], ["query_id", "doc_id", "score"])

    return run


def search(queries: DataFrame, index: Clusters, k: int) -> DataFrame:
    """query_id, doc_id, score (cosine), rank: the nearest k other vectors of each query (vec_id, embedding), equal ones by
    the larger id."""
    shared = queries.sparkSession.sparkContext.broadcast((index.centre, index.radius, index.many))
    asked = queries.select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("v")).where("id is not null and v is not null")

    many = asked.count()
    tasks = 4 * queries.sparkSession.sparkContext.defaultParallelism

    def met(rows: DataFrame) -> DataFrame:
        # queries come in whole blocks, and few bytes make much work
        rows = rows.repartition(max(1, -(-many // QUERIES)), "id")
        blocks = rows.mapInArrow(_blocks(shared, index.dim, k), _BLOCKS).repartition(tasks, "pivot")
        # Spark takes blocks to have the bytes of the queries, and would broadcast them: a query goes to many pivots
        found = blocks.hint("merge").join(index.chunks.hint("merge"), "pivot").mapInArrow(_compared(index.dim, k), "query_id long, doc_id long, score double")
        best = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("doc_id"))
        return found.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k).drop("r")

    first = written(met(asked.withColumn("reach", F.lit(None).cast("double"))))
    kth = first.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("s"))
    # a score that rounds to the k-th best still counts
    reach = F.when(F.col("n") >= k, F.acos(F.greatest(F.col("s") - 2 * 10.0**-PLACES, F.lit(-1.0))) + SLACK).otherwise(float(np.pi))
    again = asked.join(kth.select("query_id", reach.alias("reach")), asked["id"] == kth["query_id"], "left").select("id", "v", F.coalesce("reach", F.lit(float(np.pi))).alias("reach"))
    return ranked(first.unionByName(met(again)), k)


def vector_topk(queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """`search` in clusters made for it."""
    return search(queries, clusters(vectors), k)
