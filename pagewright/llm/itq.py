"""Embedding near-dedup: iterative quantisation, multi-index Hamming tables, exact reranking.

Vectors equal in all components are one class.  A rotation is learned on a bounded sample (SAMPLE vectors, by hash) so
that the signs of the rotated, centred components are balanced bits with little quantisation error; several
rotations (from different starts) lengthen the code.  A code is cut into keys, one a table, each probed
with every key within Hamming distance 1.  The width of a key follows the logarithm of the number of vectors, so
buckets stay small at any size, and the number of tables follows from the width: it is raised until at most MISS
of pairs at exactly the threshold's angle (made from the sample, so that skewed directions and centring count)
would escape all tables, and never falls below what the angle alone asks for.

Near-duplicate groups are not enumerated.  A vector within half the threshold's angle of the smallest vector of one
of its buckets joins that vector's ball.  Vectors of one ball all link, by the triangle inequality, and are
counted.  Tables hold each ball once a key.  Two balls that meet in a table are compared by the exact angle of their
centres: where the radii decide, all their vectors link or none; else the vectors of one are compared with the other's
centre, and only where that leaves it open are vectors compared one by one.  Every comparison is the cosine of the original
vectors in double precision, so nothing below the threshold links.

Vectors of each dimension are compared among themselves.  A dimension that is rare in the sample has random rotations in place
of learned ones, for which the number of tables holds as well.

Defined results: a null, empty, zero or non-finite vector, or one with a null component, links with nothing; so does a row
with a null id, which is kept; ids are whole numbers (others raise a TypeError); labels and extra columns are ignored,
whatever their names; rows that share an id are one vector if equal, else each row counts; equal angles go to the smaller id;
an empty table gives an empty result.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import bounded, components, whole_number, written

SAMPLE = 20_000
MISS = 0.001
#: Bits of the short code that sorts out most pairs that met by chance.
SKETCH = 64
#: Angles this near a bound are not decided by it (radians).
SLACK = 1e-6
ROUNDS = 3


def learn(sample: np.ndarray, bits: int, rounds: int = 30, seed: int = 7) -> np.ndarray:
    """Projection (dimension x bits) whose signs are the code: as many learned rotations as the bits need."""
    rng = np.random.default_rng(seed)
    d = sample.shape[1]
    _, _, axes = np.linalg.svd(sample, full_matrices=False) if len(sample) else (0, 0, np.eye(d))
    main = axes.T[:, : min(d, bits, len(axes))]  # principal axes
    v = sample @ main
    out = []
    while sum(x.shape[1] for x in out) < bits:
        r, _ = np.linalg.qr(rng.standard_normal((main.shape[1], main.shape[1])))
        for _ in range(rounds if len(v) else 0):
            u, _, w = np.linalg.svd(np.where(v @ r >= 0, 1.0, -1.0).T @ v)
            r = (u @ w).T
        out.append(main @ r)
    return np.concatenate(out, 1)[:, :bits]


def tables_for(width: int, angle: float) -> int:
    """Tables of that key width with which at most MISS of pairs at that angle escape, if their bits differ by it."""
    p = angle / np.pi
    q = (1 - p) ** width + width * p * (1 - p) ** (width - 1)
    return max(1, int(np.ceil(np.log(MISS) / np.log1p(-q))))


class Code:
    """Keys and sketch of unit vectors of one dimension."""

    def __init__(self, mean: np.ndarray, project: np.ndarray, width: int):
        self.mean, self.project, self.width = mean, project, width

    def bits(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) @ self.project >= 0

    def __call__(self, x: np.ndarray, tables: int) -> tuple[np.ndarray, np.ndarray]:
        bit = self.bits(x)
        keys = bit[:, SKETCH : SKETCH + tables * self.width].reshape(len(x), tables, self.width)
        sketch = np.packbits(bit[:, :SKETCH], axis=1).view(np.int64)[:, 0]
        return (keys << np.arange(self.width)).sum(2).astype(np.int64), sketch


def fit(sample: np.ndarray, width: int, angle: float, seed: int = 7, most: int = 1024) -> tuple[Code, int, float, float]:
    """A code for unit vectors of one dimension, its number of tables, and how many bits of the sketches of vectors at that
    angle differ: mean and deviation.  Measured on pairs made from the sample.  Where vectors are so alike that `most` tables
    would still lose more than MISS, keys are made shorter (see the code's width): of 8 bits, even random ones meet often enough."""
    rng = np.random.default_rng(seed)
    mean = sample.mean(0)
    x = sample[:2_000]
    u = rng.standard_normal(x.shape)
    u -= (u * x).sum(1, keepdims=True) * x
    y = np.cos(angle) * x + np.sin(angle) * u / np.maximum(np.linalg.norm(u, axis=1, keepdims=True), 1e-300)
    tables, missed, parts = 0, np.ones(len(x), bool), []
    add = tables_for(width, angle)
    while tables == 0 or (missed.mean() > MISS and tables < most):
        parts.append(learn(sample - mean if tables == 0 else (sample - mean)[:5_000], add * width + (SKETCH if tables == 0 else 0), seed=seed + tables))
        both = Code(mean, parts[-1], width)
        apart = both.bits(x) != both.bits(y)
        if tables == 0:
            off = apart[:, :SKETCH].sum(1)
            apart = apart[:, SKETCH:]
        missed &= (apart.reshape(len(x), add, width).sum(2) > 1).all(1)
        tables += add
        add = max(1, tables // 2)
        # tables miss alike at best: where so many would not do, no more are learned at this width
        if width > 8 and (missed.all() or missed.mean() > MISS and tables * np.log(MISS) / np.log(missed.mean()) > most):
            break
    if missed.mean() > MISS and width > 8:
        return fit(sample, max(8, width - 8), angle, seed, most)
    return Code(mean, np.concatenate(parts, 1), width), tables, float(off.mean()), float(off.std())


@cache
def _random(d: int, width: int, tables: int) -> Code:
    return Code(np.zeros(d), learn(np.zeros((0, d)), SKETCH + width * tables), width)


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    """Rows of a list column as unit vectors in double precision; zeros where a row is not a valid vector of d components."""
    out = np.zeros((len(column), d))
    size = np.asarray(column.value_lengths().fill_null(-1))
    flat = column.flatten()
    start = np.r_[0, np.cumsum(np.maximum(size, 0))[:-1]]
    good = size == d
    values = flat.cast(pa.float64()).to_numpy(zero_copy_only=False)  # null components become NaN
    if good.any():
        out[good] = values[start[good][:, None] + np.arange(d)]
    out[~np.isfinite(out).all(1)] = 0
    out /= np.maximum(np.abs(out).max(1, keepdims=True, initial=0), 1e-300)  # so that no square overflows
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-300)


def _codes(shared, width: int, tables: int):
    def run(batches):
        codes = shared.value
        for batch in batches:
            size = np.asarray(batch.column(1).value_lengths())
            for d in np.unique(size).tolist():
                pick = pa.array(np.flatnonzero(size == d))
                part = batch.take(pick)
                keys, sketch = (codes.get(d) or _random(d, width, tables))(_matrix(part.column(1), d), tables)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), pa.array(keys.tolist(), pa.list_(pa.int64())), pa.array(sketch)], ["rep", "v", "many", "keys", "sketch"])

    return run


def _angles(batches):
    """Replaces two columns of vectors, x and y, by the cosine and the angle between them."""
    for batch in batches:
        names = batch.schema.names
        x, y = batch.column(names.index("x")), batch.column(names.index("y"))
        size = np.asarray(x.value_lengths())
        cosine = np.zeros(batch.num_rows)
        for d in np.unique(size).tolist():
            pick = np.flatnonzero(size == d)
            at = pa.array(pick)
            cosine[pick] = np.einsum("ij,ij->i", _matrix(x.take(at), d), _matrix(y.take(at), d))
        cols = [batch.column(i) for i, n in enumerate(names) if n not in ("x", "y")]
        yield pa.RecordBatch.from_arrays([*cols, pa.array(cosine), pa.array(np.arccos(np.clip(cosine, -1, 1)))], [*[n for n in names if n not in ("x", "y")], "cosine", "angle"])


def _with_angles(pairs: DataFrame, vectors: DataFrame, one: str, two: str) -> DataFrame:
    """Adds the cosine and the angle of the vectors that two columns name."""
    x, y = vectors.select(F.col("rep").alias(one), F.col("v").alias("x")), vectors.select(F.col("rep").alias(two), F.col("v").alias("y"))
    both = pairs.join(x, one).join(y, two).select(*pairs.columns, "x", "y")
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pairs.schema.fields)
    return both.mapInArrow(_angles, f"{kinds}, cosine double, angle double")


def _balls(coded: DataFrame, theta: float) -> DataFrame:
    """rep, ball (its centre's rep, the smallest of the ball) and angle to the centre, under half of theta; for vectors in
    a ball of another one."""
    left, done = coded, None
    for _ in range(ROUNDS):
        table = left.select("rep", F.size("v").alias("d"), F.posexplode("keys").alias("t", "key"))
        lead = written(table.groupBy("d", "t", "key").agg(F.min("rep").alias("ball"), F.max("rep").alias("last")).where("last > ball").drop("last"))
        near = table.join(lead.hint("merge"), ["d", "t", "key"]).where("ball < rep").select("rep", "ball").distinct()
        near = written(_with_angles(near, coded, "rep", "ball").where(F.col("angle") <= theta / 2 - SLACK).select("rep", "ball", "angle"))
        # a centre is in no other's ball
        taken = near.select(F.col("rep").alias("ball")).distinct()
        sure = written(near.join(taken, "ball", "left_anti").groupBy("rep").agg(F.min(F.struct("ball", "angle")).alias("x")).select("rep", "x.*"))
        done = sure if done is None else done.union(sure)
        # next: what has near vectors, but no centre among them
        left = coded.join(near.select("rep").distinct().join(sure, "rep", "left_anti"), "rep", "left_semi")
        if not left.limit(1).count():
            break
        left = written(left)
    return done


def near_vectors(vectors: DataFrame, cosine: float = 0.95, vec_id: str = "vec_id", embedding: str = "embedding", width: int | None = None) -> DataFrame:
    """Per vector: vec_id, class_id (smallest id of an equal vector), ball_id, n_links, component_id, kept.

    width: bits of a key; by default the logarithm of the number of classes and two.
    """
    whole_number(vectors, vec_id)
    spark = vectors.sparkSession
    theta = float(np.arccos(np.clip(cosine, -1, 1)))
    rows = vectors.select(F.col(vec_id).cast("long").alias("id"), F.col(embedding).cast("array<double>").alias("v"))
    good = F.col("id").isNotNull() & F.col("v").isNotNull() & F.forall("v", lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)) & ~F.isnan(x)) & F.exists("v", lambda x: x != 0)
    # two hashes stand for a vector, so that joins carry no components
    rows = rows.withColumn("ok", F.coalesce(good, F.lit(False))).withColumn("k1", F.xxhash64("v")).withColumn("k2", F.xxhash64(F.lit(1), "v"))
    classes = written(rows.where("ok").groupBy("k1", "k2").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("many"), F.first("v").alias("v")))
    n = classes.count()
    width = width or int(np.clip(np.ceil(np.log2(max(n, 2))) + 2, 8, 40))
    sample: dict[int, list] = {}
    for r in bounded(classes.select("rep", "v"), ["rep"], SAMPLE, n).select("v").toLocalIterator():
        sample.setdefault(len(r.v), []).append(r.v)
    codes, tables, mean, deviation = {}, tables_for(width, theta), SKETCH * theta / np.pi, np.sqrt(SKETCH * theta / np.pi)
    fits, enough = {}, {d: _matrix(pa.array(x, pa.list_(pa.float64())), d) for d, x in sample.items() if len(x) >= max(d, 64)}
    for _ in range(5):  # at most from 40 bits to 8: all dimensions have keys of the shortest width
        fits = {d: fits[d] if d in fits and fits[d][0].width == width else fit(x, width, theta) for d, x in enough.items()}
        shortest = min((f[0].width for f in fits.values()), default=width)
        if shortest == width:
            break
        width, tables = shortest, tables_for(shortest, theta)
    for d, (code, some, m, s) in fits.items():
        codes[d], tables, mean, deviation = code, max(tables, some), max(mean, m), max(deviation, s)
    for d, code in codes.items():  # as many tables for each dimension
        lacks = SKETCH + tables * width - code.project.shape[1]
        if lacks > 0:
            code.project = np.concatenate([code.project, learn(np.zeros((0, d)), lacks)], 1)
    shared = spark.sparkContext.broadcast(codes)
    coded = written(classes.select("rep", "v", "many").mapInArrow(_codes(shared, width, tables), "rep long, v array<double>, many long, keys array<long>, sketch long"))
    inside = written(_balls(coded, theta))
    member = written(coded.select("rep", "many", "keys", "sketch", F.size("v").alias("d")).join(inside, "rep", "left").select("rep", "many", "keys", "sketch", "d", F.coalesce("ball", "rep").alias("ball"), F.coalesce("angle", F.lit(0.0)).alias("angle")))
    balls = member.groupBy("ball").agg(F.max("angle").alias("radius"), F.sum("many").alias("weight"), F.count(F.lit(1)).alias("kinds"), F.max(F.when(F.col("rep") == F.col("ball"), F.col("sketch"))).alias("sketch"))
    balls = written(balls)

    # balls that meet in a table
    keys = member.select("ball", "d", F.posexplode("keys").alias("t", "key")).distinct().join(balls.select("ball", "radius", "sketch"), "ball")
    flips = F.array(F.lit(0).cast("long"), *(F.lit(1 << i).cast("long") for i in range(width)))
    probe = keys.select("d", "t", F.explode(F.transform(flips, lambda f: F.col("key").bitwiseXOR(f))).alias("key"), F.col("ball").alias("a"), F.col("radius").alias("ra"), F.col("sketch").alias("sa"))
    index = keys.select("d", "t", "key", F.col("ball").alias("b"), F.col("radius").alias("rb"), F.col("sketch").alias("sb"))
    apart = F.bit_count(F.col("sa").bitwiseXOR(F.col("sb"))) <= F.lit(mean + 6 * deviation) * (1 + (F.col("ra") + F.col("rb")) / max(theta, SLACK))
    met = probe.join(index, ["d", "t", "key"]).where(F.col("a") < F.col("b")).where(apart).select("a", "b").distinct()
    size = balls.select("ball", "radius", "weight", "kinds")
    met = _with_angles(met, coded, "a", "b").join(size.toDF("a", "ra", "wa", "na"), "a").join(size.toDF("b", "rb", "wb", "nb"), "b")
    reach = F.col("ra") + F.col("rb")
    alone = (F.col("na") == 1) & (F.col("nb") == 1)
    verdict = F.when(alone, (F.col("cosine") >= cosine).cast("int")).when(F.col("angle") - reach > theta + SLACK, 0).when(F.col("angle") + reach <= theta - SLACK, 1).otherwise(2)
    met = written(met.withColumn("all", verdict).where("all > 0"))

    # what the centres leave open: the vectors of the larger ball (x) against the centre of the other (o)
    open_ = met.where("all = 2").select(F.when(F.col("na") >= F.col("nb"), F.col("a")).otherwise(F.col("b")).alias("ball"), F.when(F.col("na") >= F.col("nb"), F.col("b")).otherwise(F.col("a")).alias("o"))
    of = member.select("ball", F.col("rep").alias("x"), F.col("many").alias("mx"))
    half = _with_angles(open_.join(of, "ball").withColumnRenamed("x", "p").withColumnRenamed("ball", "q"), coded, "p", "o").join(size.toDF("o", "ro", "wo", "no"), "o")
    verdict = F.when(F.col("no") == 1, (F.col("cosine") >= cosine).cast("int")).when(F.col("angle") - F.col("ro") > theta + SLACK, 0).when(F.col("angle") + F.col("ro") <= theta - SLACK, 1).otherwise(2)
    half = written(half.withColumn("all", verdict).where("all > 0").select("q", "o", "p", "mx", "wo", "all"))
    other = member.select(F.col("ball").alias("o"), F.col("rep").alias("r"), F.col("many").alias("mr"))
    single = written(_with_angles(half.where("all = 2").select("q", "o", "p", "mx").join(other, "o"), coded, "p", "r").where(F.col("cosine") >= cosine).select("q", "o", "p", "r", "mx", "mr"))

    sure, some = met.where("all = 1"), half.where("all = 1")
    by_ball = sure.select(F.col("a").alias("ball"), F.col("wb").alias("w")).union(sure.select("b", "wa")).union(some.select("o", "mx")).groupBy("ball").agg(F.sum("w").alias("of_ball"))
    by_one = some.select(F.col("p").alias("rep"), F.col("wo").alias("w")).union(single.select("p", "mr")).union(single.select("r", "mx")).groupBy("rep").agg(F.sum("w").alias("own"))
    edges = sure.select("a", "b").union(some.select("q", "o")).union(single.select("q", "o")).distinct()
    comp = components(edges)
    balls = balls.select("ball", "weight").join(by_ball, "ball", "left").join(comp, F.col("ball") == F.col("node"), "left")
    balls = balls.select("ball", (F.col("weight") - 1 + F.coalesce("of_ball", F.lit(0))).alias("links"), F.coalesce("component", "ball").alias("component_id"))
    found = member.select("rep", "ball").join(balls, "ball").join(by_one, "rep", "left")
    found = written(classes.select("k1", "k2", "rep").join(found.select("rep", "ball", (F.col("links") + F.coalesce("own", F.lit(0))).alias("n_links"), "component_id"), "rep"))
    valid = rows.where("ok").select("id", "k1", "k2").join(found.hint("merge"), ["k1", "k2"]).select(F.col("id").alias("vec_id"), F.col("rep").alias("class_id"), F.col("ball").alias("ball_id"), F.col("n_links").cast("long").alias("n_links"), "component_id")
    rest = rows.where("not ok").select("id", "id", "id", F.lit(0).cast("long"), "id")
    return valid.union(rest).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
