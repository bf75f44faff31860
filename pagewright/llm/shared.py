"""Connected components, size-checked broadcasts, and samples of a bounded size."""

from __future__ import annotations

import gc

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import BROADCAST_BYTES, dropped, small, spread, written  # noqa: F401 (operators take them from here)

#: Rows that a Python worker gets at once: each may be a long text.
BATCH_ROWS = 1_000


def whole_texts(spark: SparkSession) -> SparkSession:
    """The session, with Arrow batches of few rows, as a batch of texts is held whole on both sides."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    return spark


def freed(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of finished jobs, which it does when the driver's JVM collects what named them."""
    gc.collect()
    spark._jvm.System.gc()


def whole_number(df: DataFrame, key: str) -> None:
    """Raises a TypeError unless the column holds whole numbers, as components are named by the smallest."""
    if df.schema[key].dataType.typeName() not in ("byte", "short", "integer", "long"):
        raise TypeError(f"column {key} has to hold whole numbers, not {df.schema[key].dataType.simpleString()}")


def keyed(df: DataFrame, key: str) -> bool:
    """Whether every row has a key of its own: none null, none twice."""
    return not df.groupBy(key).count().where(F.col(key).isNull() | (F.col("count") > 1)).limit(1).count()


def bounded(df: DataFrame, keys: list[str], rows: int, n: int) -> DataFrame:
    """The `rows` rows of `df` (of `n`) that come first by a hash of their keys.

    Twice as many are let through by the hash itself, in the scan, so that what reaches the last sort is bounded by
    `rows` and not by tasks times `rows`.
    """
    h = F.xxhash64(*keys)
    if n > 4 * rows:
        df = df.where(F.pmod(h, F.lit(1 << 40)) < int((1 << 40) * 2 * rows / n) + 1)
        h = F.pmod(h, F.lit(1 << 40))
    return df.orderBy(h, *keys).limit(rows)


def _forest(batches):
    """Edges of a task replaced by a spanning forest whose roots are the smallest ids; memory is bounded by flushing."""
    import numpy as np
    import pyarrow as pa

    up: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while (y := up.get(top, top)) != top:
            top = y
        while (y := up.get(x, x)) != top and y != x:
            up[x] = top
            x = y
        return top

    def flush():
        pairs = np.array([(k, root(k)) for k in up if root(k) != k], np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = root(a), root(b)
            if a != b:
                up[max(a, b)] = min(a, b)
                up.setdefault(min(a, b), min(a, b))
        if len(up) > 500_000:
            yield flush()
            up = {}
    yield flush()


def components(edges: DataFrame) -> DataFrame:
    """Smallest reachable id of every node that has an edge.

    edges: columns a, b (long).  Returns node, component, for nodes with component < node only; all other
    nodes are their own component.  Rounds of large-star / small-star with task-local forests in between;
    each round is written to the shared folder.  Rounds grow with the logarithm of the longest chain; no
    node's neighbours are gathered in one row, as every step is a grouped minimum and an equi-join.
    """
    now = written(edges.select("a", "b").where("a <> b").mapInArrow(_forest, "a long, b long").distinct())
    while True:
        both = now.union(now.select("b", "a")).toDF("u", "v")
        # the smallest neighbour, of nodes that have a smaller one; a table, so that the joins on a hub can be split
        low = written(both.groupBy("u").agg(F.min("v").alias("m")).where("m < u"))
        # large-star: larger neighbours move to the smallest neighbour; small-star then moves the rest
        large = written(both.where("v > u").join(low.hint("merge"), "u", "left").select(F.col("v").alias("a"), F.coalesce("m", "u").alias("b")))
        low2 = written(large.groupBy("a").agg(F.min("b").alias("m")))
        star = large.join(low2.hint("merge"), "a").select(F.explode(F.array(F.struct(F.col("a").alias("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*")
        nxt = written(star.where("a <> b").distinct())
        # done when every node has one parent that is a root
        busy = nxt.groupBy("a").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count() or nxt.select("b").distinct().join(nxt.select(F.col("a").alias("b")), "b", "left_semi").limit(1).count()
        for t in (low, large, low2):
            dropped(t)
        dropped(now)
        now = nxt
        if not busy:
            return now.toDF("node", "component")
        now = now.mapInArrow(_forest, "a long, b long").distinct()
