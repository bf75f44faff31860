"""Operators that need an order: numbering, as-of join, first-wins dedupe, samples, rotation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..storage import written


def _ranges(df: DataFrame, *order: str) -> DataFrame:
    """The rows, written in ranges of the order (spark.sql.shuffle.partitions of them): `__p`, the range, which rises with it, and
    `__r`, the place in the range (from 0).

    The table is written, as the bounds of ranges come from a sample and would differ if they were taken again.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(n, *order).sortWithinPartitions(*order)
    # an id that rises within a partition counts its rows in the lower 33 bits
    return written(ranged.withColumn("__p", F.spark_partition_id()).withColumn("__r", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))))


def numbered(df: DataFrame, key: str, *ties: str) -> DataFrame:
    """Adds `i`, the row's number (from 0) in the order of a key of any type that has one, and `n`, the number of rows.

    Rows of a key, which a hot key may have many of, are ordered by `ties`, and then by a hash of the row, so that they
    need not be in one range; null keys come first.  Rows are counted by range, and the only window over everything has a row a range.
    """
    whole = F.xxhash64(*(F.col(c) for c in df.columns if df.schema[c].dataType.typeName() not in ("map", "variant")))
    rows = _ranges(df.withColumn("__h", whole), key, *ties, "__h").drop("__h")
    per = rows.groupBy("__p").agg(F.count(F.lit(1)).alias("__c"))
    before = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    per = per.select(F.col("__p").alias("__q"), F.coalesce(F.sum("__c").over(before), F.lit(0)).alias("__before"), F.sum("__c").over(Window.partitionBy()).alias("n"))
    out = rows.join(F.broadcast(per), F.col("__p") == F.col("__q"))  # a row a range
    return out.withColumn("i", F.col("__before") + F.col("__r")).select(*df.columns, "i", "n")


def stride_sample(df: DataFrame, key: str, k: int) -> DataFrame:
    """Rows int(j * n / k) for j in 0..k-1, in the key's order."""
    at = numbered(df, key)
    j = F.ceil(F.col("i") * k / F.col("n"))
    picked = (F.floor(j * F.col("n") / F.lit(k)) == F.col("i")) & (j < k)
    return at.where((F.col("n") <= k) | picked).drop("i", "n")


def rotated(df: DataFrame, key: str, value: str, by: int = 37, name: str = "rotated") -> DataFrame:
    """Each row with the value of the row `by` places on, around the end."""
    at = numbered(df, key)
    other = at.select(F.col("i").alias("__j"), F.col(value).alias(name))
    return at.join(other, F.pmod(F.col("i") + by, F.col("n")) == F.col("__j")).drop("i", "n", "__j")


def asof(left: DataFrame, right: DataFrame, on: list[str], at: str, value: str, seq: str, default: str) -> DataFrame:
    """Left rows with the value of the last right row at or before them; of equals the largest `seq` wins.  Null keys are
    a key; a null place comes before all others; a null value counts as none.

    A prefix scan in segments: each (key, place) counts once, whatever rows it has; these are written in ranges of (key, place), so
    that a hot key lies in many ranges.  Each range scans its own part of a key, and takes over what the ranges before
    it end with: of a key one value a range.
    """
    keys = [f"__k{i}" for i in range(len(on))]
    key = [F.col(c).alias(k) for c, k in zip(on, keys)]
    last = F.max_by(F.col(value).cast("string"), F.struct(seq, F.col(value).cast("string")))
    known = right.where(F.col(value).isNotNull()).groupBy(*key, F.col(at).alias("__at")).agg(last.alias("__v"))
    asked = left.select(*key, F.col(at).alias("__at")).withColumn("__v", F.lit(None).cast("string"))
    points = known.unionByName(asked).groupBy(*keys, "__at").agg(F.max("__v").alias("__v"))
    rows = _ranges(points, *keys, "__at").drop("__r")
    ends = rows.where("__v is not null").groupBy(*keys, "__p").agg(F.max_by("__v", F.struct("__at")).alias("__v"))
    parts = rows.select(*keys, "__p").distinct().withColumn("__v", F.lit(None).cast("string")).unionByName(ends).groupBy(*keys, "__p").agg(F.max("__v").alias("__v"))
    over = Window.partitionBy(*keys).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    carried = parts.select(*(F.col(k).alias(f"{k}_") for k in keys), F.col("__p").alias("__q"), F.last("__v", ignorenulls=True).over(over).alias("__carried")).where("__carried is not null")
    within = Window.partitionBy(*keys, "__p").orderBy("__at").rowsBetween(Window.unboundedPreceding, 0)
    same = [F.col(k).eqNullSafe(F.col(f"{k}_")) for k in keys]
    scanned = rows.withColumn("__v", F.last("__v", ignorenulls=True).over(within)).join(carried, [*same, F.col("__p") == F.col("__q")], "left")
    scanned = scanned.select(*keys, "__at", F.coalesce("__v", "__carried").alias("__v")).where("__v is not null")
    same = [left[c].eqNullSafe(F.col(k)) for c, k in zip(on, keys)]
    return left.join(scanned, [*same, left[at].eqNullSafe(F.col("__at"))], "left").select(*left.columns, F.coalesce("__v", F.lit(default)).alias(value))


def running_sum(df: DataFrame, on: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """Adds the sum of a value over the rows of a key up to each row, in an order that tells the rows of a key apart.

    As in `asof`, ranges of (key, order) are summed, and each takes over what those before it have of its first key.
    """
    rows = _ranges(df, *on, *order)
    parts = rows.groupBy(*on, "__p").agg(F.sum(value).alias("__s"))
    over = Window.partitionBy(*on).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    carried = parts.select(*(F.col(c).alias(f"__{c}_") for c in on), F.col("__p").alias("__q"), F.coalesce(F.sum("__s").over(over), F.lit(0)).alias("__before"))
    within = Window.partitionBy(*on, "__p").orderBy("__r").rowsBetween(Window.unboundedPreceding, 0)
    same = [rows[c].eqNullSafe(F.col(f"__{c}_")) for c in on]
    out = rows.withColumn("__own", F.sum(value).over(within)).join(carried, [*same, F.col("__p") == F.col("__q")])
    return out.select(*df.columns, (F.col("__before") + F.col("__own")).alias(name))


def first_wins(df: DataFrame, text: Column, order: str) -> DataFrame:
    """One row per text without anything but letters and digits: the first in the order.

    Grouped minimum of the order per digest, so no group of equal texts is gathered.
    """
    d = df.withColumn("__d", F.md5(F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\p{L}\p{N}_]", "")))
    first = d.groupBy("__d").agg(F.min(order).alias("__first"), F.count(F.lit(1)).alias("copies"))
    return d.join(first.withColumnRenamed("__d", "__e"), (F.col("__d") == F.col("__e")) & (F.col(order) == F.col("__first"))).drop("__d", "__e", "__first")


def stratified(df: DataFrame, stratum: str, key: str, k: int, seed: str = "s") -> DataFrame:
    """k rows (all, if there are fewer): each stratum's share of them (half to even), the smallest stratum the rest, what it
    lacks from the others; rows by a hash of the key."""
    size = df.groupBy(stratum).agg(F.count(F.lit(1)).alias("__n"))
    w = Window.partitionBy()
    order = Window.orderBy(F.desc("__n"), stratum)
    quota = size.withColumn("__o", F.row_number().over(order)).withColumn("__q", F.bround(F.lit(k) * F.col("__n") / F.sum("__n").over(w)).cast("long"))
    before = F.coalesce(F.sum("__q").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    quota = quota.withColumn("__q", F.when(F.col("__o") == F.max("__o").over(w), F.lit(k) - before).otherwise(F.col("__q"))).select(F.col(stratum).alias("__s"), "__q")
    hashed = F.md5(F.concat(F.lit(seed), F.col(key).cast("string")))
    # no stratum gives more than k, so each task ranks k rows of it at most
    rank = F.row_number().over(Window.partitionBy(stratum).orderBy("__h", key))
    ranked = df.withColumn("__h", hashed).withColumn("__r", rank).where(F.col("__r") <= k).join(quota, F.col(stratum).eqNullSafe(F.col("__s")))
    # the quotas first, then the rest by hash
    ranked = ranked.withColumn("__over", (F.col("__r") > F.col("__q")).cast("int"))
    return ranked.orderBy("__over", "__h", key).limit(k).drop("__s", "__q", "__r", "__h", "__over")


def latest(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row per key: the last in the order.  A grouped maximum, so repeated keys are not gathered."""
    rest = [c for c in df.columns if c not in keys and c != order]
    return df.groupBy(*keys).agg(F.max_by(F.struct(order, *rest), F.struct(order, F.struct(*rest))).alias("__x")).select(*keys, "__x.*")


def first_accepted(tries: DataFrame, key: str, order: str, accepted: Column, value: str) -> DataFrame:
    """Per key the value of its first accepted try, or '' if there is none."""
    return tries.groupBy(key).agg(F.coalesce(F.min_by(value, F.when(accepted, F.col(order))), F.lit("")).alias(value))


def first_rows(df: DataFrame, order: str, k: int) -> DataFrame:
    """The first k rows in the order, numbered from 1 as `place`."""
    return df.orderBy(order).limit(k).withColumn("place", F.row_number().over(Window.orderBy(order)))


def in_order(df: DataFrame, name: str, wanted: list[str]) -> DataFrame:
    """Rows sorted by a fixed list of names; those that it lacks follow, by name."""
    at = F.array_position(F.array(*map(F.lit, wanted)), F.col(name))
    return df.withColumn("place", F.row_number().over(Window.orderBy(F.when(at > 0, at).otherwise(len(wanted) + 1), name))).orderBy("place")


def zipped(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Rows of two tables of one length side by side, by their place in the order of their keys (equal keys of one table in no
    particular order)."""
    a, b = numbered(left, key).drop("n"), numbered(right, key).drop("n", key)
    return a.join(b, "i").drop("i")
