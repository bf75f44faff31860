"""Tables that cut lineage, in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Bytes a core that a table has to have to be read as its files lie.
SPREAD_BYTES = 16_000_000


def spread(df: DataFrame) -> DataFrame:
    """A table of few bytes in fewer files than there are cores, dealt out to all cores; any other one as it is."""
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size < cores * SPREAD_BYTES and len(df.inputFiles()) < cores else df


#: Bytes that may be broadcast; beyond it the same join is shuffled.
BROADCAST_BYTES = 16_000_000


def small(df: DataFrame) -> DataFrame:
    """`df` (already written) with a broadcast hint if its rows, counted, are within the bound in bytes, else unchanged."""
    return F.broadcast(df) if df.count() * _width(df) <= BROADCAST_BYTES else df


def _width(df: DataFrame) -> int:
    """Bytes of a row: 40 a value, the longest array's 16 an element."""
    lists = [F.size(f.name) for f in df.schema.fields if f.dataType.typeName() == "array"]
    longest = max((x or 0 for x in df.agg(*(F.max(x) for x in lists)).first()), default=0) if lists else 0
    return 40 * len(df.columns) + 16 * longest * len(lists)


#: Bytes of an Arrow batch (a longer row is a batch of its own).
BATCH_BYTES = 4_000_000


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches of bounded bytes from now on: the default bounds rows only, and both the JVM and Python hold a batch whole."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir.  Without that setting a temporary one, in local mode only: elsewhere each executor
    would write to a disk of its own."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not at:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="pagewright-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


#: Bytes of a row group of wide rows.
WIDE_GROUP = 2_000_000


def write_wide(df: DataFrame, path: str) -> None:
    """A Parquet table of rows of megabytes each, in row groups of a few of them.  By default a writer looks at the size of what
    it holds after a hundred rows first, and a reader takes in a row group as a whole; codes of a dictionary would count for less than the
    vectors that a reader makes of them (zstd makes up for them on disk)."""
    options = {"compression": "zstd", "parquet.block.size": WIDE_GROUP, "parquet.enable.dictionary": "false", "parquet.block.size.row.check.min": 1, "parquet.page.size.row.check.min": 1}
    df.write.options(**options).parquet(path)


def written(df: DataFrame, wide: bool = False) -> DataFrame:
    """The same rows, as a Parquet table in the shared folder: later jobs depend on that table only.  wide: as `write_wide`."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cut-{spark.sparkContext.applicationId}/cut-{uuid.uuid4().hex}"
    if wide:
        write_wide(df, path)
    else:
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def dropped(df: DataFrame) -> None:
    """Deletes a table made by `written` that nothing will read again."""
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/cut-" in path:
            _delete(df.sparkSession, path)


def cleared(spark: SparkSession) -> None:
    """Deletes all tables of `written` of this application, once their results are stored elsewhere."""
    _delete(spark, f"{shared_dir(spark)}/cut-{spark.sparkContext.applicationId}")
