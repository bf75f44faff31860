"""Tables of wide rows: row groups of a few rows each."""

import glob

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq

from pagewright.operators import locate, retrieval
from pagewright.storage import WIDE_GROUP, shared_dir, write_wide


def _groups(path: str) -> list[int]:
    """Bytes of each row group."""
    found = (pq.read_metadata(f) for f in glob.glob(f"{path}/*.parquet"))
    return [m.row_group(i).total_byte_size for m in found for i in range(m.num_row_groups)]


def _wide(batches):
    for batch in batches:
        for i in batch.column(0).to_pylist():
            x = np.random.default_rng(i).integers(0, 1 << 62, 500_000)
            yield pa.RecordBatch.from_arrays([pa.array([i]), pa.array([x.tolist()], pa.list_(pa.int64()))], ["id", "x"])


def test_row_groups_are_small(spark, tmp_path):
    path = str(tmp_path / "wide")
    write_wide(spark.range(0, 12, 1, 1).mapInArrow(_wide, "id long, x array<long>"), path)  # 4 MB a row
    assert len(_groups(path)) >= 4 and max(_groups(path)) <= WIDE_GROUP + 5_000_000
    assert spark.read.parquet(path).selectExpr("count(*)", "sum(size(x))").first()[:] == (12, 6_000_000)


def _letters(batches):
    for batch in batches:
        rows = [bytes(np.random.default_rng(i).integers(97, 123, 500_000, np.uint8)).decode() for i in batch.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows)], ["doc_id", "text"])


def test_kept_word_index(spark, tmp_path):
    docs = spark.range(0, 24, 1, 1).mapInArrow(_letters, "doc_id long, text string").selectExpr("doc_id", "regexp_replace(text, '[a-e]', ' ') as text")
    index = retrieval.index(docs, "word", str(tmp_path / "words"))
    assert index.size == 24 and len(_groups(f"{tmp_path}/words/shards")) > 1


def _few(batches):
    for batch in batches:
        for i in batch.column(0).to_pylist():
            x = pa.array(np.random.default_rng(i).integers(0, 16, 100_000))
            yield pa.RecordBatch.from_arrays([pa.array([i]), pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)], ["id", "x"])


def test_row_groups_are_small_as_vectors(spark, tmp_path):
    """Before, values of a dictionary counted as their codes: a group of a few MB was sixteen times as much in a reader's vectors."""
    path = str(tmp_path / "few")
    write_wide(spark.range(0, 60, 1, 1).mapInArrow(_few, "id long, x array<long>"), path)  # 0.8 MB a row as vectors
    found = [pq.read_metadata(f) for f in glob.glob(f"{path}/*.parquet")]
    held = [8 * m.row_group(i).column(1).num_values for m in found for i in range(m.num_row_groups)]
    assert sum(held) == 48_000_000 and max(held) <= 10_000_000


def test_an_index_leaves_no_table_that_nothing_reads(spark):
    tables = lambda: set(glob.glob(f"{shared_dir(spark).removeprefix('file://')}/cut-*/cut-*"))
    docs = spark.createDataFrame([(1, "one two"), (2, "two three")], "doc_id long, text string")
    before = tables()
    made = retrieval.index(docs, "word")
    assert len(tables() - before) == 2 and made.shards.count() >= 1 and made.terms.count() == 4  # before: 3


def test_kept_suffix_index(spark, tmp_path):
    docs = spark.range(0, 24, 1, 1).mapInArrow(_letters, "doc_id long, text string")
    path = str(tmp_path / "suffixes")
    assert locate.index(docs, "doc_id", "text", path=path).selectExpr("sum(size(keys))").first()[0] == 24
    assert len(_groups(path)) > 1
