"""What a task, the JVM and a join hold does not grow with the corpus."""

import pyarrow as pa
from pyspark.sql import functions as F

from pagewright import storage
from pagewright.operators import retrieval as r
from pagewright.plans import evaluate as ev


def test_shards_reach_python_in_small_batches(spark, monkeypatch):
    """Before, one batch held all shards of a task."""
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    monkeypatch.setattr(storage, "BATCH_BYTES", 200_000)
    monkeypatch.setattr(r, "SHARD", 20_000)
    docs = spark.range(200).select(F.col("id").alias("doc_id"), F.array_join(F.transform(F.sequence(F.lit(1), F.lit(800)), lambda i: F.concat(F.lit("w"), (F.col("id") * 31 + i) % 5000)), " ").alias("text")).coalesce(1)
    made = r.index(docs, "word")
    sizes = made.shards.mapInArrow(lambda bs: (pa.RecordBatch.from_arrays([pa.array([b.num_rows])], ["n"]) for b in bs), "n long")
    most, all_ = sizes.agg(F.max("n"), F.sum("n")).first()
    assert all_ > 20 and most <= 4


def test_texts_are_not_shuffled_for_a_context(spark, tmp_path):
    """Before, all texts were sorted and dealt out by document for the few that a prompt takes."""
    spark.createDataFrame([(i, f"tax plan {i} " + "revenue of the year " * 6, "en", "s", 100) for i in range(40)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([("1", "tax plan 7"), ("2", "revenue")], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = ev.rag_context(spark, str(tmp_path))
        assert found.count() == 2
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
