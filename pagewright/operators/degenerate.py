"""Repetition in a text: how often its most frequent character n-gram occurs."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def most_repeated(docs: DataFrame, n: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, most: of the text without white space at its ends; 1 if that is shorter than n, 0 if it is empty or null.  Within
    the scan; nothing is shuffled."""

    def run(batches):
        for batch in batches:
            most = []
            for t in batch.column(1).to_pylist():
                code = np.frombuffer((t or "").strip().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
                if len(code) < n:
                    most.append(int(len(code) > 0))
                    continue
                size = len(code) - n + 1
                _, key = np.unique(code, return_inverse=True)
                key, kinds = key.astype(np.int64), int(key.max()) + 1
                run_key = key[:size]
                for i in range(1, n):  # renumbered at each step, so that keys stay small
                    _, run_key = np.unique(run_key * kinds + key[i : i + size], return_inverse=True)
                most.append(int(np.bincount(run_key).max()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(most, pa.int64())], ["doc_id", "most"])

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, most long")
