"""Rows of a list column as matrices, and partial sums of tasks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


def dense(column: pa.Array, d: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and matrix (double) of the rows that have exactly d components, all of them finite."""
    size = lengths(column)
    start = np.r_[0, np.cumsum(np.maximum(size, 0))[:-1]]
    values = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)  # null components become NaN
    at = np.flatnonzero(size == d)
    x = values[start[at][:, None] + np.arange(d)]
    good = np.isfinite(x).all(1)
    return at[good], x[good]


def lengths(column: pa.Array) -> np.ndarray:
    """Components of each row; -1 for a null vector."""
    return np.asarray(column.value_lengths().fill_null(-1))


def whole(x: np.ndarray, scale: int, most: int) -> np.ndarray:
    """floor(scale * x) as integers; a ValueError where one is `most` or more in size, as sums of squares would not be exact."""
    x = np.floor(x * scale)
    if len(x) and np.abs(x).max() >= most:
        raise ValueError(f"a component times {scale} is not below {most} in size")
    return x.astype(np.int64)


def _added(batches):
    total: dict[tuple[int, int], np.ndarray] = {}
    for batch in batches:
        for d, i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            row = np.asarray(v.values)
            total[d, i] = total[d, i] + row if (d, i) in total else row.astype(float)
    keys = list(total)
    columns = [pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.int32()), pa.array([total[k].tolist() for k in keys], pa.list_(pa.float64()))]
    yield pa.RecordBatch.from_arrays(columns, ["d", "i", "v"])


def added(rows: DataFrame) -> DataFrame:
    """Rows v (lists of doubles) of the same d and i added up; a task holds the sums of its keys only."""
    return rows.repartition("d", "i").mapInArrow(_added, "d int, i int, v array<double>")
