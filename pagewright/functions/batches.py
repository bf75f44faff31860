"""Arrow columns worked on in slices of bounded bytes: a batch has up to 10,000 rows, and a row as an object in Python several times its bytes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of a slice (a longer row is a slice of its own).
SLICE_BYTES = 2_000_000


def sizes(column: pa.Array) -> np.ndarray:
    """Bytes of each text (or of each list of them)."""
    if pa.types.is_list(column.type):
        within = np.r_[0, np.cumsum(sizes(column.values))]
        at = np.asarray(column.offsets)
        return within[at[1:]] - within[at[:-1]]
    return np.asarray(pc.fill_null(pc.binary_length(column), 0)).astype(np.int64) + 16


def slices(*columns: pa.Array) -> Iterator[tuple[int, int]]:
    """From where to where the slices of the columns go."""
    upto = np.cumsum(sum(sizes(c) for c in columns))
    cuts = (np.flatnonzero(np.diff(upto // SLICE_BYTES)) + 1).tolist() if len(upto) else []
    return zip([0, *cuts], [*cuts, len(upto)])


def mapped(column: pa.Array, f: Callable, kind: pa.DataType) -> pa.Array:
    """f of each row that is not null; null of the others."""
    return pa.concat_arrays([pa.array((None if x is None else f(x) for x in column.slice(a, b - a).to_pylist()), kind) for a, b in slices(column)])
