"""Vectors of Arrow list columns as matrices."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def matrices(column: pa.Array | pa.ChunkedArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each length: the rows with vectors of so many components, none of them null or non-finite, and these as float64."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    size = np.asarray(pc.fill_null(pc.list_value_length(column), 0)).astype(np.int64)
    values = np.asarray(pc.fill_null(column.flatten().cast(pa.float64()), np.nan))
    at = np.cumsum(size) - size
    for n in np.unique(size[size > 0]).tolist():
        rows = np.flatnonzero(size == n)
        found = values[at[rows][:, None] + np.arange(n)]
        good = np.isfinite(found).all(1)
        if good.any():
            yield rows[good], found[good]


def units(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which rows have a direction, and these scaled to length 1."""
    most = np.abs(matrix).max(1)
    some = most > 0
    scaled = matrix[some] / most[some, None]
    return some, scaled / np.sqrt((scaled * scaled).sum(1))[:, None] + 0.0
