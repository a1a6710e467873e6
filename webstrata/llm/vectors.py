"""Reading embedding columns as matrices inside Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def matrices(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, matrix in double precision) for each length of vectors in a list column.

    Null and empty vectors and those with a null or non-finite component are in none.
    """
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)  # a null component becomes nan
    begins = np.cumsum(sizes) - sizes
    for size in np.unique(sizes[sizes > 0]):
        places = np.flatnonzero(sizes == size)
        matrix = values[begins[places][:, None] + np.arange(size)]
        good = np.isfinite(matrix).all(1)
        if good.any():
            yield places[good], matrix[good]


def unit(matrix: np.ndarray) -> np.ndarray:
    """Rows of length one; rows of zeros stay. Scaled by the largest component first, so that no square overflows or vanishes."""
    largest = np.abs(matrix).max(1, keepdims=True)
    scaled = matrix / np.where(largest > 0, largest, 1)
    norm = np.sqrt((scaled * scaled).sum(1, keepdims=True))
    return scaled / np.where(norm > 0, norm, 1)
