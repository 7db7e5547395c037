"""Whole vectors as integer matrices, batch by batch."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def finite_vectors(df: DataFrame, *columns: str, vector: str = "embedding") -> DataFrame:
    """``columns`` and ``vector`` (as doubles, last) of the rows whose vector is there and wholly finite.

    A vector of length 0 holds no bad entry and stays.
    """
    entry_is_good = f"forall(`{vector}`, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity'))"
    kept = df.filter(F.col(vector).isNotNull() & F.expr(entry_is_good))
    return kept.select(*columns, F.col(vector).cast("array<double>").alias(vector))


def scaled_floor(column: pa.ListArray, scale: float, most: float, width: int | None = None) -> np.ndarray:
    """floor(scale * entry) of each vector as a row of a matrix of doubles that are whole numbers.

    Numbers beyond ``most`` either way count as ``most``. A vector shorter than ``width`` (by default the longest of
    the batch) is filled up with 0.
    """
    sizes = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    if width is None:
        width = int(sizes.max(initial=0))
    values = np.floor(column.flatten().to_numpy(zero_copy_only=False) * scale)
    np.clip(values, -most, most, out=values)
    if len(values) == len(sizes) * width:
        return values.reshape(len(sizes), width)
    rows = np.zeros((len(sizes), width))
    rows[np.arange(width) < sizes[:, None]] = values
    return rows
