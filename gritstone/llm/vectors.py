"""Vectors out of Arrow batches, shared by the operators on ``embeddings``."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def slim(rows: DataFrame, *others: str) -> DataFrame:
    """vec_id, embedding and ``others`` alone, rows with an id; other columns, whatever their names, take no part."""
    return rows.select(rows["vec_id"].cast("long").alias("vec_id"), "embedding", *others).where("vec_id is not null")


def matrices(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, matrix) for each length of vector: rows that are null, empty or hold null or non-finite components are left out."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten()
    if flat.null_count:
        flat = pc.fill_null(flat, pa.scalar(float("nan"), flat.type))
    values = flat.to_numpy(zero_copy_only=False)
    starts = np.cumsum(lengths) - lengths
    for dim in np.unique(lengths[lengths > 0]).tolist():
        rows = np.flatnonzero(lengths == dim)
        matrix = values[starts[rows][:, None] + np.arange(dim)] if len(rows) < len(lengths) else values.reshape(-1, dim)
        sound = np.isfinite(matrix).all(axis=1)
        if sound.any():
            yield rows[sound], matrix[sound]


def blocks_of(rows: DataFrame, size: int) -> list[DataFrame]:
    """``rows`` in parts of about ``size`` rows, dealt by a hash of vec_id."""
    n = max(1, -(-rows.count() // size))
    return [rows] if n == 1 else [rows.where(F.pmod(F.xxhash64("vec_id"), F.lit(n)) == at) for at in range(n)]
