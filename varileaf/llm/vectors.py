"""Vectors as integers: entries scaled by 1024 and floored, in matrices of a batch's usable rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCALE = 1024


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet")


def chosen(df: DataFrame, key: str, vector: str) -> DataFrame:
    """The id as a long and the vector as doubles, whatever else the table has."""
    return df.select(F.col(f"`{key}`").cast("long").alias("vec_id"), F.col(f"`{vector}`").cast("array<double>").alias("v"))


def usable(column: pa.ListArray, most: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Length of each row's vector, or -1 where it is null or holds a null, a non-finite entry or one of `most` or more in magnitude
    (of which a long can't hold what is computed); all entries; where each row's entries start."""
    offsets = column.offsets.to_numpy()
    entries = column.values.to_numpy(zero_copy_only=False)  # nulls are not numbers here
    lengths = np.diff(offsets).astype(np.int64)
    bad = np.concatenate(([0], np.cumsum(~(np.abs(entries[offsets[0] : offsets[-1]]) < most))))
    at = offsets - offsets[0]
    lengths[(bad[at[1:]] > bad[at[:-1]]) | column.is_null().to_numpy(zero_copy_only=False)] = -1
    return lengths, entries, offsets[:-1].astype(np.int64)


def integers(frame: pa.RecordBatch, dims: int, most: float) -> tuple[pa.Array, np.ndarray]:
    """vec_id and floor(SCALE * entry) of the usable rows of `dims` entries."""
    lengths, entries, starts = usable(frame.column(1), most)
    rows = np.flatnonzero(lengths == dims)
    picked = entries[starts[rows, None] + np.arange(dims)]
    return frame.column(0).take(pa.array(rows)), np.floor(SCALE * picked).astype(np.int64)


def matrices(frames: Iterator[pa.RecordBatch], dims: int, most: float) -> Iterator[tuple[pa.Array, np.ndarray]]:
    for frame in frames:
        ids, x = integers(frame, dims, most)
        if len(x):
            yield ids, x
