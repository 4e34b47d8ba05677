"""Assignment and partition statistics on streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter


def partition_windows(df: DataFrame, time: str, value: str, width: str, late: str | None = None, slide: str | None = None) -> DataFrame:
    """window_start, partition_id, n, mean and std by event time. late: how long a stream waits for rows out of order."""
    given = df.withWatermark(time, late) if late else df
    window = F.window(time, width, slide) if slide else F.window(time, width)
    return given.groupBy(window.alias("w"), "partition_id").agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std")).select(F.col("w.start").alias("window_start"), "partition_id", "n", "mean", "std")


def reduce_batches(stream: DataFrame, model, ratio: float, sink: Callable[[DataFrame, int], None], method: str = "stratified") -> DataStreamWriter:
    """Each micro-batch reduced by a fitted model and handed to the sink; empty ones are skipped."""

    def one(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            sink(model.reduce(ratio=ratio, method=method, X=batch), number)

    return stream.writeStream.foreachBatch(one)
