"""Shared plumbing of the training-data operators: tables in the shared folder, Arrow batches, word rules."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: A word is a run of characters other than space, tab, line feed, vertical tab, form feed and carriage return.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows that Spark hands to Python carry at most about this many bytes of text at a time.
CHUNK_BYTES = 4 << 20
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or one set here where a session on one machine has none (tests)."""
    conf = spark.sparkContext.getConf()
    base = conf.get("spark.checkpoint.dir", None)
    if not base:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        if found.isDefined():
            base = found.get()
        else:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            spark.sparkContext.setCheckpointDir("/tmp/checkpoints")
            base = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return base.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes a table once into the shared folder and returns a reader of it, so lineage ends there.

    Spark deletes the shuffle files of the write when it ends: nothing reads them again.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Deletes the files behind a table made by materialize(). Nothing may read it later."""
    jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
    for parent in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(parent)
        path.getFileSystem(conf).delete(path, True)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet")


def text_bytes(column) -> list[bytes]:
    """UTF-8 of an Arrow string column; null counts as empty."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def batches(frames: Iterator[pa.RecordBatch], text: str = "text", most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of about `most` bytes of the text column; a longer text is a slice of its own."""
    for frame in frames:
        if not frame.num_rows:
            continue
        column = frame.column(frame.schema.get_field_index(text))
        lengths = pc.fill_null(pc.binary_length(column), 0).to_pylist()
        start = total = 0
        for i, n in enumerate(lengths):
            if i > start and total + n > most:
                yield frame.slice(start, i - start)
                start, total = i, 0
            total += n
        yield frame.slice(start)


def release() -> None:
    """Gives what this process has freed back to the system: Python workers are used again, beside those of the next stage."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    def rows(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from fn(frames)
        release()

    return df.mapInArrow(rows, schema)


def word_count(column):
    """Words of a text, on the JVM; null has none."""
    return F.coalesce(F.regexp_count(column, F.lit(WORD)), F.lit(0)).cast("long")
