"""Tables that a job keeps for its own later steps, in the folder that all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a session on one machine that has none (tests) gets one here."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not base:
        context = spark.sparkContext._jsc.sc()
        if not context.getCheckpointDir().isDefined():
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            spark.sparkContext.setCheckpointDir("/tmp/checkpoints")
        base = context.getCheckpointDir().get()
    return base.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes a table once and returns a reader of it: lineage ends there, a lost executor costs nothing that was written."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def removed(df: DataFrame) -> None:
    """Deletes the files behind a table of stored(). Nothing may read it later."""
    jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
    for parent in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(parent)
        path.getFileSystem(conf).delete(path, True)
