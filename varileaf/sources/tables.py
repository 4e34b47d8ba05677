"""The driver's tables, and results as JSON and as text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LINE_IDS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
LINE_FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def labelled_csv(spark: SparkSession, path: str, label: str, positive: str) -> DataFrame:
    """A CSV with a header whose text label becomes 1 for `positive` and 0 otherwise."""
    raw = spark.read.csv(path, header=True, inferSchema=True)
    return raw.withColumn(label, (F.trim(F.col(f"`{label}`").cast("string")) == positive).cast("int"))


#: task, dataset, method, params, metrics and timestamp of each run
RESULT = "task string, dataset string, method string, params map<string,double>, metrics map<string,double>, timestamp string"


def write_results(results: DataFrame, path: str) -> None:
    results.coalesce(1).write.mode("overwrite").json(path)


def read_results(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RESULT).json(path)


def results_table(results: DataFrame, task: str, metric: str, dataset: str | None = None) -> str:
    """Datasets by methods as text."""
    rows = results.where(F.col("task") == task)
    if dataset is not None:
        rows = rows.where(F.col("dataset") == dataset)
    wide = rows.groupBy("dataset").pivot("method").agg(F.avg(F.element_at("metrics", metric))).orderBy("dataset")
    lines = [wide.columns] + [[r[0], *["-" if v is None else f"{v:.4f}" for v in r[1:]]] for r in wide.collect()]
    width = [max(len(x[i]) for x in lines) for i in range(len(wide.columns))]
    return "\n".join("  ".join(v.ljust(w) for v, w in zip(x, width, strict=True)).rstrip() for x in lines)


def summary(results: DataFrame) -> DataFrame:
    """Mean, deviation, median, range and count of each metric by method."""
    each = results.select("dataset", "method", F.explode("metrics").alias("metric", "value"))
    return each.groupBy("method", "metric").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.median("value").alias("median"), F.min("value").alias("min"), F.max("value").alias("max"), F.count("value").alias("n"))
