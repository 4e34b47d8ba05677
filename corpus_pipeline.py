"""A corpus pipeline of five training-data stages: language, near duplicates, repeated passages, source mix, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from varileaf.llm import jaccard, langid, mixing, packing, repeats
from varileaf.llm.common import documents, materialize
from varileaf.llm.tokens import tokenizer_path

#: Bytes of a repeated passage: those of over 50 words are met whose words have four letters or more on average.
PASSAGE = 250


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told go on; the model learns from the labelled ones.

    Null texts and texts without a letter go; repeated rows share their fate; an empty table stays empty.
    """
    return langid.confident(docs, langid.fit(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest doc_id stays, as one row; rows without a doc_id stay.

    Null and wordless texts are linked with nothing. Of rows that share that doc_id the first by hashes of the text and of all columns stays.
    """
    told = [F.col(f"`{c}`") for c, kind in docs.dtypes if "map<" not in kind]
    heads = jaccard.join(docs).where("doc_id = component_id").select(F.col("doc_id").alias("head")).distinct()
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("key"), F.struct(F.xxhash64(F.col("text").cast("string")), F.xxhash64(*told)).alias("order"))
    kept = row.where("key is not null").join(heads, F.col("key") == F.col("head"), "left_semi")
    one = kept.withColumn("place", F.row_number().over(W.partitionBy("key").orderBy("order"))).where("place = 1")
    return one.select("row").union(row.where("key is null").select("row")).select("row.*")


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes in strings of PASSAGE bytes that also start elsewhere go; a document that nothing is left of goes with them.

    Null and shorter texts stay; of rows that repeat one another all lose what is long enough; an empty table stays empty.
    """
    return repeats.cleaned(docs, PASSAGE, PASSAGE // 4)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the quotas of its source take it; wordless texts go, null sources are one source."""
    return mixing.repeated(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of the packing length; a null or empty text is its end id alone."""
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("source_mix", source_mix),
    ("packed", packed),
]

#: Language models, links, suffix arrays and tokenizers have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over all documents; each result is written to the shared folder and reread."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
