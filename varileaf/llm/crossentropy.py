"""Cross-entropy difference: two word trigram models over one vocabulary, and the difference of a document's losses under them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varileaf.llm import ngrams
from varileaf.llm.common import discard, materialize, text_bytes

#: So many targets at most go to all executors, so that texts needn't be shuffled to meet them. This decides the work, never the result.
TARGETS = 1 << 22


def marked(docs: DataFrame, target: DataFrame) -> DataFrame:
    """doc_id, text and whether the document is in-domain."""
    wanted = target.select(F.col("doc_id").cast("long").alias("of")).where("of is not null").distinct().withColumn("hit", F.lit(True))
    if wanted.count() <= TARGETS:
        wanted = F.broadcast(wanted)
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return given.join(wanted, F.col("doc_id") == F.col("of"), "left").select("doc_id", "text", F.coalesce("hit", F.lit(False)).alias("hit"))


def score(docs: DataFrame, target: DataFrame) -> DataFrame:
    """doc_id, n_tokens, loss_target, loss_background and score, their difference (the lower, the more like the target).

    target: doc_ids of the in-domain documents; the background is every document. Both models have the same words, order and
    smoothing, and are counted over whole texts. A null or empty text has no tokens and score 0; repeated rows and null doc_ids stay
    and are background; without targets the target model is uniform; an empty table gives none; other columns are left out.
    """
    # written once, as both passes over the texts read it
    given = materialize(marked(docs, target), "marked")

    def read(frame: pa.RecordBatch) -> tuple[list[bytes], list[np.ndarray]]:
        return text_bytes(frame.column(1)), [np.array(frame.column(2).to_pylist(), bool)]

    def describe(frame: pa.RecordBatch, texts: list[bytes], sizes: np.ndarray) -> list:
        return [frame.column(0), pa.array(sizes, pa.int64())]

    scored = ngrams.mean_losses(given, read, describe, "doc_id long, n_words long", 2)
    discard(given)
    a, b = F.col("losses")[0], F.col("losses")[1]
    return scored.select("doc_id", F.col("n_words").alias("n_tokens"), a.alias("loss_target"), b.alias("loss_background"), (a - b).alias("score"))
