"""Quality rules: counts of words, symbols and repeats, and perplexity bands of each language."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from varileaf.llm import ngrams
from varileaf.llm.common import text_bytes

#: A document's log perplexity may lie so many quartile distances (at least LEAST) beyond its language's quartiles.
WIDTH, LEAST = 4.0, 0.02
#: Share of a language's documents that is sorted on either side of where a quartile about is. This decides the work, never the result.
NEAR = 0.001
#: A repeated window's words.
WINDOW = 5
#: So many rounds the texts are scored in, for the sake of the disk.
ROUNDS = 2
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD)]
_SYMBOLS = b"#*$%&|<>"


def repeat_words(words: list[list[bytes]]) -> np.ndarray:
    """Of each document, the words that lie in a window found twice or more in it."""
    sizes = np.array([len(w) for w in words], np.int64)
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    out = np.zeros(len(words), np.int64)
    if total < WINDOW:
        return out
    h = np.fromiter((hash(w) for doc in words for w in doc), np.int64, total).view(np.uint64)
    doc = np.repeat(np.arange(len(words)), sizes)
    last = total - WINDOW + 1
    code = np.zeros(last, np.uint64)
    for i in range(WINDOW):
        code = (code ^ h[i : i + last]) * _ODD[i]
        code ^= code >> np.uint64(29)
    inside = np.flatnonzero(doc[:last] == doc[WINDOW - 1 :])
    code = code[inside] ^ (doc[inside].astype(np.uint64) * _ODD[0])
    order = np.argsort(code)
    same = code[order][1:] == code[order][:-1]
    twice = np.zeros(len(code), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    marks = np.zeros(total + 1, np.int64)
    at = inside[twice]
    np.add.at(marks, at, 1)
    np.add.at(marks, at + WINDOW, -1)
    covered = np.cumsum(marks[:-1]) > 0
    return np.bincount(doc[covered], minlength=len(words))


def duplicate_lines(text: bytes) -> int:
    """Lines with a word that equal an earlier one."""
    if b"\n" not in text:
        return 0
    lines = [x for x in text.split(b"\n") if x.strip(b" \t\n\x0b\x0c\r")]
    return len(lines) - len(set(lines))


_FIELDS = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, lang string"


def measure(docs: DataFrame) -> DataFrame:
    """The base counts and the log perplexity of every whole text."""

    def read(frame: pa.RecordBatch) -> tuple[list[bytes], list[np.ndarray]]:
        return text_bytes(frame.column(1)), []

    def describe(frame: pa.RecordBatch, texts: list[bytes], sizes: np.ndarray) -> list:
        words = [t.split() for t in texts]
        code_points = [sum(map(len, w)) if t.isascii() else len(b"".join(w).decode("utf-8", "replace")) for t, w in zip(texts, words, strict=True)]
        symbols = [len(t) - len(t.translate(None, _SYMBOLS)) for t in texts]
        return [frame.column(0), pa.array(sizes, pa.int64()), code_points, symbols, [duplicate_lines(t) for t in texts], pa.array(repeat_words(words)), frame.column(2)]

    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    return ngrams.mean_losses(given, read, describe, _FIELDS, 1, ROUNDS).withColumn("loss", F.col("losses")[0]).drop("losses")


def quartiles(df: DataFrame, group: str, value: str) -> DataFrame:
    """group and q: the exact first and third quartile of each group, the least value that so many of its rows don't exceed.

    Two values around each quartile are found approximately; rows below them are counted, and only distinct values between them are sorted.
    """
    shares = (0.25, 0.75)
    probes = [max(0.0, min(1.0, s + e)) for s in shares for e in (-NEAR, NEAR)]
    around = df.groupBy(group).agg(F.percentile_approx(value, F.array(*map(F.lit, probes)), int(4 / NEAR)).alias("p"), F.count(F.lit(1)).alias("n"))
    around = around.select(F.col(group).alias("of"), "n", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(s).alias("share"), F.col("p")[2 * i].alias("a"), F.col("p")[2 * i + 1].alias("b")) for i, s in enumerate(shares)])).alias("r")).select("of", "n", "r.*")
    each = df.select(group, value).join(around, F.col(group).eqNullSafe(F.col("of"))).where(F.col(value) <= F.col("b"))
    inside = F.when(F.col(value) >= F.col("a"), F.col(value))  # all that is less counts as one
    counted = each.groupBy("of", "i", "share", "n", inside.alias("v")).agg(F.count(F.lit(1)).alias("k"))
    upto = F.sum("k").over(W.partitionBy("of", "i").orderBy(F.col("v").asc_nulls_first()))
    found = counted.withColumn("upto", upto).where(F.col("v").isNotNull() & (F.col("upto") >= F.ceil(F.col("n") * F.col("share"))))
    least = found.groupBy("of", "i").agg(F.min("v").alias("v"))
    return least.groupBy(F.col("of").alias(group)).agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "v"))), lambda x: x["v"]).alias("q"))


def apply_rules(docs: DataFrame, width: float = WIDTH) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, perplexity.

    A null or empty text has no words and fails. A null language is a language of its own. Repeated rows and null doc_ids stay;
    an empty table gives none; other columns are left out. The model counts all texts; a language's band comes from all its documents
    that pass the base rules, and a document on its edge is kept.
    """
    measured = measure(docs)
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    bands = quartiles(measured.where(~failed), "lang", "loss")
    reach = F.greatest(F.col("q")[1] - F.col("q")[0], F.lit(LEAST)) * width
    bands = bands.select(F.col("lang").alias("of"), (F.col("q")[0] - reach).alias("low"), (F.col("q")[1] + reach).alias("high"))
    joined = measured.join(bands, F.col("lang").eqNullSafe(F.col("of")), "left")
    return joined.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & F.coalesce(F.col("loss").between(F.col("low"), F.col("high")), F.lit(False))).alias("kept"), F.exp("loss").alias("perplexity")
    )
