"""Mixing sources to target weights: Sainte-Laguë quotas of equal-token blocks, then seeded block selection."""

from __future__ import annotations

import heapq
import math
from fractions import Fraction

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from varileaf.llm.common import materialize, word_count

#: Words in a block; quotas are whole blocks, and what is left of a target is settled in words.
BLOCK = 16
#: A source is dealt over shards of about this many documents.
SHARD_DOCS = 1 << 15
#: A target stops at so many times its source's size.
REPEATS = 3
SEED = 20
#: Sources whose sizes the driver may hold; a source is a label such as a crawl or a site, not a key of each row.
MOST_SOURCES = 1_000_000


def targets(sizes: list[int], weights: list[int], repeats: int = REPEATS) -> list[float]:
    """Shares of the sum of sizes by weight; one that would exceed repeats x its size stops there, the rest is shared anew."""
    out = [0.0] * len(sizes)
    open_, left = [i for i, n in enumerate(sizes) if n], Fraction(sum(sizes))
    while open_:
        total = sum(weights[i] for i in open_)
        full = [i for i in open_ if left * weights[i] > repeats * sizes[i] * total]
        if not full:
            for i in open_:
                out[i] = float(left * weights[i] / total)
            break
        for i in full:
            out[i] = float(repeats * sizes[i])
            left -= repeats * sizes[i]
        open_ = [i for i in open_ if i not in set(full)]
    return out


def apportion(votes: list[float], seats: int) -> list[int]:
    """Sainte-Laguë: every seat goes to the highest of votes / (2 * seats so far + 1); ties to the first.

    Rounding at a divisor that is surely too large deals at once seats that everybody keeps, no more than there are; the others
    go one by one from a heap.
    """
    total, n = sum(votes), sum(v > 0 for v in votes)
    out = [0] * len(votes)
    if not total or seats <= 0:
        return out
    if 2 * seats > n:
        divisor = total / (seats - n / 2)
        out = [max(0, math.floor(v / divisor + 0.5 - 1e-9)) for v in votes]
    heap = [(-v / (2 * k + 1), i) for i, (v, k) in enumerate(zip(votes, out, strict=True)) if v]
    heapq.heapify(heap)
    for _ in range(seats - sum(out)):
        _, i = heap[0]
        out[i] += 1
        heapq.heapreplace(heap, (-votes[i] / (2 * out[i] + 1), i))
    return out


def shard_quotas(words: list[int], blocks: int, target: int, repeats: int = REPEATS) -> list[int]:
    """Words that each shard of a source gives: its blocks of the source's, then word by word what is left of the target, as far as it has room."""
    out = [min(n * BLOCK, repeats * w) for n, w in zip(apportion([float(w) for w in words], blocks), words, strict=True)]
    left = target - sum(out)
    for i, w in enumerate(words):
        step = min(left, repeats * w - out[i]) if left > 0 else max(left, -out[i])
        out[i] += step
        left -= step
    return out


def _blocks(words: int) -> int:
    return -(-words // BLOCK)


def mix(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """doc_id, size, source_size, target and taken: the words that the mix takes of each document, repeats counted.

    Sources by code point, null last, weigh 1, 2, 3, 1, ...; a source without words has target 0. In a source, documents are dealt to shards and ordered by seeded hashes;
    a shard's words form a circle of blocks, of which the quota's whole rounds take all and the rest is a run from a seeded start.
    So nearly every document is taken a whole number of times. A null text has size 0 and is never taken; rows that repeat
    a doc_id are mixed as rows of their own; an empty table gives an empty result; extra columns are left out.
    """
    sized = materialize(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size")), "mix-sizes")
    return plan(sized, seed).select("doc_id", "size", "source_size", "target", "taken")


def plan(sized: DataFrame, seed: int = SEED) -> DataFrame:
    """Adds source_size, target and taken to a written table that has doc_id, source and size; rows alike are mixed each by itself.

    Null sources are one source, the last; rows of size 0 are taken 0 times; an empty table gives none.
    """
    spark = sized.sparkSession
    sources = sized.groupBy("source").agg(F.count(F.lit(1)).alias("docs"), F.sum("size").alias("words")).limit(MOST_SOURCES + 1).collect()
    if len(sources) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    sources.sort(key=lambda r: (r.source is None, (r.source or "").encode("utf-32-be")))
    shards = [-(-r.docs // SHARD_DOCS) for r in sources]
    wanted = targets([r.words for r in sources], [1 + i % 3 for i in range(len(sources))])
    blocks = apportion(wanted, round(sum(wanted) / BLOCK))
    shape = "source string, of long, source_size long, target double"
    table = spark.createDataFrame([(r.source, n, r.words, t) for r, n, t in zip(sources, shards, wanted, strict=True)], shape)
    # one row a source: at most MOST_SOURCES, and the optimizer broadcasts only what its own limit allows
    dealt = (
        sized.alias("d")
        .join(table.alias("s"), F.col("d.source").eqNullSafe(F.col("s.source")), "inner")
        .select("d.*", "s.of", "s.source_size", "s.target")
        .withColumn("order", F.xxhash64(F.lit(seed), "doc_id", "size"))
        .withColumn("shard", F.pmod(F.xxhash64(F.lit(seed + 1), "order"), F.col("of")))
    )
    totals: dict = {}
    for r in dealt.groupBy("source", "shard").agg(F.sum("size").alias("words")).collect():  # a row for every SHARD_DOCS documents
        totals.setdefault(r.source, []).append((r.shard, r.words))
    quotas = []
    for r, quota, want in zip(sources, blocks, wanted, strict=True):
        own = sorted(totals.get(r.source, []))
        given = shard_quotas([w for _, w in own], quota, round(want))
        for (shard, words), n in zip(own, given, strict=True):
            start = (hash_start(seed, len(quotas)) % _blocks(words)) * BLOCK if words else 0
            quotas.append((r.source, shard, words, n, start))
    quota = spark.createDataFrame(quotas, "source string, shard long, words long, quota long, begin long")
    both = dealt.alias("d").join(quota.alias("q"), F.col("d.source").eqNullSafe(F.col("q.source")) & (F.col("d.shard") == F.col("q.shard"))).select("d.*", "q.words", "q.quota", "q.begin")
    line = W.partitionBy("source", "shard").orderBy("order", "doc_id").rowsBetween(W.unboundedPreceding, W.currentRow)
    at = both.withColumn("stop", F.sum("size").over(line)).withColumn("at", F.col("stop") - F.col("size"))
    rest = F.when(F.col("words") > 0, F.col("quota") % F.col("words")).otherwise(F.lit(0))
    rounds = F.when(F.col("words") > 0, F.floor(F.col("quota") / F.col("words"))).otherwise(F.lit(0))
    overlap = lambda low, high: F.greatest(F.lit(0), F.least(F.col("stop"), high) - F.greatest(F.col("at"), low))
    run = overlap(F.col("begin"), F.col("begin") + rest) + overlap(F.lit(0), F.col("begin") + rest - F.col("words"))
    return at.withColumn("taken", (rounds * F.col("size") + run).cast("long")).drop("of", "order", "shard", "words", "quota", "begin", "stop", "at")


def hash_start(seed: int, k: int) -> int:
    """A seeded number for the k-th shard."""
    x = (seed * 0x9E3779B97F4A7C15 + k * 0xBF58476D1CE4E5B9 + 1) & (1 << 64) - 1
    x = (x ^ x >> 31) * 0x94D049BB133111EB & (1 << 64) - 1
    return x >> 3


def repeated(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """The mixed table itself: each document as often as the mix takes it, rounded to whole copies, with its own columns, whatever their names.

    Null and wordless texts go; rows that repeat a doc_id, source and size are taken equally often; an empty table gives none.
    """
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count(F.col("text").cast("string")).alias("size"))
    sized = materialize(row, "mix-docs")
    counted = plan(sized.select("doc_id", "source", "size"), seed)
    copies = counted.select("doc_id", "source", "size", F.round(F.col("taken") / F.col("size")).cast("int").alias("copies")).where("size > 0 and copies > 0")
    times = copies.groupBy("doc_id", "source", "size").agg(F.max("copies").alias("copies"))
    joined = sized.alias("d").join(times.alias("t"), F.col("d.doc_id").eqNullSafe(F.col("t.doc_id")) & F.col("d.source").eqNullSafe(F.col("t.source")) & (F.col("d.size") == F.col("t.size")))
    return joined.select(F.col("d.row").alias("row"), F.explode(F.sequence(F.lit(1), F.col("t.copies"))).alias("copy")).select("row.*")
