"""Passages of words that another document holds too, by suffix arrays over shards of candidate segments of word codes.

A text is the sequence of its words' codes here, so white space doesn't count. Windows of `words` words have anchors and segments as those of
bytes have in repeats.py. A document's equal segments are one row, so that a segment's rows are the documents that hold it: those of two or
more are shared as a whole; where an anchor has several kinds of segments, one of each kind goes to the anchor's shard, whose suffix array tells
which windows lie in several documents. Anchors with more than HOT kinds are counted by two 64-bit hashes, as in repeats.py.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varileaf.llm import repeats
from varileaf.llm.common import batches, discard, map_arrow, materialize, text_bytes
from varileaf.llm.rolling import Prefix, mixed, word_codes
from varileaf.llm.suffixes import permuted_lcp, refine

#: Words of a passage, "over 50", and of an anchor.
WORDS, K = 51, 12


def _found(docs: DataFrame, words: int, k: int) -> DataFrame:
    """Segments of the documents; los: their first starts in the document, n: their windows."""

    def rows(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in batches(frames, most=repeats.BATCH):
            d, r = (frame.column(c).to_numpy() for c in (0, 1))
            own, anchor, seg, lo, hi = (np.concatenate(x) for x in zip(*repeats.placed(word_codes(text_bytes(frame.column(2))), words, k), strict=True))
            order = np.lexsort((lo, seg, anchor, own))
            own, anchor, seg, lo, hi = (x[order] for x in (own, anchor, seg, lo, hi))
            same = (own[1:] == own[:-1]) & (anchor[1:] == anchor[:-1]) & (seg[1:] == seg[:-1])
            first = np.flatnonzero(np.concatenate(([True], ~same))) if len(own) else order
            los = pa.ListArray.from_arrays(pa.array(np.append(first, len(own)), pa.int32()), pa.array(lo))
            yield pa.RecordBatch.from_arrays([pa.array(d[own[first]]), pa.array(r[own[first]]), pa.array(anchor[first]), pa.array(seg[first]), los, pa.array((hi - lo + 1)[first])], names=["d", "r", "anchor", "seg", "los", "n"])

    return map_arrow(docs.where(F.octet_length("text") >= 2 * words - 1), rows, "d long, r long, anchor long, seg long, los array<long>, n long")


def shared_words(parts: list[np.ndarray], owners: list[int], words: int = WORDS) -> list[np.ndarray]:
    """Of each segment the starts of windows that a segment of another owner has too."""
    sizes = np.array([len(p) for p in parts])
    stops = np.cumsum(sizes + 1) - 1
    data = np.zeros(stops[-1] + 1, np.uint64)
    for p, stop in zip(parts, stops.tolist(), strict=True):
        data[stop - len(p) : stop] = p
    limit = (np.repeat(stops, sizes + 1) - np.arange(len(data))).astype(np.int32)
    names = np.unique(data, return_inverse=True)[1] + len(parts)
    names[stops] = np.arange(len(parts))
    order = refine(names)
    common, _ = permuted_lcp(data, order.astype(np.int32), limit)
    first = np.flatnonzero(common[order] < words)  # of suffixes that begin with the same window
    own = np.repeat(np.array(owners), sizes + 1)[order]
    several = np.minimum.reduceat(own, first) != np.maximum.reduceat(own, first)
    flag = np.zeros(len(data), bool)
    flag[order] = np.repeat(several, np.diff(first, append=len(data)))
    return [np.flatnonzero(flag[stop - n : stop]) for n, stop in zip(sizes.tolist(), stops.tolist(), strict=True)]


def _by_suffix_array(cut: DataFrame, words: int) -> DataFrame:
    def rows(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in repeats._shards(row for frame in frames for row in zip(*(frame.column(i).to_pylist() for i in range(6)), strict=True)):
            number: dict = {}  # what several documents hold is an owner of its own
            owners = [number.setdefault((d, r) if c == 1 else i, len(number)) for i, (_, d, r, _, c, _) in enumerate(held)]
            out: list[tuple[int, int, int, int]] = []
            for (_, d, r, los, c, _), found in zip(held, shared_words([np.frombuffer(h[5], np.uint64) for h in held], owners, words), strict=True):
                if c == 1:
                    a, b = repeats._runs(found)
                    out += [(d, r, lo + x, lo + y) for lo in los for x, y in zip(a.tolist(), b.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], pa.int64()) for i in range(4)], names=["d", "r", "lo", "hi"])

    dealt = cut.select("anchor", "d", "r", "los", "c", "bytes").repartition("anchor").sortWithinPartitions("anchor")
    return map_arrow(dealt, rows, "d long, r long, lo long, hi long")


def _by_counting(cut: DataFrame, words: int) -> DataFrame:
    """A window counts for as many documents as hold its segment; a document's own segments with the same window are one row first."""

    def rows(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            for d, r, los, c, raw in zip(*(x.to_pylist() for x in frame.columns), strict=True):
                data = np.frombuffer(raw, np.uint64)
                at = np.arange(len(data) - words + 1)
                h = Prefix(data).of(at, at + words)
                g = mixed(Prefix(mixed(data ^ np.uint64(0x5A))).of(at, at + words) + h)
                for lo in los:
                    n = len(at)
                    yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(g.view(np.int64)), pa.array([d] * n, pa.int64()), pa.array([r] * n, pa.int64()), pa.array(lo + at), pa.array([c] * n, pa.int64())], names=["h", "g", "d", "r", "lo", "c"])

    each = map_arrow(cut.select("d", "r", "los", "c", "bytes"), rows, "h long, g long, d long, r long, lo long, c long")
    whose = F.xxhash64("d", "r")
    several = each.groupBy("h", "g").agg(F.min(whose).alias("a"), F.max(whose).alias("b"), F.max("c").alias("c")).where("c > 1 or a != b").select("h", "g")
    return each.where("c = 1").join(several, ["h", "g"], "left_semi").select("d", "r", "lo", F.col("lo").alias("hi"))


def intervals(docs: DataFrame, words: int = WORDS, k: int = K) -> DataFrame:
    """d, r and places: first and last starts, in words, of windows that another row holds too, of every text that has any. Written to the shared folder."""
    given = repeats._keyed(docs).select("d", "r", "text")
    found = materialize(_found(given, words, k), "word-segments")
    kinds = materialize(found.groupBy("anchor", "seg").agg(F.count(F.lit(1)).alias("c"), F.min(F.struct("d", "r", "los", "n")).alias("at")), "word-kinds")
    several = kinds.groupBy("anchor").agg(F.count(F.lit(1)).alias("k"), F.min("c").alias("least")).where("k > 1 and least = 1").select("anchor", "k")
    wanted = kinds.join(several, "anchor").select(F.col("at.d").alias("d"), F.col("at.r").alias("r"), F.struct("anchor", "at.los", "at.n", "c", "k").alias("s")).groupBy("d", "r").agg(F.collect_list("s").alias("parts"))

    def cut(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in batches(frames, most=repeats.BATCH):
            out: list[list] = [[] for _ in range(7)]
            for d, r, codes, parts in zip(frame.column(0).to_pylist(), frame.column(1).to_pylist(), word_codes(text_bytes(frame.column(2))), frame.column(3).to_pylist(), strict=True):
                for s in parts:
                    lo = s["los"][0]
                    for column, value in zip(out, (s["anchor"], d, r, s["los"], s["c"], s["k"], codes[lo : lo + s["n"] + words - 1].tobytes()), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, [*[pa.int64()] * 3, pa.list_(pa.int64()), *[pa.int64()] * 2, pa.binary()], strict=True)], names=["anchor", "d", "r", "los", "c", "k", "bytes"])

    pieces = materialize(map_arrow(given.join(wanted, ["d", "r"]).select("d", "r", "text", "parts"), cut, "anchor long, d long, r long, los array<long>, c long, k long, bytes binary"), "word-pieces")
    whole = found.join(kinds.where("c > 1").select("anchor", "seg"), ["anchor", "seg"], "left_semi").select("d", "r", F.explode("los").alias("lo"), "n").select("d", "r", "lo", (F.col("lo") + F.col("n") - 1).alias("hi"))
    part = _by_suffix_array(pieces.where(F.col("k") <= repeats.HOT), words).unionByName(_by_counting(pieces.where(F.col("k") > repeats.HOT), words))
    out = materialize(whole.unionByName(part).groupBy("d", "r").agg(F.collect_set(F.struct("lo", "hi")).alias("places")), "passages")
    for x in (found, kinds, pieces):
        discard(x)
    return out


def counted(docs: DataFrame, words: int = WORDS, k: int = K) -> DataFrame:
    """d, r, n_passages and n_passage_words: maximal runs of words that such windows cover, and the words in them, of every text that has any.

    Null texts and those of fewer words have none; a row that repeats another counts as another document; an empty table gives none.
    """

    def rows(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            runs = [repeats.spans(x, words) for x in frame.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([frame.column(0), frame.column(1), pa.array([len(x) for x in runs], pa.int64()), pa.array([sum(b - a for a, b in x) for x in runs], pa.int64())], names=["d", "r", "n_passages", "n_passage_words"])

    return map_arrow(intervals(docs, words, k), rows, "d long, r long, n_passages long, n_passage_words long")
