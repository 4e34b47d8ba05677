"""Removal of repeated byte strings with suffix arrays over shards of candidate segments.

Every window of `length` bytes has a canonical anchor, its least gram of `k` bytes by hash (the leftmost of equals), so equal windows
have equal anchors at equal places. The starts that share an anchor form a segment, and all windows of a document lie in one segment each. Segments that
occur twice as a whole are repeats; where an anchor has several kinds of segments, one of each kind goes to the anchor's shard, whose suffix array
and common prefixes tell which windows are shared. Segments of an anchor with more than HOT kinds aren't gathered: their windows are counted by
two 64-bit hashes, which Spark sums before it shuffles.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varileaf.llm.common import batches, discard, map_arrow, materialize, text_bytes
from varileaf.llm.rolling import Prefix, mixed
from varileaf.llm.suffixes import permuted_lcp, suffix_array

#: Bytes of a repeat, and of an anchor.
LENGTH, K = 400, 100
HOT = 4096
#: Bytes of a shard's suffix array, and starts that one piece of a long text has.
SHARD, PIECE = 3 << 20, 1 << 22
#: Bytes of texts that are cut into segments at a time; each byte takes about sixty in arrays.
BATCH = 1 << 19
_PLACE = np.uint64((1 << 24) - 1)


def sliding_least(v: np.ndarray, width: int) -> np.ndarray:
    """Minimum of v[p : p + width] for every p."""
    n = len(v) - width + 1
    full = np.full(-(-len(v) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    full[: len(v)] = v
    rows = full.reshape(-1, width)
    left = np.minimum.accumulate(rows, axis=1).ravel()
    right = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[:n], left[width - 1 : width - 1 + n])


def segments(texts: list[bytes] | list[np.ndarray], length: int = LENGTH, k: int = K) -> tuple[np.ndarray, ...]:
    """Index of the text, anchor, print, first and last start of each segment of the texts, which are bytes or arrays of codes."""
    data = np.frombuffer(b"".join(texts), np.uint8) if isinstance(texts[0], bytes) else np.concatenate(texts)
    sizes = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(sizes)
    if len(data) < length:
        return (np.zeros(0, np.int64),) * 5
    prefix = Prefix(data)
    at = np.arange(len(data) - k + 1)
    grams = prefix.of(at, at + k)
    canonical = (sliding_least(grams & ~_PLACE | at.astype(np.uint64), length - k + 1) & _PLACE).astype(np.int64)
    owner = np.repeat(np.arange(len(texts)), np.maximum(sizes - length + 1, 0))
    if not len(owner):
        return (np.zeros(0, np.int64),) * 5
    starts = ends - sizes
    counts = np.maximum(sizes - length + 1, 0)
    p = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts) + starts[owner]
    anchor = canonical[p]
    new = np.flatnonzero(np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (owner[1:] != owner[:-1]))))
    last = np.append(new[1:], len(p)) - 1
    lo, hi, own = p[new], p[last], owner[new]
    view = memoryview(data)
    prints = b"".join([hashlib.blake2b(view[a:b], digest_size=8).digest() for a, b in zip(lo.tolist(), (hi + length).tolist(), strict=True)])
    return own, grams[anchor[new]], np.frombuffer(prints, np.uint64), lo - starts[own], hi - starts[own]


def _pieces(texts: list, length: int) -> tuple[list[int], list[int], list]:
    """Long texts in pieces whose starts don't overlap."""
    index, base, out = [], [], []
    for i, t in enumerate(texts):
        for at in range(0, max(1, len(t) - length + 1), PIECE):
            index.append(i)
            base.append(at)
            out.append(t if len(t) <= PIECE else t[at : at + PIECE + length - 1])
    return index, base, out


def placed(texts: list[bytes] | list[np.ndarray], length: int, k: int) -> Iterator[tuple[np.ndarray, ...]]:
    """What segments() gives, for texts of any length."""
    index, base, texts = _pieces(texts, length)
    base = np.array(base)
    groups, total, held = [], 0, []
    for i, t in enumerate(texts):  # no more than the anchors' places can tell apart
        if held and total + len(t) > 1 << 23:
            groups.append(held)
            held, total = [], 0
        held.append(i)
        total += len(t)
    groups.append(held)
    for g in groups:
        own, anchor, seg, lo, hi = segments([texts[i] for i in g], length, k)
        own = np.array(g)[own]
        yield np.array(index)[own], anchor.view(np.int64), seg.view(np.int64), lo + base[own], hi + base[own]


def _found(docs: DataFrame, length: int, k: int) -> DataFrame:
    def rows(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in batches(frames, most=BATCH):
            d, r = (frame.column(c).to_numpy() for c in (0, 1))
            for own, anchor, seg, lo, hi in placed(text_bytes(frame.column(2)), length, k):
                yield pa.RecordBatch.from_arrays([pa.array(d[own]), pa.array(r[own]), pa.array(anchor), pa.array(seg), pa.array(lo), pa.array(hi)], names=["d", "r", "anchor", "seg", "lo", "hi"])

    return map_arrow(docs.where(F.octet_length("text") >= length), rows, "d long, r long, anchor long, seg long, lo long, hi long")


def shared_starts(parts: list[bytes], length: int = LENGTH) -> list[np.ndarray]:
    """Of each segment the starts of windows that another place among the segments has too."""
    data = np.zeros(sum(map(len, parts)) + len(parts), np.uint16)
    limit = np.zeros(len(data), np.int32)
    bounds, at = [], 0
    for p in parts:
        n = len(p)
        data[at : at + n] = np.frombuffer(p, np.uint8)
        data[at : at + n] += 1
        limit[at : at + n] = np.arange(n, 0, -1)
        bounds.append(at)
        at += n + 1
    sa = suffix_array(data, 257)
    common, before = permuted_lcp(data, sa, limit)
    hit = np.flatnonzero(common >= length)
    flag = np.zeros(len(data) + 1, bool)
    flag[hit] = True
    flag[before[hit]] = True
    return [np.flatnonzero(flag[a : a + max(0, len(p) - length + 1)]) for a, p in zip(bounds, parts, strict=True)]


def _runs(starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(starts):
        return starts, starts
    cut = np.flatnonzero(np.diff(starts) > 1)
    return starts[np.concatenate(([0], cut + 1))], starts[np.append(cut, len(starts) - 1)]


def _shards(rows: Iterator[tuple]) -> Iterator[list[tuple]]:
    """Rows of whole anchors, which come first in a row and in order, up to SHARD bytes (last in a row); an anchor that has more is a shard of its own."""
    held: list[tuple] = []
    total = 0
    for _, group in itertools.groupby(rows, lambda row: row[0]):
        own = list(group)
        size = sum(len(row[-1]) for row in own)
        if held and total + size > SHARD:
            yield held
            held, total = [], 0
        held += own
        total += size
    if held:
        yield held


def _by_suffix_array(cut: DataFrame, length: int) -> DataFrame:
    def rows(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _shards(row for frame in frames for row in zip(*(frame.column(i).to_pylist() for i in range(6)), strict=True)):
            out: list[tuple[int, int, int, int]] = []
            for (_, d, r, lo, c, _), found in zip(held, shared_starts([h[5] for h in held], length), strict=True):
                if c == 1:
                    a, b = _runs(found)
                    out += [(d, r, lo + x, lo + y) for x, y in zip(a.tolist(), b.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], pa.int64()) for i in range(4)], names=["d", "r", "lo", "hi"])

    dealt = cut.select("anchor", "d", "r", "lo", "c", "bytes").repartition("anchor").sortWithinPartitions("anchor")
    return map_arrow(dealt, rows, "d long, r long, lo long, hi long")


def _by_counting(cut: DataFrame, length: int) -> DataFrame:
    def rows(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            for d, r, lo, c, raw in zip(*(x.to_pylist() for x in frame.columns), strict=True):
                data = np.frombuffer(raw, np.uint8)
                at = np.arange(len(data) - length + 1)
                h = Prefix(data).of(at, at + length)
                g = mixed(Prefix(data ^ np.uint8(0x5A)).of(at, at + length) + h)
                n = len(at)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(g.view(np.int64)), pa.array([d] * n, pa.int64()), pa.array([r] * n, pa.int64()), pa.array(lo + at), pa.array([c] * n, pa.int64())], names=["h", "g", "d", "r", "lo", "c"])

    each = map_arrow(cut.select("d", "r", "lo", "c", "bytes"), rows, "h long, g long, d long, r long, lo long, c long")
    often = each.groupBy("h", "g").agg(F.sum("c").alias("times")).where("times > 1").select("h", "g")
    return each.where("c = 1").join(often, ["h", "g"], "left_semi").select("d", "r", "lo", F.col("lo").alias("hi"))


def _keyed(docs: DataFrame) -> DataFrame:
    """row (all columns), text, and d and r, which tell a row's text; rows that repeat one another share them."""
    text = F.col("text").cast("string")
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), text.alias("text"), F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 62))).alias("d"), F.xxhash64("doc_id", text).alias("r"))


def intervals(docs: DataFrame, length: int = LENGTH, k: int = K) -> DataFrame:
    """d, r and starts: first and last starts of repeated windows, of every text that has any. Written to the shared folder."""
    given = _keyed(docs).select("d", "r", "text")
    found = materialize(_found(given, length, k), "segments")
    kinds = materialize(found.groupBy("anchor", "seg").agg(F.count(F.lit(1)).alias("c"), F.min(F.struct("d", "r", "lo", "hi")).alias("at")), "kinds")
    several = kinds.groupBy("anchor").agg(F.count(F.lit(1)).alias("k"), F.min("c").alias("least")).where("k > 1 and least = 1").select("anchor", "k")
    wanted = kinds.join(several, "anchor").select(F.col("at.d").alias("d"), F.col("at.r").alias("r"), F.struct("anchor", "at.lo", "at.hi", "c", "k").alias("s")).groupBy("d", "r").agg(F.collect_list("s").alias("parts"))

    def cut(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in batches(frames):
            out: list[list] = [[] for _ in range(7)]
            for d, r, text, parts in zip(frame.column(0).to_pylist(), frame.column(1).to_pylist(), text_bytes(frame.column(2)), frame.column(3).to_pylist(), strict=True):
                for s in parts:
                    for column, value in zip(out, (s["anchor"], d, r, s["lo"], s["c"], s["k"], text[s["lo"] : s["hi"] + length]), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, [pa.int64()] * 6 + [pa.binary()], strict=True)], names=["anchor", "d", "r", "lo", "c", "k", "bytes"])

    pieces = materialize(map_arrow(given.join(wanted, ["d", "r"]).select("d", "r", "text", "parts"), cut, "anchor long, d long, r long, lo long, c long, k long, bytes binary"), "pieces")
    whole = found.join(kinds.where("c > 1").select("anchor", "seg"), ["anchor", "seg"], "left_semi").select("d", "r", "lo", "hi")
    part = _by_suffix_array(pieces.where(F.col("k") <= HOT), length).unionByName(_by_counting(pieces.where(F.col("k") > HOT), length))
    out = materialize(whole.unionByName(part).groupBy("d", "r").agg(F.collect_list(F.struct("lo", "hi")).alias("starts")), "repeats")
    for x in (found, kinds, pieces):
        discard(x)
    return out


def spans(starts: list[dict], length: int = LENGTH) -> list[tuple[int, int]]:
    """Maximal runs of bytes that windows with these starts cover."""
    out: list[list[int]] = []
    for lo, hi in sorted((s["lo"], s["hi"]) for s in starts):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi + length)
        else:
            out.append([lo, hi + length])
    return [(a, b) for a, b in out]


def without(text: bytes, removed: list[tuple[int, int]]) -> bytes:
    at, kept = 0, []
    for a, b in removed:
        kept.append(text[at:a])
        at = b
    return b"".join((*kept, text[at:]))


def remove(docs: DataFrame, length: int = LENGTH, k: int = K, beside: DataFrame | None = None) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every row, and the long columns of `beside`, a table by d and r; 0 where it has no row.

    A null text is empty; texts shorter than `length` lose nothing; a row that repeats another loses all that is long enough; null doc_ids
    stay; an empty table gives none; other columns are left out.
    """
    more = [c for c in beside.columns if c not in {"d", "r"}] if beside is not None else []
    joined = _keyed(docs.select("doc_id", "text")).join(intervals(docs, length, k), ["d", "r"], "left")
    joined = (joined.join(beside, ["d", "r"], "left") if more else joined).select(F.col("row.doc_id").cast("long").alias("doc_id"), "text", "starts", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in more])
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]

    def rows(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in batches(frames):
            out: list[tuple] = []
            for doc_id, text, starts in zip(frame.column(0).to_pylist(), text_bytes(frame.column(1)), frame.column(2).to_pylist(), strict=True):
                removed = spans(starts or [], length)
                out.append((doc_id, len(text), sum(b - a for a, b in removed), len(removed), hashlib.sha256(without(text, removed)).hexdigest()))
            yield pa.RecordBatch.from_arrays([*[pa.array([o[i] for o in out], t) for i, t in enumerate([pa.int64()] * 4 + [pa.string()])], *frame.columns[3:]], names=names + more)

    return map_arrow(joined, rows, ", ".join(["doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string", *[f"{c} long" for c in more]]))


def cleaned(docs: DataFrame, length: int = LENGTH, k: int = K) -> DataFrame:
    """The documents without bytes of strings of `length` bytes that start elsewhere too, with all their columns; one that nothing is left of goes.

    Characters of which a byte is removed go whole. n_chars, where there is one, is counted anew. Null and short texts stay as they are;
    rows that repeat one another lose all that is long enough; null doc_ids stay; an empty table gives none; column names don't matter.
    """
    columns = docs.columns
    joined = _keyed(docs).join(intervals(docs, length, k), ["d", "r"], "left").select("starts", "row")
    at = columns.index("text")

    def rows(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = ([frame.column(0), *frame.column(1).flatten()] for frame in frames)
        named = (pa.RecordBatch.from_arrays(given, names=["text" if i == at + 1 else str(i) for i in range(len(given))]) for given in whole)
        for frame in batches(named):
            texts, keep = [], []
            given = frame.columns[1:]
            for text, starts in zip(given[at].to_pylist(), frame.column(0).to_pylist(), strict=True):
                if starts:
                    text = without(text.encode(), spans(starts, length)).decode("utf-8", "ignore")
                    keep.append(bool(text.strip()))
                else:
                    keep.append(True)
                texts.append(text)
            given[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(given, names=columns).filter(pa.array(keep, pa.bool_()))

    kept = map_arrow(joined, rows, docs.schema)
    return kept.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast(docs.schema["n_chars"].dataType)) if "n_chars" in columns else kept
