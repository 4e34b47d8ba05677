"""Similarity join of documents on word shingles: a blocked sparse product of the document by shingle incidence.

Documents with equal sets are one class, numbered by a print of its set. The columns (shingles) are dealt to blocks by hash, which count how many classes
have each; columns of one class alone are left out from there on. A class keeps the first elements of its set under one global order (rare shingles
first): two sets with similarity t share one of their first n - ceil(t * n) + 1. Those columns are dealt to blocks again, by the smallest class that has
them, so that the columns of a group of copies meet in few blocks, and each class brings its whole set of common columns. A block first compares each
class with some others of its columns, which links most near copies; then it multiplies its columns for the pairs that no link joins yet. Two similar sets
share a least number of first elements, by their sizes, so one block at least has its share of that; a pair below that share is discarded. The
others are decided by the overlap of the whole sets. A block returns a forest of links, never all pairs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varileaf.llm.common import batches, discard, map_arrow, materialize, text_bytes
from varileaf.llm.components import components
from varileaf.llm.rolling import mixed, shingle_sets

WIDTH, PERCENT = 5, 75
#: Frequent shingles are looked for in about so many documents; those counted so often there go last without being counted further; so many at most are
#: broadcast (16 bytes each). This order decides the work, never the result.
SAMPLE_DOCS, OFTEN, MOST_FREQUENT = 50_000, 500, 200_000
#: Entries of a block that counts columns, and of one that multiplies them; the least number of either.
COUNTED, MULTIPLIED, LEAST_BLOCKS = 1 << 21, 1 << 22, 4
#: Columns of one smallest class are dealt to so many blocks; how often a block compares each class with one of a column before the product.
SPLIT, TURNS = 4, 8
#: Pairs that a block counts at a time; one document's are not parted.
PAIRS = 1 << 20


def needed(a, b, percent: int = PERCENT):
    """Least overlap of two similar sets of sizes a and b: 100 * o >= percent * (a + b - o)."""
    return -(-percent * (a + b) // (100 + percent))


def frequent(docs: DataFrame) -> np.ndarray:
    """Hashes of shingles that many documents of a bounded sample have."""
    total = docs.count()
    draw = F.pmod(F.xxhash64(F.lit(5), "doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))

    def counts(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def merged() -> tuple[np.ndarray, np.ndarray]:
            h, at = np.unique(np.concatenate([a for a, _ in held]), return_inverse=True)
            return h, np.bincount(at, np.concatenate([b for _, b in held])).astype(np.int64)

        for frame in batches(frames, most=2 << 20):
            h, n = np.unique(np.concatenate(shingle_sets(text_bytes(frame.column(0)), WIDTH)), return_counts=True)
            held.append((h[n > 1], n[n > 1]))
            if len(held) > 16:
                held[:] = [merged()]
        if held:
            h, n = merged()
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], names=["h", "n"])

    found = map_arrow(docs.where(draw < min(1.0, SAMPLE_DOCS / max(1, total))).select("text"), counts, "h long, n long")
    rows = found.groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= OFTEN).orderBy(F.desc("n"), "h").limit(MOST_FREQUENT).collect()
    return np.sort(np.array([r.h for r in rows], np.int64).view(np.uint64))


def _prints(sets: list[np.ndarray]) -> np.ndarray:
    """Two 64-bit numbers for each set."""
    return np.frombuffer(b"".join([hashlib.blake2b(s, digest_size=16).digest() for s in sets]), np.int64).reshape(-1, 2)


def incidence(docs: DataFrame) -> DataFrame:
    """doc_id, n (size of its set), s1 and s2 (a 128-bit print of the set)."""

    def rows(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in batches(frames, most=2 << 20):
            sets = shingle_sets(text_bytes(frame.column(1)), WIDTH)
            both = _prints(sets)
            yield pa.RecordBatch.from_arrays([frame.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy())], names=["doc_id", "n", "s1", "s2"])

    return map_arrow(docs.select("doc_id", "text"), rows, "doc_id long, n long, s1 long, s2 long")


def _runs(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of equal values of a sorted array start, and their lengths."""
    starts = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1]))) if len(h) else np.zeros(0, np.int64)
    return starts, np.diff(np.append(starts, len(h)))


def block_pairs(hashes: np.ndarray, doc: np.ndarray, label: np.ndarray, size: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The product of one block: pairs of documents (by index, the smaller set first) with different labels and fitting sizes, and how many columns they share.

    Each pair comes once, with all its columns: those in which a document is the smaller one are counted together.
    """
    n = len(size)
    by_size = np.argsort(size, kind="stable")
    rank = np.empty(n, np.int64)
    rank[by_size] = np.arange(n)
    order = np.lexsort((rank[doc], hashes))
    h, d = hashes[order], rank[doc][order].astype(np.int32)
    size, label = size[by_size], label[by_size]
    starts, lengths = _runs(h)
    if not len(starts):
        return
    several = np.maximum.reduceat(label[d], starts) != np.minimum.reduceat(label[d], starts)
    run = np.repeat(np.arange(len(starts)), lengths)
    reach = np.searchsorted(size, 100 * size // PERCENT, side="right")
    after = np.arange(1, len(d) + 1)
    k = np.where(several[run], np.searchsorted(run * (n + 1) + d, run * (n + 1) + reach[d]) - after, 0)
    own = np.argsort(d, kind="stable")
    own = own[k[own] > 0]
    first, _ = _runs(d[own])
    edges = np.append(first, len(own))
    total = np.concatenate(([0], np.cumsum(k[own])))[edges]
    a = 0
    while a < len(first):
        b = max(a + 1, int(np.searchsorted(total, total[a] + PAIRS, side="right")) - 1)
        at = own[edges[a] : edges[b]]
        x = np.repeat(d[at], k[at])
        y = d[np.arange(len(x)) + np.repeat(after[at] - (np.cumsum(k[at]) - k[at]), k[at])]
        other = label[x] != label[y]
        codes, times = np.unique(x[other].astype(np.int64) * n + y[other], return_counts=True)
        del x, y, other
        yield by_size[codes // n], by_size[codes % n], times
        a = b


def together(table: DataFrame, column: str, *blocks: int) -> DataFrame:
    """Rows of one block in one task, block by block; a task gets several blocks."""
    return table.repartition(*blocks, column).sortWithinPartitions(column)


def flat(column: pa.Array, kind: type) -> np.ndarray:
    """The bytes of a binary column as one array of numbers, not copied."""
    edges = np.frombuffer(column.buffers()[1], np.int64 if pa.types.is_large_binary(column.type) else np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[edges[0] : edges[-1]].view(kind)


def one_by_one(frames: Iterator[pa.RecordBatch]) -> Iterator[list[pa.RecordBatch]]:
    """The rows of one block after another (the first column), so that a task holds the arrays of one only."""
    held: list[pa.RecordBatch] = []
    for frame in frames:
        keys = frame.column(0).to_numpy()
        for a, k in zip(*(x.tolist() for x in _runs(keys)), strict=True):
            if held and held[0].column(0)[0].as_py() != keys[a]:
                yield held
                held = []
            held.append(frame.slice(a, k))
    if held:
        yield held


def counted(docs: DataFrame, often: np.ndarray, blocks: int) -> DataFrame:
    """Packed rows for each part of the classes: cls, n and each (how many columns), low, df and head: the shingles of each class that another
    class has too, how many classes have them, and the smallest one.

    Frequent shingles (`often`) come with a count above all others, by their rank among them.
    """
    shared = docs.sparkSession.sparkContext.broadcast(often)

    def deal(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = shared.value
        for number, frame in enumerate(batches(frames, most=2 << 20)):
            sets = [s for s in shingle_sets(text_bytes(frame.column(0)), WIDTH) if len(s)]
            if not sets:
                continue
            cls, at = np.unique(_prints(sets)[:, 0], return_index=True)  # copies in one batch count once
            sets = [sets[i] for i in at.tolist()]
            sizes = np.array([len(s) for s in sets], np.int64)
            h, doc = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
            block = ((h >> np.uint64(24)) % np.uint64(blocks)).astype(np.int64)
            if len(last):
                block[last[np.minimum(np.searchsorted(last, h), len(last) - 1)] == h] = blocks
            order = np.argsort(block.astype(np.uint16) if blocks < 1 << 16 else block, kind="stable")
            h, doc, block = h[order], doc[order], block[order]
            starts, lengths = _runs(block)
            out: list[list] = [[], [], [], [], [], []]
            for a, k in zip(starts.tolist(), lengths.tolist(), strict=True):
                own, each = np.unique(doc[a : a + k], return_counts=True)
                which = int(block[a])
                for column, value in zip(out, (number % blocks if which == blocks else which, which == blocks, cls[own].tobytes(), sizes[own].tobytes(), each.tobytes(), h[a : a + k].tobytes()), strict=True):
                    column.append(value)
            kinds = [pa.int64(), pa.bool_(), *[pa.binary()] * 4]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, kinds, strict=True)], names=["block", "frequent", "cls", "n", "each", "low"])

    def count(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in one_by_one(frames):
            yield from count_one(block)

    def count_one(frames: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = shared.value
        table = pa.Table.from_batches(frames)
        frames.clear()
        for frequent_ones in (False, True):
            held = table.filter(pc.equal(table["frequent"], frequent_ones))
            if not held.num_rows:
                continue
            cls, n, each, h = (np.concatenate([flat(c, kind) for c in held[name].chunks if len(c)]) for name, kind in (("cls", np.int64), ("n", np.int64), ("each", np.int64), ("low", np.uint64)))
            del held
            ids, doc = np.unique(cls, return_inverse=True)
            sizes = np.empty(len(ids), np.int64)
            sizes[doc] = n
            doc = np.repeat(doc, each)
            order = np.lexsort((doc, h))
            h, doc = h[order], doc[order]
            first = np.concatenate(([True], (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])))  # the copies of a class count once
            h, doc = h[first], doc[first]
            if frequent_ones:
                df, head = len(last) - np.searchsorted(last, h) + (1 << 31), h
            else:
                starts, lengths = _runs(h)
                df, head = np.repeat(lengths, lengths), np.repeat(ids[doc[starts]].view(np.uint64), lengths)
                h, doc, df, head = h[df > 1], doc[df > 1], df[df > 1], head[df > 1]
            target = (mixed(ids.view(np.uint64)) % np.uint64(blocks)).astype(np.int64)[doc]
            order = np.lexsort((doc, target))
            h, doc, df, head, target = h[order], doc[order], df[order].astype(np.uint32), head[order], target[order]
            starts, lengths = _runs(target)
            for a, k in zip(starts.tolist(), lengths.tolist(), strict=True):
                s = slice(a, a + k)
                own, each = np.unique(doc[s], return_counts=True)
                row = (ids[own], sizes[own], each, h[s], df[s], head[s])
                yield pa.RecordBatch.from_arrays([pa.array([int(target[a])]), *[pa.array([x.tobytes()], pa.binary()) for x in row]], names=["part", "cls", "n", "each", "low", "df", "head"])

    dealt = map_arrow(docs.select("text"), deal, "block long, frequent boolean, cls binary, n binary, each binary, low binary")
    return map_arrow(together(dealt, "block", blocks), count, "part long, cls binary, n binary, each binary, low binary, df binary, head binary")


def columns(parts: DataFrame, blocks: int) -> DataFrame:
    """block, cls, n, low and part: of each class its common columns, for each block that has one of its first elements.

    part: for each column 2 where it is a first element and in this block, 1 where it is one in another block, else 0.
    """

    def chosen(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in one_by_one(frames):
            yield from chosen_of(part)

    def chosen_of(frames: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[bytes]] = [[], [], [], [], [], []]
        for frame in frames:
            for column, values in zip(held, frame.columns[1:], strict=True):
                column += values.to_pylist()
        if not held[0]:
            return
        cls, n, each, h, df, head = (np.frombuffer(b"".join(x), kind) for x, kind in zip(held, (np.int64, np.int64, np.int64, np.uint64, np.uint32, np.uint64), strict=True))
        held.clear()
        ids, at = np.unique(cls, return_inverse=True)
        sizes = np.empty(len(ids), np.int64)
        sizes[at] = n
        doc = np.repeat(at, each)
        order = np.lexsort((h, df, doc))
        h, doc, head = h[order], doc[order], head[order]
        first = np.concatenate(([True], (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])))  # copies send frequent shingles more than once
        h, doc, head = h[first], doc[first], head[first]
        starts, lengths = _runs(doc)
        own = doc[starts]
        alone = sizes[own] - lengths  # shingles of this class only come first
        wanted = np.maximum(sizes[own] + (-PERCENT * sizes[own] // 100) + 1 - alone, 0)
        block = (mixed(head + (h & np.uint64(SPLIT - 1))) % np.uint64(blocks)).astype(np.int64)
        out: list[list] = [[], [], [], [], []]
        for d, a, k, most in zip(own.tolist(), starts.tolist(), lengths.tolist(), wanted.tolist(), strict=True):
            if not most:
                continue
            low, where = h[a : a + k], block[a : a + most]
            part = np.zeros(k, np.uint8)
            part[:most] = 1
            for b in np.unique(where).tolist():
                here = part.copy()
                here[:most][where == b] = 2
                for column, value in zip(out, (b, int(ids[d]), int(sizes[d]), low.tobytes(), here.tobytes()), strict=True):
                    column.append(value)
            if len(out[0]) >= 2000:
                yield batch(out)
                out = [[], [], [], [], []]
        if out[0]:
            yield batch(out)

    def batch(out: list[list]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in out[:3]), *(pa.array(x, pa.binary()) for x in out[3:])], names=["block", "cls", "n", "low", "part"])

    return map_arrow(together(parts, "part"), chosen, "block long, cls long, n long, low binary, part binary")


class Forest:
    """Sets that links have joined."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def root(self, i: int) -> int:
        parent = self.parent
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    def roots(self) -> np.ndarray:
        while True:
            up = self.parent[self.parent]
            if (up == self.parent).all():
                return up
            self.parent = up

    def join(self, a: int, b: int) -> bool:
        a, b = int(self.root(a)), int(self.root(b))
        self.parent[max(a, b)] = min(a, b)
        return a != b


def block_links(cls: np.ndarray, sizes: np.ndarray, lows: list[np.ndarray], parts: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links among the classes of a block that join all similar ones which have their share of first elements in it. `lows` are sorted in place."""
    here = [x[p == 2] for x, p in zip(lows, parts, strict=True)]
    owner = np.repeat(np.arange(len(cls)), [len(x) for x in here])
    hashes = np.concatenate(here)
    own, first = np.array([len(x) for x in here]), np.array([int((p > 0).sum()) for p in parts])
    del here
    for x in lows:
        x.sort()
    forest, out = Forest(len(cls)), []

    def decide(a: np.ndarray, b: np.ndarray) -> None:
        for x, y in zip(a.tolist(), b.tolist(), strict=True):
            if forest.root(x) == forest.root(y):
                continue
            z = np.concatenate((lows[x], lows[y]))
            z.sort(kind="stable")
            if np.count_nonzero(z[1:] == z[:-1]) >= needed(int(sizes[x]), int(sizes[y])):
                forest.join(x, y)
                out.append((int(cls[x]), int(cls[y])))

    for turn in range(TURNS):
        label = forest.roots()
        spun = mixed(hashes + np.uint64(2 * turn + 1))
        order = np.lexsort((mixed(cls.view(np.uint64)[owner] + spun), hashes))
        h, doc, spun = hashes[order], owner[order], spun[order]
        at, lengths = _runs(h)
        centre = np.repeat(doc[at], lengths)
        fits = (label[centre] != label[doc]) & (100 * np.minimum(sizes[centre], sizes[doc]) >= PERCENT * np.maximum(sizes[centre], sizes[doc]))
        centre, doc, spun = centre[fits], doc[fits], spun[fits]
        order = np.lexsort((spun, doc))
        centre, doc = centre[order], doc[order]
        at, _ = _runs(doc)
        decide(centre[at], doc[at])
    for x, y, k in block_pairs(hashes, owner, forest.roots(), sizes):
        low = least(sizes[x], sizes[y])
        share = (k * first[x] >= low * own[x]) | (k * first[y] >= low * own[y])
        label = forest.roots()
        open_ = share & (label[x] != label[y])
        decide(x[open_], y[open_])
    return out


def links(table: DataFrame, blocks: int) -> DataFrame:
    """Pairs (a, b) of similar classes that join all similar ones; table: what columns() gives."""

    def rows(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in one_by_one(frames):
            cls, n = (np.concatenate([f.column(i).to_numpy() for f in held]) for i in (1, 2))
            edges = np.cumsum(np.concatenate([pc.binary_length(f.column(4)).to_numpy() for f in held]))[:-1]
            lows, parts = (np.split(np.concatenate([flat(f.column(i), kind) for f in held]), edges) for i, kind in ((3, np.uint64), (4, np.uint8)))
            held.clear()
            at = np.argsort(cls, kind="stable")
            found = block_links(cls[at], n[at], [lows[i] for i in at.tolist()], [parts[i] for i in at.tolist()])
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], names=["a", "b"])

    return map_arrow(together(table, "block", blocks), rows, "a long, b long")


def least(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """First elements that two similar sets of these sizes share: what they need but for what the others could add."""
    rest_a, rest_b = (n - (n + (-PERCENT * n // 100) + 1) for n in (a, b))
    return needed(a, b) - np.minimum(np.maximum(rest_a, rest_b), np.minimum(a, b))


def join(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id of every row. The result is written to the shared folder, what led to it is deleted.

    Null texts and texts without words have no shingles and are linked with nothing. Rows of one doc_id count as one document
    for links, but each keeps the size of its own set; a row whose doc_id is null has no component and no links. An empty table
    gives none; other columns are left out.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    table = materialize(incidence(docs), "incidence")
    linked = table.where("n > 0 and doc_id is not null")
    reps = materialize(linked.groupBy("s1", "s2").agg(F.min("doc_id").alias("doc")).select("s1", "s2", F.col("s1").alias("cls"), "doc"), "classes")
    entries = linked.agg(F.sum("n")).first()[0] or 0
    parts = materialize(counted(docs.where("doc_id is not null"), frequent(docs), max(LEAST_BLOCKS, entries // COUNTED)), "counts")
    blocks = max(LEAST_BLOCKS, (parts.agg(F.sum(F.length("low"))).first()[0] or 0) // (8 * MULTIPLIED))
    found = materialize(links(columns(parts, blocks), blocks), "links")
    # texts of one doc_id are linked with its first class; what the stars have joined is a link from each node to its component
    several = linked.groupBy("doc_id").agg(F.min("s1").alias("a"), F.max("s1").alias("_z")).where("a <> _z")
    own = linked.join(several, "doc_id").where("s1 <> a").select("a", F.col("s1").alias("b"))
    last = materialize(components(found.union(own)), "labels")
    of = reps.join(last, reps.cls == last.node, "left").select("s1", "s2", "doc", F.coalesce("component", "cls").alias("joined"))
    heads = of.groupBy("joined").agg(F.min("doc").alias("c"))
    of = of.join(heads, "joined").select("s1", "s2", "c")
    placed = table.select("doc_id", "n", "s1", "s2").join(of, ["s1", "s2"], "left")
    out = materialize(placed.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("c", "doc_id")).alias("component_id")), "joined")
    for x in (table, reps, parts, found, last):
        discard(x)
    return out
