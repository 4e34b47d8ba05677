"""Word trigram models with interpolated modified Kneser-Ney smoothing, in hash-partitioned sorted arrays that stay distributed.

Trigrams (u, v, w) are dealt to buckets by the hash of their middle word, so the totals of a history (u, v) and the continuation counts of a
bigram (v, w) are local to a bucket, which holds its trigrams as one sorted array of keys. The trigrams around a frequent middle word are dealt by
the hash of (u, v) instead; the continuation counts of its bigrams are summed in the bucket of v and come back. Those of single words are summed in
the bucket of the word and come back. Every batch of texts is one chunk: it sends each of its trigrams once, with the texts that they occur in, and gets sums of
losses back. Common words (found in the sample) are numbers that all know; the others are places in a table that goes along. Rows between buckets
are packed arrays; the driver sees the sample's common words and counts of counts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varileaf.llm.common import batches, discard, map_arrow, materialize, text_bytes
from varileaf.llm.rolling import distinct_words, mixed

#: Bytes of text for each bucket and in a chunk, and the least number of buckets.
BUCKET_BYTES, CHUNK, LEAST_BUCKETS = 16 << 20, 12 << 20, 12
#: A word that as a middle one stands for more bytes than this has its trigrams dealt to all buckets; looked for in about so many texts. This decides
#: the work, never the result.
OFTEN_BYTES, SAMPLE_TEXTS = BUCKET_BYTES // 2, 20_000
#: So many of the sample's words are common ones. This decides how words are written, never the result.
COMMON = 1 << 18
#: Bits of a word's number in a bucket of up to so many words; of more words it has 32. This decides memory, never the result.
NARROW = 21
#: What stands before the first words of a text.
START = 1
#: Sums of losses are sent in so many steps for each unit.
STEPS = float(1 << 36)
_NONE = np.zeros(0, np.uint64)
#: Kinds of packed rows: trigrams (or the last words of bigrams), replies, texts, counts of counts, bigrams of frequent words, replies on them.
TRIGRAMS, REPLIES, TEXTS, COUNTS, BIGRAMS, SUMS = range(6)
PACKED = "bucket int, kind int, chunk long, payload binary, docs binary"
_NAMES = ["bucket", "kind", "chunk", "payload", "docs"]
_KINDS = [pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary()]
_STORED = ("u1", "u2", "u4", "u8", "f8")


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed string: numbers without sign in as few bytes as they need, byte planes apart."""
    head, parts = [len(arrays)], []
    for a in arrays:
        if a.dtype.kind != "f":
            a = a.astype(np.min_scalar_type(int(a.max())) if a.size else np.uint8)
        head += [a.size, _STORED.index(a.dtype.str[1:])]
        parts.append(np.ascontiguousarray(a).view(np.uint8).reshape(-1, a.itemsize).T.tobytes())
    raw = b"".join([np.array(head, "<i8").tobytes(), *parts])
    return len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def unpack(blob: bytes) -> list[np.ndarray]:
    """Signed 64-bit numbers or doubles; 64-bit hashes stay without sign."""
    raw = pa.decompress(blob[8:], int.from_bytes(blob[:8], "little"), "zstd", asbytes=True)
    n = int(np.frombuffer(raw, "<i8", 1)[0])
    head, at, out = np.frombuffer(raw, "<i8", 2 * n, 8).reshape(n, 2).tolist(), 8 + 16 * n, []
    for size, code in head:
        kind = np.dtype(_STORED[code])
        planes = np.frombuffer(raw, np.uint8, size * kind.itemsize, at).reshape(kind.itemsize, size)
        found = np.ascontiguousarray(planes.T).view(kind).ravel()
        out.append(found if code > 2 else found.astype(np.int64))
        at += size * kind.itemsize
    return out


def steps(codes: np.ndarray) -> np.ndarray:
    """Differences of sorted codes, which take fewer bytes."""
    return np.diff(codes, prepend=np.uint64(0))


def codes_of(steps: np.ndarray) -> np.ndarray:
    return np.cumsum(steps.astype(np.uint64))


def bucket_of(h: np.ndarray, buckets: int) -> np.ndarray:
    return ((mixed(h) >> np.uint64(16)) % np.uint64(buckets)).astype(np.int64)


def _sampled(docs: DataFrame) -> tuple[int, np.ndarray, np.ndarray]:
    """How many buckets, the codes of frequent words, and those of common words, the most common first."""
    size, n = docs.agg(F.sum(F.octet_length("text")), F.count("text")).first()
    if (size or 0) <= OFTEN_BYTES:
        return LEAST_BUCKETS, _NONE, _NONE
    draw = F.pmod(F.xxhash64(F.lit(7), "text"), F.lit(1 << 30)) / F.lit(float(1 << 30))

    def counts(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in batches(frames):
            codes, index, _ = distinct_words(text_bytes(frame.column(0)))
            code = np.concatenate((np.zeros(1, np.int64), (codes >> np.uint64(16)).astype(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(code), pa.array(np.concatenate(([len(index)], np.bincount(index, minlength=len(codes)))))], names=["code", "n"])

    kept = materialize(map_arrow(docs.where(draw < min(1.0, SAMPLE_TEXTS / n)).select("text"), counts, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).where("n > 1"), "sample")
    found = kept.toArrow()
    discard(kept)
    code, k = (found.column(c).to_numpy() for c in ("code", "n"))
    words = int(k[code == 0].max(initial=0))
    code, k = code[code > 0], k[code > 0]
    order = np.lexsort((code, -k))[:COMMON]
    return max(LEAST_BUCKETS, size // BUCKET_BYTES), np.sort(code[k * size > words * OFTEN_BYTES].astype(np.uint64)), np.concatenate((np.array([START], np.uint64), code[order].astype(np.uint64)))


def buckets_for(docs: DataFrame) -> tuple[int, np.ndarray]:
    """How many buckets, and the codes of frequent words."""
    return _sampled(docs)[:2]


def _runs(x: np.ndarray) -> np.ndarray:
    """Where runs of equal values start."""
    return np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1]))) if len(x) else np.zeros(0, np.int64)


def by_home(home: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each bucket that occurs, and its places in order."""
    order = np.argsort(home, kind="stable")
    starts = _runs(home[order])
    for a, b in zip(starts.tolist(), np.append(starts, len(order))[1:].tolist(), strict=True):
        yield int(home[order[a]]), order[a:b]


def _sorted(first: np.ndarray, second: np.ndarray, third: np.ndarray, size: int) -> np.ndarray:
    """Order of triples of numbers below `size`."""
    if size <= 1 << NARROW:
        return np.argsort(first << 2 * NARROW | second << NARROW | third, kind="stable")
    return np.lexsort((third, second, first))


def split(texts: list[bytes], member: list[np.ndarray], buckets: int, often: np.ndarray, places: bool, common: np.ndarray = _NONE, turn: tuple[int, int] = (0, 1)) -> tuple[np.ndarray, list[tuple[int, bytes, bytes | None]]]:
    """Words of each text; and for each bucket its trigrams (a table of words that aren't common; the numbers of v and how many trigrams each has,
    the differences of u within these, w, and counts) and the texts they occur in.

    member: for each further model, which texts it counts; the last model counts all. often: codes of frequent words. places: whether the texts are wanted.
    turn: of so many rounds the one whose buckets are wanted.
    """
    codes, index, sizes = distinct_words(texts)
    if not len(index):
        return sizes, []
    # 48 bits of each word's code; words are numbered as the common ones are, the others after them by code
    table, number = np.unique(np.concatenate((np.array([START], np.uint64), codes >> np.uint64(16))), return_inverse=True)
    known = np.argsort(common)
    at = np.minimum(np.searchsorted(common, table, sorter=known), max(0, len(common) - 1))
    rare = common[known[at]] != table if len(common) else np.ones(len(table), bool)
    turned = len(common) + np.cumsum(rare) - 1
    turned[~rare] = known[at[~rare]]
    table, number = np.concatenate((common, table[rare])), turned[number]
    home, spread = bucket_of(table, buckets), np.isin(table, often)
    rank = np.empty(len(table), np.int64)  # of a word as a middle one: bucket by bucket, frequent ones last
    rank[np.argsort(np.where(spread, buckets, home), kind="stable")] = np.arange(len(table))
    w, start = number[index + 1], number[0]
    doc = np.repeat(np.arange(len(texts), dtype=np.int64), sizes)
    place = np.arange(len(w)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    v, u = np.full(len(w), start), np.full(len(w), start)
    v[1:], u[2:] = w[:-1], w[:-2]
    v[place < 1] = u[place < 2] = start
    if turn[1] > 1:
        to, far = home[v], np.flatnonzero(spread[v])
        to[far] = bucket_of(mixed(table[v[far]]) + table[u[far]], buckets)
        own = to % turn[1] == turn[0]
        v, u, w, doc = v[own], u[own], w[own], doc[own]
        if not len(v):
            return sizes, []
    order = _sorted(rank[v], u, w, len(table))
    first = len(order) - np.count_nonzero(spread[v])
    if first < len(order):  # frequent words' trigrams go in among the others
        to = home[v[order]]
        rest = order[first:]
        to[first:] = bucket_of(mixed(table[v[rest]]) + table[u[rest]], buckets)
        again = np.argsort(to, kind="stable")
        order, to = order[again], to[again]
    else:
        to = home[v[order]]
    v, u, w, doc = v[order], u[order], w[order], doc[order]
    starts = np.flatnonzero(np.concatenate(([True], (v[1:] != v[:-1]) | (u[1:] != u[:-1]) | (w[1:] != w[:-1]))))
    counts = [*(np.add.reduceat(m[doc].astype(np.int64), starts) for m in member), np.diff(np.append(starts, len(w)))]
    v, u, w, to, stops = v[starts], u[starts], w[starts], to[starts], np.append(starts, len(doc))
    first = _runs(to)
    out = []
    for a, b in zip(first.tolist(), [*first[1:].tolist(), len(v)], strict=True):
        of = np.concatenate((v[a:b], u[a:b], w[a:b]))
        other = np.flatnonzero(of >= len(common))
        used, of[other] = np.unique(of[other], return_inverse=True)
        of[other] += len(common)
        middle, left, right = np.split(of, 3)
        new = _runs(middle)
        apart = np.diff(left, prepend=0)
        apart[new] = left[new]
        payload = pack(steps(table[used]), middle[new], np.diff(np.append(new, b - a)), apart, right, *(k[a:b] for k in counts))
        out.append((int(to[a]), payload, pack(doc[stops[a] : stops[b]]) if places else None))
    return sizes, out


def packed(rows: list[tuple]) -> pa.Table:
    return pa.table([pa.array([r[i] for r in rows], t) for i, t in enumerate(_KINDS)], names=_NAMES)


def _counts(level: int, k: list[np.ndarray]) -> tuple:
    """A row of one bucket for the driver: of each model, n-grams found once to four times, all found, their sum, and all of any model."""
    return -1, COUNTS, level, pack(*[np.array([*[(x == i).sum() for i in (1, 2, 3, 4)], (x > 0).sum(), x.sum(), len(x)], np.int64) for x in k]), None


def _totals(table: DataFrame, models: int) -> np.ndarray:
    """By level, what _counts() says of all buckets: columns are models."""
    out = np.zeros((4, 7, models), np.int64)
    for r in table.where(F.col("kind") == COUNTS).select("chunk", "payload").collect():
        out[r.chunk] += np.stack(unpack(bytes(r.payload)), 1)
    return out


def discounts(totals: np.ndarray) -> np.ndarray:
    """D(0), D(1), D(2), D(3+) of each model from its counts of counts."""
    out = []
    for n1, n2, n3, n4 in totals[:4].T.tolist():
        if not min(n1, n2, n3, n4):
            out.append([0, 0.5, 0.75, 0.9])
            continue
        y = n1 / (n1 + 2 * n2)
        out.append(np.clip([0, 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3], [0, 0.05, 0.05, 0.05], [0, 0.95, 1.95, 2.95]))
    return np.array(out, float)


def smoothed(starts: np.ndarray, k: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of one model, discounted probabilities of n-grams whose histories start at `starts`, and what these leave to lower orders (all where not found)."""
    off = d[np.minimum(k, 3)]
    lengths = np.diff(np.append(starts, len(k)))
    total, left = np.add.reduceat(k, starts), np.add.reduceat(off, starts)
    rest = np.where(total > 0, left / np.maximum(total, 1), 1.0)
    return (k - off) / np.repeat(np.maximum(total, 1), lengths), np.repeat(rest, lengths)


class Bucket:
    """The trigrams of a bucket as sorted keys, and the bigrams and last words among them, with their counts under each model."""

    def __init__(self, payloads: list[bytes], models: int, often: np.ndarray, common: np.ndarray = _NONE):
        given = [unpack(p) for p in payloads]
        self.words, number = np.unique(np.concatenate([common, *(codes_of(g[0]) for g in given)]), return_inverse=True)
        narrow = len(self.words) <= 1 << NARROW
        self.bits = NARROW if narrow else 32
        parts, histories, at = [], [], len(common)
        for g in given:
            own = np.concatenate((number[: len(common)], number[at : at + len(g[0])]))
            at += len(g[0])
            sums = np.cumsum(g[3])
            first = np.cumsum(g[2]) - g[2]
            left = sums - np.repeat(sums[first] - g[3][first], g[2])
            history = np.repeat(own[g[1]], g[2]) << self.bits | own[left]
            if narrow:
                parts.append(history << NARROW | own[g[4]])
            else:  # three numbers don't fit: histories are numbered in their order
                parts.append(own[g[4]])
                histories.append(history)
        self.ends = np.cumsum([len(p) for p in parts]).tolist()
        keys = np.concatenate(parts)
        if not narrow:
            held, number = np.unique(np.concatenate(histories), return_inverse=True)
            keys |= number << 32
            del histories
        order = np.argsort(keys, kind="stable")
        self.starts = _runs(keys[order])
        self.place = np.empty(len(keys), np.int64)
        self.place[order] = np.repeat(np.arange(len(self.starts)), np.diff(np.append(self.starts, len(keys))))
        keys = keys[order][self.starts]
        self.histories = _runs(keys >> self.bits)
        self.middle = (keys >> 2 * NARROW if narrow else held[keys >> 32] >> 32).astype(np.int32)
        self.times = np.concatenate([g[-1] for g in given])
        self.k3 = [np.add.reduceat(np.concatenate([g[5 + m] for g in given])[order], self.starts) for m in range(models)]
        del given, parts, order, number  # what was sent is not held while the bigrams are counted
        mask = (1 << self.bits) - 1
        self.keys2, self.at2 = np.unique(self.middle.astype(np.int64) << self.bits | keys & mask, return_inverse=True)
        del keys
        self.k2 = [np.bincount(self.at2, k > 0, len(self.keys2)).astype(np.int64) for k in self.k3]
        self.last, self.at1 = np.unique(self.keys2 & mask, return_inverse=True)
        self.spread = np.isin(self.words, often)[self.keys2 >> self.bits]  # bigrams that other buckets may have too
        self.k1 = [np.bincount(self.at1, (k > 0) & ~self.spread, len(self.last)).astype(np.int64) for k in self.k2]

    def shared(self, buckets: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """By bucket of their first words: that, places of the bigrams that other buckets may have too, and where their first words change."""
        at = np.flatnonzero(self.spread)
        first = self.keys2[at] >> self.bits
        for b, own in by_home(bucket_of(self.words[first], buckets)):
            yield b, at[own], _runs(first[own])

    def probabilities(self, m: int, p1: np.ndarray, d2: np.ndarray, d3: np.ndarray, sums: list[tuple[np.ndarray, ...]]) -> np.ndarray:
        """Of each trigram under model m, given the last words' own. sums: what other buckets' counts add up to for bigrams of frequent words."""
        own, left = smoothed(_runs(self.keys2 >> self.bits), self.k2[m], d2)
        for at, starts, k, n in sums:
            lengths, total = np.diff(np.append(starts, len(at))), n[m, 0]
            rest = np.where(total > 0, (d2[1:, None] * n[m, 1:]).sum(0) / np.maximum(total, 1), 1.0)
            own[at] = (k[m] - d2[np.minimum(k[m], 3)]) / np.repeat(np.maximum(total, 1), lengths)
            left[at] = np.repeat(rest, lengths)
        p2 = own + left * p1[self.at1]
        own, left = smoothed(self.histories, self.k3[m], d3)
        return own + left * p2[self.at2]


def _fixed(x: np.ndarray) -> np.ndarray:
    """Losses in whole steps, whose sums don't depend on their order."""
    return np.maximum(np.rint(x * STEPS), 0.0)


def mean_losses(docs: DataFrame, read: Callable, describe: Callable, fields: str, models: int, rounds: int = 1) -> DataFrame:
    """The fields of each text and losses, the mean over its words under each model; 0 for a text without words.

    read: of an Arrow batch of docs, its texts and the members of the models but the last. describe: of the batch, its texts and their
    numbers of words, the columns of `fields`. The texts are split again to score, so that no table of trigrams is stored; of many buckets, one in
    `rounds` is scored at a time, so that less is on the disk, and the texts are split in each of the rounds.
    """
    kinds = [(f.split()[0], pa.string() if f.endswith("string") else pa.int64()) for f in fields.split(", ")]
    names = [n for n, _ in kinds]
    buckets, often, common = _sampled(docs)

    def counting(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in batches(frames, most=CHUNK):
            yield from packed([(b, TRIGRAMS, 0, payload, None) for b, payload, _ in split(*read(frame), buckets, often, False, common)[1]]).to_batches()

    def scoring(turn: tuple[int, int]) -> Callable:
        def rows(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for number, frame in enumerate(batches(frames, most=CHUNK)):
                texts, member = read(frame)
                chunk, n = TaskContext.get().partitionId() << 32 | number, len(texts)
                sizes, dealt = split(texts, member, buckets, often, True, common, turn)
                if not turn[0]:
                    own = [c if isinstance(c, pa.Array) else pa.array(c, t) for c, (_, t) in zip(describe(frame, texts, sizes), kinds, strict=True)]
                    first = [pa.array([x] * n, t) for x, t in zip((chunk % buckets, TEXTS, chunk, None, None), _KINDS, strict=True)]
                    yield pa.RecordBatch.from_arrays([*first, pa.array(range(n), pa.int64()), *own], names=[*_NAMES, "place", *names])
                for part in packed([(b, TRIGRAMS, chunk, payload, where) for b, payload, where in dealt]).to_batches():
                    blank = [pa.nulls(part.num_rows, t) for t in (pa.int64(), *[t for _, t in kinds])]
                    yield pa.RecordBatch.from_arrays([*part.columns, *blank], names=[*_NAMES, "place", *names])

        return rows

    def counts(table: pa.Table) -> pa.Table:
        found = Bucket(table.column("payload").to_pylist(), models, often, common)
        source, out = table.column("bucket")[0].as_py(), []
        for b, at, _ in found.shared(buckets):
            used, local = np.unique(np.concatenate((found.keys2[at] >> found.bits, found.keys2[at] & (1 << found.bits) - 1)), return_inverse=True)
            out.append((b, BIGRAMS, source, pack(steps(found.words[used]), *np.split(local, 2), *(k[at] for k in found.k2)), None))
        return packed([_counts(3, found.k3), _counts(2, [k[~found.spread] for k in found.k2]), *sent(source, found.words[found.last], found.k1), *out])

    def sent(source: int, words: np.ndarray, k1: list[np.ndarray]) -> list[tuple]:
        """Rows for the buckets of the words."""
        return [(b, TRIGRAMS, source, pack(steps(words[s]), *(k[s] for k in k1)), None) for b, s in by_home(bucket_of(words, buckets))]

    def bigrams(table: pa.Table) -> pa.Table:
        """Of the frequent words of a bucket: the bigrams of all buckets added up; counts for the driver and for the last words, and what each bucket is told."""
        given = sorted(zip(table.column("chunk").to_pylist(), table.column("payload").to_pylist(), strict=True), key=lambda x: x[0])
        got = [unpack(p) for _, p in given]
        words, number = np.unique(np.concatenate([codes_of(g[0]) for g in got]), return_inverse=True)
        bases = np.cumsum([0, *(len(g[0]) for g in got[:-1])]).tolist()
        keys, place = np.unique(np.concatenate([number[a + g[1]] << 32 | number[a + g[2]] for a, g in zip(bases, got, strict=True)]), return_inverse=True)
        k = np.array([np.bincount(place, np.concatenate([g[3 + m] for g in got]), len(keys)) for m in range(models)]).astype(np.int64)
        starts = _runs(keys >> 32)
        n = np.array([[np.add.reduceat(x, starts) for x in (row, row == 1, row == 2, row > 2)] for row in k]).astype(np.int64)
        first = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(keys))))
        last, at = np.unique(keys & (1 << 32) - 1, return_inverse=True)
        out, a = [_counts(2, list(k)), *sent(-1, words[last], [np.bincount(at, row > 0, len(last)).astype(np.int64) for row in k])], 0
        mine = table.column("bucket")[0].as_py()
        for (source, _), g in zip(given, got, strict=True):
            own = place[a : a + len(g[1])]
            a += len(g[1])
            out.append((source, SUMS, mine, pack(k[:, own].ravel(), n[:, :, np.unique(first[own])].ravel()), None))
        return packed(out)

    def summed(table: pa.Table) -> tuple[list[int], list[int], np.ndarray, list[np.ndarray]]:
        """Sources of a word bucket's rows, where each ends, the places of its words among all, and their sums."""
        given = sorted(zip(table.column("chunk").to_pylist(), table.column("payload").to_pylist(), strict=True), key=lambda x: x[0])
        got = [unpack(p) for _, p in given]
        words, place = np.unique(np.concatenate([codes_of(g[0]) for g in got]), return_inverse=True)
        sums = [np.bincount(place, np.concatenate([g[1 + m] for g in got]), len(words)).astype(np.int64) for m in range(models)]
        return [c for c, _ in given], np.cumsum([len(g[0]) for g in got]).tolist(), place, sums

    def word_counts(table: pa.Table) -> pa.Table:
        return packed([_counts(1, summed(table)[3])])

    def replies(table: pa.Table) -> pa.Table:
        mine = table.column("bucket")[0].as_py()
        sources, ends, place, sums = summed(table)
        return packed([(b, REPLIES, mine, pack(*(k[place[a:e]] for k in sums)), None) for b, a, e in zip(sources, [0, *ends[:-1]], ends, strict=True) if b >= 0])

    def by_bucket(df: DataFrame):
        return df.where("bucket >= 0").groupBy("bucket")

    singles = materialize(by_bucket(map_arrow(docs, counting, PACKED)).applyInArrow(counts, PACKED), "words")
    told, total2 = None, 0
    if len(often):
        told = materialize(by_bucket(singles.where(F.col("kind") == BIGRAMS)).applyInArrow(bigrams, PACKED), "bigrams")
        total2 = _totals(told, models)
    words = (singles.union(told) if told else singles).where(F.col("kind") == TRIGRAMS)
    told1 = materialize(by_bucket(words).applyInArrow(word_counts, PACKED), "totals")
    totals = _totals(singles, models) + total2 + _totals(told1, models)
    d1, d2, d3 = (discounts(totals[level]) for level in (1, 2, 3))
    found, total, vocabulary = totals[1][4], totals[1][5], max(1, int(totals[1][6].max()))
    left1 = np.where(total > 0, (d1[:, 1] * totals[1][0] + d1[:, 2] * totals[1][1] + d1[:, 3] * (found - totals[1][0] - totals[1][1])) / np.maximum(total, 1), 1.0)

    def losses(table: pa.Table) -> pa.Table:
        kind = table.column("kind").to_numpy()
        texts = table.filter(pa.array(kind == TEXTS)).select([*names, "chunk", "place"])
        texts = texts.append_column("payload", pa.nulls(texts.num_rows, pa.binary()))
        mine = table.filter(pa.array(kind == TRIGRAMS))
        if not mine.num_rows:
            return texts
        bucket = Bucket(mine.column("payload").to_pylist(), models, often, common)
        answers = table.filter(pa.array(kind == REPLIES))
        answered = dict(zip(answers.column("chunk").to_pylist(), answers.column("payload").to_pylist(), strict=True))
        known = np.zeros((models, len(bucket.last)), np.int64)
        for source, own in by_home(bucket_of(bucket.words[bucket.last], buckets)):
            known[:, own] = np.stack(unpack(answered[source]))
        of = table.filter(pa.array(kind == SUMS))
        of = dict(zip(of.column("chunk").to_pylist(), of.column("payload").to_pylist(), strict=True))
        sums = []
        for b, at, starts in bucket.shared(buckets):
            k, n = unpack(of[b])
            sums.append((at, starts, k.reshape(models, -1), n.reshape(models, 4, -1)))
        loss = []
        for m in range(models):
            p1 = (known[m] - d1[m][np.minimum(known[m], 3)]) / max(total[m], 1) + left1[m] / vocabulary
            loss.append(_fixed(-np.log(bucket.probabilities(m, p1, d2[m], d3[m], sums))))
        out, a = [], 0
        for e, where in zip(bucket.ends, mine.column("docs").to_pylist(), strict=True):
            ids, at = np.unique(unpack(where)[0], return_inverse=True)
            each = np.repeat(bucket.place[a:e], bucket.times[a:e])
            out.append(pack(ids, *(np.bincount(at, x[each], len(ids)).astype(np.uint64) for x in loss)))
            a = e
        blank = [pa.nulls(len(out), t) for _, t in kinds]
        sums = pa.table([*blank, mine.column("chunk"), pa.nulls(len(out), pa.int64()), pa.array(out, pa.binary())], names=texts.column_names)
        return pa.concat_tables([texts, sums])

    def means(group: pa.Table) -> pa.Table:
        blobs = group.column("payload").to_pylist()
        given = group.filter(pa.array([b is None for b in blobs]))
        place = given.column("place").to_numpy()
        total = np.zeros((int(place.max()) + 1, models))
        for ids, *loss in sorted((unpack(b) for b in blobs if b is not None), key=lambda x: x[1].tobytes()):
            total[ids] += np.stack(loss, 1)
        mean = total[place] / STEPS / np.maximum(given.column("n_words").to_numpy(), 1)[:, None]
        return pa.table([*[given.column(c) for c in names], pa.array(mean.tolist(), pa.list_(pa.float64()))], names=[*names, "losses"])

    asked = by_bucket(words).applyInArrow(replies, PACKED)
    if told:
        asked = asked.union(told.where(F.col("kind") == SUMS))
    rounds = rounds if buckets > LEAST_BUCKETS else 1
    scored = []
    for i in range(rounds):
        rows = map_arrow(docs, scoring((i, rounds)), f"{PACKED}, place long, {fields}")
        mine = asked.where(F.col("bucket") % rounds == i)
        both = by_bucket(rows.unionByName(mine, allowMissingColumns=True)).applyInArrow(losses, f"{fields}, chunk long, place long, payload binary")
        scored.append(materialize(both, "sums") if rounds > 1 else both)
    out = materialize(reduce(DataFrame.union, scored).groupBy("chunk").applyInArrow(means, f"{fields}, losses array<double>"), "losses")
    for x in (singles, told1, *([told] if told else []), *(scored if rounds > 1 else [])):
        discard(x)
    return out
