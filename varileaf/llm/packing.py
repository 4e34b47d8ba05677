"""Order-preserving packing: a dynamic programme over document and sentence ends chooses the window cuts."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from varileaf.llm.common import batches, map_arrow

LENGTH = 2048
#: What cutting a document costs, in tokens of padding: after a sentence, and inside one that is longer than LONG.
SENTENCE, INSIDE = 4, 24
#: A sentence of more ids than this may also be cut every STEP ids.
LONG, STEP = 128, 32
#: What a window costs besides, so that fewer are preferred.
WINDOW = 1
#: Ids that are planned together.
BLOCK = 1 << 20


def padding(n: int, length: int = LENGTH) -> int:
    """Ids added to a window of n: none at a power of two, else up to `length`."""
    return 0 if n & (n - 1) == 0 else length - n


def plan(at: np.ndarray, penalty: np.ndarray, length: int = LENGTH) -> list[int]:
    """Window ends among the candidate positions `at` (ascending, the last is the end) that cost least.

    cost(i, j) = padding + penalty[j] + WINDOW, so best(j) = length - at[j] + penalty[j] + min over the window of
    (best(i) + at[i]): the minimum comes from a monotone queue, each candidate enters and leaves it once. Lengths
    that are a power of two cost no padding and are tried besides. Of equal costs the earliest cut is taken.
    """
    m = len(at)
    exact: dict[int, list[int]] = {}
    starts = np.concatenate(([0], at))
    for k in range(length.bit_length()):
        if 1 << k <= length:
            want = at - (1 << k)
            found = np.searchsorted(starts, want)
            for j in np.flatnonzero((want >= 0) & (starts[np.minimum(found, m)] == want)).tolist():
                exact.setdefault(j, []).append(int(found[j]))
    where, pen = starts.tolist(), penalty.tolist()
    best, back = [0.0] * (m + 1), [0] * (m + 1)
    queue: deque[tuple[float, int]] = deque([(0.0, 0)])
    for j in range(1, m + 1):
        here = where[j]
        while where[queue[0][1]] < here - length:
            queue.popleft()
        value, i = queue[0]
        value += length - here
        for e in exact.get(j - 1, ()):
            if best[e] < value:
                value, i = best[e], e
        best[j] = value = value + pen[j - 1] + WINDOW
        back[j] = i
        key = value + here
        while queue and queue[-1][0] > key:
            queue.pop()
        queue.append((key, j))
    ends = []
    while m:
        ends.append(where[m])
        m = back[m]
    return ends[::-1]


def candidates(ids: np.ndarray, doc_ends: np.ndarray, ends: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions where a window may end, and what each costs; the last is the end."""
    n = len(ids)
    cost = np.full(n + 1, np.inf)
    cost[np.flatnonzero(ends[ids[:-1]] & begins[ids[1:]]) + 1] = SENTENCE
    cost[doc_ends] = 0
    cost[n] = 0
    at = np.flatnonzero(np.isfinite(cost))
    gaps = np.diff(np.concatenate(([0], at)))
    for j in np.flatnonzero(gaps > LONG).tolist():
        start = int(at[j] - gaps[j])
        cost[start + STEP : int(at[j]) : STEP] = INSIDE
    at = np.flatnonzero(np.isfinite(cost))
    at = at[at > 0]
    return at, cost[at]


def pack(docs: DataFrame, path: str, end_id: int = 1, length: int = LENGTH) -> DataFrame:
    """Packs the documents of every input split, in the order in which it holds them, into windows of `length` ids.

    No row is moved: windows fill up inside a split, so a split's last window alone is short. Returns a row for each
    piece of a document: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and sequence_tokens, the ids of
    its window. A null or empty text is the end id alone; a row that repeats a doc_id is packed again; an empty table gives
    no row; a null doc_id is kept.
    """

    def windows(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zlib

        from pyspark import TaskContext

        from varileaf.llm.tokens import encoder

        enc = encoder(path)
        ends, begins = enc.sentence_marks()
        sequence = TaskContext.get().partitionId() << 33
        names: list = []
        totals: list[int] = []
        done: list[int] = []  # ids of each document that earlier windows have
        parts: list[np.ndarray] = []
        held = 0

        def flush(last: bool) -> pa.RecordBatch | None:
            nonlocal names, totals, done, parts, held, sequence
            ids = np.concatenate(parts)
            doc_ends = np.cumsum([len(p) for p in parts])
            cuts = np.array(plan(*candidates(ids, doc_ends, ends, begins), length))
            if not last:
                cuts = cuts[:-1]
            if not len(cuts):
                return None
            stop = int(cuts[-1])
            edges = np.union1d(cuts, doc_ends[doc_ends < stop])
            begin = np.concatenate(([0], edges[:-1]))
            doc = np.searchsorted(doc_ends, begin, side="right")
            window = np.searchsorted(cuts, begin, side="right")
            opened = np.concatenate(([0], cuts))
            doc_starts = np.concatenate(([0], doc_ends))
            before = np.array(done)[doc]
            view = memoryview(ids.astype("<u4")).cast("B")
            crc = [zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(begin.tolist(), edges.tolist(), strict=True)]
            out = pa.RecordBatch.from_arrays(
                [pa.array([names[d] for d in doc.tolist()], pa.int64()), pa.array(before + begin - doc_starts[doc]), pa.array(edges - begin), pa.array(crc, pa.int64()), pa.array(np.array(totals, np.int64)[doc]), pa.array(sequence + window), pa.array(begin - opened[window]), pa.array(np.diff(opened)[window])],
                names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "sequence_tokens"],
            )
            sequence += len(cuts)
            first = int(np.searchsorted(doc_ends, stop, side="right"))
            names, totals, done, parts = names[first:], totals[first:], done[first:], parts[first:]
            if parts and (taken := stop - int(doc_starts[first])) > 0:
                done[0] += taken
                parts[0] = parts[0][taken:]
            held = len(ids) - stop
            return out

        for frame in batches(frames):
            ids, stops = enc.encode(frame.column(1), end_id)
            sizes = np.diff(stops, prepend=0).tolist()
            names += frame.column(0).to_pylist()
            totals += sizes
            done += [0] * len(sizes)
            parts += np.split(ids, stops[:-1])
            held += len(ids)
            if held >= BLOCK and (out := flush(False)) is not None:
                yield out
        if parts:
            yield flush(True)

    return map_arrow(docs.select("doc_id", "text"), windows, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_tokens long")
