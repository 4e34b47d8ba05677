"""Nearest rows of another table.

A sample of the other side, of a checked size, is sent to every task: where it is the whole side, that is all. Beyond it, some of the sample are pivots:
the other side's rows go to the cell of their nearest pivot, and a query row visits the cells that can hold anything nearer than
the sample does, by the triangle inequality: no row of a cell is nearer than the pivot's distance less the cell's radius. Cells lie in blocks of a bounded size; what
visits the same cell travels together, and the least distance of each query row is an aggregation.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from varileaf.sources.store import stored

#: Cells (rows times columns) of the sample that every task gets.
SAMPLE_CELLS = 1 << 20
#: Pivots at most, and rows and cells of a block of the other side.
MOST_PIVOTS, BLOCK_ROWS, BLOCK_CELLS = 1024, 1 << 16, 1 << 22
#: Rows of a box, and columns up to which boxes are looked at: with many columns none is far from another.
BOX_ROWS, BOX_COLUMNS = 128, 8
_TILE = 1 << 22

def squared_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] - 2 * a @ b.T + (b * b).sum(1)[None], 0)


def boxes(x: np.ndarray, leaf: int) -> list[np.ndarray]:
    """The rows' numbers in groups of at most `leaf`, halved along the widest side."""
    out, open_ = [], [np.arange(len(x))] if len(x) else []
    while open_:
        at = open_.pop()
        if len(at) <= leaf:
            out.append(at)
            continue
        own = x[at]
        side, half = int((own.max(0) - own.min(0)).argmax()), len(at) // 2
        order = np.argpartition(own[:, side], half)
        open_ += [at[order[half:]], at[order[:half]]]
    return out


class Boxed:
    """Rows in boxes, for exact searches that leave out the boxes which are too far."""

    def __init__(self, x: np.ndarray, leaf: int = BOX_ROWS):
        groups = boxes(x, leaf)
        self.at = np.concatenate(groups) if groups else np.zeros(0, np.int64)
        self.x, self.edges = x[self.at], np.cumsum([0, *map(len, groups)])
        self.low, self.high = (np.array([f(x[g], axis=0) for g in groups]).reshape(len(groups), x.shape[1]) for f in (np.min, np.max))

    def _rows(self, which: np.ndarray) -> np.ndarray:
        return np.concatenate([np.arange(self.edges[w], self.edges[w + 1]) for w in which])

    def nearest(self, a: np.ndarray, k: int, same: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Squared distances of each row of a to its k nearest rows, the nearest first, and their numbers; infinite and -1 where there are fewer. same: the number that doesn't count."""
        k = min(k, len(self.x))
        far, near = np.full((len(a), k), np.inf), np.full((len(a), k), -1)
        if not k:
            return far, near
        # a few rows among many are looked at in smaller groups, which are as wide as a box
        for q in boxes(a, max(8, min(BOX_ROWS, BOX_ROWS * len(a) // len(self.x)))):
            low, high = a[q].min(0), a[q].max(0)
            # sums run in the same order as those of the distances, so rounding can't put a bound above them
            bound = np.zeros(len(self.low))
            for f in range(a.shape[1]):
                bound += np.maximum(0, np.maximum(self.low[:, f] - high[f], low[f] - self.high[:, f])) ** 2
            order = np.argsort(bound, kind="stable")
            use = 1 + int(np.searchsorted(np.cumsum(np.diff(self.edges)[order]), k + (same is not None)))
            d, at = self._best(a[q], self._rows(order[:use]), k, None if same is None else same[q])
            more = int(np.searchsorted(bound[order], d[:, -1].max(), side="right"))
            if more > use:
                d, at = self._best(a[q], self._rows(order[:more]), k, None if same is None else same[q])
            far[q], near[q] = d, at
        return far, near

    def _best(self, a: np.ndarray, rows: np.ndarray, k: int, same: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        far, near = np.full((len(a), k), np.inf), np.full((len(a), k), -1)
        for i in range(0, len(rows), _TILE // BOX_ROWS):
            some = rows[i : i + _TILE // BOX_ROWS]
            d = np.zeros((len(a), len(some)))
            for f in range(a.shape[1]):
                d += (a[:, f, None] - self.x[None, some, f]) ** 2
            own = self.at[some]
            if same is not None:
                d[same[:, None] == own[None]] = np.inf
            if k == 1:
                at = d.argmin(1)[:, None]
            else:
                at = np.argpartition(d, min(k, len(some)) - 1, axis=1)[:, :k]
            d, own = np.concatenate((far, np.take_along_axis(d, at, 1)), 1), np.concatenate((near, own[at]), 1)
            order = np.argsort(d, axis=1, kind="stable")[:, :k]
            far, near = np.take_along_axis(d, order, 1), np.take_along_axis(own, order, 1)
        return far, np.where(np.isfinite(far), near, -1)


def nearest_rows(a: np.ndarray, b: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Squared distances of each row of a to its k nearest rows of b, the nearest first, and their numbers."""
    return Boxed(b).nearest(a, k)


def repeated(far: np.ndarray, near: np.ndarray, times: np.ndarray, k: int) -> np.ndarray:
    """The k least distances, where row i of the other side occurs times[i] times; infinite where there are fewer."""
    upto = np.cumsum(np.where(near >= 0, times[near], 0), axis=1)
    at = np.stack([(upto <= i).sum(1) for i in range(k)], 1)
    wide = np.concatenate((far, np.full((len(far), 1), np.inf)), 1)
    return np.take_along_axis(wide, at, 1)


def least_distance(a: np.ndarray, b: np.ndarray | Boxed, same: np.ndarray | None = None) -> np.ndarray:
    """Distance of each row of a to the nearest of b; same: b's index that doesn't count."""
    if isinstance(b, Boxed) or a.shape[1] <= BOX_COLUMNS:
        return np.sqrt(nearest_of(a, b, same)) if len(a) else np.zeros(0)
    out = np.full(len(a), np.inf)
    step = max(1, _TILE // max(1, len(b)))
    for i in range(0, len(a) if len(b) else 0, step):
        d = squared_distances(a[i : i + step], b)
        if same is not None:
            d[np.arange(len(d))[same[i : i + step] >= 0], same[i : i + step][same[i : i + step] >= 0]] = np.inf
        best = d.argmin(1)
        near = np.sqrt(((a[i : i + step] - b[best]) ** 2).sum(1))  # the best one again, without cancellation
        out[i : i + step] = np.where(np.isfinite(d[np.arange(len(d)), best]), near, np.inf)
    return out


def nearest_of(a: np.ndarray, b: np.ndarray | Boxed, same: np.ndarray | None) -> np.ndarray:
    """Squared distance of each row of a to the nearest of b; equal rows are looked up once."""
    b = b if isinstance(b, Boxed) else Boxed(b)
    if not len(b.x):
        return np.full(len(a), np.inf)
    own = np.full(len(a), -1) if same is None else same
    order = np.lexsort((own, *a.T))
    x, left_out = a[order], own[order]
    starts = np.concatenate(([True], (x[1:] != x[:-1]).any(1) | (left_out[1:] != left_out[:-1])))
    out = np.empty(len(a))
    out[order] = b.nearest(x[starts], 1, None if same is None else left_out[starts])[0][np.cumsum(starts) - 1, 0]
    return out


def _in_boxes(x: np.ndarray) -> np.ndarray | Boxed:
    return Boxed(x) if x.shape[1] <= BOX_COLUMNS else x


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.values.to_numpy(zero_copy_only=False)[column.offsets[0].as_py() : column.offsets[-1].as_py()].reshape(-1, d)


def _same(keys: np.ndarray, reference: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Place of each key in the reference, -1 without one; order sorts the reference."""
    if not len(reference):
        return np.full(len(keys), -1)
    at = order[np.minimum(np.searchsorted(reference, keys, sorter=order), len(reference) - 1)]
    return np.where(reference[at] == keys, at, -1)


def _prints(x: np.ndarray) -> np.ndarray:
    """A number for each row's coordinates, the same in all processes."""
    odd = np.random.default_rng(13).integers(1 << 62, 1 << 63, x.shape[1], np.uint64) | np.uint64(1)
    return (np.ascontiguousarray(x).view(np.uint64) * odd).sum(1, dtype=np.uint64).view(np.int64)


def _cells(x: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest pivot of each row, and the distance."""
    cell = np.zeros(len(x), np.int64)
    step = max(1, _TILE // len(pivots))
    for i in range(0, len(x), step):
        cell[i : i + step] = squared_distances(x[i : i + step], pivots).argmin(1)
    return cell, np.sqrt(np.square(x - pivots[cell]).sum(1))


def _blocks(placed: DataFrame, d: int) -> DataFrame:
    """cell, keys and x of blocks of rows of one cell. Hot cells are dealt to several tasks."""
    most = max(1, min(BLOCK_ROWS, BLOCK_CELLS // d))

    def pack(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        now, size = -1, 0

        def full() -> pa.RecordBatch:
            columns = [pa.array([now]), *[pa.array([np.concatenate([h[k] for h in held]).tobytes()]) for k in (0, 1)]]
            return pa.RecordBatch.from_arrays(columns, names=["cell", "keys", "x"])

        for frame in frames:
            cell, keys, x = frame.column(0).to_numpy(), frame.column(1).to_numpy(), _matrix(frame.column(2), d)
            edges = [0, *(np.flatnonzero(np.diff(cell)) + 1).tolist(), len(cell)]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                for i in range(a, b, most):
                    j = min(b, i + most)
                    if held and (cell[i] != now or size + j - i > most):
                        yield full()
                        held, size = [], 0
                    now = int(cell[i])
                    held.append((keys[i:j], x[i:j]))
                    size += j - i
        if held:
            yield full()

    dealt = placed.select("cell", "key", "x").repartitionByRange("cell", F.xxhash64("x", "key")).sortWithinPartitions("cell")
    return dealt.mapInArrow(pack, "cell long, keys binary, x binary")


def nearest(query: DataFrame, reference: DataFrame, columns: list[str], ids: list[str], exclude_self: bool = False) -> DataFrame:
    """ids and distance: to the nearest reference row over the columns, of every query row; null where there is none.

    exclude_self leaves out the reference row with the same ids. Rows of the reference with a null or NaN coordinate don't count, and such
    a query row has no distance. Of equal reference rows one is compared (two where self is left out). Of the reference the driver sees
    SAMPLE_CELLS at most. Beyond that its rows are written once, by cell, to the shared folder.
    """
    d = len(columns)
    key = F.xxhash64(*[F.col(f"`{c}`").cast("string") for c in ids]) if exclude_self else F.lit(0).cast("long")
    x = F.array(*[F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(float("nan"))) for c in columns])
    whole = reference.select(key.alias("key"), x.alias("x")).where(~F.exists("x", F.isnan))
    apart = whole.groupBy("x").agg(F.min("key").alias("a"), F.max("key").alias("b")).select(F.explode(F.array_distinct(F.array("a", "b"))).alias("key"), "x")
    most = max(1, SAMPLE_CELLS // d)
    sample = apart.orderBy(F.xxhash64(F.lit(11), "x"), "key").limit(most + 1).toArrow()
    keys, near = sample.column(0).to_numpy(), _matrix(sample.column(1).combine_chunks(), d) if sample.num_rows else np.zeros((0, d))
    order = np.argsort(keys, kind="stable")
    given = query.select(*[F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(ids)], key.alias("key"), x.alias("x"))
    # neighbours travel together, however the table's files are cut; equal rows may be dealt to several tasks
    given = given.repartitionByRange("x", F.xxhash64(*[f"_{i}" for i in range(len(ids))])).sortWithinPartitions("x")

    def bounded(frame: pa.RecordBatch, near: np.ndarray | Boxed) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        own, at = frame.column(len(ids)).to_numpy(), _matrix(frame.column(len(ids) + 1), d)
        known = ~np.isnan(at).any(1)
        out = np.full(len(at), np.inf)
        out[known] = least_distance(at[known], near, _same(own[known], keys, order) if exclude_self else None)
        return own, at, out

    if sample.num_rows <= most:

        def compare(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = _in_boxes(near)
            for frame in frames:
                yield pa.RecordBatch.from_arrays([*frame.columns[: len(ids)], pa.array(bounded(frame, held)[2])], names=[*frame.schema.names[: len(ids)], "distance"])

        shape = StructType(given.schema.fields[: len(ids)]).add("distance", "double")
        found = given.mapInArrow(compare, shape)
    else:
        found = _beyond(given, apart, bounded, near, d, len(ids), exclude_self)
    distance = F.when(F.col("distance") < float("inf"), F.col("distance"))
    return found.select(*[F.col(f"_{i}").alias(c) for i, c in enumerate(ids)], distance.alias("distance"))


def _beyond(given: DataFrame, apart: DataFrame, bounded, near: np.ndarray, d: int, width: int, exclude_self: bool) -> DataFrame:
    """The ids and the least distance of each query row, where the sample isn't the whole reference."""
    rows = max(1, min(BLOCK_ROWS, BLOCK_CELLS // d))
    pivots = near[: max(1, min(MOST_PIVOTS, len(near), -(-apart.count() // rows)))]

    def place(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            cell, r = _cells(_matrix(frame.column(1), d), pivots)
            yield pa.RecordBatch.from_arrays([pa.array(cell), *frame.columns, pa.array(r)], names=["cell", "key", "x", "r"])

    placed = stored(apart.mapInArrow(place, "cell long, key long, x array<double>, r double"), "cells")
    radius = np.full(len(pivots), -np.inf)  # nothing visits an empty cell
    for r in placed.groupBy("cell").agg(F.max("r").alias("r")).collect():
        radius[r.cell] = r.r
    blocks = _blocks(placed, d).select("cell", F.col("keys").alias("their_keys"), F.col("x").alias("their_x"))
    names = [f"_{i}" for i in range(width)]
    lists = ", ".join(f"{f.name} array<{f.dataType.simpleString()}>" for f in given.schema.fields[:width])

    def visit(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def group(frame: pa.RecordBatch, cell: int, at: np.ndarray, parts: tuple[np.ndarray, ...]) -> pa.RecordBatch:
            own = [pa.ListArray.from_arrays(pa.array([0, len(at)], pa.int32()), c.take(pa.array(at))) for c in frame.columns[:width]]
            return pa.RecordBatch.from_arrays([pa.array([cell]), *own, *[pa.array([p[at].tobytes()]) for p in parts]], names=["cell", *names, "keys", "x", "least"])

        held = _in_boxes(near)
        for frame in frames:
            parts = bounded(frame, held)
            _, x, least = parts
            if not len(x):
                continue
            yield group(frame, -1 - int(np.abs(x[0]).view(np.int64).sum() & 0xFFFFF), np.arange(len(x)), parts)  # meets no block
            known = np.flatnonzero(~np.isnan(x).any(1))
            step = max(1, _TILE // len(pivots))
            reach: list[tuple[np.ndarray, np.ndarray]] = []
            for i in range(0, len(known), step):
                some = known[i : i + step]
                away = np.sqrt(squared_distances(x[some], pivots))
                slack = 1e-7 * (np.linalg.norm(x[some], axis=1)[:, None] + np.linalg.norm(pivots, axis=1))  # more than rounding takes
                row, cell = np.nonzero((away - radius <= least[some][:, None] + slack) & (least[some] > 0)[:, None])
                reach.append((cell, some[row]))
            if reach:
                cell, at = (np.concatenate(c) for c in zip(*reach, strict=True))
                sort = np.argsort(cell, kind="stable")
                cell, at = cell[sort], at[sort]
                edges = [0, *(np.flatnonzero(np.diff(cell)) + 1).tolist(), len(cell)]
                for a, b in zip(edges[:-1], edges[1:], strict=True):
                    if b > a:
                        yield group(frame, int(cell[a]), at[a:b], parts)

    def compare(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            for i in range(frame.num_rows):
                own = [frame.column(1 + k)[i].values for k in range(width)]
                keys, x, least, other_keys, other = (frame.column(width + 1 + k)[i].as_py() for k in range(5))
                keys, x, least = np.frombuffer(keys, np.int64), np.frombuffer(x).reshape(-1, d), np.frombuffer(least)
                if other is not None:
                    theirs = np.frombuffer(other_keys, np.int64)
                    same = _same(keys, theirs, np.argsort(theirs, kind="stable")) if exclude_self else None
                    least = np.minimum(least, least_distance(x, np.frombuffer(other).reshape(-1, d), same))
                home = pa.array(np.full(len(x), int(frame.column(0)[i].as_py() < 0)))
                yield pa.RecordBatch.from_arrays([*own, pa.array(_prints(x)), pa.array(least), home], names=[*names, "print", "distance", "home"])

    visits = given.mapInArrow(visit, f"cell long, {lists}, keys binary, x binary, least binary").join(blocks, "cell", "left")
    shape = StructType(given.schema.fields[:width]).add("print", "long").add("distance", "double").add("home", "long")
    # a query row is told by its ids and coordinates; rows that share both come back as often as they were given
    each = visits.mapInArrow(compare, shape).groupBy(*names, "print").agg(F.min("distance").alias("distance"), F.sum("home").alias("times"))
    return each.select(*names, F.explode(F.array_repeat("distance", F.col("times").cast("int"))).alias("distance"))
