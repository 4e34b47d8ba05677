"""Picking a budget of rows from every partition.

Input: a table with ids, z columns and partition_id; budgets: partition_id -> rows. Output: ids, partition_id and selection_rank (from 0).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol, runtime_checkable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from varileaf.functions import draws
from varileaf.operators.budgets import largest_remainder
from varileaf.operators.neighbours import BOX_COLUMNS, boxes, nearest_rows, repeated, squared_distances
from varileaf.sources.store import removed, stored

#: Rows of a partition that one kernel call holds; rounds over all tasks make the same picks from a larger one.
GROUP_ROWS = 20_000
#: Different rows of a partition that one call of farthest picks takes, in GROUP_ROWS: with boxes a pick looks at few of them.
PICK_GROUPS = 3
#: Rows of a box, and picks up to which no boxes are made.
PICK_BOX, FEW_PICKS = 32, 64
#: Rows that a round of distributed picks brings to the driver, over all tasks and partitions.
CANDIDATES = 100_000
#: Shares that a partition's rows are dealt to before their first ones are picked.
SHARES = 64
NEIGHBOURS = 10


@runtime_checkable
class SelectionStrategy(Protocol):
    """A custom strategy: indices of `budget` distinct rows of z, best first."""

    def __call__(self, z: np.ndarray, budget: int, seed: int) -> np.ndarray: ...


def ranked(df: DataFrame, ids: list[str], seed: int, by: str = "partition_id", name: str = "rank") -> DataFrame:
    """Adds a row's place, from 0, in its group's order by the md5 key.

    The key's first byte deals a group to 256 windows, whose sizes are summed apart, so no task sorts a whole group.
    """
    keyed = df.withColumn("_key", draws.order_key(seed, ids)).withColumn("_part", F.substring("_key", 1, 2))
    sizes = keyed.groupBy(by, "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy(by).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    inside = F.row_number().over(W.partitionBy(by, "_part").orderBy("_key", *ids)) - 1
    return keyed.withColumn("_in", inside).join(offsets, [by, "_part"]).withColumn(name, (F.col("_before") + F.col("_in")).cast("long")).drop("_key", "_part", "_in", "_before")


def budget_table(df: DataFrame, budgets: dict[int, int]) -> DataFrame:
    """One row for each partition of a tree, so its size is bounded by the number of leaves."""
    return df.sparkSession.createDataFrame([(int(p), int(b)) for p, b in budgets.items() if b > 0], "partition_id int, budget long")


def stratified(df: DataFrame, ids: list[str], z: list[str], budgets: dict[int, int], seed: int = 42) -> DataFrame:
    """A seeded sample of each partition."""
    kept = ranked(df.select(*ids, "partition_id"), ids, seed).join(F.broadcast(budget_table(df, budgets)), "partition_id")
    return kept.where("rank < budget").select(*ids, "partition_id", F.col("rank").alias("selection_rank"))


def farthest(z: np.ndarray, budget: int, first: int) -> np.ndarray:
    """From `first`, always the row farthest from all chosen ones; rows are never chosen twice."""
    if budget > FEW_PICKS and z.shape[1] < BOX_COLUMNS and len(z) > 4 * PICK_BOX and np.isfinite(z).all():
        return _farthest_in_boxes(z, budget, first)
    chosen, least = [first], ((z - z[first]) ** 2).sum(1)
    least[first] = -1
    while len(chosen) < budget:
        at = int(least.argmax())
        chosen.append(at)
        np.minimum(least, ((z - z[at]) ** 2).sum(1), out=least)
        least[at] = -1
    return np.array(chosen)


def _farthest_in_boxes(z: np.ndarray, budget: int, first: int) -> np.ndarray:
    """The same picks: a new one looks only at boxes of rows that are nearer to it than their farthest row is to the older ones.

    Up to seven columns numpy adds them in their order, as is done here, so rounding can't put a bound above a distance.
    """
    groups = [np.sort(g) for g in boxes(z, PICK_BOX)]
    member, least = np.full((len(groups), PICK_BOX), -1), np.full((len(groups), PICK_BOX), -1.0)
    for b, g in enumerate(groups):
        member[b, : len(g)], least[b, : len(g)] = g, np.inf
    box, place = np.zeros(len(z), np.int64), np.zeros(len(z), np.int64)
    held = member >= 0
    box[member[held]], place[member[held]] = np.nonzero(held)
    columns = [c[member] for c in z.T]
    low, high = (np.array([f(z[g], axis=0) for g in groups]).T.copy() for f in (np.min, np.max))
    best, top = member[:, 0].copy(), np.full(len(groups), np.inf)
    chosen, at = [], first
    while True:
        chosen.append(at)
        if len(chosen) == budget:
            return np.array(chosen)
        own = z[at]
        gap = np.maximum(low - own[:, None], own[:, None] - high)
        np.maximum(gap, 0, out=gap)
        gap *= gap
        look = np.flatnonzero(gap.sum(0) < top)
        least[box[at], place[at]] = -1
        if top[box[at]] <= 0:  # its box isn't looked at where copies of chosen rows are left
            look = np.append(look, box[at])
        far = np.zeros((len(look), PICK_BOX))
        for c, x in zip(columns, own, strict=True):
            apart = c[look]
            apart -= x
            apart *= apart
            far += apart
        far = np.minimum(least[look], far)
        least[look] = far
        k = far.argmax(1)
        rows = np.arange(len(look))
        top[look], best[look] = far[rows, k], member[look, k]
        at = int(best[top == top.max()].min())


def centroid_fps(z: np.ndarray, budget: int, seed: int = 0) -> np.ndarray:
    return farthest(z, budget, int(((z - z.mean(0)) ** 2).sum(1).argmin()))


def medoid_fps(z: np.ndarray, budget: int, seed: int = 0) -> np.ndarray:
    """Starts at the medoid: exact up to 200 rows, beyond among the rows nearest to the centroid. centroid_fps starts at the exact one of any number."""
    pool = np.arange(len(z))
    if len(z) > 200:
        k = min(max(30, int(len(z) ** 0.5)), len(z))
        pool = np.sort(np.argsort(((z - z.mean(0)) ** 2).sum(1), kind="stable")[:k])
    return farthest(z, budget, int(pool[squared_distances(z[pool], z[pool]).sum(1).argmin()]))


def variance_ordered(z: np.ndarray, budget: int, seed: int = 0) -> np.ndarray:
    """Rows whose distances to their nearest rows (themselves included) vary most."""
    k = min(NEIGHBOURS, len(z) - 1)
    if k < 1:
        return np.arange(len(z))[:budget]
    apart, own, times = np.unique(z, axis=0, return_inverse=True, return_counts=True)
    score = np.sqrt(repeated(*nearest_rows(apart, apart, k), times, k)).var(axis=1)[own.ravel()]
    return np.argsort(-np.round(score, 12), kind="stable")[:budget]


def mixed_fps(z: np.ndarray, budget: int, seed: int = 0) -> np.ndarray:
    """Sample of a custom strategy: 70 % by distance, the rest by variance."""
    head = centroid_fps(z, max(1, round(0.7 * budget)), seed)
    rest = [i for i in variance_ordered(z, len(z), seed).tolist() if i not in set(head.tolist())]
    return np.concatenate((head, np.array(rest[: budget - len(head)], int)))


def grouped(df: DataFrame, ids: list[str], z: list[str], budgets: dict[int, int], kernel: SelectionStrategy, seed: int = 42) -> DataFrame:
    """Runs a kernel on every whole partition; beyond GROUP_ROWS the known ones are distributed, a custom one still gets all rows."""
    wanted = budget_table(df, budgets)
    table = df.select(*ids, *z, "partition_id").join(F.broadcast(wanted), "partition_id")
    sizes = {r.partition_id: r["count"] for r in table.groupBy("partition_id").count().collect()}
    large = {p: min(budgets[p], n) for p, n in sizes.items() if n > GROUP_ROWS and kernel in DISTRIBUTED}

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(ids, kind="stable")
        budget = int(frame["budget"].iloc[0])
        at = np.asarray(kernel(frame[z].to_numpy(float), min(budget, len(frame)), seed), int)
        out = frame.iloc[at][[*ids, "partition_id"]]
        return out.assign(selection_rank=np.arange(len(out)))

    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*ids, "partition_id").schema) + ", selection_rank long"
    if large and len(large) == len(sizes):
        return distributed(df, ids, z, large, kernel, sizes)
    # a condition on partition_id would work out the tree twice for each row
    small = table.join(F.broadcast(budget_table(df, large).select("partition_id")), "partition_id", "left_anti") if large else table
    out = small.groupBy("partition_id").applyInPandas(run, shape)
    return out.unionByName(distributed(df, ids, z, large, kernel, sizes)) if large else out


def distributed(df: DataFrame, ids: list[str], z: list[str], budgets: dict[int, int], kernel: SelectionStrategy, sizes: dict[int, int]) -> DataFrame:
    """What a kernel picks from whole partitions that are too large for one call.

    Rows with the same z are one row here: distances are looked at between different rows, and the copies follow by their number.
    """
    mine = df.select(*ids, *z, "partition_id").join(F.broadcast(budget_table(df, budgets).select("partition_id")), "partition_id")
    # numbered in the order of the ids, so that ties end as in one kernel
    rows = mine.orderBy(*ids).withColumn("_row", F.monotonically_increasing_id()).persist(StorageLevel.DISK_ONLY)
    apart = rows.groupBy("partition_id", *z).agg(F.min("_row").alias("_row"), F.count(F.lit(1)).alias("_times")).persist(StorageLevel.DISK_ONLY)
    kinds = {r.partition_id: r["count"] for r in apart.groupBy("partition_id").count().collect()}
    heads = {p: max(1, round(0.7 * b)) for p, b in budgets.items()} if kernel is mixed_fps else budgets
    picks = None
    if kernel is not variance_ordered:
        picks = farthest_rows(rows, apart, z, heads, kernel is medoid_fps, sizes, kinds)
    if kernel in (variance_ordered, mixed_fps):
        at = {p: heads[p] if picks is not None else 0 for p in budgets}
        scored = rows.join(neighbour_variance(apart, z, kinds), ["partition_id", *z]).select("partition_id", "_row", "_score")
        if picks is not None:
            scored = scored.join(picks.select("_row"), "_row", "left_anti")
        rest = _leading(scored, {p: budgets[p] - at[p] for p in budgets}, at)
        picks = rest if picks is None else picks.unionByName(rest)
    return rows.join(picks.select("_row", "selection_rank"), "_row").select(*ids, "partition_id", "selection_rank")


def _quota(df: DataFrame, most: dict[int, int], at: dict[int, int]) -> DataFrame:
    return F.broadcast(df.sparkSession.createDataFrame([(p, n, at[p]) for p, n in most.items() if n > 0], "partition_id int, _n long, _at long"))


def _leading(scored: DataFrame, most: dict[int, int], at: dict[int, int]) -> DataFrame:
    """Of each partition so many rows of the greatest _score, ranked from `at`. Shares of a partition are cut first, so no task sorts all its rows."""
    order = (F.desc("_score"), "_row")
    dealt = scored.join(_quota(scored, most, at), "partition_id").withColumn("_share", F.pmod(F.xxhash64("_row"), F.lit(SHARES)))
    cut = dealt.withColumn("_place", F.row_number().over(W.partitionBy("partition_id", "_share").orderBy(*order))).where("_place <= _n")
    placed = cut.withColumn("_place", F.row_number().over(W.partitionBy("partition_id").orderBy(*order)) - 1).where("_place < _n")
    return placed.select("partition_id", "_row", (F.col("_at") + F.col("_place")).cast("long").alias("selection_rank"))


def _runs(rows: DataFrame) -> DataFrame:
    """Rows of each partition before each _run, small enough for every task: runs are tasks of a sort."""
    before = W.partitionBy("partition_id").orderBy("_run").rowsBetween(W.unboundedPreceding, -1)
    return F.broadcast(rows.groupBy("partition_id", "_run").agg(F.count(F.lit(1)).alias("_k")).withColumn("_before", F.coalesce(F.sum("_k").over(before), F.lit(0))).drop("_k"))


def _following(rows: DataFrame, picks: DataFrame, most: dict[int, int], at: dict[int, int]) -> DataFrame:
    """Of each partition so many rows that aren't picked, by their number, ranked from `at`, the picks so far. A number's upper bits are a run of the order of the ids, which one task sorts."""
    run = rows.select("partition_id", "_row", F.shiftright("_row", 33).alias("_run")).join(_quota(rows, most, at), "partition_id")
    # at most _at of a partition's first rows are picks, so these hold all that follow
    first = run.join(_runs(run), ["partition_id", "_run"]).where("_before < _n + _at").drop("_before")
    left = first.join(picks.select("_row"), "_row", "left_anti")
    needed = left.join(_runs(left), ["partition_id", "_run"]).where("_before < _n")
    placed = needed.withColumn("_place", F.col("_before") + F.row_number().over(W.partitionBy("partition_id", "_run").orderBy("_row")) - 1).where("_place < _n")
    return placed.select("partition_id", "_row", (F.col("_at") + F.col("_place")).cast("long").alias("selection_rank"))


def _center(rows: DataFrame, z: list[str]) -> dict[int, np.ndarray]:
    means = rows.groupBy("partition_id").agg(*[F.avg(F.col(c).cast("double")).alias(f"_m{i}") for i, c in enumerate(z)]).collect()
    return {r.partition_id: np.array(r[1:], float) for r in means}


def _nearest_center(rows: DataFrame, z: list[str], most: dict[int, int], center: dict[int, np.ndarray]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Of each partition the numbers and z of the rows nearest to its mean, so many, the nearest first."""

    def top(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Held()
        for p, number, x, _ in _by_partition(frames, z):
            held.add(p, number, x, ((x - center[p]) ** 2).sum(1), most[p])
        for p, (number, x, far) in held.parts.items():
            yield _candidates(p, number, x, far)

    near = rows.select("partition_id", "_row", F.lit(0.0).alias("_least"), *z).mapInArrow(top, _SHAPE)
    place = F.row_number().over(W.partitionBy("partition_id").orderBy("_least", "_row"))
    wanted = rows.sparkSession.createDataFrame(list(most.items()), "partition_id int, _most long")
    out = {}
    for p, own in near.withColumn("_place", place).join(F.broadcast(wanted), "partition_id").where("_place <= _most").toPandas().groupby("partition_id"):
        own = own.sort_values("_place")
        out[p] = own["_row"].to_numpy(), np.frombuffer(b"".join(own["_z"])).reshape(len(own), -1)
    return out


class _Held:
    """Of each partition the least rows (by a number, then by their own) that a task has met; others tells the least one that was left out."""

    def __init__(self) -> None:
        self.parts: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        self.others: dict[int, tuple[float, int]] = {}

    def add(self, p: int, number: np.ndarray, x: np.ndarray, by: np.ndarray, most: int) -> None:
        if p in self.parts:
            number, x, by = (np.concatenate(c) for c in zip(self.parts[p], (number, x, by), strict=True))
        at = np.lexsort((number, by))
        if len(at) > most:
            out = at[most]
            self.others[p] = min(self.others.get(p, (np.inf, 0)), (float(by[out]), int(number[out])))
            at = at[:most]
        self.parts[p] = number[at], x[at], by[at]


_SHAPE = "partition_id int, _row long, _least double, _z binary"


def _candidates(p: int, number: np.ndarray, x: np.ndarray, least: np.ndarray) -> pa.RecordBatch:
    n = len(number)
    return pa.RecordBatch.from_arrays([pa.array([p] * n, pa.int32()), pa.array(number, pa.int64()), pa.array(least, pa.float64()), pa.array([r.tobytes() for r in np.ascontiguousarray(x)], pa.binary())], names=["partition_id", "_row", "_least", "_z"])


def _by_partition(frames: Iterator[pa.RecordBatch], z: list[str]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Of a task's rows (partition_id, _row, _least, z): each partition's, in the order of their numbers."""
    for frame in frames:
        p = frame.column(0).to_numpy()
        number, least = frame.column(1).to_numpy(), frame.column(2).to_numpy()
        x = np.stack([np.asarray(frame.column(3 + i).to_numpy(zero_copy_only=False), float) for i in range(len(z))], 1)
        for own in np.unique(p):
            at = np.flatnonzero(p == own)
            at = at[np.argsort(number[at], kind="stable")]
            yield int(own), number[at], x[at], least[at]


def farthest_rows(rows: DataFrame, apart: DataFrame, z: list[str], budgets: dict[int, int], medoid: bool, sizes: dict[int, int], kinds: dict[int, int]) -> DataFrame:
    """partition_id, _row and selection_rank of what farthest() picks from each whole partition.

    All different rows are picked before any copy, whose distance is 0; copies follow by their number. One call takes the different rows of a
    partition if they are few, else they are picked in rounds.
    """
    pool = {p: min(max(30, int(sizes[p] ** 0.5)), sizes[p]) if medoid else 1 for p in budgets}
    first: dict[int, tuple[int, np.ndarray]] = {}
    for p, (number, x) in _nearest_center(rows if medoid else apart, z, pool, _center(rows, z)).items():
        order = np.argsort(number)
        at = int(order[squared_distances(x[order], x[order]).sum(1).argmin()]) if medoid else 0
        first[p] = int(number[at]), x[at]
    heads = {p: min(b, kinds[p]) for p, b in budgets.items()}
    few = {p: b for p, b in heads.items() if kinds[p] <= PICK_GROUPS * GROUP_ROWS}

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("_row", kind="stable")
        p, x = int(frame["partition_id"].iloc[0]), frame[z].to_numpy(float)
        number = frame["_row"].to_numpy()
        # the first one may be a copy; its kind stands for it
        at = farthest(x, few[p], int(((x - first[p][1]) ** 2).sum(1).argmin()))
        return pd.DataFrame({"partition_id": p, "_row": np.concatenate(([first[p][0]], number[at[1:]])), "selection_rank": np.arange(len(at))})

    shape = "partition_id int, _row long, selection_rank long"
    found = []
    if few:
        found.append(apart.where(F.col("partition_id").isin(list(few))).groupBy("partition_id").applyInPandas(run, shape))
    if len(few) < len(heads):
        found.append(farthest_rounds(apart, z, {p: b for p, b in heads.items() if p not in few}, first))
    picks = found[0] if len(found) == 1 else found[0].unionByName(found[1])
    copies = {p: budgets[p] - heads[p] for p in budgets}
    if not any(copies.values()):
        return picks
    picks = picks.persist(StorageLevel.DISK_ONLY)
    return picks.unionByName(_following(rows, picks, copies, heads))


def farthest_rounds(apart: DataFrame, z: list[str], budgets: dict[int, int], first: dict[int, tuple[int, np.ndarray]]) -> DataFrame:
    """partition_id, _row and selection_rank of what farthest() picks from different rows.

    A round adds the new picks to every row's least distance and marks them in the table, and each task sends its farthest rows, CANDIDATES over
    all. Distances only shrink, so the driver goes on among the sent rows as long as its pick is ahead of all that any task has kept back.
    """
    count = dict.fromkeys(budgets, 1)
    new = {p: (first[p][1][None], np.array([first[p][0]]), np.array([0])) for p in budgets}
    given = apart.where(F.col("partition_id").isin(list(budgets)))
    state = given.select("partition_id", "_row", F.lit(float("inf")).alias("_least"), *z, F.lit(-1).cast("long").alias("_rank"))
    shape = ", ".join(f"`{f.name}` {'double' if f.name in z else f.dataType.simpleString()}" for f in state.schema)
    old = None
    while True:
        shared = apart.sparkSession.sparkContext.broadcast(new)

        def update(frames: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for frame in frames:
                ranks = dict(zip(frame.column(1).to_pylist(), frame.column(frame.num_columns - 1).to_pylist(), strict=True))
                for p, number, x, least in _by_partition(iter([frame]), z):
                    least, number = least.copy(), number.copy()
                    rank = np.array([ranks[k] for k in number.tolist()])
                    c, chosen, places = shared.value.get(p, (np.zeros((0, x.shape[1])), np.zeros(0, np.int64), np.zeros(0, np.int64)))
                    for one, own, place in zip(c, chosen, places, strict=True):
                        far = ((x - one) ** 2).sum(1)
                        np.minimum(least, far, out=least)
                        # the first one may be a copy; its kind stands for it
                        at = far == 0 if place == 0 else number == own
                        least[at], rank[at], number[at] = -1, place, own
                    yield pa.RecordBatch.from_arrays([pa.array([p] * len(number), pa.int32()), pa.array(number), pa.array(least), *[pa.array(x[:, i]) for i in range(x.shape[1])], pa.array(rank, pa.int64())], names=["partition_id", "_row", "_least", *z, "_rank"])

        state = stored(state.mapInArrow(update, shape), "farthest")
        if old is not None:
            removed(old)
        old = state
        shared.destroy()
        if all(count[p] >= b for p, b in budgets.items()):
            return state.where("_rank >= 0").select("partition_id", "_row", F.col("_rank").alias("selection_rank"))
        open_ = [p for p, b in budgets.items() if count[p] < b]
        some = state.where(F.col("partition_id").isin(open_)).drop("_rank")
        most = max(1, CANDIDATES // (max(1, some.rdd.getNumPartitions()) * len(open_)))

        def top(frames: Iterator[pa.RecordBatch], most=most) -> Iterator[pa.RecordBatch]:
            held = _Held()
            for p, number, x, least in _by_partition(frames, z):
                held.add(p, number, x, -least, most)
            for p, (number, x, far) in held.parts.items():
                yield _candidates(p, number, x, -far)
                if p in held.others:  # bounds all that stay behind
                    far, number = held.others[p]
                    yield _candidates(p, np.array([number]), x[:1, :0], np.array([-far]))

        got = some.mapInArrow(top, _SHAPE).toPandas()
        new = {}
        for p, own in got.groupby("partition_id"):
            bound = own["_z"].map(len) == 0
            ahead = max(((d, -n) for d, n in zip(own["_least"][bound], own["_row"][bound], strict=True)), default=(-2.0, 0))
            own = own[~bound].sort_values("_row")
            number, least, x = own["_row"].to_numpy(), own["_least"].to_numpy().copy(), np.frombuffer(b"".join(own["_z"])).reshape(len(own), -1)
            at: list[int] = []
            while count[p] + len(at) < budgets[p]:
                best = int(least.argmax())
                if least[best] < 0 or (least[best], -number[best]) < ahead:
                    break
                at.append(best)
                np.minimum(least, ((x - x[best]) ** 2).sum(1), out=least)
                least[best] = -1
            new[p] = x[at], number[at], count[p] + np.arange(len(at))
            count[p] += len(at)


def neighbour_variance(apart: DataFrame, z: list[str], kinds: dict[int, int]) -> DataFrame:
    """partition_id, z and _score of variance_ordered() over whole partitions, given their different rows and how often each occurs (_times).

    All pairs of parts, then each row's nearest of all.
    """
    parts = apart.sparkSession.createDataFrame([(p, -(-n // GROUP_ROWS)) for p, n in kinds.items()], "partition_id int, _parts int")
    dealt = apart.join(F.broadcast(parts), "partition_id").select("partition_id", "_row", "_times", *z, F.pmod(F.xxhash64("_row"), F.col("_parts")).cast("int").alias("_part"))

    def pack(table: pa.Table) -> pa.Table:
        x = np.stack([np.asarray(table.column(c).to_numpy(), float) for c in z], 1)
        numbers = [pa.array([np.ascontiguousarray(table.column(c).to_numpy()).tobytes()], pa.binary()) for c in ("_row", "_times")]
        return pa.table({"partition_id": table.column("partition_id")[:1], "_part": table.column("_part")[:1], "_rows": numbers[0], "_n": numbers[1], "_x": pa.array([x.tobytes()], pa.binary())})

    blocks = dealt.groupBy("partition_id", "_part").applyInArrow(pack, "partition_id int, _part int, _rows binary, _n binary, _x binary").persist(StorageLevel.DISK_ONLY)
    other = blocks.select("partition_id", F.col("_n").alias("_n2"), F.col("_x").alias("_x2"))

    def near(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            for i in range(frame.num_rows):
                p, a, x, n, y = (frame.column(c)[i].as_py() for c in range(5))
                a, n = np.frombuffer(a, np.int64), np.frombuffer(n, np.int64)
                x, y = np.frombuffer(x).reshape(len(a), -1), np.frombuffer(y).reshape(len(n), -1)
                d = repeated(*nearest_rows(x, y, NEIGHBOURS), n, NEIGHBOURS)
                for k in range(0, len(a), 10_000):
                    some = d[k : k + 10_000]
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1) * some.shape[1], pa.int32()), pa.array(some.ravel()))
                    yield pa.RecordBatch.from_arrays([pa.array([p] * len(some), pa.int32()), pa.array(a[k : k + 10_000]), lists], names=["partition_id", "_row", "_d"])

    pairs = blocks.join(other, "partition_id").select("partition_id", "_rows", "_x", "_n2", "_x2").repartition(max(8, len(kinds)))
    found = pairs.mapInArrow(near, "partition_id int, _row long, _d array<double>")
    every = F.slice(F.array_sort(F.flatten(F.collect_list("_d"))), 1, NEIGHBOURS)
    root = found.groupBy("partition_id", "_row").agg(F.transform(F.filter(every, lambda d: d < float("inf")), F.sqrt).alias("_d"))
    mean = F.aggregate("_d", F.lit(0.0), lambda a, x: a + x) / F.size("_d")
    spread = root.withColumn("_mean", mean).withColumn("_score", F.round(F.aggregate("_d", F.lit(0.0), lambda a, x: a + (x - F.col("_mean")) * (x - F.col("_mean"))) / F.size("_d"), 12))
    return apart.join(spread.select("partition_id", "_row", "_score"), ["partition_id", "_row"]).select("partition_id", *z, "_score")


#: Kernels that distributed() follows.
DISTRIBUTED = (centroid_fps, medoid_fps, variance_ordered, mixed_fps)
KERNELS: dict[str, SelectionStrategy] = {"fps": centroid_fps, "centroid_fps": centroid_fps, "medoid_fps": medoid_fps, "variance_ordered": variance_ordered, "variance": variance_ordered, "mixed_fps": mixed_fps}


def select(df: DataFrame, ids: list[str], z: list[str], budgets: dict[int, int], method: str | SelectionStrategy = "fps", seed: int = 42) -> DataFrame:
    if method == "stratified":
        return stratified(df, ids, z, budgets, seed)
    if method == "sampled_variance":
        return sampled_variance(df, ids, z, budgets, seed)
    if isinstance(method, str):
        if method not in KERNELS:
            raise ValueError(f"unknown selection method {method!r}, expected one of {sorted([*KERNELS, 'sampled_variance', 'stratified'])}")
        method = KERNELS[method]
    if not isinstance(method, Callable):
        raise TypeError("a selection strategy is a callable (z, budget, seed) -> indices")
    return grouped(df, ids, z, budgets, method, seed)


#: Sampled variance order: rows of a partition that it compares, the share from which picks are random, the nearest rows it looks at (itself
#: included), and the squared distance up to which a row counts as the same.
SAMPLE_ROWS, HIGH_SHARE, NEAREST_ROWS, SAME = 400, 0.65, 8, 1e-15


def near_variance(z: np.ndarray, neighbours: int = NEIGHBOURS) -> np.ndarray:
    """Variance of each row's distances to its nearest other rows; equal rows are left out, fewer than two distances give 0."""
    k = min(neighbours, len(z) - 1)
    if k < 1:
        return np.zeros(len(z))
    near = min(k + 1, NEAREST_ROWS, len(z))
    far = sum(((x[:, None] - x[None]) ** 2 for x in z.T), np.zeros((len(z), len(z))))  # differences: equal rows are at 0 exactly
    least = np.sort(np.partition(far, near - 1, axis=1)[:, :near], axis=1)
    other = least > SAME
    use = other & (np.cumsum(other, 1) <= k)
    n, d = use.sum(1), np.sqrt(np.where(use, least, 0.0))
    mean = d.sum(1) / np.maximum(n, 1)
    return np.where(n > 1, (d * d).sum(1) / np.maximum(n, 1) - mean * mean, 0.0)


def sampled_variance(df: DataFrame, ids: list[str], z: list[str], budgets: dict[int, int], seed: int = 42, neighbours: int = NEIGHBOURS) -> DataFrame:
    """Variance order over at most SAMPLE_ROWS seeded rows of each partition, so its work grows with the rows and not with their square.

    A budget of HIGH_SHARE of the partition, or of SAMPLE_ROWS of a larger one, is a seeded sample. Equal scores go by the seeded order.
    """
    rows = ranked(df.select(*ids, *z, "partition_id"), ids, seed)
    sizes = df.groupBy("partition_id").agg(F.count(F.lit(1)).alias("_n"))
    wanted = budget_table(df, budgets).join(sizes, "partition_id")
    table = rows.join(F.broadcast(wanted), "partition_id")  # a row for each leaf
    at_random = (F.col("budget") >= F.lit(HIGH_SHARE) * F.col("_n")) | ((F.col("_n") > SAMPLE_ROWS) & (F.col("budget") >= SAMPLE_ROWS))
    drawn = table.where(at_random & (F.col("rank") < F.col("budget"))).select(*ids, "partition_id", F.col("rank").alias("selection_rank"))

    def pick(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("rank", kind="stable")
        score = np.round(near_variance(frame[z].to_numpy(float), neighbours), 12)
        out = frame.iloc[np.argsort(-score, kind="stable")[: int(frame["budget"].iloc[0])]][[*ids, "partition_id"]].copy()
        out["selection_rank"] = np.arange(len(out))
        return out

    kept = table.where(~at_random & (F.col("rank") < SAMPLE_ROWS)).select(*ids, "partition_id", *[c for c in z if c not in ids], "rank", "budget")
    shape = df.select(*ids, "partition_id", F.lit(0).cast("long").alias("selection_rank")).schema
    return drawn.unionByName(kept.groupBy("partition_id").applyInPandas(pick, shape))


#: Sign patterns whose budgets are shared out at a time.
MOST_ORTHANTS = 1 << 16


def orthants(df: DataFrame, ids: list[str], z: list[str], y: str, n: int) -> DataFrame:
    """Picks over the sign patterns around the column medians: budgets by size times MAD of y, linearly spaced from the farthest row on.

    Output: ids, orthant and selection_rank. A row on a median counts as above it. More than MOST_ORTHANTS patterns raise an error.
    """
    row = df.agg(*[F.median(c) for c in z]).first()
    signs = F.concat(*[F.when(F.col(c) >= F.lit(float(m)), "+").otherwise("-") for c, m in zip(z, row, strict=True)])
    marked = df.select(*ids, *z, F.col(y).alias("_y"), signs.alias("orthant"))
    middle = marked.groupBy("orthant").agg(F.median("_y").alias("_m"), *[F.avg(c).alias(f"_c{i}") for i, c in enumerate(z)], F.count(F.lit(1)).alias("_n"))
    near = marked.join(middle, "orthant")
    groups = near.groupBy("orthant", "_n").agg(F.median(F.abs(F.col("_y") - F.col("_m"))).alias("mad")).orderBy("orthant").limit(MOST_ORTHANTS + 1).collect()
    if len(groups) > MOST_ORTHANTS:
        raise ValueError(f"the rows have more than {MOST_ORTHANTS} sign patterns; use fewer features")
    sizes = np.array([r["_n"] for r in groups], np.int64)
    budget = largest_remainder(sizes * (np.array([r.mad for r in groups], float) + 1e-12), min(n, int(sizes.sum())), sizes)
    table = df.sparkSession.createDataFrame([(r.orthant, int(b)) for r, b in zip(groups, budget, strict=True) if b], "orthant string, budget long")
    far = sum((F.abs(F.col(c) - F.col(f"_c{i}")) for i, c in enumerate(z)), F.lit(0.0))
    order = F.row_number().over(W.partitionBy("orthant").orderBy(F.round(far, 9).desc(), *ids)) - 1
    placed = near.select(*ids, "orthant", "_n", order.cast("long").alias("_at"))
    picks = table.join(middle.select("orthant", "_n"), "orthant").select("orthant", F.posexplode(F.expr("transform(sequence(0L, budget - 1), b -> cast(floor(b * (_n - 1) / greatest(budget - 1, 1L) + 0.5) as bigint))")).alias("selection_rank", "_at"))
    return placed.join(picks, ["orthant", "_at"]).select(*ids, "orthant", F.col("selection_rank").cast("long"))
