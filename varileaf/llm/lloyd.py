"""Delta Lloyd: clustering of integer vectors around k centroids, in rounds that touch only what changed.

Vectors lie in blocks, a row each, in a table that is bucketed by block and written once. Their owners and distances are a second table in
the same buckets, a few bytes a vector, so that a round joins the two without a shuffle. A round compares each vector with the centroids
that changed; only a vector whose owner changed meets the others too. A vector that changes hands leaves its old owner's
sums and enters its new one's: blocks store these signed transfers, Spark adds them up, and the driver adds the totals (k times the
dimension) to the global sums that it keeps from round to round.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varileaf.llm.common import discard, map_arrow, shared_dir
from varileaf.llm.vectors import SCALE, chosen, matrices

_BLOCKS = "block long, vec_ids array<long>, x binary, seeds array<struct<hash: string, x: array<long>>>"
_STATE = "block long, owner binary, distance binary, transfers array<struct<cluster: int, dim: int, amount: long>>, inertia array<decimal(38,0)>"
_SEED = pa.struct([("hash", pa.string()), ("x", pa.list_(pa.int64()))])
_TRANSFER = pa.struct([("cluster", pa.int32()), ("dim", pa.int32()), ("amount", pa.int64())])


def most(dims: int) -> float:
    """Entries of this size or more count as non-finite: 1024 times them, their squared distances don't fit a long."""
    return min(2.0**28, 2.0**30 / dims**0.5) / SCALE


def bucketed(df: DataFrame, name: str, buckets: int) -> DataFrame:
    """Writes a table once into the shared folder in buckets by `block`, and returns a reader that knows them."""
    spark = df.sparkSession
    table = f"{name}_{uuid.uuid4().hex}"
    df.write.bucketBy(buckets, "block").option("path", f"{shared_dir(spark)}/{table}").option("compression", "zstd").saveAsTable(table)
    out = spark.table(table)
    spark.sql(f"drop table {table}")  # the files stay
    return out


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of the rows of x from those of c."""
    top = max(int(np.abs(x).max(initial=0)), int(np.abs(c).max(initial=0)))
    if 4 * top * top * x.shape[1] < 1 << 53:
        a, b = x.astype(np.float64), c.astype(np.float64)
        return (np.square(a).sum(axis=1)[:, None] - 2 * (a @ b.T) + np.square(b).sum(axis=1)).astype(np.int64)
    return np.stack([np.square(x - row).sum(axis=1) for row in c], axis=1)


def _blocks(rows: DataFrame, dims: int, k: int, seed: int, buckets: int) -> DataFrame:
    def cut(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 33
        for i, (ids, x) in enumerate(matrices(frames, dims, most(dims))):
            keys = [hashlib.sha256(f"{seed}:{v}".encode()).hexdigest() if v is not None else "~" for v in ids.to_pylist()]
            least = sorted(((h, x[at].tolist()) for at, h in _least(keys, k)))[:k]
            columns = [pa.array([first + i], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([x.astype("<i4").tobytes()], pa.binary()), pa.array([[{"hash": h, "x": v} for h, v in least]], pa.list_(_SEED))]
            yield pa.RecordBatch.from_arrays(columns, names=["block", "vec_ids", "x", "seeds"])

    return bucketed(map_arrow(rows, cut, _BLOCKS).repartition(buckets, "block"), "lloyd_blocks", buckets)


def _least(keys: list[str], k: int) -> list[tuple[int, str]]:
    """Places and keys up to the k-th least key, its equals included."""
    last = sorted(keys)[min(k, len(keys)) - 1]
    return [(i, h) for i, h in enumerate(keys) if h <= last]


def assign(x: np.ndarray, centroids: np.ndarray, changed: np.ndarray, owner: np.ndarray, distance: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Owners and distances after the centroids of the numbers `changed` moved; -1 is no owner yet. The smaller number wins ties."""
    owner, distance = owner.copy(), distance.copy()
    lost = (owner < 0) | np.isin(owner, changed)
    if lost.any():
        d = squared(x[lost], centroids)
        owner[lost] = d.argmin(axis=1)
        distance[lost] = d.min(axis=1)
    kept = np.flatnonzero(~lost)
    if len(kept) and len(changed):
        d = squared(x[kept], centroids[changed])
        near, least = changed[d.argmin(axis=1)], d.min(axis=1)
        wins = (least < distance[kept]) | (least == distance[kept]) & (near < owner[kept])
        owner[kept[wins]], distance[kept[wins]] = near[wins], least[wins]
    return owner, distance


def transfers(x: np.ndarray, before: np.ndarray, after: np.ndarray) -> list[dict]:
    """What each cluster gains and loses by dimension; at the dimension -1, in vectors."""
    moved = np.flatnonzero(before != after)
    out = []
    for c in np.unique(np.concatenate((before[moved], after[moved]))):
        if c >= 0:
            gained, lost = moved[after[moved] == c], moved[before[moved] == c]
            amounts = [len(gained) - len(lost), *(x[gained].sum(axis=0) - x[lost].sum(axis=0)).tolist()]
            out += [{"cluster": int(c), "dim": j - 1, "amount": a} for j, a in enumerate(amounts) if a]
    return out


def _round(blocks: DataFrame, state: DataFrame | None, centroids: np.ndarray, changed: np.ndarray, buckets: int) -> DataFrame:
    dims, first = centroids.shape[1], state is None

    def step(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            for i in range(frame.num_rows):
                x = np.frombuffer(frame.column(1)[i].as_buffer(), "<i4").reshape(-1, dims).astype(np.int64)
                before = np.frombuffer(frame.column(2)[i].as_buffer(), "<i4").astype(np.int64) if not first else np.full(len(x), -1)
                distance = np.frombuffer(frame.column(3)[i].as_buffer(), "<i8") if not first else np.zeros(len(x), np.int64)
                after, distance = assign(x, centroids, changed, before, distance)
                inertia = [Decimal(sum(distance[after == c].tolist())) for c in range(len(centroids))]
                columns = [frame.column(0).slice(i, 1), pa.array([after.astype("<i4").tobytes()]), pa.array([distance.astype("<i8").tobytes()]), pa.array([transfers(x, before, after)], pa.list_(_TRANSFER)), pa.array([inertia], pa.list_(pa.decimal128(38, 0)))]
                yield pa.RecordBatch.from_arrays(columns, names=["block", "owner", "distance", "transfers", "inertia"])

    given = blocks.select("block", "x")
    if not first:
        given = given.join(state.select("block", "owner", "distance").hint("shuffle_hash"), "block")
    return bucketed(map_arrow(given, step, _STATE), "lloyd_state", buckets)


def _added(state: DataFrame, sums: np.ndarray) -> None:
    """Adds a round's transfers to the global sums (objects, by cluster; first the number of vectors)."""
    each = state.select(F.explode("transfers").alias("t")).groupBy("t.cluster", "t.dim").agg(F.sum(F.col("t.amount").cast("decimal(38,0)")).alias("amount"))
    for row in each.collect():
        sums[row.cluster, row.dim + 1] += int(row.amount)


def cluster(df: DataFrame, k: int = 8, rounds: int = 10, seed: int = 3, dims: int = 64, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """vec_id, cluster, distance (squared), cluster_inertia, inertia and centroid_sha256 of every vector of `dims` entries.

    Entries are floor(1024 * entry). Left out are vectors that are null, have another length, or hold a null, a non-finite entry or one of
    most(dims) or more. Centroids start as the k vectors with the least sha256 of "seed:vec_id"; vectors that share an id are in the order of
    their entries, those without an id come last; with fewer than k vectors there are fewer centroids. Repeated rows count as often as they
    occur. An empty table gives none; other columns are left out. Rounds end early when no centroid changes, as the rest would change
    nothing. The blocks and the last round's owners stay in the shared folder; those of other rounds are deleted.
    """
    spark = df.sparkSession
    rows = chosen(df, key, vector)
    buckets = max(1, rows.rdd.getNumPartitions())
    blocks = _blocks(rows, dims, k, seed, buckets)
    seeds = blocks.select(F.explode("seeds").alias("s")).select("s.*").orderBy("hash", "x").limit(k).collect()
    if not seeds:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    centroids = np.array([s.x for s in seeds], np.int64)
    sums = np.zeros((len(seeds), dims + 1), object)
    changed = np.arange(len(seeds))
    state = _round(blocks, None, centroids, changed, buckets)
    for _ in range(rounds):
        _added(state, sums)
        moved = centroids.copy()
        for c, (count, *total) in enumerate(sums):
            if count:
                moved[c] = [t // count for t in total]
        changed = np.flatnonzero((moved != centroids).any(axis=1))
        if not len(changed):
            break
        centroids = moved
        old, state = state, _round(blocks, state, centroids, changed, buckets)
        discard(old)
    inertia = [int(x or 0) for x in state.agg(*[F.sum(F.element_at("inertia", c + 1)) for c in range(len(centroids))]).first()]
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    return _members(blocks, state, inertia, digests)


def _members(blocks: DataFrame, state: DataFrame, inertia: list[int], digests: list[str]) -> DataFrame:
    def rows(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            for i in range(frame.num_rows):
                owner = np.frombuffer(frame.column(1)[i].as_buffer(), "<i4")
                distance = np.frombuffer(frame.column(2)[i].as_buffer(), "<i8")
                yield pa.RecordBatch.from_arrays([frame.column(0)[i].values, pa.array(owner), pa.array(distance)], names=["vec_id", "cluster", "distance"])

    given = blocks.select("block", "vec_ids").join(state.select("block", "owner", "distance").hint("shuffle_hash"), "block").select("vec_ids", "owner", "distance")
    pick = lambda values: F.get(F.array(*map(F.lit, values)), F.col("cluster"))
    return map_arrow(given, rows, "vec_id long, cluster int, distance long").select("*", pick([F.lit(Decimal(v)) for v in inertia]).cast("long").alias("cluster_inertia"), F.lit(Decimal(sum(inertia))).cast("long").alias("inertia"), pick(digests).alias("centroid_sha256"))
