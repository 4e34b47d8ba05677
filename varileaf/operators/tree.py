"""Regression tree over standardised features, best-first or breadth-first. Spark adds histograms, one job a level; splits are chosen on the driver.

Rows are binned once, into a byte a feature, and written. A level adds the histograms of each split's smaller child; the larger one's is its
parent's less that. A node's best split doesn't depend on the order of growth, so levels are grown whole and best-first order decides
afterwards which splits stay; breadth-first order takes the first ones of a level that the number of leaves leaves room for. Up to LOCAL_CELLS cells the same histograms are added on the driver instead, with the same result.
"""

from __future__ import annotations

import heapq
import json
import math
from dataclasses import asdict, dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from varileaf.sources.store import removed, stored

MAX_BINS, TARGET_BINS = 128, 32
LOCAL_CELLS = 4_000_000
#: Cells of one feature's histograms up to which a batch adds them in an array of all of them.
DENSE = 1 << 22
#: Cells that a task sends at a time.
SENT = 1 << 16
_CELLS = (pa.int64(), pa.int64(), pa.float64(), pa.float64())
#: A tree with more leaves is routed by numpy in Arrow batches: an expression of that size would leave code generation.
EXPRESSION_LEAVES = 256


@dataclass
class Node:
    id: int
    depth: int
    n: int
    value: float
    feature: int = -1
    threshold: float = 0.0
    gain: float = 0.0
    left: int = -1
    right: int = -1
    leaf: int = -1


@dataclass
class Tree:
    columns: list[str]
    nodes: list[Node] = field(default_factory=list)

    @property
    def leaves(self) -> list[Node]:
        return sorted((x for x in self.nodes if x.left < 0), key=lambda x: x.leaf)

    @property
    def importances(self) -> dict[str, float]:
        """Share of the gain that each feature's splits bring."""
        out = dict.fromkeys(self.columns, 0.0)
        for x in self.nodes:
            if x.left >= 0:
                out[self.columns[x.feature]] += x.gain
        whole = sum(out.values())
        return {c: v / whole if whole else 0.0 for c, v in out.items()}

    def _case(self, at: int, what: str) -> Column:
        x = self.nodes[at]
        if x.left < 0:
            return F.lit(getattr(x, what))
        return F.when(F.col(f"`{self.columns[x.feature]}`") <= F.lit(x.threshold), self._case(x.left, what)).otherwise(self._case(x.right, what))

    def leaf(self) -> Column:
        """Id of a row's leaf, from 0."""
        return self._routed("leaf", "int")

    def predict(self) -> Column:
        """Mean target of a row's leaf."""
        return self._routed("value", "double")

    def _routed(self, what: str, kind: str) -> Column:
        if len(self.nodes) <= 2 * EXPRESSION_LEAVES:
            return self._case(0, what).cast(kind)
        arrays, values = self.arrays(), np.array([getattr(x, what) for x in self.nodes])

        @F.pandas_udf(kind)
        def route(*z: pd.Series) -> pd.Series:
            return pd.Series(values[walk(np.column_stack([c.to_numpy(float) for c in z]), *arrays)])

        return route(*[F.col(f"`{c}`") for c in self.columns])

    def arrays(self) -> tuple[np.ndarray, ...]:
        return tuple(np.array([getattr(x, k) for x in self.nodes]) for k in ("feature", "threshold", "left", "right"))

    def to_json(self) -> str:
        return json.dumps({"columns": self.columns, "nodes": [asdict(x) for x in self.nodes]})

    @classmethod
    def from_json(cls, text: str) -> Tree:
        raw = json.loads(text)
        return cls(raw["columns"], [Node(**x) for x in raw["nodes"]])

    def save(self, spark: SparkSession, path: str) -> None:
        """One row for each node, as Parquet."""
        rows = [(*asdict(x).values(), self.columns[x.feature] if x.feature >= 0 else None, i) for i, x in enumerate(self.nodes)]
        shape = "id long, depth long, n long, value double, feature long, threshold double, gain double, left long, right long, leaf long, column string, at long"
        head = [(-1, 0, 0, 0.0, -1, 0.0, 0.0, -1, -1, -1, c, -1 - i) for i, c in enumerate(self.columns)]
        spark.createDataFrame(head + rows, shape).coalesce(1).write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Tree:
        rows = sorted(spark.read.parquet(path).collect(), key=lambda r: r["at"])
        columns = [r["column"] for r in reversed(rows) if r["at"] < 0]
        return cls(columns, [Node(*(r[k] for k in Node.__dataclass_fields__)) for r in rows if r["at"] >= 0])


def walk(z: np.ndarray, feature: np.ndarray, threshold: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Index of the node where each row ends."""
    at = np.zeros(len(z), np.int64)
    moving = np.arange(len(z)) if left[0] >= 0 else np.zeros(0, np.int64)
    while len(moving):
        here = at[moving]
        at[moving] = np.where(z[moving, feature[here]] <= threshold[here], left[here], right[here])
        moving = moving[left[at[moving]] >= 0]
    return at


def edges(df: DataFrame, columns: list[str], bins: int = MAX_BINS) -> list[np.ndarray]:
    """Candidate thresholds of each column: midpoints between all its values if they are few, else between quantiles."""
    return _middles(df.agg(*_quantiles(columns, bins)).first())


def _quantiles(columns: list[str], bins: int) -> list[Column]:
    return [F.percentile_approx(F.col(f"`{c}`"), [i / bins for i in range(bins + 1)], 10000).alias(f"q{i}") for i, c in enumerate(columns)]


def _middles(quantiles) -> list[np.ndarray]:
    found = [np.unique(np.array(values or [], float)) for values in quantiles]
    return [(v[1:] + v[:-1]) / 2 for v in found]


def binned(z: np.ndarray, cuts: list[list[np.ndarray]], root: np.ndarray | int = 0) -> np.ndarray:
    """Bin of each cell: how many thresholds of its column, in its row's tree, are less. A row with z <= cuts[b] has a bin of b at most."""
    out = np.empty(z.shape, np.uint8 if max(len(c) for own in cuts for c in own) < 256 else np.uint16)
    for k in [0] if len(cuts) == 1 else np.unique(root).tolist():
        rows = slice(None) if len(cuts) == 1 else np.flatnonzero(root == k)
        for f, c in enumerate(cuts[k]):
            out[rows, f] = np.searchsorted(c, z[rows, f])
    return out


def settle(bins: np.ndarray, at: np.ndarray, feature: np.ndarray, cut: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Nodes where rows end that stand at `at`."""
    at = at.copy()
    moving = np.flatnonzero(left[at] >= 0)
    while len(moving):
        here = at[moving]
        at[moving] = np.where(bins[moving, feature[here]] <= cut[here], left[here], right[here])
        moving = moving[left[at[moving]] >= 0]
    return at


def partial(bins: np.ndarray, t: np.ndarray, slot: np.ndarray, fine: np.ndarray | int, width: int, kinds: int, slots: int) -> tuple[np.ndarray, ...]:
    """Nonzero cells of the histograms: key, count, sum and sum of squares. slot: a row's place among the wanted nodes, -1 if it isn't in one."""
    use = np.flatnonzero(slot >= 0)
    bins, t, slot = bins[use], t[use], slot[use].astype(np.int64)
    fine = fine if isinstance(fine, int) else fine[use]
    squares, d = t * t, bins.shape[1]
    out = []
    for f in range(d):
        key = (slot * width + bins[:, f]) * kinds + fine
        if slots * width * kinds <= DENSE:
            n = np.bincount(key, minlength=1)
            u = np.flatnonzero(n)
            found = (n[u], np.bincount(key, t)[u], np.bincount(key, squares)[u]) if len(u) else (n[:0], t[:0], t[:0])
        else:
            u, place = np.unique(key, return_inverse=True)
            found = (np.bincount(place, minlength=len(u)), np.bincount(place, t, len(u)), np.bincount(place, squares, len(u)))
        node, rest = np.divmod(u, width * kinds)
        out.append(((node * d + f) * (width * kinds) + rest, *found))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _sent(found: tuple[np.ndarray, ...]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, c) for x, c in zip(found, _CELLS, strict=True)], names=["k", "n", "s", "q"])


class _Source:
    """Adds up histograms of nodes, on the driver or over the cluster. Of several trees each has its own thresholds; the column `group` is a row's tree, whose
    root is the node of that number."""

    def __init__(self, df: DataFrame, columns: list[str], target: str, cuts: list[list[np.ndarray]], grid: np.ndarray | None, rows: int, group: str | None = None):
        self.cuts, self.width, self.kinds = cuts, max(len(c) for own in cuts for c in own) + 1, 1 if grid is None else len(grid) + 1
        self.added = 0  # rows that histograms were made of
        root = F.col(f"`{group}`") if group else F.lit(0)
        given = df.select(*[F.col(f"`{c}`").cast("double").alias(c) for c in columns], F.col(f"`{target}`").cast("double").alias("_t"), root.cast("int").alias("_root"))
        self.local = self.table = None
        if rows * (len(columns) + 1) <= LOCAL_CELLS:
            table = given.toArrow()
            t, self.at = table.column(len(columns)).to_numpy(), table.column(len(columns) + 1).to_numpy().astype(np.int64)
            self.local = (binned(np.column_stack([c.to_numpy() for c in table.columns[:-2]]), cuts, self.at), t, 0 if grid is None else np.searchsorted(grid, t))
            return

        def cut(frames):
            for frame in frames:
                x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in frame.columns[:-1]])
                t, root = np.ascontiguousarray(x[:, -1]), frame.column(frame.num_columns - 1).to_numpy()
                fine = np.zeros(0, np.uint8) if grid is None else np.searchsorted(grid, t).astype(np.uint8)
                yield pa.RecordBatch.from_arrays([pa.array([p.tobytes()], pa.binary()) for p in (binned(x[:, :-1], cuts, root), t, fine, root)], names=["bins", "t", "fine", "root"])

        self.table = stored(given.mapInArrow(cut, "bins binary, t binary, fine binary, root binary"), "binned")

    def close(self) -> None:
        if self.table is not None:
            removed(self.table)

    def levels(self, tree: tuple[np.ndarray, ...], wanted: list[int], size: int) -> np.ndarray:
        """(node, feature, bin, target bin, [count, sum, squares]) for the wanted nodes of a tree of `size` nodes."""
        slots = np.full(size, -1)
        slots[wanted] = np.arange(len(wanted))
        d, width, kinds, n = len(self.cuts[0]), self.width, self.kinds, len(wanted)
        if self.local is not None:
            bins, t, fine = self.local
            self.at = settle(bins, self.at, *tree)
            keys, *values = partial(bins, t, slots[self.at], fine, width, kinds, n)
        else:
            kind = np.uint8 if width <= 256 else np.uint16

            cells = n * d * width * kinds

            def rows(frames):
                # a task adds its rows up where the cells are few enough, so that it sends each of them once
                total = np.zeros((3, cells)) if cells <= DENSE else None
                for frame in frames:
                    for i in range(frame.num_rows):
                        one, other, third, root = (c[i].as_buffer() for c in frame.columns)
                        bins, t = np.frombuffer(one, kind).reshape(-1, d), np.frombuffer(other)
                        fine = 0 if kinds == 1 else np.frombuffer(third, np.uint8)
                        at = settle(bins, np.frombuffer(root, np.int32).astype(np.int64), *tree)
                        found = partial(bins, t, slots[at], fine, width, kinds, n)
                        if total is None:
                            yield _sent(found)
                        else:
                            total[:, found[0]] += found[1:]
                if total is not None:
                    keys = np.flatnonzero(total[0])
                    for i in range(0, len(keys), SENT):
                        some = keys[i : i + SENT]
                        yield _sent((some, total[0, some].astype(np.int64), total[1, some], total[2, some]))

            found = self.table.mapInArrow(rows, "k long, n long, s double, q double").groupBy("k").agg(F.sum("n"), F.sum("s"), F.sum("q")).toArrow()
            keys, *values = (c.to_numpy() for c in found.columns)
        out = np.zeros((n * d * width * kinds, 3))
        out[keys] = np.column_stack(values)
        out = out.reshape(n, d, width, kinds, 3)
        self.added += int(out[:, 0, ..., 0].sum())
        return out


def spread(h: np.ndarray, absolute: bool) -> np.ndarray:
    """Impurity times rows of cells (..., target bin, 3): squared error, or absolute error around the median on the target grid."""
    if not absolute:
        n, s, q = (h[..., 0, k] for k in range(3))
        return np.maximum(q - np.divide(s * s, n, out=np.zeros_like(s), where=n > 0), 0)
    n, s = h[..., 0], h[..., 1]
    below, sums = np.cumsum(n, -1), np.cumsum(s, -1)
    whole, total = below[..., -1:], sums[..., -1:]
    at = np.argmax(below >= whole / 2, -1)[..., None]
    pick = lambda x: np.take_along_axis(x, at, -1)
    middle = np.divide(pick(s), pick(n), out=np.zeros_like(pick(s)), where=pick(n) > 0)
    low_n, low_s = pick(below) - pick(n), pick(sums) - pick(s)
    high_n, high_s = whole - pick(below), total - pick(sums)
    return np.maximum(middle * low_n - low_s + high_s - middle * high_n, 0)[..., 0]


def best_split(h: np.ndarray, cuts: list[np.ndarray], rows: int, least: int, absolute: bool, rng: np.random.Generator | None, two: list[int] | None = None) -> tuple[float, int, int] | None:
    """Gain (impurity decrease weighted by the node's share of rows), feature and bin; the first of equals. rng: one random valid bin a feature.

    two: features of two values. They come after all others, and one that wins with a side of fewer than `least` rows leaves the node whole.
    """
    left = np.cumsum(h, axis=1)[:, :-1]
    right = left[:, -1:] + h[:, -1:] - left if left.shape[1] else left
    n_left, n_right = left[..., 0].sum(-1), right[..., 0].sum(-1)
    enough = (n_left >= least) & (n_right >= least)
    ok = enough.copy()
    if two:
        ok[two] = (n_left[two] > 0) & (n_right[two] > 0)
    for f, c in enumerate(cuts):
        ok[f, len(c) :] = False
    if not ok.any():
        return None
    parent = spread(h[0].sum(0)[None], absolute)[0]
    gain = np.where(ok, parent - spread(left, absolute) - spread(right, absolute), -np.inf) / rows
    if rng is not None:
        chosen = np.full_like(gain, -np.inf)
        for f in range(len(cuts)):
            valid = np.flatnonzero(ok[f])
            if len(valid):
                b = int(rng.choice(valid))
                chosen[f, b] = gain[f, b]
        gain = chosen
    turn = [*(f for f in range(len(cuts)) if f not in (two or [])), *(two or [])]
    f, b = np.unravel_index(int(gain[turn].argmax()), gain.shape)
    f = turn[f]
    return (float(gain[f, b]), int(f), int(b)) if enough[f, b] else None


def min_gain_floor(d: int, leaves: int | None) -> float:
    """The 'auto' floor: half of an information criterion over all candidate features and leaves, ln(d * B)."""
    return math.log(max(1, d * (leaves or 32)))


def grow(df: DataFrame, columns: list[str], target: str, max_leaves: int = 31, min_leaf: int = 5, max_depth: int | None = None, min_gain: float = 0.0, criterion: str = "squared_error", splitter: str = "best", seed: int = 42, bins: int = MAX_BINS, order: str = "best", colsample: float = 1.0) -> Tree:
    """The tree over columns of df for a target column. A table that is used often should be cached by the caller.

    order: "best" splits the node of the greatest gain next; "breadth" goes level by level, from left to right, until there are max_leaves,
    numbers the leaves in that order, and cuts columns of at most two values at 0 (see best_split). colsample: the share of the columns
    of more than two values whose histograms are made; which ones are left out moves round with the seed.
    """
    if criterion not in ("squared_error", "absolute_error"):
        raise ValueError(f"unknown criterion {criterion!r}")
    if order not in ("best", "breadth"):
        raise ValueError(f"unknown order {order!r}")
    if not 0 < colsample <= 1:
        raise ValueError("colsample is a share above 0")
    whole, flat = columns, two_valued(df, columns) if order == "breadth" or colsample < 1 else set()
    columns = [c for c in columns if c in flat or c in rotation([c for c in columns if c not in flat], colsample, seed)]
    absolute, max_leaves = criterion == "absolute_error", max(2, max_leaves)
    rows, mean = df.agg(F.count(F.lit(1)), F.avg(f"`{target}`")).first()
    if not rows:
        raise ValueError("no rows to fit on")
    cuts = edges(df, columns, 64 if absolute else bins)
    two = [f for f, c in enumerate(columns) if c in flat] if order == "breadth" else []
    cuts = [np.zeros(1) if f in two else c for f, c in enumerate(cuts)]
    grid = edges(df, [target], TARGET_BINS)[0] if absolute else None
    source = _Source(df, columns, target, [cuts], grid, rows)
    try:
        nodes = _grown(source, [Root(rows, float(mean), max_leaves)], min_leaf, max_depth, min_gain, absolute, splitter == "random", seed, order == "breadth", two)
    finally:
        source.close()
    made = _breadth_first(columns, nodes) if order == "breadth" else _best_first(columns, nodes, max_leaves)
    for x in made.nodes:
        x.feature = whole.index(columns[x.feature]) if x.feature >= 0 else -1
    made.columns = whole
    return made


def two_valued(df: DataFrame, columns: list[str]) -> set[str]:
    """Columns of at most two values: no row lies between the least and the greatest."""
    if not columns:
        return set()
    cells = [F.col(f"`{c}`").cast("double") for c in columns]
    ends = df.agg(*[f(x).alias(f"{f.__name__}{i}") for i, x in enumerate(cells) for f in (F.min, F.max)]).first()
    if ends["min0"] is None:
        return set()
    inside = df.agg(*[F.max(((x > F.lit(ends[f"min{i}"])) & (x < F.lit(ends[f"max{i}"]))).cast("int")).alias(f"i{i}") for i, x in enumerate(cells)]).first()
    return {c for c, found in zip(columns, inside, strict=True) if not found}


def rotation(columns: list[str], share: float, turn: int) -> list[str]:
    """All columns but a run of neighbours around the circle; each turn the run begins where the last one ended, so every column takes its part alike."""
    d = len(columns)
    out = d - max(1, int(d * share)) if share < 1 else 0
    return [c for i, c in enumerate(columns) if (i - turn * out) % d >= out]


@dataclass(frozen=True)
class Root:
    """Rows and mean target of a tree, and the leaves that it may have."""

    rows: int
    mean: float
    max_leaves: int


def _grown(source: _Source, roots: list[Root], min_leaf: int, max_depth: int | None, min_gain: float, absolute: bool, random: bool, seed: int, breadth: bool = False, two: list[int] | None = None) -> list[Node]:
    """All nodes that best-first growth of each tree can reach, or those of breadth-first growth, the roots first; a level of all trees is one job."""
    nodes = [Node(0, 0, r.rows, r.mean) for r in roots]
    at_bin = [0] * len(roots)  # of each split node the bin of its threshold
    own_root = list(range(len(roots)))
    reach = dict.fromkeys(range(len(roots)), math.inf)  # least gain on the way to a node: best-first order takes the greatest
    open_ = [k for k, r in enumerate(roots) if r.max_leaves > 1 and max(map(len, source.cuts[k]))]
    known = dict(zip(open_, source.levels(_arrays(nodes, at_bin), open_, len(nodes)), strict=True)) if open_ else {}  # histograms of the open nodes
    while open_ and known:
        later = []
        for at in open_:
            node, root = nodes[at], own_root[at]
            if max_depth is not None and node.depth >= max_depth:
                continue
            rng = np.random.default_rng((seed, *([root] if root else []), node.id & (1 << 62) - 1)) if random else None
            h, cuts = known[at], source.cuts[root]
            found = best_split(h, cuts, roots[root].rows, min_leaf, absolute, rng, two)
            if found is None or found[0] < min_gain or found[0] <= 1e-12:
                continue
            node.gain, node.feature, b = found
            node.threshold, at_bin[at] = float(cuts[node.feature][b]), b
            later.append((at, h[node.feature, : b + 1].sum((0, 1)), h[node.feature, b + 1 :].sum((0, 1))))
        if breadth:
            later = _in_turn(later, own_root, nodes, roots)
        gains: dict[int, list[float]] = {}
        for k in [*(x[0] for x in later), *(k for k in reach if nodes[k].left >= 0)]:
            gains.setdefault(own_root[k], []).append(min(reach[k], nodes[k].gain))
        floors = {r: sorted(g, reverse=True)[roots[r].max_leaves - 2] if len(g) >= roots[r].max_leaves else -math.inf for r, g in gains.items()}
        open_, pairs = [], []
        for at, a, b in later:
            node, own = nodes[at], min(reach[at], nodes[at].gain)
            if not breadth and own < floors[own_root[at]]:
                node.feature, node.gain = -1, 0.0
                continue
            node.left, node.right = len(nodes), len(nodes) + 1
            for k, cell in ((0, a), (1, b)):
                reach[len(nodes)] = own
                open_.append(len(nodes))
                nodes.append(Node(2 * node.id + 1 + k, node.depth + 1, int(cell[0]), float(cell[1] / cell[0])))
                at_bin.append(0)
                own_root.append(own_root[at])
            small, large = sorted((node.left, node.right), key=lambda k: nodes[k].n)
            if max_depth is None or node.depth + 1 < max_depth:
                pairs.append((at, small, large))
        if not pairs:
            break
        added = source.levels(_arrays(nodes, at_bin), [small for _, small, _ in pairs], len(nodes))
        above, known = known, {}
        for (at, small, large), h in zip(pairs, added, strict=True):
            known[small], known[large] = h, above[at] - h
            known[large][..., 1:][known[large][..., 0] == 0] = 0.0  # what rounding leaves in empty bins
    return nodes


@dataclass
class Forest:
    """Trees over the same columns, by number."""

    columns: list[str]
    trees: list[Tree]

    @property
    def leaves(self) -> int:
        return sum(len(t.leaves) for t in self.trees)

    def leaf(self, group: Column) -> Column:
        """Number of a row's leaf among all trees' leaves, tree after tree, given its tree's number."""
        feature, threshold, left, right = (np.concatenate(x) for x in zip(*(t.arrays() for t in self.trees), strict=True))
        sizes = [len(t.nodes) for t in self.trees]
        roots = np.cumsum([0, *sizes[:-1]])
        shift = np.repeat(roots, sizes)
        left, right = (np.where(x >= 0, x + shift, -1) for x in (left, right))
        before = np.repeat(np.cumsum([0, *[len(t.leaves) for t in self.trees[:-1]]]), sizes)
        number = np.array([x.leaf for t in self.trees for x in t.nodes]) + before

        @F.pandas_udf("int")
        def route(*given: pd.Series) -> pd.Series:
            cells = np.column_stack([c.to_numpy(float) for c in given[1:]])
            at = roots[given[0].to_numpy(np.int64)]
            moving = np.flatnonzero(left[at] >= 0)
            while len(moving):
                here = at[moving]
                at[moving] = np.where(cells[moving, feature[here]] <= threshold[here], left[here], right[here])
                moving = moving[left[at[moving]] >= 0]
            return pd.Series(number[at])

        return route(group, *[F.col(f"`{c}`") for c in self.columns])


def grow_forest(df: DataFrame, group: str, columns: list[str], target: str, max_leaves: list[int], min_leaf: int = 5, max_depth: int | None = None, min_gain: float = 0.0, bins: int = MAX_BINS) -> Forest:
    """A tree for each value of `group` (0, 1, ...) with max_leaves of that place; one aggregation for all thresholds and one for each level of all trees."""
    mean, count = F.avg(f"`{target}`").alias("_m"), F.count(F.lit(1)).alias("_n")
    found = {r["_g"]: r for r in df.groupBy(F.col(f"`{group}`").alias("_g")).agg(count, mean, *_quantiles(columns, bins)).collect()}
    if set(found) - set(range(len(max_leaves))):
        raise ValueError("a row's tree has no number of leaves")
    none = [np.zeros(0)] * len(columns)
    cuts = [_middles(found[k][3:]) if k in found else none for k in range(len(max_leaves))]
    roots = [Root(found[k]["_n"], float(found[k]["_m"]), m) if k in found else Root(0, 0.0, 1) for k, m in enumerate(max_leaves)]
    source = _Source(df, columns, target, cuts, None, sum(r.rows for r in roots), group)
    try:
        nodes = _grown(source, roots, min_leaf, max_depth, min_gain, False, False, 0)
    finally:
        source.close()
    return Forest(columns, [_best_first(columns, nodes, r.max_leaves, k) for k, r in enumerate(roots)])


def _arrays(nodes: list[Node], at_bin: list[int]) -> tuple[np.ndarray, ...]:
    """Feature, bin of the threshold, left and right child, by node."""
    feature, left, right = (np.array([getattr(x, k) for x in nodes]) for k in ("feature", "left", "right"))
    return feature, np.array(at_bin), left, right


def _in_turn(later: list[tuple], own_root: list[int], nodes: list[Node], roots: list[Root]) -> list[tuple]:
    """Splits of a level, in order, as far as each tree may have more leaves; the nodes of the others stay leaves."""
    left = [r.max_leaves - 1 for r in roots]
    for k, x in enumerate(nodes):
        left[own_root[k]] -= x.left >= 0
    kept = []
    for split in later:
        at = split[0]
        if left[own_root[at]] > 0:
            left[own_root[at]] -= 1
            kept.append(split)
        else:
            nodes[at].feature, nodes[at].gain = -1, 0.0
    return kept


def _breadth_first(columns: list[str], grown: list[Node]) -> Tree:
    """A single tree's nodes, which were made level by level, with the leaves numbered in that order."""
    leaves = 0
    for k, x in enumerate(grown):
        x.id = k
        if x.left < 0:
            x.leaf, leaves = leaves, leaves + 1
    return Tree(columns, grown)


def _best_first(columns: list[str], grown: list[Node], max_leaves: int, root: int = 0) -> Tree:
    """Keeps the splits that best-first growth would make, and numbers the leaves from left to right."""
    kept: set[int] = set()
    heap = [(-grown[root].gain, root)] if grown[root].left >= 0 else []
    while heap and len(kept) < max_leaves - 1:
        _, at = heapq.heappop(heap)
        kept.add(at)
        for child in (grown[at].left, grown[at].right):
            if grown[child].left >= 0:
                heapq.heappush(heap, (-grown[child].gain, child))
    out: list[Node] = []
    leaves = 0
    stack = [(root, -1, "")]
    while stack:
        at, parent, side = stack.pop()
        x = grown[at]
        here = len(out)
        if parent >= 0:
            setattr(out[parent], side, here)
        if at in kept:
            out.append(Node(here, x.depth, x.n, x.value, x.feature, x.threshold, x.gain))
            stack += [(x.right, here, "right"), (x.left, here, "left")]
        else:
            out.append(Node(here, x.depth, x.n, x.value, leaf=leaves))
            leaves += 1
    return Tree(columns, out)


def leaf_values(df: DataFrame, tree: Tree, gradient: str, hessian: str | None = None, l2: float = 0.0, l1: float = 0.0) -> Tree:
    """The tree with values from gradients: their shrunken sum over the hessians' sum (or the count) plus l2."""
    g = F.sum(f"`{gradient}`")
    weight = F.sum(f"`{hessian}`") if hessian else F.count(F.lit(1)).cast("double")
    shrunk = F.signum(g) * F.greatest(F.abs(g) - l1, F.lit(0.0))
    found = {r.leaf: r.v for r in df.select(tree.leaf().alias("leaf"), "*").groupBy("leaf").agg((shrunk / (weight + l2)).alias("v")).collect()}
    out = Tree.from_json(tree.to_json())
    for x in out.leaves:
        x.value = float(found.get(x.leaf, 0.0))
    return out


def tuned(n: int, d: int, reduction: bool = False) -> tuple[int, int]:
    """Leaves and rows of a leaf by the size of the table."""
    least = max(5, 80 * d // 3) if reduction else max(d + 2, math.isqrt(n))
    return max(30, min(1500, 3 * n // (2 * least))), least


def resolved(n: int, d: int, n_partitions: int | None = None, min_samples_leaf: int | None = None, auto_tune: bool = True, reduction: bool = False) -> tuple[int, int]:
    """What the caller sets, and for the rest what the size gives."""
    leaves, least = tuned(n, d, reduction) if auto_tune else (max(2, n // 100), max(5, n // 1000))
    if n_partitions is not None:
        leaves, least = n_partitions, max(2, n // (3 * n_partitions))
    return leaves, least if min_samples_leaf is None else min_samples_leaf
