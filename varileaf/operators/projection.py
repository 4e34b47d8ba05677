"""A numeric column for categories: what a shallow tree over their codes predicts of a label, standardised.

Codes have an order that means nothing; the label's means by groups of codes have one that does. Spark adds up the label once for each
combination of codes that occurs; the levels of the tree (four at most) are aggregations of that small table, by node, column and code.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varileaf.operators.tree import Node, Tree
from varileaf.sources.store import removed, stored

#: Name of the column.
PROJECTION = "z_projection"
#: Keeps a constant prediction from dividing by zero.
LEAST = 1e-10


@dataclass(frozen=True)
class Projection:
    """The tree over z columns of categories, and the mean and deviation of its predictions over the fitted rows."""

    tree: Tree
    mean: float
    deviation: float

    def column(self) -> Column:
        return (self.tree.predict() - F.lit(self.mean)) / F.lit(self.deviation)

    def to_dict(self) -> dict:
        return {"tree": self.tree.to_json(), "mean": self.mean, "deviation": self.deviation}

    @classmethod
    def from_dict(cls, state: dict) -> Projection:
        return cls(Tree.from_json(state["tree"]), state["mean"], state["deviation"])


def depth_for(combinations: int) -> int:
    """Levels by how many combinations of codes there are: the whole part of the binary logarithm, from 2 to 4."""
    return min(4, max(2, int(math.log2(max(combinations, 4)))))


def best_cut(cells: np.ndarray, least: int) -> tuple[float, float] | None:
    """Of one column's cells (value, n, sum; by value): what a cut adds to the sum of squared sums over sizes, and the cut in the middle of
    two values that occur; the first of equals."""
    n, s = np.cumsum(cells[:, 1])[:-1], np.cumsum(cells[:, 2])[:-1]
    whole, total = cells[:, 1].sum(), cells[:, 2].sum()
    ok = (n >= least) & (whole - n >= least)
    if not ok.any():
        return None
    gain = np.where(ok, s * s / n + (total - s) ** 2 / (whole - n), -np.inf)
    at = int(gain.argmax())
    return float(gain[at] - total * total / whole), float((cells[at, 0] + cells[at + 1, 0]) / 2)


def grow_over_codes(cells: DataFrame, columns: list[str], depth: int, least: int) -> Tree:
    """The tree over cells (columns, n, sum, squares), grown level by level; leaves are numbered from left to right.

    A node of less than 2 * least rows, or whose labels are all equal, is a leaf. A cut that gains nothing is taken too: the next may.
    """
    n, s, q = cells.agg(F.sum("n"), F.sum("sum"), F.sum("squares")).first()
    nodes = [Node(0, 0, int(n), s / n)]
    squares = {0: q}
    open_ = [0]
    for level in range(depth):
        open_ = [k for k in open_ if nodes[k].n >= 2 * least and squares[k] - nodes[k].n * nodes[k].value ** 2 > 1e-12 * max(squares[k], 1e-300)]
        if not open_:
            break
        at = Tree(columns, nodes)._case(0, "id").cast("int")  # a grown node's id is its place
        each = F.explode(F.array(*[F.struct(F.lit(j).alias("column"), F.col(f"`{c}`").alias("value")) for j, c in enumerate(columns)]))
        found = cells.select(at.alias("node"), each.alias("c"), "n", "sum", "squares").where(F.col("node").isin(open_))
        rows = found.groupBy("node", "c.column", "c.value").agg(F.sum("n").alias("n"), F.sum("sum").alias("sum"), F.sum("squares").alias("squares")).orderBy("node", "column", "value").collect()
        by: dict[tuple[int, int], list] = {}
        for r in rows:
            by.setdefault((r.node, r.column), []).append((r.value, r.n, r.sum, r.squares))
        grown = []
        for k in open_:
            cuts = {j: cut for j in range(len(columns)) if (cut := best_cut(np.array(by[k, j], float), least))}
            if not cuts:
                continue
            j = max(cuts, key=lambda j: (cuts[j][0], -j))
            nodes[k].feature, nodes[k].threshold, nodes[k].gain = j, cuts[j][1], cuts[j][0] / n
            for side in ("left", "right"):
                own = [x for x in by[k, j] if (x[0] <= cuts[j][1]) == (side == "left")]
                size, total = sum(x[1] for x in own), sum(x[2] for x in own)
                setattr(nodes[k], side, len(nodes))
                squares[len(nodes)] = sum(x[3] for x in own)
                grown.append(len(nodes))
                nodes.append(Node(len(nodes), level + 1, int(size), total / size))
        open_ = grown
    leaves, stack = 0, [0]
    while stack:
        k = stack.pop()
        if nodes[k].left >= 0:
            stack += [nodes[k].right, nodes[k].left]
        else:
            nodes[k].leaf, leaves = leaves, leaves + 1
    return Tree(columns, nodes)


def fit_projection(df: DataFrame, columns: list[str], y: str) -> Projection:
    """The projection of the z columns of categories in df for a label. Rows without a label don't count; a table without any gets zeros."""
    label = F.col(f"`{y}`").cast("double")
    one = df.where(label.isNotNull()).groupBy(*[F.col(f"`{c}`") for c in columns]).agg(F.count(F.lit(1)).alias("n"), F.sum(label).alias("sum"), F.sum(label * label).alias("squares"))
    cells = stored(one, "codes")
    combinations, rows = cells.agg(F.count(F.lit(1)), F.sum("n")).first()
    if not rows:
        removed(cells)
        return Projection(Tree(columns, [Node(0, 0, 0, 0.0, leaf=0)]), 0.0, 1.0)
    tree = grow_over_codes(cells, columns, depth_for(combinations), max(10, rows // 100))
    removed(cells)
    sizes, values = (np.array([getattr(x, k) for x in tree.leaves], float) for k in ("n", "value"))
    mean = float((sizes * values).sum() / rows)
    return Projection(tree, mean, float(np.sqrt((sizes * (values - mean) ** 2).sum() / rows)) + LEAST)
