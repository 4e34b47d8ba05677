"""Picks from partitions beyond one kernel call against the kernel over the whole partition."""

import numpy as np
import pytest

from varileaf.operators import select


@pytest.mark.parametrize("method", ["fps", "medoid_fps", "variance_ordered", "mixed_fps", lambda z, b, s: np.arange(len(z) - b, len(z))])
def test_whole_partition(spark, monkeypatch, method):
    monkeypatch.setattr(select, "GROUP_ROWS", 200)
    monkeypatch.setattr(select, "CANDIDATES", 300)
    rng = np.random.default_rng(5)
    z = rng.normal(size=(1500, 2)).round(2)
    part = np.where(np.arange(1500) < 1400, 0, 1)
    df = spark.createDataFrame([(int(i), float(x), float(y), int(p)) for i, (x, y), p in zip(range(1500), z, part, strict=True)], "id long, x double, y double, partition_id int").repartition(4)
    budgets = {0: 60, 1: 10}
    kernel = select.KERNELS.get(method, method) if isinstance(method, str) else method
    got = select.select(df, ["id"], ["x", "y"], budgets, method).orderBy("partition_id", "selection_rank").collect()
    for p, b in budgets.items():
        mine = np.flatnonzero(part == p)
        assert [r.id for r in got if r.partition_id == p] == mine[kernel(z[mine], b, 42)].tolist()
        assert [r.selection_rank for r in got if r.partition_id == p] == list(range(b))
