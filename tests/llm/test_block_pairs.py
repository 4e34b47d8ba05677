"""The product of a block counts every pair whole, however many pairs there are."""

import numpy as np
import pyarrow as pa

from varileaf.llm import jaccard


def test_counts_of_a_pair_are_not_parted():
    n = 2100  # more than PAIRS pairs in each of the two columns
    hashes, doc = np.repeat(np.array([1, 2], np.uint64), n), np.tile(np.arange(n), 2)
    found = 0
    for x, y, k in jaccard.block_pairs(hashes, doc, np.arange(n), np.full(n, 100)):
        assert (k == 2).all() and (x != y).all()
        found += len(k)
    assert found == n * (n - 1) // 2 > jaccard.PAIRS


def test_pairs_against_all(monkeypatch):
    rng = np.random.default_rng(5)
    for most in (1, 7, 1 << 21):
        monkeypatch.setattr(jaccard, "PAIRS", most)
        sets = [rng.choice(40, rng.integers(1, 9), replace=False).astype(np.uint64) for _ in range(60)]
        size, label = rng.integers(10, 20, 60), rng.integers(0, 25, 60)
        doc = np.repeat(np.arange(60), [len(s) for s in sets])
        wanted = {}
        for i in range(60):
            for j in range(i):
                k = len(np.intersect1d(sets[i], sets[j]))
                if k and label[i] != label[j] and 100 * min(size[i], size[j]) >= 75 * max(size[i], size[j]):
                    wanted[j, i] = k
        found = [((min(a, b), max(a, b)), k) for x, y, z in jaccard.block_pairs(np.concatenate(sets), doc, label, size) for a, b, k in zip(x.tolist(), y.tolist(), z.tolist())]
        assert len(found) == len(wanted) and dict(found) == wanted


def test_links_of_crowded_columns(monkeypatch):
    monkeypatch.setattr(jaccard, "PAIRS", 300)
    rng = np.random.default_rng(6)
    lows, parts = [], []
    for _ in range(200):
        rare, rest = rng.choice(24, 6, replace=False), 100 + rng.choice(100_000, 14, replace=False)
        for last in (rest, np.append(rest[:-1], 200_000 + rest[-1])):  # 19 of 20 in common
            lows.append(np.concatenate((rare, last)).astype(np.uint64))
            parts.append(np.array([2] * 6 + [0] * 14, np.uint8))
    found = jaccard.block_links(np.arange(400), np.full(400, 20), lows, parts)
    assert sorted(tuple(sorted(x)) for x in found) == [(i, i + 1) for i in range(0, 400, 2)]


def test_blocks_come_one_by_one():
    frames = [pa.RecordBatch.from_pydict({"block": b, "x": x}, pa.schema({"block": pa.int64(), "x": pa.int64()})) for b, x in (([1, 1, 2], [0, 1, 2]), ([2], [3]), ([], []), ([2, 5], [4, 5]))]
    found = [[(b, x) for f in block for b, x in zip(f.column(0).to_pylist(), f.column(1).to_pylist(), strict=True)] for block in jaccard.one_by_one(iter(frames))]
    assert found == [[(1, 0), (1, 1)], [(2, 2), (2, 3), (2, 4)], [(5, 5)]]
