"""Shards of the suffix arrays: what they take, what workers keep of them, and that parts of the work change nothing."""

import random
import tracemalloc

import numpy as np

from varileaf.llm import repeats, rolling, suffixes


def _parts(size: int) -> list[bytes]:
    """Strings of 650 bytes in words; every third one repeats the one before it but for its ends."""
    rng = random.Random(5)
    words = [bytes(rng.choices(b"abcdefghij", k=rng.randint(2, 9))) for _ in range(3000)]
    out: list[bytes] = []
    while len(out) * 650 < size:
        made = b" ".join(rng.choices(words, k=300))[:650]
        out.append(b"<" + out[-1][1:-1] + b">" if len(out) % 3 == 2 else made)
    return out


def test_a_shard_takes_little():
    parts = _parts(1 << 20)
    repeats.shared_starts(parts[:10])
    tracemalloc.start()
    repeats.shared_starts(parts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 75 << 20


def test_workers_do_not_keep_the_powers_of_long_data():
    data = np.frombuffer(random.Random(3).randbytes(3 << 20), np.uint8)
    rolling._powers.cache_clear()
    tracemalloc.start()
    a, b = np.array([0, 5]), np.array([len(data), 9])
    found = rolling.Prefix(data).of(a, b)
    kept = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert kept < 1 << 20
    assert found[1] == rolling.Prefix(data[5:9]).of(np.array([0]), np.array([4]))[0]


def test_a_shard_is_not_filled_beyond_its_size(monkeypatch):
    monkeypatch.setattr(repeats, "SHARD", 100)
    rows = [(anchor, bytes(n)) for anchor, sizes in ((1, [60, 30]), (2, [60, 39]), (3, [1]), (4, [150, 150]), (5, [1])) for n in sizes]
    shards = list(repeats._shards(iter(rows)))
    assert [[r[0] for r in s] for s in shards] == [[1, 1], [2, 2, 3], [4, 4], [5]]
    assert [r for s in shards for r in s] == rows


def test_comparing_some_at_a_time_changes_nothing(monkeypatch):
    parts = _parts(20_000)
    whole = repeats.shared_starts(parts)
    monkeypatch.setattr(suffixes, "SOME", 97)
    some = repeats.shared_starts(parts)
    assert sum(map(len, whole)) > 0
    assert all(np.array_equal(a, b) for a, b in zip(whole, some, strict=True))
    seen: dict[bytes, int] = {}
    for p in parts:
        for i in range(len(p) - repeats.LENGTH + 1):
            seen[p[i : i + repeats.LENGTH]] = seen.get(p[i : i + repeats.LENGTH], 0) + 1
    assert [f.tolist() for f in whole] == [[i for i in range(len(p) - repeats.LENGTH + 1) if seen[p[i : i + repeats.LENGTH]] > 1] for p in parts]
