"""Whole-number budgets of partitions. Partitions are few (a tree's leaves), so this is driver arithmetic."""

from __future__ import annotations

import heapq

import numpy as np


def weights(sizes: np.ndarray, mean_abs_z: np.ndarray | None = None) -> np.ndarray:
    """Shares by size, or by mean |z|."""
    w = np.asarray(sizes if mean_abs_z is None else np.maximum(mean_abs_z, 1e-10), float)
    return w / w.sum() if w.sum() else np.full(len(w), 1 / max(1, len(w)))


def _step(budget: np.ndarray, times: int, sign: int) -> None:
    """Moves `times` units one by one: off the largest (sign -1) or onto the smallest (+1), the first of equals."""
    heap = [(sign * b, i) for i, b in enumerate(budget.tolist())]
    heapq.heapify(heap)
    for _ in range(times):
        key, i = heap[0]
        budget[i] += sign
        heapq.heapreplace(heap, (key + 1, i))


def allocate(share: np.ndarray, n: int, floor: int = 0) -> np.ndarray:
    """Budgets that sum to n: the share's whole part or the floor, then single units from the largest or to the smallest."""
    budget = np.maximum(floor, np.floor(share * n).astype(np.int64))
    over = int(budget.sum()) - n
    if len(budget) and over:
        _step(budget, abs(over), -1 if over > 0 else 1)
    return budget


def for_reduction(share: np.ndarray, sizes: np.ndarray, n: int, floor: int = 5) -> np.ndarray:
    """As allocate(), no partition above its size; what that frees goes to the largest room, unit by unit."""
    budget = np.clip(allocate(share, n, floor), 0, sizes)
    room = sizes - budget
    heap = [(-r, i) for i, r in enumerate(room.tolist()) if r > 0]
    heapq.heapify(heap)
    for _ in range(n - int(budget.sum())):
        if not heap:
            break
        r, i = heapq.heappop(heap)
        budget[i] += 1
        if r + 1 < 0:
            heapq.heappush(heap, (r + 1, i))
    return budget


def largest_remainder(share: np.ndarray, n: int, sizes: np.ndarray | None = None) -> np.ndarray:
    """The other profile: whole parts, then the largest remainders; above a size the surplus is dealt again in proportion."""
    share = np.asarray(share, float)
    share = share / share.sum() if share.sum() > 0 else np.full(len(share), 1 / max(1, len(share)))
    if not len(share):
        return np.zeros(0, np.int64)
    budget = np.floor(share * n).astype(np.int64)
    order = np.lexsort((np.arange(len(share)), -(share * n - budget)))
    budget[order[: n - int(budget.sum())]] += 1
    if sizes is not None:
        budget = np.minimum(budget, sizes)
        while (left := min(n, int(sizes.sum())) - int(budget.sum())) > 0:
            room = sizes - budget
            budget = budget + np.minimum(largest_remainder(np.where(room > 0, share + 1e-12, 0), left), room)
    return budget


def from_ratio(rows: int, n: int | None = None, ratio: float | None = None) -> int:
    if (n is None) == (ratio is None):
        raise ValueError("give exactly one of n and ratio")
    if n is None:
        if not 0 < ratio <= 1:
            raise ValueError("ratio must be in (0, 1]")
        return max(1, int(rows * ratio))
    if n <= 0:
        raise ValueError("n must be positive")
    return n
