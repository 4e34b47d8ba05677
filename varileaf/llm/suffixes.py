"""Suffix arrays by induced sorting, and permuted longest common prefixes.

Suffixes are classified, leftmost-smaller (LMS) substrings are sorted by induction and named, the order of LMS suffixes follows from
the names, and one more induction gives all suffixes. A bucket's entries are induced as whole arrays: within a bucket only runs of one
symbol need further rounds. The reduced string's alphabet grows with its length, so there the ranks are refined by doubling, which
ends after as many rounds as the logarithm of the longest repeat.
"""

from __future__ import annotations

import numpy as np

from varileaf.llm.rolling import Prefix

#: Suffixes that are compared at a time.
SOME = 1 << 18


def classify(s: np.ndarray) -> np.ndarray:
    """True for suffixes that are smaller than the next one; the last symbol, an end, counts as one."""
    n = len(s)
    differs = np.flatnonzero(s[:-1] != s[1:])
    small = np.repeat(np.append(s[differs] < s[differs + 1], False), np.diff(differs, prepend=-1, append=n - 1))
    small[-1] = True
    return small


def _spread(into: list[list[np.ndarray]], s: np.ndarray, found: np.ndarray) -> None:
    """Appends positions to the buckets of their symbols, in order."""
    if not len(found):
        return
    symbols = s[found]
    order = np.argsort(symbols, kind="stable")
    found, symbols = found[order], symbols[order]
    cuts = np.flatnonzero(symbols[1:] != symbols[:-1]) + 1
    starts = [0, *cuts.tolist(), len(found)]
    for a, b, c in zip(starts[:-1], starts[1:], symbols[np.concatenate(([0], cuts))].tolist(), strict=True):
        into[c].append(found[a:b])


def induce(s: np.ndarray, small: np.ndarray, lms: np.ndarray, alphabet: int) -> np.ndarray:
    """All suffixes from LMS ones in their order (of suffixes or substrings)."""
    none = np.zeros(0, np.int32)
    seeds: list[list[np.ndarray]] = [[] for _ in range(alphabet)]
    _spread(seeds, s, lms)
    large: list[list[np.ndarray]] = [[] for _ in range(alphabet)]

    def before(x: np.ndarray, kind: bool) -> np.ndarray:
        x = x[x > 0] - 1
        return x[small[x] == kind]

    for c in range(alphabet):
        done = 0
        while done < len(large[c]):
            batch = large[c][done] if done + 1 == len(large[c]) else np.concatenate(large[c][done:])
            done = len(large[c])
            _spread(large, s, before(batch, False))
        for batch in seeds[c]:
            _spread(large, s, before(batch, False))
    little: list[list[np.ndarray]] = [[] for _ in range(alphabet)]  # largest first
    whole: list[np.ndarray] = [none] * alphabet
    whole[0] = np.flatnonzero(s == 0).astype(np.int32)  # nothing smaller stands before an end
    for c in range(alphabet - 1, 0, -1):
        done = 0
        while done < len(little[c]):
            batch = little[c][done] if done + 1 == len(little[c]) else np.concatenate(little[c][done:])
            done = len(little[c])
            _spread(little, s, before(batch, True))
        front = np.concatenate(large[c]) if large[c] else none
        _spread(little, s, before(front[::-1], True))
        whole[c] = np.concatenate((front, np.concatenate(little[c])[::-1])) if little[c] else front
    return np.concatenate(whole)


def refine(names: np.ndarray) -> np.ndarray:
    """Order of the suffixes of a string of names, by doubling; only ranks that are still shared are sorted again."""
    n = len(names)
    order = np.argsort(names, kind="stable")
    first = np.concatenate(([True], names[order][1:] != names[order][:-1]))
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    step = 1
    while True:
        at = np.flatnonzero(~first | np.append(~first[1:], False))  # places of shared ranks
        if not len(at):
            return order
        own = order[at]
        ahead = np.where(own + step < n, rank[np.minimum(own + step, n - 1)] + 1, 0)
        inner = np.lexsort((ahead, rank[own]))
        own, ahead = own[inner], ahead[inner]
        order[at] = own
        same = np.concatenate(([False], (rank[own][1:] == rank[own][:-1]) & (ahead[1:] == ahead[:-1])))
        first[at] = ~same
        rank[order[at]] = np.maximum.accumulate(np.where(first, np.arange(n), 0))[at]
        step *= 2


def suffix_array(s: np.ndarray, alphabet: int) -> np.ndarray:
    """Positions of all suffixes of s in order. s is one or more strings, each of one or more symbols and an ending 0: an earlier end is the smaller, and no two are equal."""
    n = len(s)
    if n == 0:
        return np.zeros(0, np.int32)
    small = classify(s)
    lms = np.flatnonzero(small[1:] & ~small[:-1]).astype(np.int32) + 1
    roughly = induce(s, small, lms, alphabet)
    marked = np.zeros(n, bool)
    marked[lms] = True
    ordered = roughly[marked[roughly]]
    del roughly, marked
    stop = np.full(n, n, np.int32)
    stop[lms[:-1]] = lms[1:] + 1
    stop = stop[ordered]
    length = stop - ordered
    prints = Prefix(s).of(ordered, stop)
    new = np.concatenate(([True], (prints[1:] != prints[:-1]) | (length[1:] != length[:-1])))
    ends = s[ordered] == 0
    ordered[ends] = np.sort(ordered[ends])
    new |= ends
    del stop, length, prints, ends
    if not new.all():
        names = np.empty(len(lms), np.int64)
        names[np.searchsorted(lms, ordered)] = np.cumsum(new)
        ordered = lms[refine(names)]
    return induce(s, small, ordered, alphabet)


def permuted_lcp(s: np.ndarray, sa: np.ndarray, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """By position: common prefix with the suffix before it in order, and that suffix (-1: none).

    limit: symbols from a position to the end of its string. Where a suffix and the one before it have equal symbols in
    front, the value is one less than that in front; only the others are compared, SOME at a time.
    """
    n = len(s)
    before = np.full(n, -1, np.int32)
    before[sa[1:]] = sa[:-1]
    here = np.arange(n, dtype=np.int32)
    fresh = np.ones(n, bool)
    for a in range(0, n, SOME):
        at = here[a : a + SOME]
        at = at[(at > 0) & (before[at] > 0)]
        fresh[at] = (s[at - 1] != s[before[at] - 1]) | (s[at - 1] == 0)
    compared = here[fresh & (before >= 0)]
    value = np.zeros(n, np.int32)
    prefix = Prefix(s)
    for a in range(0, len(compared), SOME):
        x = compared[a : a + SOME]
        y = before[x]
        low, high = np.zeros(len(x), np.int32), np.minimum(limit[x], limit[y]).astype(np.int32)
        while (open_ := low < high).any():
            middle = (low + high + 1) // 2
            same = prefix.of(x, x + middle) == prefix.of(y, y + middle)
            low = np.where(open_ & same, middle, low)
            high = np.where(open_ & ~same, middle - 1, high)
        value[x] = low
    del prefix, compared
    source = np.maximum.accumulate(np.where(fresh, here, np.int32(0)))
    value = value[source]
    value -= here
    value += source
    return np.maximum(value, 0, out=value), before
