"""Vectorised 64-bit polynomial hashes of byte strings and of word shingles."""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa

_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
#: Powers that stay in memory.
KEPT = 1 << 20
#: Bytes of a word that is hashed by the polynomial.
LONG = 64


@lru_cache(maxsize=1)
def _bytes() -> np.ndarray:
    """A number for each byte and a few more symbols, the same everywhere."""
    return np.random.Generator(np.random.PCG64(7)).integers(1, _MASK, 320, np.uint64, endpoint=True)


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = pow(_BASE, -1, 1 << 64)
    up, down = np.full(n, _BASE, np.uint64), np.full(n, inverse, np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up, out=up), np.multiply.accumulate(down, out=down)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, n of each or more. Beyond KEPT they are made anew: workers that are used again would hold them."""
    return _powers(1 << max(16, (n - 1).bit_length())) if n <= KEPT else _powers.__wrapped__(n)


def mixed(x: np.ndarray) -> np.ndarray:
    """Spreads every bit over all."""
    x = (x ^ x >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ x >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ x >> np.uint64(32)


class Prefix:
    """of(a, b): hashes of data[a:b] for arrays of starts and stops. Data of 64 bits are codes already."""

    def __init__(self, data: np.ndarray):
        up, self.down = powers(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        each = self.sums[1:]
        if data.dtype == np.uint64:
            each[:] = data
        else:
            np.take(_bytes(), data, out=each, mode="clip")
        each *= up[: len(data)]
        np.cumsum(each, out=each)

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return mixed((self.sums[b] - self.sums[a]) * self.down[a])


_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True


def distinct_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64-bit codes of the distinct words (blake2b digests), which of them each word is, one text after another, and how many words each text has."""
    data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    blank = _BLANK[data]
    edge = np.flatnonzero(np.diff(blank, prepend=True))
    starts, stops = edge[::2], edge[1::2]
    offsets = np.concatenate(([0], np.cumsum(stops - starts))).astype(np.int32)
    words = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data[~blank])]).dictionary_encode()
    codes = np.frombuffer(b"".join([hashlib.blake2b(w, digest_size=8).digest() for w in words.dictionary.to_pylist()]), np.uint64)
    ends = np.searchsorted(starts, np.cumsum([len(t) + 1 for t in texts]))
    return codes, words.indices.to_numpy(), np.diff(ends, prepend=0)


def word_codes(texts: list[bytes]) -> list[np.ndarray]:
    """Of each text the 64-bit codes of its words: hashes as above, and blake2b digests of words over LONG bytes, where letters in a pattern could meet."""
    data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    edge = np.flatnonzero(np.diff(_BLANK[data], prepend=True))
    starts, stops = edge[::2], edge[1::2]
    codes = Prefix(data).of(starts, stops)
    long = np.flatnonzero(stops - starts > LONG)
    view = memoryview(data)
    digests = [hashlib.blake2b(view[a:b], digest_size=8).digest() for a, b in zip(starts[long].tolist(), stops[long].tolist(), strict=True)]
    codes[long] = np.frombuffer(b"".join(digests), np.uint64)
    return np.split(codes, np.searchsorted(starts, np.cumsum([len(t) + 1 for t in texts]))[:-1])


def shingle_sets(texts: list[bytes], width: int = 5) -> list[np.ndarray]:
    """Of each text the sorted distinct hashes of its shingles of `width` words; a shorter text is one shingle, one without words has none.

    A-Z count as a-z; words are split at ASCII white space.
    """
    codes, index, sizes = distinct_words([t.lower() for t in texts])
    words = codes[index]
    bounds = np.concatenate(([0], np.cumsum(sizes))).tolist()
    n = len(words) - width + 1
    code = mixed(words[: max(n, 0)])
    for k in range(1, width):
        if n > 0:
            code = mixed(code * np.uint64(2 * k + 1) + words[k : k + n])
    out = []
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        if b - a >= width:
            out.append(np.unique(code[a : b - width + 1]))
        elif b > a:
            one = np.array([b - a], np.uint64)
            for w in words[a:b]:
                one = mixed(one * np.uint64(3) + w)
            out.append(one)
        else:
            out.append(np.zeros(0, np.uint64))
    return out
