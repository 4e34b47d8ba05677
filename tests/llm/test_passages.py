"""Passages of over 50 words that other documents hold: brute force, short passages, a document's own repeats, many kinds of segments."""

import random
import re

import numpy as np
import pytest

from varileaf.llm import passages, queries, repeats, rolling


def _rows() -> list[tuple]:
    rng = random.Random(9)
    words = ["".join(rng.choices("abcdefgh", k=rng.randint(1, 6))) for _ in range(4000)]
    made = lambda n: rng.choices(words, k=n)
    rows = [(i, " ".join(made(rng.randint(0, 300)))) for i in range(40)]
    short = [made(n) for n in (50, 51, 52, 60)]  # under 400 bytes
    for i, p in enumerate(short * 2):
        rows.append((100 + i, " ".join([*made(rng.randint(0, 90)), *p, *made(rng.randint(0, 90))])))
    own = made(70)
    rows += [(200, " ".join([*own, *made(9), *own])), (201, " \n".join([*own[5:60], *made(5), *own[5:58]]))]
    alone = made(80)
    rows.append((210, " ".join([*alone, "x", *alone])))
    base = made(200)
    for i in range(30):  # near copies
        near = list(base)
        near[rng.randrange(200)] = f"y{i}"
        rows.append((300 + i, "\t".join(near)))
    rows += [(400, rows[20][1]), (400, rows[20][1]), (None, rows[21][1]), (None, rows[21][1]), (401, None), (402, ""), (403, "é " * 60)]
    return rows


def _want(rows: list[tuple], n: int) -> list[tuple]:
    """By row: doc_id, runs and words covered by windows of n words that another row has."""
    split = [re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode()) for _, t in rows]
    held: dict[tuple, set[int]] = {}
    for i, w in enumerate(split):
        for p in range(len(w) - n + 1):
            held.setdefault(tuple(w[p : p + n]), set()).add(i)
    out = []
    for (doc_id, _), w in zip(rows, split, strict=True):
        mark = [False] * len(w)
        for p in range(len(w) - n + 1):
            if len(held[tuple(w[p : p + n])]) > 1:
                mark[p : p + n] = [True] * n
        out.append((doc_id, sum(m and (k == 0 or not mark[k - 1]) for k, m in enumerate(mark)), sum(mark)))
    return out


@pytest.mark.parametrize("hot", [repeats.HOT, 1])
def test_passages_equal_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(repeats, "HOT", hot)
    rows = _rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    out = repeats.remove(docs, beside=passages.counted(docs)).collect()
    want = _want(rows, passages.WORDS)
    assert sorted([(x.doc_id, x.n_passages, x.n_passage_words) for x in out], key=str) == sorted(want, key=str)
    told = {x[0]: x[2] for x in want}
    assert told[210] == told[100] == 0 < min(told[101], told[200], told[300])


def test_the_query_tells_passages_under_400_bytes(spark, tmp_path):
    """Of two documents that share 60 short words nothing is removed, and both are told; one that repeats itself isn't."""
    rng = random.Random(4)
    made = lambda n: [f"{rng.randrange(9999)}" for _ in range(n)]
    both, own = made(60), made(60)
    rows = [(i, " ".join([*made(80), *(both if i < 2 else []), *made(80)])) for i in range(6)] + [(6, " ".join([*own, *made(5), *own]))]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    out = queries.op9_suffix_repeats(spark, str(tmp_path)).collect()
    assert all(x.n_removed == 0 for x in out)
    assert {x.doc_id: (x.n_passages, x.n_passage_words) for x in out} == {i: (1, 60) if i < 2 else (0, 0) for i in range(7)}


def test_a_long_text_is_cut_in_pieces(monkeypatch):
    monkeypatch.setattr(repeats, "PIECE", 100)
    codes = np.random.Generator(np.random.PCG64(1)).integers(1, 1 << 60, 1000, np.uint64)
    own, _, _, lo, hi = (np.concatenate(x) for x in zip(*repeats.placed([codes], 51, 12), strict=True))
    assert not own.any() and sorted(p for a, b in zip(lo, hi, strict=True) for p in range(a, b + 1)) == list(range(950))


def test_windows_of_one_owner_are_not_shared():
    a, b = np.arange(1, 31, dtype=np.uint64), np.arange(11, 41, dtype=np.uint64)
    assert [x.tolist() for x in passages.shared_words([a, b, a], [0, 0, 0], 10)] == [[], [], []]
    assert [x.tolist() for x in passages.shared_words([a, b, a[:9]], [0, 1, 2], 10)] == [list(range(10, 21)), list(range(11)), []]


def test_codes_are_those_of_words():
    """Texts without words, all white space, and long words of two letters that the polynomial can't tell apart."""
    a = ["a"]
    for _ in range(11):
        a += ["b" if x == "a" else "a" for x in a]
    b = "".join("b" if x == "a" else "a" for x in a)
    texts = ["x y\tx", "", " \n\x0b\x0c\r", "".join(a), b, " é\u3000z  x ", f"{b} x"]
    one: dict[bytes, int] = {}
    for t, codes in zip(texts, rolling.word_codes([t.encode() for t in texts]), strict=True):
        words = re.findall(rb"[^\x20\x09-\x0D]+", t.encode())
        assert len(words) == len(codes) and all(one.setdefault(w, c) == c for w, c in zip(words, codes.tolist(), strict=True))
    assert len(set(one.values())) == len(one) == 5
