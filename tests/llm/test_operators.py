"""Every training-data operator against brute force, on nulls, empty and long texts, ties, repeats and clashing columns."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from varileaf.llm import crossentropy, eliasfano, html, jaccard, langid, mixing, packing, quality, repeats, transport
from varileaf.llm.tokens import tokenizer_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, n long, label string, d long"


def corpus():
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 200))) for _ in range(40)]
    passage = " ".join(rng.choice(words) for _ in range(90))
    texts[3] = texts[2]
    texts[5] = texts[4] + " extra"
    texts[6] = "start " + passage + " end"
    texts[7] = "other " + passage + " tail"
    texts[8] = passage + "\n" + passage
    texts += [None, "", "   \n", "é" * 3, "12 34 !", "x" * 30_000, " ".join(words) * 12, "A b C d", "a B c D", "null   line\nline\nline"]
    rows = [(i, t, (None, "en", "de")[i % 3], ("b", "a", None)[i % 3], None, 7, 8, "x", 9) for i, t in enumerate(texts)]
    return [*rows, rows[2], (None, "no id at all here", None, None, 1, 7, 8, "x", 9)]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def ids_of(text, end):
    from tokenizers import Tokenizer

    return [*Tokenizer.from_file(tokenizer_path()).encode(text or "", add_special_tokens=False).ids, end]


def crc(ids):
    import numpy as np

    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_packing_covers_each_id_once(docs, empty, rows):
    out = [r for r in packing.pack(docs, tokenizer_path()).collect()]
    pieces, windows = defaultdict(list), defaultdict(list)
    for r in out:
        pieces[r.doc_id].append(r)
        windows[r.sequence_id].append(r)
    want = {i: ids_of(t, 1) for i, t, *_ in rows}
    for i, ids in want.items():
        own = sorted(pieces[i], key=lambda r: (r.start, r.sequence_id))
        times = 2 if i == 2 else 1
        assert sum(r.length for r in own) == times * len(ids)
        for r in own:
            assert r.doc_tokens == len(ids) and r.ids_crc32 == crc(ids[r.start : r.start + r.length])
    for w in windows.values():
        at = 0
        for r in sorted(w, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
    assert packing.pack(empty, tokenizer_path()).count() == 0


def test_packing_plan_is_optimal():
    import numpy as np

    rng = random.Random(1)
    for _ in range(30):
        at = np.array(sorted(rng.sample(range(1, 60), 14)))
        penalty = np.array([rng.choice([0, 4, 24]) for _ in at], float)
        if max(np.diff(np.concatenate(([0], at)))) > 16:
            continue

        def cost(ends):
            total, before = 0, 0
            for e in ends:
                total += packing.padding(int(e) - before, 16) + penalty[list(at).index(e)] + packing.WINDOW
                before = int(e)
            return total

        best = {0: 0}
        for j in at.tolist():
            best[j] = min(best[i] + packing.padding(j - i, 16) + penalty[list(at).index(j)] + packing.WINDOW for i in best if j - i <= 16)
        assert cost(packing.plan(at, penalty, 16)) == best[int(at[-1])]


def test_media_round_trip(docs, empty, rows):
    out = {r.doc_id: r for r in transport.read_media(transport.encode_media(docs)).collect()}
    for i, t, *_ in rows:
        raw = (t or "").encode()
        payload = raw + b" " * (max(192, -(-len(raw) // 192) * 192) - len(raw))
        r = out[i]
        assert (r.n_bytes, r.payload_bytes) == (len(raw), len(payload))
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest() and r.tail_crc32 == zlib.crc32(payload[-16:])
    assert out[2].media_sha256 == out[3].media_sha256 and out[2].feature == out[3].feature
    assert transport.read_media(transport.encode_media(empty)).count() == 0


def test_language(docs, empty, rows, spark):
    model = langid.fit(docs)
    out = langid.predict(docs, model).collect()
    assert len(out) == len(rows)
    by = {r.doc_id: r for r in out}
    assert all(by[i].lang_pred == "und" for i, t, *_ in rows if t is None or not any(c.isalpha() for c in t))
    assert all(0 <= r.score <= 1 for r in out) and by[2].lang_pred == by[3].lang_pred
    assert by[5].held_out == (zlib.crc32(b"5") % 4 == 2)
    assert langid.predict(empty, langid.fit(empty)).count() == 0
    assert {r.lang_pred for r in langid.predict(docs, langid.fit(empty)).collect()} == {"und"}
    real = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.predict(real, langid.fit(real)).where("held_out").join(real, "doc_id").where("lang is not null and text is not null").selectExpr("avg(cast(lang = lang_pred as double))").first()[0]
    assert got >= 0.9


def test_quality_counts(docs, empty, rows):
    word = re.compile(r"[^\x20\x09-\x0D]+")
    out = {r.doc_id: r for r in quality.apply_rules(docs).collect()}
    for i, t, *_ in rows:
        w = word.findall(t or "")
        windows = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        covered = {k + j for k in range(len(w) - 4) if windows[tuple(w[k : k + 5])] > 1 for j in range(5)}
        lines = [x for x in (t or "").split("\n") if word.search(x)]
        r = out[i]
        assert (r.n_words, r.word_chars, r.n_repeat_words) == (len(w), sum(map(len, w)), len(covered))
        assert (r.n_symbols, r.n_dup_lines) == (len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)))
        assert r.base_failed == (len(w) < 10 or 100 * len(covered) > 20 * len(w)) and not (r.base_failed and r.kept)
    assert quality.apply_rules(empty).count() == 0


def test_token_files(docs, empty, rows):
    out = eliasfano.read_tokens(eliasfano.write_tokens(docs.where("doc_id is not null").dropDuplicates(["doc_id"]), tokenizer_path())).orderBy("doc_id").collect()
    at = 0
    for r, (i, t, *_) in zip(out, [x for x in rows[:-2]], strict=True):
        ids = ids_of(t, 2)
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (i, at, len(ids), crc(ids))
        at += len(ids)
    assert eliasfano.read_tokens(eliasfano.write_tokens(empty, tokenizer_path())).count() == 0


def test_html(spark):
    shape = "page_id long, url string, html string, text string, n_chars long"
    long = "This is the story of the town and of the people who lived in it for a long time, and it was told by all of them to each other. " * 3
    page = f"<html><body><nav><a href='/'>Home</a> <a href='/x'>More</a></nav><article><h1>The title of it all</h1><p>{long}&amp; more</p></article><footer>Copyright</footer></body></html>"
    pages = spark.createDataFrame([(1, "u", page, "x", 1), (2, "u", None, "x", 1), (3, None, "", "x", 1)], shape)
    out = {r.page_id: r for r in html.extract(pages).collect()}
    assert "& more" in out[1].text and "Home" not in out[1].text and "Copyright" not in out[1].text
    assert out[2].text == "" == out[3].text and all(r.n_chars == len(r.text) for r in out.values())
    assert html.extract(spark.createDataFrame([], shape)).count() == 0


def test_cross_entropy(docs, empty, rows):
    out = crossentropy.score(docs, docs.where("doc_id in (6, 7, 8)")).collect()
    assert len(out) == len(rows)
    by = {r.doc_id: r for r in out}
    assert by[6].score < by[20].score and by[40].score == 0 and by[2].score == by[3].score
    assert crossentropy.score(empty, empty).count() == 0


def test_mix(docs, empty, rows):
    out = mixing.mix(docs).collect()
    assert len(out) == len(rows)
    size = Counter()
    for _, t, _, s, *_ in rows:
        size[s] += len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    order = ["a", "b", None]
    want = dict(zip(order, mixing.targets([size[s] for s in order], [1, 2, 3]), strict=True))
    source = {i: s for i, _, _, s, *_ in rows}
    taken = Counter()
    for r in out:
        s = source[r.doc_id]
        taken[s] += r.taken
        assert r.source_size == size[s] and r.taken <= 3 * r.size and abs(r.target - want[s]) < 1e-6
    assert all(abs(taken[s] - want[s]) <= max(32, 0.02 * want[s]) for s in order)
    assert sorted(map(tuple, out), key=str) == sorted(map(tuple, mixing.mix(docs).collect()), key=str)
    assert mixing.mix(empty).count() == 0


@pytest.mark.parametrize("length", [400, 250])
def test_repeats(docs, empty, rows, length):
    raw = [(i, (t or "").encode()) for i, t, *_ in rows]
    seen = Counter(t[k : k + length] for _, t in raw for k in range(len(t) - length + 1))
    want, left = [], []
    for i, t in raw:
        hit = [k for k in range(len(t) - length + 1) if seen[t[k : k + length]] > 1]
        mark = bytearray(len(t))
        for k in hit:
            mark[k : k + length] = b"\1" * length
        kept = bytes(c for c, m in zip(t, mark, strict=True) if not m)
        spans = sum(1 for k, m in enumerate(mark) if m and (k == 0 or not mark[k - 1]))
        want.append((i, len(t), sum(mark), spans, hashlib.sha256(kept).hexdigest()))
        if not hit or kept.decode("utf-8", "ignore").strip():
            left.append((i, kept.decode("utf-8", "ignore")))
    got = [tuple(r) for r in repeats.remove(docs, length, length // 4).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    kept = [(r.doc_id, r.text or "") for r in repeats.cleaned(docs, length, length // 4).collect()]
    assert sorted(kept, key=str) == sorted(left, key=str)
    assert any(w[2] for w in want) and repeats.remove(empty).count() == 0


def test_jaccard(docs, empty, rows):
    sets = {}
    for i, t, *_ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    ids = [i for i in sets if i is not None]
    parent = {i: i for i in ids}

    def root(i):
        return i if parent[i] == i else root(parent[i])

    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    got = jaccard.join(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.n_shingles == len(sets[r.doc_id])
        assert r.component_id == (None if r.doc_id is None else root(r.doc_id))
    assert root(3) == 2 and jaccard.join(empty).count() == 0
