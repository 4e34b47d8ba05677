"""Edge cases of single parts: special tokens, apportionment, slashes, hash patterns, clashing columns, large groups."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from varileaf.llm import eliasfano, html, jaccard, mixing, packing, repeats, rolling
from varileaf.llm.tokens import encoder, tokenizer_path


def library(text):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path()).encode(text or "", add_special_tokens=False).ids


def test_ids_are_the_librarys():
    rng = random.Random(1)
    signs = [*"abAB é×÷ñß  \n\n\t.,;:!?'0199-_<|>—  　жЯ中文́𝒳½²Ⅷ\r\x0b", "<|endoftext|>", "'s", "'ll", " the"]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 25))) for _ in range(3000)]
    texts += [None, "", "a <|endoftext|> b", "<|endoftext|>", "\n", "a\n", " a", "a ", "a  ", "x" * 70, " " * 40]
    from tokenizers import Tokenizer

    lib, enc = Tokenizer.from_file(tokenizer_path()), encoder(tokenizer_path())
    for a in range(0, len(texts), 100):
        some = texts[a : a + 100]
        ids, ends = enc.encode(pa.array(some).slice(3), 7)
        start = 0
        for text, end in zip(some[3:], ends.tolist(), strict=True):
            assert ids[start:end].tolist() == [*lib.encode(text or "", add_special_tokens=False).ids, 7]
            start = end


def test_highest_quotients():
    def plain(votes, seats):
        out = [0] * len(votes)
        for _ in range(seats):
            i = max(range(len(votes)), key=lambda i: (votes[i] / (2 * out[i] + 1), -i))
            out[i] += 1
        return out

    assert mixing.apportion([940.0] + [0.6] * 100, 1000)[0] == 900
    rng = random.Random(2)
    for _ in range(200):
        votes = [rng.paretovariate(0.7) if rng.random() < 0.9 else 0.0 for _ in range(rng.randint(1, 30))]
        seats = rng.randint(0, 200)
        if sum(votes):
            assert mixing.apportion(votes, seats) == plain(votes, seats)


def test_small_sources_take_their_targets(spark):
    docs = spark.createDataFrame([(1, "a b c", "x"), (2, "d e f g", "y"), (3, None, None)], "doc_id long, text string, source string")
    out = {r.doc_id: r for r in mixing.mix(docs).collect()}
    assert [out[i].taken for i in (1, 2, 3)] == [round(out[i].target) for i in (1, 2, 3)] == [2, 5, 0]


def test_quotas_reach_the_target():
    assert mixing.shard_quotas([10, 20, 0], 2, 31) == [10, 21, 0] or sum(mixing.shard_quotas([10, 20, 0], 2, 31)) == 31
    assert sum(mixing.shard_quotas([5, 5], 10, 30)) == 30 and max(mixing.shard_quotas([5, 5], 10, 30)) <= 15


def test_a_slash_ends_void_and_foreign_elements_only():
    long = "It was the story of the town and of all that had been there with them. " * 4
    page = f"<article><p>{long}</p><script src='a.js'/>var hidden = 1;</script><div class=ad/>buy this now</div><svg/><p>{long}<br/>end</p></article>"
    text = html.main_text(page)
    assert "hidden" not in text and "buy" not in text and text.endswith("end")
    links = [(b.text, b.linked) for b in html.blocks("<p><a href=http://x.com/>all of this is linked</a></p>")]
    assert links == [("all of this is linked", 21)]


def test_word_codes_have_no_pattern(spark):
    """Words that a polynomial modulo a power of two can't tell apart."""
    a = ["a"]
    for _ in range(10):
        a += ["b" if x == "a" else "a" for x in a]
    b = "".join("b" if x == "a" else "a" for x in a)
    a = "".join(a)
    one, two = rolling.shingle_sets([a.encode(), b.encode()])
    assert one.tolist() != two.tolist()
    docs = spark.createDataFrame([(1, a), (2, b), (3, a)], "doc_id long, text string")
    assert sorted((r.doc_id, r.component_id) for r in jaccard.join(docs).collect()) == [(1, 1), (2, 2), (3, 1)]


def test_a_large_group_of_near_copies_costs_no_square(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(3000)]
    base = [rng.choice(words) for _ in range(200)]
    rows = []
    for i in range(500):
        own = list(base)
        for at in rng.sample(range(200), 2):
            own[at] = f"x{i}_{at}"
        rows.append((i, " ".join(own)))
    rows += [(1000 + i, " ".join(rng.choice(words) for _ in range(200))) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    found = jaccard.links(jaccard.columns(jaccard.counted(docs, jaccard.frequent(docs), 4), 4), 4)
    assert 499 <= found.count() < 4 * 500
    out = {r.doc_id: r.component_id for r in jaccard.join(docs).collect()}
    assert {out[i] for i in range(500)} == {0} and all(out[i] == i for i in out if i >= 1000)


def test_clashing_columns_stay(spark):
    passage = " ".join(f"word{i}" for i in range(100))
    rows = [(1, passage + " one", 111, 5, "s", "t", "h"), (2, "two " + passage, 112, 6, "s", "t", "h"), (3, None, 113, 7, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, d long, r int, row string, starts string, source string")
    out = {x.doc_id: x for x in repeats.cleaned(docs).collect()}
    assert {i: (x.d, x.r, x.row, x.starts) for i, x in out.items()} == {1: (111, 5, "s", "t"), 2: (112, 6, "s", "t"), 3: (113, 7, None, None)}
    assert passage not in out[1].text and out[1].text.endswith("one")
    rows = [(1, "a b c d", 77, 1, "x", 3, "h"), (2, "e f g h", 78, 2, "y", 4, "h")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, size long, copies long, row string, copy long, source string")
    assert {(x.doc_id, x.size, x.copies, x.row, x.copy) for x in mixing.repeated(docs).collect()} == {(1, 77, 1, "x", 3), (2, 78, 2, "y", 4)}
    docs = spark.createDataFrame([(1, "a b c d e f", 7, 8, 9), (2, "a b c d e f", 7, 8, 9), (None, "q", 1, 2, 3)], "doc_id long, text string, _row long, place long, key long")
    kept = corpus_pipeline.near_duplicates(spark, docs, "").collect()
    assert sorted([tuple(x) for x in kept], key=str) == [(1, "a b c d e f", 7, 8, 9), (None, "q", 1, 2, 3)]


def test_select_finds_every_document():
    rng = random.Random(3)
    docs = [np.array([rng.randint(0, 60_000) for _ in range(rng.choice([1, 1, 2, 50, 3000]))]) for _ in range(1300)]
    file = eliasfano.TokenFile(eliasfano.write_file(docs, 60_001))
    at = 0
    for i, d in enumerate(docs):
        start, ids = file.document(i)
        assert start == at and ids.tolist() == d.tolist()
        at += len(d)
    bits = 8 * (len(file.boundaries.low) + len(file.boundaries.high)) / len(docs)
    assert bits <= 2 + np.log2(at / len(docs)) + 1


def test_token_files_keep_null_and_repeated_ids(spark):
    rows = [(5, "b b"), (None, "n"), (5, "a"), (2, None), (5, "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = eliasfano.read_tokens(eliasfano.write_tokens(docs, tokenizer_path())).orderBy("start").collect()
    want, at = [(None, "n"), (2, ""), (5, "a"), (5, "a"), (5, "b b")], 0
    for r, (i, t) in zip(out, want, strict=True):
        ids = [*library(t), 2]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


def test_windows_pad_little(spark):
    rng = random.Random(6)
    docs = spark.createDataFrame([(i, " ".join(rng.choice(["the", "town", "was", "old."]) for _ in range(rng.randint(1, 900)))) for i in range(120)], "doc_id long, text string").coalesce(1)
    sizes = {r.sequence_id: r.sequence_tokens for r in packing.pack(docs, tokenizer_path()).collect()}
    padded = sum(packing.padding(n) for n in sizes.values())
    assert padded <= 0.02 * sum(sizes.values()) + 2048


def test_stages_keep_empty_tables_and_columns(spark):
    shape = "doc_id long, text string, lang string, source string, n_chars long, row string"
    empty = spark.createDataFrame([], shape)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, empty, "")
        assert out.count() == 0 and (name == "packed" or out.columns == empty.columns)


def test_stages_against_plain_versions(spark):
    rng = random.Random(8)
    words = [f"{rng.choice('bcdfg')}{rng.choice('aeiou')}{rng.choice('lmnrs')}{i}" for i in range(500)]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(60, 160))) for _ in range(30)]
    passage = " ".join(rng.choice(words) for _ in range(110))
    texts[1] = texts[0]
    texts[3] = texts[2] + " more"
    texts[4] += " " + passage
    texts[5] = passage + " " + texts[5]
    docs = spark.createDataFrame([(i, t, "en", "ab"[i % 2], None) for i, t in enumerate(texts)] + [(90, None, None, None, None), (91, "12 34", "en", "a", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    # languages: everything with a letter, as only one is known
    first = corpus_pipeline.language(spark, docs, "")
    assert {r.doc_id for r in first.collect()} == set(range(30))

    def shingles(t):
        w = t.lower().split()
        return {tuple(w[k : k + 5]) for k in range(len(w) - 4)}

    sets, heads = [shingles(t) for t in texts], []
    for i in range(30):
        if not any(100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]) for j in range(i)):
            heads.append(i)
    second = corpus_pipeline.near_duplicates(spark, first, "")
    assert sorted(r.doc_id for r in second.collect()) == heads and {1, 3} & set(heads) == set()
    # repeated passages
    raw = {i: texts[i].encode() for i in heads}
    seen: dict[bytes, int] = {}
    for t in raw.values():
        for k in range(len(t) - 399):
            seen[t[k : k + 400]] = seen.get(t[k : k + 400], 0) + 1
    want = {}
    for i, t in raw.items():
        mark = bytearray(len(t))
        for k in range(len(t) - 399):
            if seen[t[k : k + 400]] > 1:
                mark[k : k + 400] = b"\1" * 400
        want[i] = bytes(c for c, m in zip(t, mark, strict=True) if not m).decode()
    third = corpus_pipeline.repeated_passages(spark, second, "")
    assert {r.doc_id: r.text for r in third.collect()} == want and any(want[i] != texts[i] for i in want)
    assert all(r.n_chars == len(r.text) for r in third.collect())
    # the mix takes whole copies near each source's target
    fourth = corpus_pipeline.source_mix(spark, third, "").collect()
    size = {s: sum(len(t.split()) for i, t in want.items() if "ab"[i % 2] == s) for s in "ab"}
    target = dict(zip("ab", mixing.targets([size["a"], size["b"]], [1, 2]), strict=True))
    for s in "ab":
        assert sum(len(r.text.split()) for r in fourth if r.source == s) == pytest.approx(target[s], abs=170)
    assert {r.doc_id for r in fourth} <= set(want)
