"""Pieces, their bytes and decoding against the library, with the model as it is and with a character map put into it."""

import hashlib
import random

import numpy as np
import pytest

from varileaf.llm import pieces
from varileaf.llm.queries import op13_offset_pieces
from varileaf.llm.tokens import tokenizer_path

SIGNS = [*"abAB é×÷ñß  \n\n\t.,;:!?'0199-_<|>—  　жЯ中文́𝒳½²Ⅷ\r\x0b\x00▁ﬁ①ｶﾞＡ…", "<s>", "</s>", "<0x0A>", "<unk>", " the", "   ", "ing", "é", "�", "👩‍👩‍👧"]


def texts(n, seed):
    rng = random.Random(seed)
    made = ["".join(rng.choice(SIGNS) for _ in range(rng.randint(0, 40))) for _ in range(n)]
    return [*made, "", "▁", "▁▁a", " ", "  a ", "\n", "x" * 300, " " * 100, "ab cd" * 60]


@pytest.fixture(scope="module", params=["", "nmt_nfkc", "nfkc_cf"])
def both(request, tmp_path_factory):
    """The library's model and ours, with the compiled map of one of the library's rules."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as files

    spec = files.ModelProto()
    with open(tokenizer_path("piece_bpe_32k.model"), "rb") as f:
        spec.ParseFromString(f.read())
    if request.param:
        rules = files.ModelProto()
        rules.ParseFromString(sentencepiece.SentencePieceNormalizer(rule_name=request.param).serialized_model_proto())
        spec.normalizer_spec.precompiled_charsmap = rules.normalizer_spec.precompiled_charsmap
        assert len(spec.normalizer_spec.precompiled_charsmap) > 1000
    path = tmp_path_factory.mktemp("model") / "m.model"
    path.write_bytes(spec.SerializeToString())
    return sentencepiece.SentencePieceProcessor(model_file=str(path)), pieces.Model(str(path))


def test_encode_and_decode(both):
    library, mine = both
    for a in range(0, 2000, 50):
        some = texts(41, a)
        ids, starts, stops, counts = mine.encode([t.encode() for t in some], [True] * len(some))
        decoded, at = mine.decode(ids, counts), 0
        for t, n, d in zip(some, counts.tolist(), decoded, strict=True):
            want = library.encode(t, return_type="proto").pieces
            assert ids[at : at + n].tolist() == [p.id for p in want], t
            assert list(zip(starts[at : at + n].tolist(), stops[at : at + n].tolist(), strict=True)) == [(p.begin, p.end) for p in want], t
            assert d.decode() == library.decode([p.id for p in want]), t
            at += n


def test_any_ids_decode(both):
    library, mine = both
    rng = random.Random(3)
    for _ in range(2000):
        ids = [rng.choice([rng.randrange(300), rng.randrange(32000), 3 + rng.randrange(256), 28705]) for _ in range(rng.randint(0, 12))]
        assert mine.decode(np.array(ids, np.int64), np.array([len(ids)]))[0].decode() == library.decode(ids)


def test_both_ways_of_merging(both, monkeypatch):
    _, mine = both
    rng = random.Random(4)
    parts = ["".join(rng.choice("▁the inganer xé") for _ in range(rng.randint(1, 40))) for _ in range(500)]
    monkeypatch.setattr(pieces, "SHORT", 100)
    assert [mine.merged(p) for p in parts] == [mine._merged_long(p) for p in parts]


def test_long_texts_go_in_stretches(spark, monkeypatch):
    rng = random.Random(5)
    words = ["the", "Haus", "été", "\n\n", "x" * 50, "", "▁", "12", "語"]
    for t in [" ".join(rng.choice(words) for _ in range(2000)), "語" * 3000, " " * 3000, ""]:
        cut = pieces.stretches(t.encode(), 500)
        assert b"".join(cut) == t.encode() and all(len(c) >= 500 for c in cut[:-1])
        m = pieces.model(tokenizer_path("piece_bpe_32k.model"))
        ids = np.concatenate([m.encode([c], [i == 0])[0] for i, c in enumerate(cut)])
        assert ids.tolist() == m.encode([t.encode()], [True])[0].tolist()


def test_query_is_the_librarys(spark):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    want = []
    for r in rows:
        ids = library.encode(r.text or "")
        sha = [hashlib.sha256(x.encode()).hexdigest() for x in (",".join(map(str, ids)), library.decode(ids))]
        want.append((r.doc_id, len(ids), *sha, len((r.text or "").encode())))
    assert sorted(map(tuple, op13_offset_pieces(spark, "/root/testdata/sf0.001").collect())) == sorted(want)


def test_edges(spark):
    path = tokenizer_path("piece_bpe_32k.model")
    long = "Ein langes Wort, été. " * 120_000
    rows = [(1, None, "x", 1, 0), (2, "", "x", 1, 0), (None, "a b", "y", 2, 0), (3, "a b", "y", 2, 0), (3, "a b", "y", 2, 0), (4, long, None, 3, 0), (5, "x" * 20_000, None, 3, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string, `a.b` int, starts int")
    out = pieces.decode(pieces.encode(docs, path), path).collect()
    assert sorted((str(r.doc_id), r.text) for r in out) == sorted((str(r[0]), r[1] or "") for r in rows)
    for r in out:
        assert len(r.ids) == len(r.starts) == len(r.stops) and (not r.text or r.stops[-1] == len(r.text.encode()))
        assert r.starts == sorted(r.starts)
    empty = pieces.decode(pieces.encode(docs.limit(0), path), path)
    assert empty.count() == 0 and empty.columns == ["doc_id", "ids", "starts", "stops", "text"]
    nothing = spark.createDataFrame([(None,), ([],), ([1, 2],)], "ids array<int>")
    assert [r.text for r in pieces.decode(nothing, path).collect()] == ["", "", ""]
