"""The trigram losses of op4 and op7 against a dictionary Kneser-Ney model."""

import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from varileaf.llm import crossentropy, ngrams, quality


def off(counts, k):
    n = [sum(1 for x in counts if x == i) for i in (1, 2, 3, 4)]
    if not min(n):
        return [0, 0.5, 0.75, 0.9][min(k, 3)]
    y = n[0] / (n[0] + 2 * n[1])
    d = [0, 1 - 2 * y * n[1] / n[0], 2 - 3 * y * n[2] / n[1], 3 - 4 * y * n[3] / n[2]]
    return [0, *[min(max(d[i], 0.05), i - 0.05) for i in (1, 2, 3)]][min(k, 3)]


def model(texts, vocabulary):
    """probability(u, v, w) of texts given as lists of words."""
    three = Counter((*(["<s>", "<s>", *t][i : i + 2]), w) for t in texts for i, w in enumerate(t))
    two = Counter((v, w) for _, v, w in three)
    one = Counter(w for _, w in two)
    offs = [{k: off(c.values(), k) for k in {0, *c.values()}} for c in (one, two, three)]
    after2, after3 = defaultdict(list), defaultdict(list)
    for (v, w), k in two.items():
        after2[v].append(k)
    for (u, v, w), k in three.items():
        after3[u, v].append(k)

    def level(k, found, d, lower):
        total = sum(found)
        return lower if not total else (k - d[k]) / total + sum(d[x] for x in found) / total * lower

    def probability(u, v, w):
        p = level(one[w], list(one.values()), offs[0], 1 / vocabulary)
        p = level(two[v, w], after2[v], offs[1], p)
        return level(three[u, v, w], after3[u, v], offs[2], p)

    return probability


def loss(p, t):
    padded = ["<s>", "<s>", *t]
    return -sum(math.log(p(*padded[i : i + 3])) for i in range(len(t))) / max(1, len(t))


def texts():
    rng = random.Random(3)
    words = [f"w{i}" for i in range(60)]
    out = [" ".join(rng.choices(words, [1 / (i + 1) for i in range(60)], k=rng.randint(1, 80))) for _ in range(60)]
    return [*out, out[3], out[4].upper(), out[5].title(), "été naïve été", "", None]


def test_losses(spark):
    given = texts()
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(given)], "doc_id long, text string, lang string").repartition(5)
    split = [(t or "").split() for t in given]
    vocabulary = len({w for t in split for w in t})
    every, target = model(split, vocabulary), model(split[:20], vocabulary)
    for r in crossentropy.score(docs, docs.where("doc_id < 20")).collect():
        t = split[r.doc_id]
        assert r.n_tokens == len(t)
        assert r.loss_target == pytest.approx(loss(target, t), rel=1e-9) and r.loss_background == pytest.approx(loss(every, t), rel=1e-9)
    for r in quality.apply_rules(docs).collect():
        assert r.perplexity == pytest.approx(math.exp(loss(every, split[r.doc_id])), rel=1e-9)


def test_losses_with_frequent_words(spark, monkeypatch):
    monkeypatch.setattr(ngrams, "OFTEN_BYTES", 200)
    text = spark.createDataFrame([(t,) for t in texts()], "text string")
    assert len(ngrams.buckets_for(text)[1]) > 5
    test_losses(spark)


def test_a_frequent_word_is_dealt_to_all_buckets(spark, monkeypatch):
    monkeypatch.setattr(ngrams, "OFTEN_BYTES", 5000)
    given = [" ".join(f"a{i}x{j} the" for j in range(100)) for i in range(30)]
    buckets, often = ngrams.buckets_for(spark.createDataFrame([(t,) for t in given], "text string"))
    sizes = [len(ngrams.Bucket([payload], 1, often).starts) for _, payload, _ in ngrams.split([t.encode() for t in given], [], buckets, often, False)[1]]
    assert sum(sizes) == 6000 and max(sizes) < 1000  # about 3,000 of them have one middle word


def test_losses_in_rounds(spark, monkeypatch):
    monkeypatch.setattr(ngrams, "BUCKET_BYTES", 300)
    monkeypatch.setattr(ngrams, "OFTEN_BYTES", 200)
    assert len(ngrams._sampled(spark.createDataFrame([(t,) for t in texts()], "text string"))[2]) > 30
    test_losses(spark)


def test_rounds_share_the_buckets():
    given = [(t or "").encode() for t in texts()]
    often = ngrams._NONE
    whole = {b: (p, d) for b, p, d in ngrams.split(given, [], 50, often, True)[1]}
    rounds = [{b: (p, d) for b, p, d in ngrams.split(given, [], 50, often, True, turn=(i, 3))[1]} for i in range(3)]
    assert all(b % 3 == i for i, r in enumerate(rounds) for b in r) and rounds[0] | rounds[1] | rounds[2] == whole


def test_many_buckets_take_few_bytes(spark, monkeypatch):
    monkeypatch.setattr(ngrams, "OFTEN_BYTES", 5000)
    rng = random.Random(5)
    given = [" ".join(f"word{int(3000 * rng.random() ** 3)}" for _ in range(200)) for _ in range(500)]
    _, often, *rest = getattr(ngrams, "_sampled", ngrams.buckets_for)(spark.createDataFrame([(t,) for t in given], "text string"))
    sent = [p for _, p, _ in ngrams.split([t.encode() for t in given], [], 400, often, False, *rest)[1]]
    assert sum(map(len, sent)) < 6.5 * 100_000  # bytes a trigram


def test_texts_are_not_shuffled_to_meet_targets(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"t{i}") for i in [*range(300), 7]] + [(None, "n")], "doc_id long, text string")
    target = spark.range(0, 400, 3).select(F.col("id").alias("doc_id")).union(spark.range(3).select(F.col("id").alias("doc_id")))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = crossentropy.marked(docs, target)
        assert "SortMergeJoin" not in found._jdf.queryExecution().toString()
        monkeypatch.setattr(crossentropy, "TARGETS", 0)
        assert sorted(map(str, found.collect())) == sorted(map(str, crossentropy.marked(docs, target).collect()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    rows = found.collect()
    assert len(rows) == 302 and {r.doc_id for r in rows if r.hit} == {*range(0, 300, 3), 1, 2} and not any(r.hit for r in rows if r.doc_id is None)


@pytest.mark.parametrize("near", [0.2, 0.001])
def test_quartiles(spark, monkeypatch, near):
    monkeypatch.setattr(quality, "NEAR", near)
    rng = random.Random(6)
    rows = [(rng.choice(["a", "b", None]), round(rng.gauss(0, 1), 1)) for _ in range(3000)] + [("one", 5.0), ("two", 1.0), ("two", 2.0)] + [("same", 3.0)] * 50
    found = {r.lang: r.q for r in quality.quartiles(spark.createDataFrame(rows, "lang string, loss double"), "lang", "loss").collect()}
    for lang in {r[0] for r in rows}:
        own = sorted(v for k, v in rows if k == lang)
        assert found[lang] == [own[math.ceil(len(own) * s) - 1] for s in (0.25, 0.75)]


def test_bands_keep_what_they_say(spark):
    """The verdicts by brute force from the losses, alike in two layouts."""
    given = [t for t in texts() * 3 if t]
    docs = spark.createDataFrame([(i, t + f" {i % 7}", "ab"[i % 2]) for i, t in enumerate(given)], "doc_id long, text string, lang string")
    losses = {r.doc_id: r for r in quality.measure(docs.repartition(3)).collect()}
    fails = {i: r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words for i, r in losses.items()}
    want = {}
    for lang in "ab":
        own = sorted(r.loss for i, r in losses.items() if r.lang == lang and not fails[i])
        low, high = (own[math.ceil(len(own) * s) - 1] for s in (0.25, 0.75))
        reach = max(high - low, quality.LEAST) * 0.5
        want |= {i: not fails[i] and low - reach <= r.loss <= high + reach for i, r in losses.items() if r.lang == lang}
    for parts in (1, 6):
        assert {r.doc_id: r.kept for r in quality.apply_rules(docs.repartition(parts), 0.5).collect()} == want
    assert len(set(want.values())) == 2


def test_more_words_than_narrow_keys_tell(monkeypatch):
    given = [(t or "").encode() for t in texts()]
    for frequent in (ngrams._NONE, ngrams.distinct_words([b"w0"])[0] >> ngrams.np.uint64(16)):
        payloads = [p for half in (given[::2], given[1::2]) for _, p, _ in ngrams.split(half, [], 1, frequent, False)[1]]
        found = []
        for bits in (21, 3):
            monkeypatch.setattr(ngrams, "NARROW", bits)
            b = ngrams.Bucket(payloads, 1, frequent)
            sums = [(at, starts, b.k2[0][None, at], ngrams.np.ones((1, 4, len(starts)), int)) for _, at, starts in b.shared(5)]
            p = b.probabilities(0, ngrams.np.full(len(b.last), 0.01), ngrams.np.array([0, 0.5, 0.7, 0.9]), ngrams.np.array([0, 0.4, 0.6, 0.8]), sums)
            found.append([x.tolist() for x in (b.place, *b.k3, *b.k2, *b.k1, b.words[b.last], b.histories, p)] + [(h, at.tolist(), s.tolist()) for h, at, s in b.shared(5)])
        assert found[0] == found[1]


def test_a_bucket_of_very_many_words(spark, monkeypatch):
    """More words than 21 bits number, in two buckets."""
    monkeypatch.setattr(ngrams, "LEAST_BUCKETS", 2)
    docs = spark.range(24).selectExpr("id as doc_id", "concat_ws(' ', transform(sequence(1, 100000), x -> concat('w', id * 100000 + x))) as text", "'en' as lang")
    out = quality.apply_rules(docs).collect()
    assert len(out) == 24 and {r.n_words for r in out} == {100_000} and len({round(r.perplexity, 3) for r in out}) == 1
