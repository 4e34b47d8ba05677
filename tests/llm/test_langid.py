"""The language model keeps every language, word and n-gram that its sample counts, and scores as plain counts do."""

import math
import random
from collections import Counter, defaultdict

import pytest

from varileaf.llm import langid


def test_every_language_and_word(spark):
    rng = random.Random(2)
    letters = "abcdefghijklmnopqrstuvwxyz"
    words = {f"l{i:02d}": ["".join(rng.choices(letters, k=8)) for _ in range(30)] for i in range(70)}
    words["l00"] += ["".join(rng.choices(letters, k=7)) for _ in range(21_000)]
    rows = [(i, " ".join(own), lang) for lang, own in words.items() for i in range(12)]
    docs = spark.createDataFrame([(i, t, lang) for i, (_, t, lang) in enumerate(rows)], "doc_id long, text string, lang string")
    model = langid.fit(docs)
    assert model.languages == sorted(words)
    scorer = langid.Scorer(model)
    assert all(scorer.score(own[3] + " " + own[7])[0] == lang for lang, own in words.items())
    assert (model.words.find(langid.hashed(sorted({w for own in words.values() for w in own}))) >= 0).all()


def test_scores_are_those_of_counts(spark):
    texts = [("der hund und die katze", "de"), ("the dog and the cat", "en"), ("le chien et le chat", "fr"), ("the den of the hund", "en")]
    docs = spark.createDataFrame([(i, t, lang) for i, (t, lang) in enumerate(texts * 6)], "doc_id long, text string, lang string")
    model = langid.fit(docs)
    def grams(w, n):
        padded = f"^{w}$" if n > 1 else w
        return [padded[i : i + n] for i in range(len(padded) - n + 1)]

    tables = {n: defaultdict(Counter) for n in (0, *langid.LENGTHS)}
    for r in docs.where(~langid.held_out(docs.doc_id)).collect():
        for w in r.text.split():
            tables[0][w][r.lang] += 1
            for n in langid.LENGTHS:
                for g in grams(w, n):
                    tables[n][g][r.lang] += 1

    def logs(n, key):
        x = [math.log((tables[n][key][lang] + 0.5) / (sum(c[lang] for c in tables[n].values()) + 0.5 * len(tables[n]))) for lang in ("de", "en", "fr")]
        return [v - sum(x) / 3 for v in x]

    def word(w):
        if w in tables[0]:
            return logs(0, w)
        for n in langid.LENGTHS:
            found = [logs(n, g) for g in grams(w, n) if g in tables[n]]
            if found:
                return [langid.TRUST[n] * sum(x) / len(found) for x in zip(*found, strict=True)]
        return None

    given = ["hund", "the", "hunde", "chats", "zzz", "qqq", "a", "dent"]
    out, known = model.score(given)
    for w, x, k in zip(given, out.tolist(), known.tolist(), strict=True):
        want = word(w)
        assert k == (want is not None) and x == pytest.approx(want or [0, 0, 0])


def test_texts_without_letters_are_und(spark):
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(["\u00b2", "\u00bd \u00b2", "\u2167", "12 34", "", None, "so it is"])], "doc_id long, text string, lang string")
    out = {r.doc_id: r for r in langid.predict(docs, langid.fit(docs)).collect()}
    assert all(out[i].lang_pred == "und" and out[i].score == 0 for i in range(6)) and out[6].lang_pred == "en"
