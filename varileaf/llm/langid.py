"""Language identification: word log frequencies, with progressively shorter character n-grams for unseen words."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varileaf.llm.common import batches, map_arrow
from varileaf.llm.rolling import Prefix

#: The model is fitted on about so many labelled documents of each language, chosen by a hash of doc_id (fewer where there are fewer).
FIT_DOCS = 3000
#: Lengths of n-grams, in the order in which they are tried.
LENGTHS = (5, 4, 3, 2, 1)
#: An unseen word counts less than a known one, by the length that knew it.
TRUST = {5: 0.9, 4: 0.8, 3: 0.6, 2: 0.4, 1: 0.2}
#: Add-so-much smoothing.
ALPHA = 0.5
_LETTERS = re.compile(r"[^\W\d_]+")
#: Numbers in the scores of distinct words that a Python worker keeps.
KEPT = 1_600_000


def hashed(keys: list[str]) -> np.ndarray:
    """64-bit hashes of strings, the same everywhere."""
    raw = [k.encode("utf-8", "surrogatepass") for k in keys]
    stops = np.cumsum([len(r) for r in raw], dtype=np.int64)
    data = np.frombuffer(b"".join(raw), np.uint8)
    return Prefix(data).of(np.concatenate(([0], stops[:-1])).astype(np.int64), stops)


@dataclass
class Scores:
    """Sorted hashes, and for each the languages that counted it: log frequencies above the one of an uncounted key."""

    keys: np.ndarray
    starts: np.ndarray
    lang: np.ndarray
    above: np.ndarray
    base: np.ndarray

    @classmethod
    def of(cls, keys: np.ndarray, lang: np.ndarray, k: np.ndarray, languages: int) -> Scores:
        order = np.lexsort((lang, keys))
        keys, lang, k = keys[order], lang[order], k[order]
        starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
        totals = np.bincount(lang, k, languages) + ALPHA * len(starts)
        return cls(keys[starts], np.append(starts, len(keys)), lang, np.log((k + ALPHA) / ALPHA), np.log(ALPHA / np.maximum(totals, ALPHA)))

    def find(self, h: np.ndarray) -> np.ndarray:
        """Places of hashes, -1 where there is none."""
        if not len(self.keys):
            return np.full(len(h), -1)
        at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
        return np.where(self.keys[at] == h, at, -1)

    def values(self, at: np.ndarray) -> np.ndarray:
        """Log frequencies in each language, less their mean, of found places."""
        n = self.starts[at + 1] - self.starts[at]
        each = np.repeat(np.arange(len(at)), n)
        entry = np.repeat(self.starts[at] - np.cumsum(n) + n, n) + np.arange(len(each))
        out = np.tile(self.base, (len(at), 1))
        out[each, self.lang[entry]] += self.above[entry]
        return out - out.mean(1, keepdims=True)


@dataclass
class LanguageModel:
    languages: list[str]
    words: Scores
    grams: dict[int, Scores] = field(default_factory=dict)

    def score(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Log-frequencies of lower-case words in each language, less their mean, and which words are known by themselves or their letters."""
        out, known = np.zeros((len(words), len(self.languages))), np.zeros(len(words), bool)
        at = self.words.find(hashed(words))
        known = at >= 0
        out[known] = self.words.values(at[known])
        for n in LENGTHS:
            left = np.flatnonzero(~known)
            if not len(left):
                break
            padded = [_padded(words[i], n) for i in left]
            parts = [p[i : i + n] for p in padded for i in range(len(p) - n + 1)]
            if not parts:
                continue
            at = self.grams[n].find(hashed(parts))
            owner = np.repeat(np.arange(len(left)), [max(0, len(p) - n + 1) for p in padded])[at >= 0]
            times = np.bincount(owner, minlength=len(left))
            total = np.zeros((len(left), len(self.languages)))
            np.add.at(total, owner, self.grams[n].values(at[at >= 0]))
            hit = times > 0
            out[left[hit]] = TRUST[n] * total[hit] / times[hit, None]
            known[left[hit]] = True
        return out, known


def _padded(word: str, n: int) -> str:
    """A word with its ends marked; single letters come from the word alone, as every word has ends."""
    return f"^{word}$" if n > 1 else word


def _grams(words: Counter[str]) -> dict[int, Counter[str]]:
    out: dict[int, Counter[str]] = {n: Counter() for n in LENGTHS}
    for word, k in words.items():
        for n in LENGTHS:
            padded = _padded(word, n)
            for i in range(len(padded) - n + 1):
                out[n][padded[i : i + n]] += k
    return out


def held_out(doc_id):
    """Documents that no model learns from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, fit_docs: int = FIT_DOCS) -> LanguageModel:
    """Counts words and n-grams of a bounded sample of labelled documents that aren't held out.

    Null texts and languages teach nothing; repeated rows are drawn together and count each time; empty and letterless texts add
    no words; an empty table gives a model without languages; other columns are not read.
    """
    labelled = docs.select("doc_id", "text", "lang").where(F.col("text").isNotNull() & F.col("lang").isNotNull() & ~held_out(F.col("doc_id")))
    sizes = labelled.groupBy("lang").count().collect()  # a row for each language
    languages = sorted(r.lang for r in sizes)
    number = {lang: i for i, lang in enumerate(languages)}
    shares = docs.sparkSession.createDataFrame([(r.lang, number[r.lang], min(1.0, fit_docs / r["count"])) for r in sizes], "lang string, number int, share double")
    draw = F.pmod(F.xxhash64(F.lit(3), "doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))

    def counts(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: dict[int, Counter[str]] = {}

        def rows() -> pa.RecordBatch:
            parts = []
            for lang, c in words.items():
                for n, table in ((0, c), *_grams(c).items()):
                    parts.append((np.full(len(table), lang, np.int32), np.full(len(table), n, np.int32), hashed(list(table)).view(np.int64), np.fromiter(table.values(), np.int64, len(table))))
            words.clear()
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*parts, strict=True)], names=["lang", "n", "key", "k"])

        for frame in batches(frames):
            for text, lang in zip(frame.column(0).to_pylist(), frame.column(1).to_pylist(), strict=True):
                words.setdefault(lang, Counter()).update(_LETTERS.findall(text.lower()))
            if sum(map(len, words.values())) > 200_000:
                yield rows()
        if any(words.values()):
            yield rows()

    sample = labelled.join(F.broadcast(shares), "lang").where(draw < F.col("share")).select("text", "number")
    found = map_arrow(sample, counts, "lang int, n int, key long, k long").groupBy("lang", "n", "key").agg(F.sum("k").alias("k"))
    return build(languages, found.toArrow())  # what the bounded sample counts


def build(languages: list[str], counted: pa.Table) -> LanguageModel:
    """Of the counts (number of the language, length or 0 for words, hash, times), all of them."""
    lang, n, key, k = (counted.column(c).to_numpy() for c in ("lang", "n", "key", "k"))
    scored = {x: Scores.of(key[n == x].view(np.uint64), lang[n == x], k[n == x].astype(float), len(languages)) for x in (0, *LENGTHS)}
    return LanguageModel(languages, scored.pop(0), scored)


class Scorer:
    """Scores texts; what a raw word adds is kept, bounded."""

    def __init__(self, model: LanguageModel):
        self.model, self.rows = model, {}
        self.values = np.zeros((1024, max(1, len(model.languages))))
        self.counted = np.zeros(1024)

    def _learn(self, raw: list[str]) -> None:
        found = [_LETTERS.findall(t) for t in raw]
        first = len(self.rows)
        while first + len(raw) > len(self.values):
            self.values = np.concatenate((self.values, np.zeros_like(self.values)))
            self.counted = np.concatenate((self.counted, np.zeros_like(self.counted)))
        self.values[first : first + len(raw)] = self.counted[first : first + len(raw)] = 0
        if flat := [w for own in found for w in own]:
            scores, known = self.model.score(flat)
            owner = first + np.repeat(np.arange(len(raw)), [len(own) for own in found])
            np.add.at(self.values, owner, scores)
            np.add.at(self.counted, owner, known)
        self.rows.update(zip(raw, range(first, first + len(raw)), strict=True))

    def score(self, text: str | None) -> tuple[str, float]:
        """Language and posterior: a softmax of the summed scores, tempered by the root of the number of words."""
        if not text or not self.model.languages or not any(map(str.isalpha, text)):
            return "und", 0.0
        seen = Counter(text.lower().split())
        if len(self.rows) * len(self.model.languages) > KEPT:
            self.rows = {}
        if new := [t for t in seen if t not in self.rows]:
            self._learn(new)
        at = np.fromiter(map(self.rows.__getitem__, seen), np.int64, len(seen))
        times = np.fromiter(seen.values(), np.float64, len(seen))
        n = float(times @ self.counted[at])
        if not n:
            return self.model.languages[0], 1.0 / len(self.model.languages)
        total = times @ self.values[at] / math.sqrt(n)
        best = int(total.argmax())
        return self.model.languages[best], float(1 / np.exp(total - total[best]).sum())


def predict(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every whole text; und and 0 where it is null or has no letter.

    Repeated rows and null doc_ids stay (a null one isn't held out), an empty table gives none, other columns are left out;
    a model without languages knows none. Equal scores go to the first language by name.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def rows(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for frame in batches(frames):
            got = [scorer.score(t) for t in frame.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([frame.column(0), frame.column(1), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string").alias("text"))
    return map_arrow(given, rows, "doc_id long, held_out boolean, lang_pred string, score double")


def confident(docs: DataFrame, model: LanguageModel, least: float = 0.5) -> DataFrame:
    """The documents whose language is told with a score of `least` or more, with all their columns, whatever their names.

    Null texts and those without a letter go; repeated rows and null doc_ids are judged by their text alone; an empty table gives none.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def rows(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for frame in batches(frames):
            keep = []
            for text in frame.column(at).to_pylist():
                lang, score = scorer.score(text)
                keep.append(lang != "und" and score >= least)
            yield frame.filter(pa.array(keep, pa.bool_()))

    return map_arrow(docs, rows, docs.schema)
