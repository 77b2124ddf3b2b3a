"""Operator 5: language spans of mixed text.

The scripts of a word's letters narrow the languages that may have written it. Each word has a log-likelihood for each
language, from its own frequency where it was learned and from its letter grams otherwise; Viterbi, with a penalty for
each switch, labels every word of the text, so spans in other languages are found. A document's language is the one with
the most letters, its score the share of them. Words' scores are kept in a bounded memo, and the paths of many documents
advance together, one word at a time.

Fitted on a bounded sample of documents of the training folds: at most MOST of each language, the first by hash of the
id. Every document is labelled over its whole text.

Defined results: null text and text without a letter are `und` with score 0, and so is all text if no language was
learned; ties go to the language first in order; repeated rows are labelled alike; an empty table gives no rows; other
columns are ignored. Digits and marks between letters belong to no language.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wirespark.llm.common import doc_texts, fold, release, slabs, staged, table, without_gc

MOST = 1500
GRAM = 3
#: Nats for a switch of language between two words.
SWITCH = 8.0
#: A word's evidence is bounded, so that one odd word doesn't make a span.
BOUND = 6.0
WORD = re.compile(r"[^\W\d_]+")
UNDETERMINED = "und"
_BLOCK_LETTERS: dict[int, str] = {}


def script(word: str) -> str:
    """The script of a word's first letter, by the first word of its Unicode name (LATIN, CYRILLIC, GREEK, CJK, ...)."""
    letter = word[0]
    if letter < "ɐ":
        return "LATIN"
    if ord(letter) not in _BLOCK_LETTERS:
        if len(_BLOCK_LETTERS) > 50_000:
            _BLOCK_LETTERS.clear()
        _BLOCK_LETTERS[ord(letter)] = unicodedata.name(letter, "UNKNOWN").split()[0]
    return _BLOCK_LETTERS[ord(letter)]


class LanguageModel:
    """For each language: words learned often, letter grams, and scripts."""

    def __init__(self, counts: list[tuple[str, str, int]]):
        """counts: language, word, occurrences."""
        self.languages = sorted({x for x, _, _ in counts})
        place = {x: k for k, x in enumerate(self.languages)}
        n = len(self.languages)
        words: dict[str, np.ndarray] = {}
        grams: dict[str, np.ndarray] = {}
        scripts: dict[str, np.ndarray] = {}
        for language, word, many in sorted(counts):
            k = place[language]
            words.setdefault(word, np.zeros(n))[k] += many
            scripts.setdefault(script(word), np.zeros(n))[k] += many
            for gram in self._grams(word):
                grams.setdefault(gram, np.zeros(n))[k] += many
        totals = sum(words.values(), np.zeros(n))
        gram_totals = sum(grams.values(), np.zeros(n))
        self.scripts = {s: x > 0.001 * np.maximum(totals, 1) for s, x in scripts.items()}
        each = np.log(gram_totals + 0.5 * len(grams) + 1)
        self.grams = {g: np.log(x + 0.5) - each for g, x in grams.items()}
        self.no_gram = np.log(0.5) - each
        often = [w for w, x in words.items() if x.sum() >= 20]
        self.words = {w: self._bounded(np.log(words[w] + 0.5) - np.log(totals + 0.5 * len(words) + 1)) for w in often}

    @staticmethod
    def _grams(word: str) -> list[str]:
        padded = f"\0{word}\0"
        return [padded[k : k + GRAM] for k in range(len(padded) - GRAM + 1)] or [padded]

    @staticmethod
    def _bounded(x: np.ndarray) -> np.ndarray:
        return np.maximum(x - x.max(initial=-np.inf), -BOUND)

    def score(self, word: str) -> np.ndarray:
        """Log-likelihoods less the best; languages that don't use the script get the bound."""
        known = self.words.get(word)
        if known is None:
            x = sum((self.grams.get(g, self.no_gram) for g in self._grams(word)), np.zeros(len(self.languages)))
            known = self._bounded(x)
        fits = self.scripts.get(script(word))
        if fits is not None and fits.any() and not fits.all():
            known = self._bounded(np.where(fits, known, known[fits].max() - BOUND))
        return known


def viterbi(scores: list[np.ndarray], switch: float = SWITCH) -> list[np.ndarray]:
    """The best path of each document; documents advance together, the longest first."""
    order = sorted(range(len(scores)), key=lambda i: -len(scores[i]))
    sizes = np.array([len(scores[i]) for i in order], np.int64)
    if not len(sizes) or not sizes[0]:
        return [np.zeros(len(x), np.int64) for x in scores]
    width, n = scores[0].shape[1], int(sizes[0])
    active = np.searchsorted(-sizes, -np.arange(n), side="left")  # documents longer than t
    starts = np.concatenate([[0], np.cumsum(active)])
    flat = np.empty((int(starts[-1]), width))  # all first words, all second words, ...
    for row, i in enumerate(order):
        flat[starts[: sizes[row]] + row] = scores[i]
    stay = np.empty((int(starts[-1]), width), bool)  # True: from the same language, else from the best one
    best_before = np.zeros(int(starts[-1]), np.int8 if width < 128 else np.int32)
    total = flat[: active[0]].copy()
    ends = np.empty((len(order), width))
    for t in range(1, n + 1):
        now = int(active[t]) if t < n else 0
        ends[now : len(total)] = total[now:]
        if not now:
            break
        total = total[:now]
        best = total.argmax(1)
        jump = total[np.arange(now), best] - switch
        at = slice(int(starts[t]), int(starts[t]) + now)
        keep = total >= jump[:, None]
        stay[at], best_before[at] = keep, best
        total = np.where(keep, total, jump[:, None]) + flat[at]
    out = [np.zeros(0, np.int64)] * len(scores)
    paths = np.empty(int(starts[-1]), np.int64)
    current = np.full(len(order), -1, np.int64)
    for t in range(n - 1, -1, -1):
        now = int(active[t])
        fresh = slice(int(active[t + 1]) if t + 1 < n else 0, now)
        current[fresh] = ends[fresh].argmax(1)
        at = int(starts[t]) + np.arange(now)
        paths[at] = current[:now]
        if t:
            current[:now] = np.where(stay[at, current[:now]], current[:now], best_before[at])
    for row, i in enumerate(order):
        out[i] = paths[starts[: sizes[row]] + row]
    return out


class Labeller:
    def __init__(self, model: LanguageModel, most: int = 400_000):
        self.model, self.most = model, most
        self._reset()

    def _reset(self) -> None:
        self.memo: dict[str, int] = {}
        self.table = np.zeros((1024, max(1, len(self.model.languages))))
        self.letters = np.zeros(1024, np.int64)

    def _number(self, words: list[str]) -> np.ndarray:
        memo = self.memo
        for word in dict.fromkeys([w for w in words if w not in memo]):
            k = len(memo)
            if k == len(self.table):
                self.table, self.letters = (np.concatenate([x, np.zeros_like(x)]) for x in (self.table, self.letters))
            self.table[k], self.letters[k] = self.model.score(word), len(word)
            memo[word] = k
        return np.fromiter(map(memo.__getitem__, words), np.int64, len(words))

    def label(self, texts: list[str]) -> list[tuple[str, float]]:
        out = []
        for group in slabs(texts, 4 << 20):
            out += self._label(group)
        return out

    def spans(self, text: str) -> list[tuple[int, int, str]]:
        """(start, end, language) of each run of words of one language."""
        found = list(WORD.finditer(text))
        if not found or not self.model.languages:
            return []
        path = viterbi([self.table[self._number([m[0].lower() for m in found])]])[0]
        out: list[tuple[int, int, str]] = []
        for m, k in zip(found, path.tolist()):
            name = self.model.languages[k]
            out[-1:] = [(out[-1][0], m.end(), name)] if out and out[-1][2] == name else [*out[-1:], (m.start(), m.end(), name)]
        return out

    def _label(self, texts: list[str]) -> list[tuple[str, float]]:
        if len(self.memo) > self.most:
            self._reset()
        words = [WORD.findall(x.lower()) for x in texts]
        if not self.model.languages:
            return [(UNDETERMINED, 0.0)] * len(texts)
        numbers = [self._number(x) for x in words]
        paths = viterbi([self.table[x] for x in numbers])
        out = []
        for x, path in zip(numbers, paths):
            if not len(x):
                out.append((UNDETERMINED, 0.0))
                continue
            by = np.bincount(path, weights=self.letters[x], minlength=len(self.model.languages))
            best = int(by.argmax())
            out.append((self.model.languages[best], float(by[best] / by.sum())))
        return out


def train(docs: DataFrame, held_out: Column, most: int = MOST) -> LanguageModel:
    from pyspark.sql import Window

    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang")).filter("doc_id is not null and lang is not null").filter(~held_out)
    known = known.groupBy("doc_id").agg(F.min("lang").alias("lang"))
    languages = sorted(r.lang for r in known.select("lang").distinct().collect())  # as many rows as there are languages
    part = [known.filter(F.col("lang") == x).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most) for x in languages]
    if not part:
        return LanguageModel([])
    sample = part[0]
    for more in part[1:]:
        sample = sample.unionByName(more)
    sample = staged(sample, "language-sample")  # at most `most` rows of each language
    chosen = doc_texts(docs).join(F.broadcast(sample), "doc_id")

    def count(batches):
        for batch in batches:
            by: Counter = Counter()
            for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist()):
                by.update((lang, w) for w in WORD.findall(text.lower()))
            yield pa.record_batch([pa.array([k[0] for k in by], pa.string()), pa.array([k[1] for k in by], pa.string()), pa.array(list(by.values()), pa.int64())], ["lang", "word", "n"])

    counts = chosen.select("lang", "text").mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    got = counts.toArrow().to_pydict()
    return LanguageModel(list(zip(got["lang"], got["word"], got["n"])))


def labelled(rows: DataFrame, model: LanguageModel) -> DataFrame:
    """doc_id, lang_pred, score."""
    shared = rows.sparkSession.sparkContext.broadcast(model)  # its size is bounded by the sample

    def run(batches):
        release()
        labeller = Labeller(shared.value)
        for batch in batches:
            got = labeller.label(batch.column("text").to_pylist())
            yield pa.record_batch([batch.column("doc_id"), pa.array([x for x, _ in got], pa.string()), pa.array([s for _, s in got], pa.float64())], ["doc_id", "lang_pred", "score"])

    return doc_texts(rows).mapInArrow(without_gc(run), "doc_id long, lang_pred string, score double")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs, fold("doc_id", 3) == 1)
    return labelled(docs, model).select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score")
