"""Operator 4: toxicity by class-conditional Kneser-Ney models.

Each class, toxic and ordinary, has a Kneser-Ney model of the letters of words (ORDER letters at most). Only the highest
order is counted by class; all lower orders are one shared model of continuation counts over both classes, so an
expression that is rare in both falls back to the same probability and says nothing, while its stem still can. A word's
two log-likelihoods differ by its letters' log ratios; they are kept in a memo, so each distinct word is scored once.

A document compares the length-normalised log-likelihoods of its whole text, and of its most suspect passages: with RATE
of its words from the toxic model, the log-likelihood ratio of the mixture. A logistic curve, fitted on the training
documents, turns them into a score from 0 to 1.

Fitted on all labelled documents outside the held-out folds, or on at most so many of each class, the first by hash of
the id: op4_toxicity asks for MOST, the pipeline for all. Every document is scored over its whole text.

Defined results: null and empty texts have no words and the score of no evidence; a word is a run of letters, marks and
digits, lower-cased; repeated rows are scored alike (in training, a document's labels count once: toxic if any row says
so); without labels of both classes every score is the share of toxic ones, or 0; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wirespark.llm.common import doc_texts, fold, held, release, shared_path, slabs, staged, table, trim, unstaged, without_gc
from wirespark.llm.katz import pack, unpack
from wirespark.llm.storage import open_file, write_file

ORDER = 7
#: Taken off a gram that its class has seen once, twice, three times, oftener. What was seen once is left to the shared model.
DISCOUNTS = (1.0, 1.6, 2.0, 2.4)
MOST = 4000
RATE = 0.02
THRESHOLD = 0.3
WORD = re.compile(r"\w+")
EDGE = "\0"


class ToxicModel:
    """Log ratios of letter grams, and of contexts for grams that neither class has; arrays in the order of their keys."""

    def __init__(self, words: list[str], counts: np.ndarray, order: int = ORDER):
        """counts: for each word its occurrences in ordinary and in toxic documents."""
        self.order = order
        self._fit(*self.top(words, counts, order))

    def _fit(self, grams: list[np.ndarray], top: list[np.ndarray]) -> None:
        below = shared_backoff(grams[1:])  # of what follows a gram's first letter
        context = _keys(grams[:-1])
        contexts, of_gram = np.unique(context, return_inverse=True)
        p, rest = [], []
        for c in (0, 1):
            off = np.where(top[c] > 0, np.array(DISCOUNTS)[np.clip(top[c], 1, len(DISCOUNTS)).astype(np.int64) - 1], 0.0)
            total = np.bincount(of_gram, top[c], len(contexts))
            share = np.where(total > 0, np.bincount(of_gram, off, len(contexts)) / np.maximum(total, 1), 1.0)
            rest.append(share)
            p.append((top[c] - off) / np.maximum(total[of_gram], 1) + share[of_gram] * below)
        keys = _keys(grams)
        by = np.argsort(keys)
        self.grams = keys[by], np.log(p[1] / p[0])[by]
        self.contexts = contexts, np.log(rest[1] / rest[0])

    @staticmethod
    def of_grams(columns: list[np.ndarray], counts: np.ndarray) -> ToxicModel:
        """The model of grams of the highest order, as columns of letters, with their occurrences in either class."""
        model = ToxicModel.__new__(ToxicModel)
        model.order = len(columns)
        model._fit(*_merged(columns, counts))
        return model

    @staticmethod
    def top(words: list[str], counts: np.ndarray, order: int = ORDER) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """The distinct grams of the highest order as columns of letters, and how often each class has them."""
        if not words:
            return [np.zeros(0, np.uint32) for _ in range(order)], [np.zeros(0), np.zeros(0)]
        columns, ends = _letters(words, order)
        return _merged([x[ends] for x in columns], np.repeat(counts, np.fromiter(map(len, words), np.int64, len(words)) + 1, 0))

    def word_ratios(self, words: list[str]) -> np.ndarray:
        """log(toxic / ordinary) of each word, over its letters and its end."""
        if not words or not len(self.grams[0]):
            return np.zeros(len(words))
        columns, ends = _letters(words, self.order)
        columns = [x[ends] for x in columns]
        value = _found(*self.grams, _keys(columns))
        unseen = np.flatnonzero(np.isnan(value))
        value[unseen] = np.nan_to_num(_found(*self.contexts, _keys([x[unseen] for x in columns[:-1]])))
        sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
        return np.add.reduceat(value, np.cumsum(sizes) - sizes)

    def arrays(self) -> bytes:
        return pack(*self.grams, *self.contexts)

    @staticmethod
    def of_arrays(data: bytes, order: int = ORDER) -> ToxicModel:
        model = ToxicModel.__new__(ToxicModel)
        model.order, (a, b, c, d) = order, unpack(data)
        model.grams, model.contexts = (a, b), (c, d)
        return model


def shared_backoff(grams: list[np.ndarray], discount: float = 0.75) -> np.ndarray:
    """Interpolated Kneser-Ney of both classes together: the probability of each gram's last letter after those before it,
    by the number of different grams one letter longer that end in it, and so on for its own end down to single letters.

    grams: columns of letters, one gram for each distinct longer gram of the classes.
    """
    if not len(grams):
        return np.zeros(0)
    keys, first, which, seen = np.unique(_keys(grams), return_index=True, return_inverse=True, return_counts=True)
    own = [x[first] for x in grams]
    below = shared_backoff(own[1:], discount) if len(own) > 1 else np.full(len(keys), 1.0 / (len(keys) + 1))
    _, of_gram = np.unique(_keys(own[:-1]) if len(own) > 1 else np.zeros(len(keys), np.uint64), return_inverse=True)
    total, types = np.bincount(of_gram, seen), np.bincount(of_gram)
    p = (np.maximum(seen - discount, 0) + discount * types[of_gram] * below) / total[of_gram] if len(keys) else below
    return p[which]


def _letters(words: list[str], order: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Letters at each place and the order - 1 places after it, and the places where a letter or the end of a word comes last."""
    pad = EDGE * (order - 1)
    codes = np.frombuffer((pad.join(["", *words]) + pad).encode("utf-32-le", "surrogatepass"), np.uint32)
    n = len(codes) - order + 1
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    starts = np.cumsum(sizes + order - 1) - sizes - order + 1
    ends = np.repeat(starts - (np.cumsum(sizes + 1) - sizes - 1), sizes + 1) + np.arange(int((sizes + 1).sum()))
    return [codes[k : n + k] for k in range(order)], ends


def _merged(columns: list[np.ndarray], counts: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Each gram once, in the order of the keys, and its occurrences in either class."""
    keys, first, which = np.unique(_keys(columns), return_index=True, return_inverse=True)
    return [x[first] for x in columns], [np.bincount(which, counts[:, c], len(keys)) for c in (0, 1)]


def _keys(columns) -> np.ndarray:
    x = np.zeros(len(columns[0]), np.uint64)
    for c in columns:
        x = (x ^ c.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(29)
    return x


def _found(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    if not len(keys):
        return np.full(len(wanted), np.nan)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, values[at], np.nan)


class Scorer:
    """Features of texts; words' ratios in a bounded memo."""

    def __init__(self, model: ToxicModel, most: int = 200_000):
        self.model, self.most = model, most
        self.memo: dict[str, float] = {}

    def features(self, texts: list[str]) -> np.ndarray:
        out = []
        for group in slabs(texts, 1 << 18):
            words = [WORD.findall(x.lower()) for x in group]
            memo = self.memo
            new = list({w for doc in words for w in doc if w not in memo})
            fresh = dict(zip(new, self.model.word_ratios(new).tolist()))
            if len(memo) + len(new) > self.most:
                keep = fresh
                values = [np.array([memo[w] if w in memo else keep[w] for w in doc]) for doc in words]
            else:
                memo.update(fresh)
                values = [np.fromiter(map(memo.__getitem__, doc), np.float64, len(doc)) for doc in words]
            out += [self.of_words(x) for x in values]
        return np.array(out).reshape(-1, 4)

    @staticmethod
    def of_words(ratios: np.ndarray) -> tuple[float, float, float, float]:
        """1, mean ratio, mixture ratio (bounded), and the best word's ratio."""
        if not len(ratios):
            return 1.0, 0.0, 0.0, 0.0
        mixture = np.log1p(RATE * np.expm1(np.minimum(ratios, 30.0))).sum()
        return 1.0, float(ratios.mean()), float(np.clip(mixture, -20, 20)), float(min(ratios.max(), 20.0))


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 0.05) -> np.ndarray:
    """Newton's method with a ridge that leaves the constant free."""
    scale = np.maximum(np.sqrt((weight[:, None] * x**2).sum(0) / weight.sum()), 1e-6)
    z, w = x / scale, np.zeros(x.shape[1])
    penalty = ridge * np.diag([1e-3] + [1.0] * (x.shape[1] - 1))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (weight * p * (1 - p))[:, None]).T @ z + penalty + 1e-9 * np.eye(len(w)), z.T @ (weight * (y - p)) - penalty @ w)
        w += np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-8:
            break
    return w / scale


def sample_of(labels: DataFrame, held_out: Column, most: int | None = MOST) -> tuple[DataFrame, dict[int, int]]:
    """doc_id, toxic of the labelled documents outside held_out, at most `most` of each class if given, and how many there are in all."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter("doc_id is not null and toxic in (0, 1)")
    known = known.filter(~held_out).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sizes = {r.toxic: r["count"] for r in known.groupBy("toxic").count().collect()}
    if most is None:
        return known.hint("shuffle_hash"), sizes
    part = lambda c: known.filter(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    return F.broadcast(part(0).unionByName(part(1))), sizes  # at most 2 * most rows of two numbers


def train(docs: DataFrame, labels: DataFrame, held_out: Column, most: int | None = MOST) -> tuple[str | None, np.ndarray]:
    """Count the words of the labelled documents by class, make the models of four fifths, fit the curve on the rest.

    Words are counted, cut into grams and these counted by all executors; the distinct grams meet in one task. Gives the
    file of the model in the shared folder (None if there is nothing to learn from) and the weights of the curve; the model
    doesn't pass the driver, four numbers for each document of the last fifth do.
    """
    spark = docs.sparkSession
    sample, sizes = sample_of(labels, held_out, most)
    chosen = staged(doc_texts(docs).join(sample, "doc_id").dropDuplicates(["doc_id", "text"]), "toxicity-sample").withColumn("fit", fold("doc_id", 5) != 0)
    path = f"{shared_path(spark, 'toxicity')}/model"

    def count(batches):
        release()
        for batch in batches:
            by: tuple[Counter, Counter] = (Counter(), Counter())
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
                by[toxic].update(WORD.findall(text.lower()))
            rows = [(w, by[0][w], by[1][w]) for w in by[0].keys() | by[1].keys()]
            columns = list(zip(*rows)) or [()] * 3
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64()))], ["word", "ordinary", "toxic"])

    letters = [f"g{k}" for k in range(ORDER)]

    def cut(batches):
        release()
        for batch in batches:
            grams, top = ToxicModel.top(batch.column("word").to_pylist(), np.stack([np.array(batch.column(k), float) for k in ("ordinary", "toxic")], 1))
            yield pa.record_batch([*(pa.array(x.astype(np.int32)) for x in grams), *(pa.array(x.astype(np.int64)) for x in top)], [*letters, "ordinary", "toxic"])

    def fit(batches):
        release()
        grams, counts = [np.zeros((0, ORDER), np.uint32)], [np.zeros((0, 2))]
        for batch in batches:
            grams.append(np.stack([np.array(batch.column(k)).astype(np.uint32) for k in letters], 1))
            counts.append(np.stack([np.array(batch.column(k), float) for k in ("ordinary", "toxic")], 1))
        columns = list(np.ascontiguousarray(np.concatenate(grams).T))
        n = len(columns[0])
        grams.clear()
        write_file(path, [ToxicModel.of_grams(columns, np.concatenate(counts)).arrays()])
        columns, counts = [], []
        trim()
        yield pa.record_batch([pa.array([n], pa.int64())], ["grams"])

    summed = [F.sum("ordinary").alias("ordinary"), F.sum("toxic").alias("toxic")]
    words = chosen.filter("fit").select("text", "toxic").mapInArrow(count, "word string, ordinary long, toxic long").groupBy("word").agg(*summed)
    grams = words.mapInArrow(cut, f"{', '.join(f'{x} int' for x in letters)}, ordinary long, toxic long").groupBy(*letters).agg(*summed)
    # the distinct grams, far fewer than the words' letters, in one task
    fitted = staged(grams.repartition(1).mapInArrow(fit, "grams long"), "toxicity-fitted")
    share = sizes.get(1, 0) / max(1, sum(sizes.values()))
    prior = float(np.log(max(share, 1e-9) / max(1 - share, 1e-9)))
    if not sizes.get(0) or not sizes.get(1) or fitted.isEmpty():
        return None, np.array([prior, 0.0, 0.0, 0.0])

    def features(batches):
        scorer = scorer_of(path)
        for batch in batches:
            x = scorer.features(batch.column("text").to_pylist())
            yield pa.record_batch([batch.column("toxic"), *(pa.array(x[:, k]) for k in range(1, 4))], ["toxic", "a", "b", "c"])

    rest = chosen.filter("not fit")
    if rest.select("toxic").distinct().count() < 2:  # too few documents for that: the curve is fitted where the models are
        rest = chosen
    got = rest.select("text", "toxic").mapInArrow(features, "toxic int, a double, b double, c double").toArrow().to_pydict()
    unstaged(chosen)
    y = np.array(got["toxic"], float)
    if len(set(got["toxic"])) < 2:
        return None, np.array([prior, 0.0, 0.0, 0.0])
    x = np.stack([np.ones(len(y)), *(np.array(got[k]) for k in "abc")], 1)
    order = np.lexsort((*x.T, y))
    weight = np.where(y == 1, sizes[1] / (y == 1).sum(), sizes[0] / (y == 0).sum())
    return path, _logistic(x[order], y[order], (weight * len(y) / weight.sum())[order])


def scorer_of(path: str) -> Scorer:
    def make():
        file = open_file(path)
        try:
            return Scorer(ToxicModel.of_arrays(file.read()))
        finally:
            file.close()

    return held(("toxicity", path), make)


def scored(rows: DataFrame, model: tuple[str | None, np.ndarray], column: str) -> DataFrame:
    """rows with a column more: the score of `text`. All columns pass; nothing is shuffled."""
    schema = T.StructType([*rows.schema.fields, T.StructField(column, T.DoubleType())])
    at = rows.columns.index("text")
    path, weights = model
    if path is None:
        return rows.withColumn(column, F.lit(float(1 / (1 + np.exp(-np.clip(weights[0], -40, 40))))))

    def run(batches):
        scorer = scorer_of(path)
        for batch in batches:
            x = scorer.features([x or "" for x in batch.column(at).to_pylist()])
            score = 1 / (1 + np.exp(-np.clip(x @ weights, -40, 40)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score, pa.float64())], names=[*batch.schema.names, column])

    return rows.mapInArrow(without_gc(run), schema)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"), fold("doc_id", 4) == 2)
    return scored(doc_texts(docs), model, "score").select(
        "doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted")
    )
