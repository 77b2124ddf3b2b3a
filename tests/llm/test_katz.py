import math
import random
import re
import zlib
from collections import Counter

import pytest

from wirespark.llm.katz import MOST_DISCOUNTED, Unigrams, discounts, op8_lm_scoring, score_documents
from pyspark.sql import functions as F


class Plain:
    """The same model, word by word."""

    def __init__(self, rows, held):
        self.rows = [(i, self.tokens(t), held(i)) for i, t in rows]
        train = [t for _, t, h in self.rows if not h]
        self.c = Counter(w for t in train for w in t)
        self.pairs = Counter(p for t in train for p in zip([None, *t], t))
        self.n, self.v = sum(self.c.values()), len(self.c)
        self.hist = Counter(v for v, _ in self.pairs.elements())
        of = lambda c: [sum(x == r for x in c.values()) for r in range(1, MOST_DISCOUNTED + 2)]
        self.d1, self.d2 = discounts(of(self.c)), discounts(of(self.pairs))
        self.after = {}
        for (v, w), n in self.pairs.items():
            self.after.setdefault(v, {})[w] = n

    @staticmethod
    def tokens(text):
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        return [*re.findall(r"[^\x20\x09-\x0D]+", text), "\n"]

    def d(self, table, r):
        return table[r] if r <= MOST_DISCOUNTED else 1.0

    def p1(self, w):
        mass = sum((1 - self.d(self.d1, n)) * n for n in self.c.values())
        if not mass:
            return (self.c[w] or 1) / (self.n + 1)
        return self.d(self.d1, self.c[w]) * self.c[w] / self.n if self.c[w] else mass / self.n

    def p(self, v, w):
        seen = self.after.get(v)
        if not seen:
            return self.p1(w)
        n = self.hist[v]
        left = sum((1 - self.d(self.d2, x)) * x for x in seen.values())
        scale, share = (1 / n, left / n) if any(x <= MOST_DISCOUNTED for x in seen.values()) else (1 / (n + 1), 1 / (n + 1))
        if w in seen:
            return self.d(self.d2, seen[w]) * seen[w] * scale
        return share / (1 - sum(self.p1(x) for x in seen)) * self.p1(w)

    def results(self):
        for i, t, h in self.rows:
            base = sum(math.log10((self.c[w] + 1) / (self.n + self.v + 1)) for w in t)
            yield i, h, len(t), sum(self.c[w] > 0 for w in t), self.n, base, sum(math.log10(self.p(v, w)) for v, w in zip([None, *t], t))


def corpus():
    random.seed(11)
    words = [f"w{k}" for k in range(60)]
    texts = [" ".join(random.choices(words, weights=[1 / (k + 1) for k in range(60)], k=random.choice([0, 1, 8, 50]))).title() for _ in range(120)]
    return list(enumerate(texts)) + [(200, None), (201, " \t "), (202, "É ß \x1c é"), (203, "common pair " * 9000), (204, "unseen words here"), (3, texts[3])]


def held(i):
    return zlib.crc32(str(i).encode()) % 7 == 2


def same(got, want):
    got, want = sorted(map(tuple, got)), sorted(want)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    for a, b in zip(got, want):
        assert a[5:] == pytest.approx(b[5:], rel=1e-9, abs=1e-9)


def test_against_plain_model(spark, tables):
    rows = corpus()
    tables.make("documents", [(*r, True, 5) for r in rows], "doc_id long, text string, held_out boolean, n_tokens int")
    same(op8_lm_scoring(spark, tables).collect(), list(Plain(rows, held).results()))
    tables.make("documents", [(None, "w1 w2"), (1, "w1")], "doc_id long, text string")
    assert {(r.doc_id, r.held_out, r.n_tokens) for r in op8_lm_scoring(spark, tables).collect()} == {(None, False, 3), (1, held(1), 2)}
    tables.make("documents", rows, "doc_id long, text string")
    docs = spark.read.parquet(f"{tables}/documents.parquet").repartition(5)
    many = score_documents(docs, (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7) == 2, block=300, hot_least=20)
    same(many.collect(), list(Plain(rows, held).results()))


def test_every_history_sums_to_one():
    model = Plain(corpus(), held)
    for v in [*list(model.after)[:40], "never"]:
        total = sum(model.p(v, w) for w in model.c) + model.p(v, "an unknown word")
        assert total == pytest.approx(1, abs=1e-9)
    u = Unigrams(model.n, model.v, [sum(x == r for x in model.c.values()) for r in range(1, 7)])
    assert float(u.probability(__import__("numpy").array([0]))[0]) == pytest.approx(model.p1("?"))


def test_nothing_to_learn(spark, tables):
    tables.make("documents", [], "doc_id long, text string")
    assert op8_lm_scoring(spark, tables).count() == 0
    held_only = next(i for i in range(100) if held(i))
    tables.make("documents", [(held_only, "a b")], "doc_id long, text string")
    r = op8_lm_scoring(spark, tables).first()
    assert (r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) == (3, 0, 0, 0.0, 0.0)
