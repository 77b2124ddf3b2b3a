import math
import random
import zlib
from collections import Counter

import numpy as np

from wirespark.llm.toxicity import DISCOUNTS, EDGE, ORDER, Scorer, ToxicModel, op4_toxicity


class Plain:
    """The same class-conditional model, letter by letter, from counts in dictionaries."""

    def __init__(self, rows, order):
        self.order, self.top = order, (Counter(), Counter())
        for word, *n in rows:
            for gram in self.grams(word):
                for c in (0, 1):
                    if n[c]:
                        self.top[c][gram] += n[c]
        self.types = {order: set(self.top[0]) | set(self.top[1])}
        for n in range(order - 1, 0, -1):
            self.types[n] = {g[1:] for g in self.types[n + 1]}

    def grams(self, word):
        padded = EDGE * (self.order - 1) + word + EDGE
        return [padded[k : k + self.order] for k in range(len(word) + 1)]

    def shared(self, gram):
        """How likely the last letter is after the others, by numbers of different longer grams."""
        if not gram:
            return 1 / (len(self.types[1]) + 1)
        after = Counter(g[-1] for g in self.types[len(gram) + 1] if g[1:-1] == gram[:-1])
        below = self.shared(gram[1:])
        return (max(after[gram[-1]] - 0.75, 0) + 0.75 * len(after) * below) / sum(after.values()) if after else below

    def letter(self, c, gram):
        own = {g: n for g, n in self.top[c].items() if g[:-1] == gram[:-1]}
        if not own:
            return self.shared(gram[1:])
        off = {g: DISCOUNTS[min(n, 4) - 1] for g, n in own.items()}
        kept = own[gram] - off[gram] if gram in own else 0
        return (kept + sum(off.values()) * self.shared(gram[1:])) / sum(own.values())

    def ratio(self, word):
        """Grams that neither class has fall back to the same probability, so their contexts decide."""
        return sum(math.log(self.letter(1, g) / self.letter(0, g)) for g in self.grams(word))


def model(rows, order=ORDER):
    return ToxicModel([r[0] for r in rows], np.array([r[1:] for r in rows], float).reshape(-1, 2), order)


def test_ratios_are_those_of_plain_kneser_ney():
    rows = [("the", 500, 50), ("idiot", 0, 40), ("idiots", 0, 9), ("rare", 1, 0), ("odd", 0, 1), ("house", 200, 20), ("thé", 3, 2), ("a", 7, 0)]
    for order in (2, 3, ORDER):
        plain, fast = Plain(rows, order), model(rows, order)
        words = ["idiot", "the", "idiotic", "zzz", "hous", "thé", "a", "oddest", ""]
        assert np.allclose(fast.word_ratios(words), [plain.ratio(w) for w in words])
        again = ToxicModel.of_arrays(fast.arrays(), order)
        assert np.allclose(again.word_ratios(words), fast.word_ratios(words))
    for gram in ("\0i", "id", "th", "ou"):  # the shared model is a distribution, but for letters never seen
        total = sum(plain.shared(gram + x) for x in plain.types[1]) + plain.shared(gram + "?")
        assert abs(total - 1) < 1e-9


def test_rare_words_say_little():
    one = model([("the", 500, 50), ("idiot", 0, 40), ("idiots", 0, 9), ("rare", 1, 0), ("odd", 0, 1), ("house", 200, 20)])
    got = one.word_ratios(["idiot", "the", "", "idiotic", "zzz"])
    assert got[0] > 3 and abs(got[1]) < 1 and got[3] > 2 and abs(got[4]) < 2.5
    assert np.allclose(one.word_ratios(["zzz", "idiot"]), [got[4], got[0]])
    assert Scorer(one).features(["", "the idiot"]).shape == (2, 4)
    assert model([]).word_ratios(["any"]).tolist() == [0]


def corpus():
    random.seed(2)
    words, bad = [f"w{i}ab"[::-1] for i in range(500)], ["scumlike", "scumish", "vilest", "vilely"]
    rows, labels = [], []
    for i in range(600):
        text = random.choices(words, k=random.choice([5, 40, 300]))
        if i % 5 == 0:
            for _ in range(2 + len(text) // 40):
                text.insert(random.randrange(len(text)), random.choice(bad))
        rows.append((i, " ".join(text).title(), "en", float(i)))
        if i % 3:
            labels.append((i, 1, int(i % 5 == 0)))
    rows += [(1000, None, None, None), (1001, "", "en", 0.0), (1002, "w1ab " * 30_000, "en", 0.0), (7, rows[7][1], "en", 1.0)]
    return rows, labels + [(5, None, None), (None, 1, 1), (10, 1, 1)]


def test_held_out_accuracy_and_odd_rows(spark, tables):
    rows, labels = corpus()
    tables.make("documents", rows, "doc_id long, text string, toxic string, score double")
    tables.make("labels", labels, "doc_id long, quality int, toxic int")
    got = op4_toxicity(spark, tables).collect()
    assert sorted(r.doc_id for r in got) == sorted(r[0] for r in rows)
    by = {r.doc_id: r for r in got}
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3)
    judged = [by[i] for i in range(600) if by[i].held_out]
    assert np.mean([r.predicted == (r.doc_id % 5 == 0) for r in judged]) > 0.97
    assert not by[1000].predicted and not by[1001].predicted


def test_no_labels_and_empty_tables(spark, tables):
    tables.make("documents", [(1, "some text"), (2, None)], "doc_id long, text string")
    tables.make("labels", [], "doc_id long, quality int, toxic int")
    assert [r.predicted for r in op4_toxicity(spark, tables).collect()] == [0, 0]
    tables.make("documents", [], "doc_id long, text string")
    assert op4_toxicity(spark, tables).count() == 0


def test_rows_without_an_id(spark, tables):
    tables.make("documents", [(None, "some words here"), (None, None), (1, "some words here")], "doc_id long, text string")
    tables.make("labels", [(1, 1, 0), (None, None, 1)], "doc_id long, quality int, toxic int")
    assert sorted(str(r.doc_id) for r in op4_toxicity(spark, tables).collect()) == ["1", "None", "None"]
