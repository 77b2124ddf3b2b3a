import itertools
import random
import zlib

import numpy as np

from wirespark.llm.language import Labeller, LanguageModel, op5_language_id, viterbi

EN, DE, RU = "the house of and with water morning".split(), "das haus und mit wasser morgen für".split(), "дом вода утро это как если хлеб".split()


def test_viterbi_against_all_paths():
    rng = np.random.default_rng(1)
    docs = [rng.normal(size=(n, 3)) * 3 for n in (0, 1, 5, 2, 6, 5)]
    for scores, path in zip(docs, viterbi(docs, 2.0)):
        n = len(scores)
        value = lambda p: sum(scores[t, k] for t, k in enumerate(p)) - 2.0 * sum(a != b for a, b in zip(p, p[1:]))  # noqa: E731,B023
        assert len(path) == n
        if n:
            assert abs(value(path.tolist()) - max(map(value, itertools.product(range(3), repeat=n)))) < 1e-9


def test_spans_of_mixed_text_and_scripts():
    model = LanguageModel([(lang, w, 30) for lang, words in (("en", EN), ("de", DE), ("ru", RU)) for w in words])
    text = " ".join(EN + DE * 2 + RU + EN)
    assert [x[2] for x in Labeller(model).spans(text)] == ["en", "de", "ru", "en"]
    assert model.score("ёлка").argmax() == model.languages.index("ru")
    assert Labeller(model).label(["", "12 -- 9", "Вода 12"]) == [("und", 0.0), ("und", 0.0), ("ru", 1.0)]
    assert Labeller(LanguageModel([])).label(["text"]) == [("und", 0.0)]


def test_query(spark, tables):
    random.seed(1)
    rows = []
    for i in range(300):
        lang, words = random.choice([("en", EN), ("de", DE), ("ru", RU)])
        rows.append((i, " ".join(random.choices(words, k=random.choice([3, 30]))).capitalize(), lang, 0.5))
    rows += [(400, None, "en", 0.5), (401, "", None, 0.5), (402, "?! 12", "de", 0.5), (403, "haus " * 40_000, None, 0.5), (5, rows[5][1], rows[5][2], 0.1)]
    tables.make("documents", rows, "doc_id long, text string, lang string, score double")
    got = op5_language_id(spark, tables).collect()
    assert sorted(r.doc_id for r in got) == sorted(r[0] for r in rows)
    by = {r.doc_id: r for r in got}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in got)
    assert np.mean([by[i].lang_pred == lang for i, _, lang, _ in rows[:300]]) > 0.98
    assert [by[i].lang_pred for i in (400, 401, 402, 403)] == ["und", "und", "und", "de"]
    tables.make("documents", [], "doc_id long, text string, lang string")
    assert op5_language_id(spark, tables).count() == 0
    tables.make("documents", [(1, "text", None)], "doc_id long, text string, lang string")
    assert op5_language_id(spark, tables).first().lang_pred == "und"


def test_rows_without_an_id(spark, tables):
    tables.make("documents", [(None, "some words here", "en"), (None, None, None), (1, "some words here", "en")], "doc_id long, text string, lang string")
    assert sorted(str(r.doc_id) for r in op5_language_id(spark, tables).collect()) == ["1", "None", "None"]
