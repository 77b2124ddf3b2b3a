import random
import re

from wirespark.llm.quality import bucket_weights, half, op6_quality_rules, scored


def base(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    seen, covered = {}, set()
    for i in range(len(words) - 7):
        seen.setdefault(tuple(words[i : i + 8]), []).append(i)
    for places in seen.values():
        if len(places) > 1:
            covered.update(k for i in places for k in range(i, i + 8))
    failed = len(words) < 20 or 100 * len(covered) > 30 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), failed


def corpus():
    random.seed(7)
    words = [f"wörd{i}" for i in range(300)] + ["a#b", "c|d", " x", "e\x1cf"]
    texts = [random.choice([" ", "\n", " \n", "\t", "\x0b "]).join(random.choices(words, k=random.choice([0, 5, 19, 20, 60, 200]))) for _ in range(150)]
    texts += [t + " " + t for t in texts[:20]] + [(t + "\n") * 3 for t in texts[20:40]] + [" ".join(["same"] * 40), None, "", " \t\n ", "\n lead trail \n", "x " * 30_000]
    texts += [" ".join(f"{w}&&&" for w in t.split()) for t in texts[40:60]]
    return list(enumerate(texts)) + [(3, texts[3])]


def test_against_brute_force(spark, tables):
    rows = corpus()
    tables.make("documents", [(i, t, 1, "w") for i, t in rows], "doc_id long, text string, n_words int, w string")
    tables.make("labels", [(i, int("&&&" not in (t or "")), None) for i, t in rows if i % 2 == 0], "doc_id long, quality int, toxic int")
    got = sorted(op6_quality_rules(spark, tables).collect(), key=lambda r: r.doc_id)
    assert [(r.doc_id, *r[1:7]) for r in got] == [(i, *base(t)) for i, t in sorted(rows, key=lambda r: r[0])]
    junk = {i for i, t in rows if "&&&" in (t or "")}
    assert all(not r.kept for r in got if r.base_failed)
    limits = [max((r.score for r in got if not r.base_failed and not r.kept), default=-9), min(r.score for r in got if r.kept)]
    assert limits[0] < limits[1] and limits[0] < -0.06
    scores = [[r.score for r in got if (r.doc_id in junk) == x and r.n_words >= 60 and (x or r.doc_id < 150)] for x in (True, False)]
    assert max(scores[0]) < min(scores[1])


def test_score_is_the_mean_log_ratio(spark):
    docs = spark.createDataFrame([(1, "good good words"), (2, "bad bad words"), (3, "")], "doc_id long, text string")
    trusted = spark.createDataFrame([(1,)], "doc_id long")
    weights = bucket_weights(docs, trusted)
    by = {r.doc_id: r for r in scored(docs, weights).collect()}
    hashed = spark.sql("select xxhash64('good') g, xxhash64('words') w, xxhash64(xxhash64('good'), xxhash64('good')) gg, xxhash64(xxhash64('good'), xxhash64('words')) gw").first()
    want = sum(weights[x % len(weights)] for x in (hashed.g, hashed.g, hashed.w, hashed.gg, hashed.gw)) / 5
    assert abs(by[1].score - want) < 1e-6 and by[1].score > by[2].score and by[3].score == 0


def test_empty_tables(spark, tables):
    tables.make("documents", [], "doc_id long, text string")
    tables.make("labels", [], "doc_id long, quality int, toxic int")
    assert op6_quality_rules(spark, tables).count() == 0
    tables.make("documents", [(1, "many words " * 30)], "doc_id long, text string")
    assert op6_quality_rules(spark, tables).first().score == 0


def test_rows_without_an_id(spark, tables):
    tables.make("documents", [(None, "some words here"), (None, None), (1, "some words here")], "doc_id long, text string")
    tables.make("labels", [(1, 1, 0), (None, None, 1)], "doc_id long, quality int, toxic int")
    assert sorted(str(r.doc_id) for r in op6_quality_rules(spark, tables).collect()) == ["1", "None", "None"]


def test_every_trusted_document_counts(spark, tables):
    """Score and verdict against plain counts over more trusted documents than a bounded sample would hold."""
    import math
    from collections import Counter

    import numpy as np

    from wirespark.llm.quality import BUCKETS, LOWEST, MARGIN, PRIOR, THRESHOLD

    rng = random.Random(5)
    words = [f"w{i}" for i in range(24)]
    rows = [(i, rng.choices(words, weights=[1 + (j + i // 8000) % 6 for j in range(24)] if i % 9 else [1] * 23 + [9], k=rng.choice([22, 30]))) for i in range(23_000)]
    good = {i for i, _ in rows if i % 10}  # 20,700
    tables.make("documents", [(i, " ".join(w)) for i, w in rows], "doc_id long, text string")
    tables.make("labels", [(i, int(i in good), 0) for i, _ in rows], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in op6_quality_rules(spark, tables).collect()}

    one = spark.createDataFrame([(w,) for w in words], "a string")
    hashed = {(r.a,): r.h % BUCKETS for r in one.selectExpr("a", "xxhash64(a) h").collect()}
    pairs = one.crossJoin(one.withColumnRenamed("a", "b"))
    hashed |= {(r.a, r.b): r.h % BUCKETS for r in pairs.selectExpr("a", "b", "xxhash64(xxhash64(a), xxhash64(b)) h").collect()}
    halves = {r.doc_id: r.h for r in spark.range(23_000).withColumnRenamed("id", "doc_id").select("doc_id", half().alias("h")).collect()}
    grams = {i: [hashed[(x,)] for x in w] + [hashed[x] for x in zip(w, w[1:])] for i, w in rows}
    corpus, target = Counter({b: 1 for b in range(BUCKETS)}), [Counter(), Counter()]
    for i, g in grams.items():
        corpus.update(g)
        if i in good:
            target[halves[i]].update(g)
    total = sum(corpus.values())

    def weights(wanted):
        own = sum(wanted.values())
        return np.array([math.log((wanted[b] + PRIOR * corpus[b] / total) / (own + PRIOR) / (corpus[b] / total)) for b in range(BUCKETS)])

    by, crossed = weights(target[0] + target[1]), [weights(target[1]), weights(target[0])]
    score = {i: by[g].mean() for i, g in grams.items()}
    assert max(abs(got[i].score - x) for i, x in score.items()) < 1e-8
    least = np.percentile([crossed[halves[i]][grams[i]].mean() for i in good if not got[i].base_failed], 100 * LOWEST)
    limit = min(THRESHOLD, least - MARGIN)
    assert all(got[i].kept == (not got[i].base_failed and x >= limit) for i, x in score.items() if abs(x - limit) > 2e-4)
