import random

import corpus_pipeline
import pytest
from tests.llm.test_minhash import brute
from tests.llm.test_packing import check
from tests.llm.test_quality import base

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row int, score double"


@pytest.fixture
def corpus(tables):
    random.seed(5)
    words = [f"w{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(240):
        text = random.choices(words, k=random.choice([8, 40, 120]))
        if i % 8 == 0:
            text[3:5] = ["vilest", "scumlike"]
        if i % 10 == 1:
            text = [f"{w}&&&" for w in text]
        rows.append((i, " ".join(text)))
        labels.append((i, int(i % 10 != 1), int(i % 8 == 0)))
    rows += [(300 + k, rows[2 * k + 2][1]) for k in range(12)]
    rows += [(330 + k, rows[2 * k + 2][1] + " tail") for k in range(12)]
    rows += [(400, None), (401, ""), (402, rows[7][1]), (7, rows[7][1])]
    tables.make("documents", [(i, t, "en", "s", len(t or ""), 1, 0.5) for i, t in rows], SCHEMA)
    tables.make("labels", labels, "doc_id long, quality int, toxic int")
    return tables


def test_stages(spark, corpus):
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, corpus)
        assert out.columns == columns
        before, after = [(r.doc_id, r.text) for r in docs.collect()], [(r.doc_id, r.text) for r in out.collect()]
        assert not [x for x in after if x not in before]
        seen[name] = before, after
        out.write.parquet(f"{corpus}/{name}")
        docs = spark.read.parquet(f"{corpus}/{name}")
    before, after = seen["toxicity"]
    bad = [x for x in before if "vilest" in (x[1] or "")]
    assert not set(bad) & set(after) and sorted(map(str, after + bad)) == sorted(map(str, before))
    before, after = seen["quality_rules"]
    assert not [x for x in after if base(x[1])[-1]]
    assert {x for x in before if not base(x[1])[-1] and "&&&" not in x[1] and len(x[1].split()) > 30} <= set(after)
    before, after = seen["minhash_dedup"]
    assert sorted(after) == sorted({(i, t) for (i, _, _, kept), (_, t) in zip(brute(sorted(before), 5, 80), sorted(before)) if kept})
    got = corpus_pipeline.STAGES[-1][1](spark, docs, corpus).collect()
    check(after, got)
    whole = corpus_pipeline.run(spark, corpus).collect()
    key = lambda r: (r.doc_id, r.piece, r.start, r.length, r.ids_crc32)
    assert sorted(map(key, whole)) == sorted(map(key, got))


def test_empty(spark, tables):
    tables.make("documents", [], SCHEMA)
    tables.make("labels", [], "doc_id long, quality int, toxic int")
    assert corpus_pipeline.run(spark, tables).count() == 0


def test_quality_stage_counts_every_trusted_document(spark, tables, monkeypatch):
    import corpus_pipeline
    from wirespark.llm import quality

    n, seen, ratios = 20_500, [], quality.log_ratios
    monkeypatch.setattr(quality, "log_ratios", lambda corpus, wanted: seen.append(sum(wanted)) or ratios(corpus, wanted))
    words = " ".join(f"w{k}" for k in range(19))
    docs = spark.range(n).selectExpr("id doc_id", f"concat('{words} n', id % 7) text", "id * 2 other")
    spark.range(n).selectExpr("id doc_id", "1 quality", "0 toxic").write.parquet(f"{tables}/labels.parquet")
    kept = corpus_pipeline.quality_rules(spark, docs, str(tables))
    assert kept.columns == docs.columns and kept.count() == kept.filter("other = 2 * doc_id").count() == n
    assert seen[0] == 39 * n == seen[1] + seen[2]  # 20 words and 19 pairs of each: all the target, and its halves


def test_toxicity_stage_learns_from_every_labelled_document(spark, tables):
    """An expression that only documents beyond the first 4000 of their class show is learned."""
    from pyspark.sql import functions as F

    n = 4400
    late = [r.id for r in spark.range(n).orderBy(F.xxhash64("id"), "id").collect()[4000:]]
    words = [f"w{k}ab"[::-1] for k in range(200)]
    rng = random.Random(4)
    text = lambda *more: " ".join(rng.sample([*rng.choices(words, k=12), *more], 12 + len(more)))
    rows = [(i, text("scumlike" if i in set(late) else "vilest")) for i in range(n)] + [(i, text()) for i in range(n, 2 * n)]
    asked = [(2 * n + i, text("scumlike", "scumlike")) for i in range(40)] + [(3 * n + i, text()) for i in range(40)]
    tables.make("documents", rows + asked, "doc_id long, text string")
    tables.make("labels", [(i, 1, int(i < n)) for i in range(2 * n)], "doc_id long, quality int, toxic int")
    kept = {r.doc_id for r in corpus_pipeline.toxicity_filter(spark, spark.read.parquet(f"{tables}/documents.parquet"), str(tables)).collect()}
    assert not kept & {i for i, _ in asked[:40]} and {i for i, _ in asked[40:]} <= kept
