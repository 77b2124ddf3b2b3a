"""Registered queries that must read all of their input, on small tables that are longer than any prefix."""

from statistics import fmean, pstdev

import pytest

from wirespark import plans
from wirespark.operators import anomaly


@pytest.fixture
def documents(spark, tmp_path):
    def make(rows):
        spark.createDataFrame(rows, "doc_id long, text string").write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
        return str(tmp_path)

    return make


def test_hexsearch_finds_hits_after_a_prefix(spark, documents):
    rows = [(0, "x" * 5000 + "Th" + "é" * 300 + "tHth"), (1, "th" * 400), (2, ""), (3, "no hit " * 100)]
    got = plans.queries()["flt_hexsearch"](spark, documents(rows)).collect()
    assert {r.doc_id: r.hits for r in got} == {i: sum(t[k : k + 2].lower() == "th" for k in range(len(t))) for i, t in rows}


def test_smb_content_is_classified_by_all_of_it(spark, documents):
    words = ["powershell", "cmd.exe", "wscript", "cscript", "invoke-expression", "downloadstring", "net user", "net localgroup", "mimikatz", "sekurlsa"]
    rows = [(4 * k + 3, "plain text " * 500 + w.upper() + " more") for k, w in enumerate(words)] + [(103, "plain text " * 500)]
    got = {r.doc_id: r.kind for r in plans.queries()["smb_content"](spark, documents(rows)).collect()}
    assert got == {4 * k + 3: f"Suspicious content: {w}" for k, w in enumerate(words)} | {103: None}


@pytest.fixture
def embeddings(spark, tmp_path):
    import numpy as np

    x = np.random.default_rng(2).normal(size=(4500, 12))
    x[10:40] = x[0]  # copies
    x = x.astype("float32").astype(float)
    spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<float>").repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    return str(tmp_path), x


@pytest.mark.parametrize("name,k", [("cls_lof", 20), ("jn_lof_knn", 5)])
def test_lof_searches_all_rows(spark, embeddings, name, k):
    import numpy as np

    d, x = embeddings
    want = anomaly.LocalOutlierFactor(x, k).score(x)
    got = {r.vec_id: r.score for r in plans.queries()[name](spark, d).collect()}
    single = [i for i in range(len(x)) if not 0 <= i < 40]  # which copy is whose neighbour is not defined
    assert len(got) == len(x) and np.allclose([got[i] for i in single], want[single], atol=2e-6)


def test_forest_threshold_is_of_all_rows(spark):
    rows = spark.range(10_000).selectExpr("id * 1.0D / 10000 score")
    assert anomaly.contamination_limit(rows, "score") == 0.9


@pytest.fixture
def long_vectors(spark, tmp_path):
    import numpy as np

    x = np.random.default_rng(3).normal(size=(40, 600)).astype("float32").astype(float)
    x[0], x[1] = 2.5, np.arange(600) == 7  # a constant; one component far from all others
    spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<float>").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    return str(tmp_path), x


def in_seconds(spark, most, run):
    """run(), given up after so many seconds: work that grows with the cube of a vector's length takes many minutes."""
    import threading

    stop = threading.Timer(most, spark.sparkContext.cancelAllJobs)
    stop.start()
    try:
        return run()
    finally:
        stop.cancel()


def test_anomaly_of_long_vectors(spark, long_vectors):
    import numpy as np

    d, x = long_vectors
    got = {r.vec_id: r.is_anomaly for r in in_seconds(spark, 60, lambda: plans.queries()["cls_anom_py"](spark, d).collect())}
    spread = x.std(1, keepdims=True)
    z = np.where(spread > 0, (x - x.mean(1, keepdims=True)) / np.where(spread > 0, spread, 1), 0)
    assert got == {i: bool(np.abs(r).max() > 3) for i, r in enumerate(z)} and not got[0] and got[1]


def test_standardized_long_vectors(spark, long_vectors):
    import numpy as np

    d, x = long_vectors
    got = {r.vec_id: r["first"] for r in in_seconds(spark, 60, lambda: plans.queries()["fn_standardize"](spark, d).collect())}
    assert got.keys() == set(range(len(x))) and got[0] == 0
    assert np.allclose([got[i] for i in range(1, len(x))], (x[1:, 0] - x[1:].mean(1)) / x[1:].std(1), atol=1e-6)


@pytest.fixture
def many_users(spark, tmp_path):
    """Events of users whose numbers, with 40000 added, are more than a port's 16 bits hold."""
    users = [0, 1499, 25_535, 25_536, 89_999, 400_000]
    rows = [(i, f"2024-01-01 00:00:{i:02d}.5", users[i % 6], "view", i / 4, '{"k": %d}' % (i % 7)) for i in range(60)] + [(97, "2024-01-02 00:00:00", 89_999, "view", 1.0, '{"k": 3}')]
    e = spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string, value double, props string")
    e.withColumn("ts", e.ts.cast("timestamp_ntz")).write.parquet(f"{tmp_path}/events.parquet")
    return str(tmp_path)


def as_sql(spark, d, name, table="events"):
    """Rows of the query and of its SQL."""
    import duckdb

    con = duckdb.connect()
    con.execute(f"SET TimeZone = 'UTC'; CREATE VIEW {table} AS SELECT * FROM read_parquet('{d}/{table}.parquet/*.parquet')")
    got = plans.queries()[name](spark, d)
    return sorted(map(str, map(tuple, got.collect()))), sorted(map(str, con.execute(plans.oracle_sql()[name]).fetchall()))


def test_decoding_with_many_users(spark, many_users):
    got, want = as_sql(spark, many_users, "prj_decode_xdp")
    assert got == want and len(got) == 61 and sum("129999" in x for x in got) == 10


def test_packet_features_with_many_users(spark, many_users):
    got = {r.packet_id: r for r in plans.queries()["cls_packet_features"](spark, many_users).collect()}
    assert got.keys() == {*range(60), 97}
    for i, r in got.items():
        k = 3 if i == 97 else i % 7
        head, payload = (20, k) if i % 97 and k % 5 != 2 else (8, k) if i % 97 else (0, 8 + k)
        assert (r.length, r.payload_length, r.ttl, r.ack) == (34 + head + payload, payload, 64 / 255, 1 if head == 20 else None)
        assert i % 97 == 0 or (r.entropy, r.mean) == (0, pytest.approx(120 / 255 if k else 0))


def test_packet_features_of_long_payloads(spark, tmp_path):
    """Mean and deviation are those of the whole payload, not of its beginning."""
    sizes = {0: 0, 97: 248, 194: 249, 291: 1400, 388: 60_000, 5: 1400}
    e = spark.createDataFrame([(i, "2024-01-01 00:00:00", 1, "view", 1.0, '{"k": %d}' % k) for i, k in sizes.items()], "event_id long, ts string, user_id long, event_type string, value double, props string")
    e.withColumn("ts", e.ts.cast("timestamp_ntz")).write.parquet(f"{tmp_path}/events.parquet")
    got = {r.packet_id: r for r in plans.queries()["cls_packet_features"](spark, str(tmp_path)).collect()}
    assert got.keys() == sizes.keys()
    for i, k in sizes.items():
        x = [120] * k if i % 97 else [8, 0, 0, 0, 0, 1, 0, 1] + [120] * k
        assert (got[i].payload_length, got[i].mean, got[i].std) == (len(x), pytest.approx(fmean(x) / 255, abs=1e-9), pytest.approx(pstdev(x) / 255, abs=1e-9))


def test_captures_with_many_users(spark, many_users):
    got, want = as_sql(spark, many_users, "src_pcap")
    assert got == want and 0 < len(got) < 61


@pytest.mark.parametrize("name", ["fn_standardize", "cls_anom_py"])
def test_vectors_without_components_or_with_nulls(spark, tmp_path, name):
    rows = [[], None, [1.0, None, 3.0], [None, 1.0, 2.0], [None, None], [1.0, 2.0, 4.0], [None] + [0.0] * 30 + [9.0]]
    spark.createDataFrame(list(enumerate(rows)), "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got, want = as_sql(spark, str(tmp_path), name, "embeddings")
    assert got == want and len(got) == len(rows)
