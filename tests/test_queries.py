"""Every registered query against its SQL, on the smallest tables."""

import math
import os

import duckdb
import pytest

from wirespark import plans

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

#: Queries without SQL, and the tests that hold their values, or those of the operator beneath, against something plain.
CHECKED = {
    "agg_carver_stats": "test_plain.py::test_carving", "crv_embedded": "test_plain.py::test_carving", "agg_reasm_stats": "test_plain.py::test_reassembly_totals", "cls_alerts_lib": "test_plain.py::test_alerts",
    "cls_ensemble": "test_plain.py::test_ensemble", "cls_iforest": "test_plain.py::test_forest", "cls_ml": "test_plain.py::test_forest",
    "cls_lof": "test_whole.py::test_lof_searches_all_rows", "jn_lof_knn": "test_whole.py::test_lof_searches_all_rows", "cls_packet_features": "test_plain.py::test_packet_features", "cls_pipeline": "test_plain.py::test_pipeline",
    "cls_vector": "test_plain.py::test_vector", "fn_blake3": "test_plain.py::test_blake3", "fn_merkle": "test_plain.py::test_merkle",
    "fn_hkdf": "test_plain.py::test_quic_keys", "pii_redact_text": "test_plain.py::test_redaction", "snk_case": "test_plain.py::test_case", "tls_fingerprints": "test_plain.py::test_fingerprints",
    "win_ewma": "test_plain.py::test_moving_average", "win_hashchain": "test_plain.py::test_hash_chain",
}

pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="needs the driver's tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    return c


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(round(value, 5) + 0.0)
    return repr(bytes(value) if isinstance(value, bytearray) else value)


@pytest.mark.parametrize("name", sorted(plans.queries()))
def test_query(spark, con, name):
    frame = plans.queries()[name](spark, DIR)
    names = sorted(frame.columns)
    got = sorted(tuple(plain(r[c]) for c in names) for r in frame.collect())
    sql = plans.oracle_sql().get(name)
    if sql is None:
        where, _, test = CHECKED[name].partition("::")  # a query without SQL has a test of its values
        with open(os.path.join(os.path.dirname(__file__), where)) as f:
            assert f"def {test}(" in f.read()
        return
    cursor = con.execute(sql)
    columns = [x[0] for x in cursor.description]
    assert sorted(columns) == names
    at = [columns.index(c) for c in names]
    assert got == sorted(tuple(plain(r[i]) for i in at) for r in cursor.fetchall())
