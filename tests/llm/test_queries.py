"""Queries that SQL can express against their SQL: on the driver's smallest tables, and on odd rows."""

import os

import duckdb
import pytest

from wirespark.llm.queries import oracle_sql, queries

DIR = "/root/testdata/sf0.001"
SOURCES = {"op2_warc": "pages", "op3_exact_topk": "embeddings", "op10_minhash_dedup": "documents"}


def compare(spark, folder, name):
    frame = queries()[name](spark, folder)
    columns = sorted(frame.columns)
    with duckdb.connect() as con:
        con.execute(f"create view {SOURCES[name]} as select * from '{folder}/{SOURCES[name]}.parquet/*.parquet'" if os.path.isdir(f"{folder}/{SOURCES[name]}.parquet") else f"create view {SOURCES[name]} as select * from '{folder}/{SOURCES[name]}.parquet'")
        cursor = con.execute(oracle_sql()[name])
        names = [x[0] for x in cursor.description]
        assert sorted(names) == columns
        want = sorted(str([row[names.index(c)] for c in columns]) for row in cursor.fetchall())
    assert sorted(str([row[c] for c in columns]) for row in frame.collect()) == want
    return want


def test_every_sql_has_a_source():
    assert set(oracle_sql()) == set(SOURCES)


@pytest.mark.skipif(not os.path.isdir(DIR), reason="needs the driver's tables")
@pytest.mark.parametrize("name", sorted(SOURCES))
def test_query(spark, name):
    assert compare(spark, DIR, name)


def test_odd_pages(spark, tables):
    html = [None, "", "é" * 10, "<p>a</p>", "<p>a</p>", "", "x" * 100_000, "é" * 10, None]
    tables.make("pages", [(7 - k, f"u{k}", t) for k, t in enumerate(html)], "page_id long, url string, html string")
    assert len(compare(spark, tables, "op2_warc")) == len(html)


def test_odd_documents(spark, tables):
    base = " ".join(f"w{k}" for k in range(60))
    near = [base.replace("w59", "z"), base.replace("w0 ", "z "), base.replace("w0 ", "z ").replace("w59", "y"), base.replace("w30", "z")]
    texts = [None, "", " \t\n", "a", "A", "a b", "A\x0bb", "a b c", "É é", "é É", base, base.upper(), *near, "q r " * 5000, "q r " * 4000, base + " v"]
    tables.make("documents", [(k * 3, t) for k, t in enumerate(texts)], "doc_id long, text string")
    assert len(compare(spark, tables, "op10_minhash_dedup")) == len(texts)
