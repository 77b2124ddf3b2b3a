"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

import importlib

#: query name -> (module, function); modules are imported when a query runs.
QUERIES = {
    "op1_byte_bpe": ("wirespark.llm.bpe", "op1_byte_bpe"),
    "op2_warc": ("wirespark.llm.warc", "op2_warc"),
    "op3_exact_topk": ("wirespark.llm.topk", "op3_exact_topk"),
    "op4_toxicity": ("wirespark.llm.toxicity", "op4_toxicity"),
    "op5_language_id": ("wirespark.llm.language", "op5_language_id"),
    "op6_quality_rules": ("wirespark.llm.quality", "op6_quality_rules"),
    "op7_best_fit_packing": ("wirespark.llm.packing", "op7_best_fit_packing"),
    "op8_lm_scoring": ("wirespark.llm.katz", "op8_lm_scoring"),
    "op9_token_binary": ("wirespark.llm.huffman", "op9_token_binary"),
    "op10_minhash_dedup": ("wirespark.llm.minhash", "op10_minhash_dedup"),
}


def _lazy(module: str, function: str):
    return lambda spark, sf_dir: getattr(importlib.import_module(module), function)(spark, sf_dir)


def queries() -> dict:
    return {name: _lazy(*where) for name, where in QUERIES.items()} | {"pipeline": _lazy("corpus_pipeline", "run")}


#: op2: SHA-1 in base32, four characters of five bits from each five hex digits; the smallest page of each payload.
#: op3: component-wise floors and products as integers; each query row against all others.
#: op10: sets of shingles, pairs of different sets by their common shingles, all that is reached from a set.
ORACLE: dict[str, str] = {
    "op2_warc": r"""
        WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
        d AS (SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha1(html) AS s, min(page_id) OVER (PARTITION BY html) AS f FROM p)
        SELECT page_id, payload_bytes,
               array_to_string(list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                   CAST(1 + ((CAST('0x' || substr(s, 1 + 5 * (k // 4), 5) AS BIGINT) >> (15 - 5 * (k % 4))) & 31) AS BIGINT), 1)), '') AS payload_digest,
               CASE WHEN page_id <> f THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id <> f THEN f END AS refers_to
        FROM d
    """,
    "op10_minhash_dedup": r"""
        WITH RECURSIVE w AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
            FROM documents
        ), sets AS (
            SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
                   ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END)) AS s
            FROM w
        ), classes AS MATERIALIZED (
            SELECT min(doc_id) AS id, s, len(s) AS n FROM sets WHERE len(s) > 0 GROUP BY s
        ), members AS MATERIALIZED (SELECT id, n, unnest(s) AS x FROM classes),
        links AS MATERIALIZED (
            SELECT a.id AS a, b.id AS b FROM members AS a JOIN members AS b ON a.x = b.x AND a.id <> b.id AND 100 * a.n >= 85 * b.n AND 100 * b.n >= 85 * a.n
            GROUP BY a.id, b.id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
        ), reached AS (
            SELECT id, id AS other FROM classes UNION SELECT r.id, l.b FROM reached AS r JOIN links AS l ON r.other = l.a
        ), component AS (SELECT id, min(other) AS component_id FROM reached GROUP BY id)
        SELECT doc_id, CAST(len(sets.s) AS BIGINT) AS n_shingles, coalesce(component_id, doc_id) AS component_id, doc_id = coalesce(component_id, doc_id) AS kept
        FROM sets LEFT JOIN classes ON sets.s = classes.s LEFT JOIN component ON classes.id = component.id
    """,
    "op3_exact_topk": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
            FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), scored AS (
            SELECT q.vec_id AS query_id, b.vec_id,
                   CAST(list_sum(list_transform(list_zip(q.v, b.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
            FROM v AS q JOIN v AS b ON q.vec_id <> b.vec_id AND len(q.v) = len(b.v)
            WHERE q.vec_id % 50 = 0
        ), ranked AS (
            SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored
        )
        SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 5
    """,
}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
