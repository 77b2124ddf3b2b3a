"""A training corpus from documents: toxicity, quality rules, near-duplicates, packing.

Each stage takes (spark, docs, sf_dir) and returns a table: all but the last the documents it keeps, with all their
columns; the last the packed pieces. run() writes each stage's result to shared storage and reads it back.

Defined results: a null or empty text scores as text without evidence and goes at the quality rules, which ask for 20 words;
rows without a doc_id are judged by their text and never count as labelled; of repeated rows (the same doc_id and text) one
stays; tables without rows give tables without rows; other columns pass as they are, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wirespark.llm import minhash, packing, quality, toxicity
from wirespark.llm.common import staged, table


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold; learned from all labelled documents among docs."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), F.lit(False), None)
    score = "score" + "_" * max(map(len, docs.columns), default=0)  # longer than any column's name
    return toxicity.scored(docs, model, score).filter(F.col(score) < toxicity.THRESHOLD).drop(score)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rule and read like the trusted ones; counts are taken over docs."""
    trusted = quality.good_labels(table(spark, sf_dir, "labels"))
    return quality.kept_documents(docs, trusted)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose word 5-shingles are similar by 0.8 or more."""
    return minhash.without_duplicates(docs, size=5, percent=80)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All that is left, in sequences of at most 2048 tokens."""
    import public_tokenizers

    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("toxicity", toxicity_filter), ("quality_rules", quality_rules), ("minhash_dedup", near_dedup), ("best_fit_packing", best_fit_packing)]

#: SQL has neither the models nor the tokenizer; tests/llm/test_pipeline.py holds the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
