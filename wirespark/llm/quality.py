"""Operator 6 [native]: quality rules and a hashed n-gram log-likelihood ratio, by DataFrame functions alone.

Every document gets word and symbol counts, repeated lines and repeated 8-word windows; the base rule rejects short and
repetitive texts. The others are judged by the method: unigrams and bigrams of words (case kept, as shouting is a sign) are hashed to BUCKETS,
a trusted target (all documents labelled of good quality) and the whole corpus give two multinomials over the buckets, with
smoothing, and a document's score is the mean of log(target / corpus) over its n-grams. What a document adds to the
corpus or the target is not taken out again. It is kept if the score is at least THRESHOLD nats per n-gram, or less where
trusted documents need it: for that, each half of all the trusted is scored with the other as target. The same document
gets the same verdict from the same corpus, whatever the partitions.

Defined results: null text has no words and fails the base rule; repeated rows are counted and judged alike; an empty
table gives no rows; other columns are ignored; without a trusted document nothing but the base rule rejects. Windows
are compared by 64-bit hashes, chained from pairs: the chance of a false match in a text of 20,000 words is 1e-11.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wirespark.llm.common import staged, table

BUCKETS = 1 << 14
#: Nats per n-gram. Text like the target is near 0 or above; junk of the corpus falls below.
THRESHOLD = -0.06
#: Trusted documents, each scored by a target that it isn't in, show what clean text scores: the threshold is at most this much under this share of them.
MARGIN, LOWEST = 0.02, 0.002
#: Added to each bucket's count, times the share that the corpus gives it.
PRIOR = 1000.0

_SPACE = "\\x20\\x09-\\x0D"
_BLANKS = " \t\n\x0b\x0c\r"
_SYMBOLS = "#*$%&|<>"


def _paired(hashes: str, step: int) -> Column:
    """Hash of each element with the one `step` further on; the last `step` elements have none and are cut off by the caller."""
    return F.zip_with(hashes, F.slice(hashes, step + 1, F.greatest(F.size(hashes), F.lit(1))), lambda a, b: F.xxhash64(a, b))


def _split(docs: DataFrame) -> DataFrame:
    """row (all columns as they are), doc_id, t (text), w (its words; one empty word if there is none)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    d = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("doc_id"), text.alias("t"))
    return d.withColumn("w", F.split(F.btrim("t", F.lit(_BLANKS)), f"[{_SPACE}]+"))


def _covered(windows: Column) -> Column:
    """Words in windows that occur twice or more: sort (hash, place), keep places whose neighbour has the same hash, and join their spans of 8."""
    # zip with places, sort, and mark
    placed = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    n = F.size(windows)
    before = F.concat(F.array(F.lit(None).cast("struct<h:bigint,i:int>")), F.slice(placed, 1, n - 1))
    after = F.concat(F.slice(placed, 2, n - 1), F.array(F.lit(None).cast("struct<h:bigint,i:int>")))
    marked = F.arrays_zip(placed.alias("p"), before.alias("b"), after.alias("a"))
    again = F.filter(marked, lambda x: F.coalesce(x["p"]["h"] == x["b"]["h"], F.lit(False)) | F.coalesce(x["p"]["h"] == x["a"]["h"], F.lit(False)))
    places = F.array_sort(F.transform(again, lambda x: x["p"]["i"]))
    nexts = F.concat(F.slice(places, 2, F.greatest(F.size(places) - 1, F.lit(0))), F.array(F.lit(1 << 30)))
    return F.aggregate(F.zip_with(places, nexts, lambda a, b: F.least(b - a, F.lit(8))), F.lit(0).cast("long"), lambda acc, x: acc + x)


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, the base columns, and h and p (hashes of words, and of neighbours, one too many) for the n-grams.

    Each column is a step of its own, so that none is computed twice; windows of 8 are made where windows of 4 repeat.
    """
    none = F.array().cast("array<bigint>")
    d = _split(docs).withColumn("h", F.transform("w", lambda x: F.xxhash64(x)))
    d = d.withColumn("h", F.when(F.get("w", F.lit(0)) == "", none).otherwise(F.col("h"))).drop("w")
    d = d.withColumn("p", _paired("h", 1))
    d = d.withColumn("p4", _paired("p", 2))
    d = d.withColumn("x4", F.slice("p4", 1, F.greatest(F.size("h") - 3, F.lit(0))))
    d = d.withColumn("p8", F.when(F.size(F.array_distinct("x4")) < F.size("x4"), _paired("p4", 4)).otherwise(none))
    d = d.withColumn("x8", F.slice("p8", 1, F.greatest(F.size("h") - 7, F.lit(0))))
    d = d.withColumn("again", F.size(F.array_distinct("x8")) < F.size("x8"))
    d = d.withColumn("lines", F.filter(F.split("t", "\n"), lambda x: F.btrim(x, F.lit(_BLANKS)) != ""))
    return d.select(
        "row", "doc_id",
        F.size("h").cast("long").alias("n_words"),
        F.length(F.translate("t", _BLANKS, "")).cast("long").alias("word_chars"),
        (F.length("t") - F.length(F.translate("t", _SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.col("again"), _covered(F.col("x8"))).otherwise(F.lit(0).cast("long")).alias("n_repeat_words"),
        "h", "p",
    )


def half() -> Column:
    """0 or 1, by hash of doc_id: trusted documents of one half are scored by the other when the threshold is taken."""
    return F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(2)).cast("int")


def trusted_ids(trusted: DataFrame) -> DataFrame:
    return trusted.select(F.col("doc_id").cast("long").alias("doc_id")).filter("doc_id is not null").distinct()


def bucket_counts(docs: DataFrame, trusted: DataFrame) -> tuple[list[float], list[float], list[float]]:
    """N-grams by bucket: of the corpus (with one for each bucket), of the trusted documents of either half; 3 * BUCKETS numbers reach the driver.

    Texts are shuffled to meet the trusted ids, whose number grows with the corpus; rows without an id go by their text,
    lest they all meet in one task.
    """
    salt = F.when(F.col("doc_id").isNull(), F.xxhash64("text")).otherwise(F.lit(0).cast("long"))
    good = trusted_ids(trusted).select("doc_id", F.lit(0).cast("long").alias("salt"), half().alias("good"))
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    d = d.filter("text != ''").withColumn("salt", salt).join(good.hint("shuffle_hash"), ["doc_id", "salt"], "left")
    d = _split(d.select("doc_id", "text", "good")).select(F.col("row.good").alias("good"), "w")
    d = d.select("good", "w", F.posexplode("w").alias("k", "x")).filter("x != ''")
    d = d.select("good", F.xxhash64("x").alias("a"), F.get("w", F.col("k") + 1).alias("y"))
    grams = F.array(F.col("a"), F.when(F.col("y").isNotNull(), F.xxhash64("a", F.xxhash64("y"))))
    d = d.select("good", F.explode(grams).alias("g")).filter("g is not null")
    of = lambda k: F.count(F.when(F.col("good") == k, 1))
    counts = d.groupBy(F.pmod("g", F.lit(BUCKETS)).alias("b")).agg(F.count("*").alias("n"), of(0).alias("first"), of(1).alias("second"))
    corpus, first, second = [1.0] * BUCKETS, [0.0] * BUCKETS, [0.0] * BUCKETS
    for row in counts.collect():
        corpus[row.b] += row.n
        first[row.b] += row.first
        second[row.b] += row.second
    return corpus, first, second


def log_ratios(corpus: list[float], wanted: list[float]) -> list[float]:
    """log(target / corpus) for each bucket."""
    total, own_total = sum(corpus), sum(wanted)
    if not own_total:
        return [0.0] * BUCKETS
    return [math.log((w + PRIOR * c / total) / (own_total + PRIOR) / (c / total)) for w, c in zip(wanted, corpus)]


def bucket_weights(docs: DataFrame, target: DataFrame) -> list[float]:
    """log(target / corpus) for each bucket, with all of the target."""
    corpus, first, second = bucket_counts(docs, target)
    return log_ratios(corpus, [x + y for x, y in zip(first, second)])


def _table(weights: list[float]) -> Column:
    return F.from_json(F.lit(json.dumps([round(x, 9) for x in weights])), "array<double>")


def scored(docs: DataFrame, weights: list[float], by_half: tuple[list[float], list[float]] | None = None) -> DataFrame:
    """row (all columns of docs), doc_id, base columns, base_failed, score for every row of docs; nothing is shuffled.

    With weights for documents of either half, the score by those follows as `cross`, if the base rule passes.
    """
    d = measured(docs)
    d = d.withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))
    bucket = lambda hashes: F.transform(hashes, lambda x: F.pmod(x, F.lit(BUCKETS)).cast("int"))
    d = d.withColumn("p", bucket(F.slice("p", 1, F.greatest(F.size("h") - 1, F.lit(0))))).withColumn("h", bucket("h"))
    ratio = lambda buckets, of: F.aggregate(buckets, F.lit(0.0), lambda acc, x: acc + F.get(of, x))
    mean = lambda of: (ratio("h", of) + ratio("p", of)) / F.greatest(2 * F.col("n_words") - 1, F.lit(1))
    d = d.withColumn("score", mean(_table(weights)))
    if by_half:
        cross = F.when(half() == 0, mean(_table(by_half[0]))).otherwise(mean(_table(by_half[1])))
        d = d.withColumn("cross", F.when(~F.col("base_failed"), cross))
    return d.select("row", "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "score", *["cross"] * bool(by_half))


def threshold_for(rows: DataFrame, trusted: DataFrame) -> float:
    """THRESHOLD, or lower where trusted documents need it: MARGIN under their LOWEST share.

    Every trusted document counts, by its `cross` score to four decimals: so the table of counts is bounded.
    """
    scores = rows.filter("not base_failed").select("doc_id", F.round("cross", 4).alias("x")).join(trusted_ids(trusted).hint("shuffle_hash"), "doc_id", "left_semi")
    least = scores.groupBy("x").agg(F.count("*").alias("n")).agg(F.percentile("x", F.lit(LOWEST), F.col("n"))).first()[0]
    return THRESHOLD if least is None else min(THRESHOLD, least - MARGIN)


def judged(docs: DataFrame, trusted: DataFrame, threshold: float | None = None, whole: bool = True) -> DataFrame:
    """row (all columns of docs, if whole), doc_id, base columns, base_failed, kept, score for every row of docs.

    Scores are written to shared storage, as the threshold is taken from them.
    """
    corpus, first, second = bucket_counts(docs, trusted)
    weights = log_ratios(corpus, [x + y for x, y in zip(first, second)])
    rows = scored(docs, weights, (log_ratios(corpus, second), log_ratios(corpus, first)))
    rows = staged(rows if whole else rows.drop("row"), "quality")
    limit = threshold_for(rows, trusted) if threshold is None else threshold
    kept = ~F.col("base_failed") & (F.col("score") >= limit)
    return rows.select(*["row"] * whole, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), "score")


def kept_documents(docs: DataFrame, trusted: DataFrame, threshold: float | None = None) -> DataFrame:
    """The documents that are kept, all columns as they are."""
    return judged(docs, trusted, threshold).filter("kept").select("row.*")


def good_labels(labels: DataFrame) -> DataFrame:
    return labels.filter("quality = 1").select("doc_id")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "documents"), good_labels(table(spark, sf_dir, "labels")), whole=False)
