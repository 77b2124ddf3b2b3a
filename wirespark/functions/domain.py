"""Host names: labels, character statistics, entropy, tunnelling and generated names. Built-in functions only.

String lengths are byte lengths (octet_length) where a ratio is taken, as the measured protocols count bytes. Scores
add doubles in a fixed order, since 0.4 + 0.2 > 0.6 holds in doubles.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wirespark.dims import BIGRAMS, COMMON_TLDS

ENTROPY_LIMIT, LENGTH_LIMIT, LABEL_LIMIT = 3.5, 50, 5
DGA_ENTROPY, DGA_CONSONANTS, DGA_BIGRAMS = 3.8, 0.7, 0.3
VERDICT = 0.6


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def labels(domain: Column | str) -> Column:
    """Labels of a name; one dot at its end is dropped."""
    return F.split(F.regexp_replace(_c(domain), "[.]$", ""), "[.]")


def _plogp(parts: Column, size: Column) -> Column:
    return -F.aggregate(parts, F.lit(0.0), lambda acc, n: acc + (n / size) * F.log2(n / size))


def entropy(text: Column | str, over: str = "bytes") -> Column:
    """Shannon entropy of the characters, with shares of the byte length (or of the characters)."""
    text = _c(text)
    size = (F.octet_length(text) if over == "bytes" else F.length(text)).cast("double")
    counts = F.transform(F.array_distinct(F.split(text, "")), lambda c: (F.length(text) - F.length(F.replace(text, c, F.lit("")))).cast("double"))
    return F.when(F.length(text) > 0, _plogp(counts, size)).otherwise(F.lit(0.0))


def ngrams(text: Column | str, n: int) -> Column:
    text = _c(text)
    return F.when(F.length(text) >= n, F.transform(F.sequence(F.lit(1), F.length(text) - (n - 1)), lambda i: F.substring(text, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))


def ngram_entropy(text: Column | str, n: int) -> Column:
    grams = ngrams(text, n)
    counts = F.transform(F.array_distinct(grams), lambda g: F.size(F.filter(grams, lambda x: x == g)).cast("double"))
    return F.when(F.size(grams) > 0, _plogp(counts, F.size(grams).cast("double"))).otherwise(F.lit(0.0))


def share(text: Column | str, pattern: str, of: str | None = None) -> Column:
    """Matches of a class per byte, or per match of another class; 0 for none."""
    text = _c(text)
    base = F.octet_length(text) if of is None else F.regexp_count(text, F.lit(of))
    return F.coalesce(F.try_divide(F.regexp_count(text, F.lit(pattern)).cast("double"), base.cast("double")), F.lit(0.0))


def consonant_ratio(text: Column | str) -> Column:
    return share(text, "[b-df-hj-np-tv-zB-DF-HJ-NP-TV-Z]", "[a-zA-Z]")


def bigram_score(text: Column | str) -> Column:
    """Share of frequent letter pairs among the pairs of a name in lower case."""
    pairs = ngrams(F.lower(_c(text)), 2)
    common = F.filter(pairs, lambda x: x.isin(*BIGRAMS))
    return F.when(F.size(pairs) > 0, F.size(common).cast("double") / F.size(pairs)).otherwise(F.lit(0.0))


def base64_like(text: Column | str) -> Column:
    return (F.octet_length(_c(text)) >= 20) & (share(text, "[A-Za-z0-9+/=]") > 0.95)


def hex_like(text: Column | str) -> Column:
    return (F.octet_length(_c(text)) >= 16) & (share(text, "[0-9a-fA-F]") > 0.9)


def numeric_like(text: Column | str) -> Column:
    return share(text, "[0-9]") > 0.3


def is_reverse(domain: Column | str) -> Column:
    x = labels(domain)
    return (F.size(x) >= 2) & (F.try_element_at(x, F.lit(-1)) == "arpa") & (F.try_element_at(x, F.lit(-2)) == "in-addr")


def is_common_tld(tld: Column | str) -> Column:
    return _c(tld).isin(*COMMON_TLDS)


def features(domain: Column | str, qtype: Column | int = 1) -> dict[str, Column]:
    """The 19 features of a queried name, by name."""
    d, x = _c(domain), labels(domain)
    lengths = F.transform(x, F.octet_length)
    flag = lambda c: c.cast("int").cast("double")
    n = F.size(x).cast("double")
    tld = F.try_element_at(x, F.lit(-1))
    qtype = F.lit(qtype) if isinstance(qtype, int) else qtype
    return {
        "domain_length": F.octet_length(d).cast("double"),
        "subdomain_count": n - 1,
        "max_label_length": F.array_max(lengths).cast("double"),
        "avg_label_length": F.aggregate(lengths, F.lit(0), lambda a, v: a + v) / n,
        "numeric_ratio": share(d, "[0-9]"),
        "alpha_ratio": share(d, "[a-zA-Z]"),
        "special_ratio": share(d, "[^0-9a-zA-Z.]"),
        "consonant_ratio": share(d, "[b-df-hj-np-tv-zB-DF-HJ-NP-TV-Z]"),
        "vowel_ratio": share(d, "[aeiouAEIOU]"),
        "domain_entropy": entropy(d),
        "label_entropy": F.aggregate(F.transform(x, lambda v: entropy(v)), F.lit(0.0), lambda a, v: a + v) / n,
        "bigram_entropy": ngram_entropy(d, 2),
        "trigram_entropy": ngram_entropy(d, 3),
        "query_type": qtype / F.lit(255.0),
        "is_reverse_lookup": flag(is_reverse(d)),
        "has_digits": flag(F.regexp_like(d, F.lit("[0-9]"))),
        "has_hyphens": flag(F.contains(d, F.lit("-"))),
        "tld_length": F.octet_length(tld).cast("double"),
        "is_common_tld": flag(is_common_tld(tld)),
    }


def _score(*terms: tuple[Column, float]) -> Column:
    total = F.lit(0.0)
    for test, points in terms:
        total = total + F.when(test, F.lit(points)).otherwise(F.lit(0.0))
    return F.least(total, F.lit(1.0))


def tunnelling(domain: Column | str, entropy_limit=ENTROPY_LIMIT, length_limit=LENGTH_LIMIT, label_limit=LABEL_LIMIT) -> Column:
    """struct(is_tunnelling, score, threat_type) of a name. Limits of 0 give the verdicts of an analyser that was never configured."""
    x = labels(domain)
    sub = F.array_join(F.slice(x, 1, F.greatest(F.size(x) - 2, F.lit(0))), ".")
    score = _score((entropy(sub) > entropy_limit, 0.4), (F.octet_length(sub) > length_limit, 0.3), (F.size(x) > label_limit, 0.2), (base64_like(sub), 0.3), (hex_like(sub), 0.2))
    kind = F.when(hex_like(sub), "hex_encoding").when(base64_like(sub), "base64_encoding").when(score > VERDICT, "dns_tunneling").otherwise("benign")
    few = F.size(x) < 3
    return F.struct(
        (~few & (score > VERDICT)).alias("is_tunnelling"), F.when(few, F.lit(0.1)).otherwise(score).alias("score"), F.when(few, F.lit("benign")).otherwise(kind).alias("threat_type")
    )


def generated(domain: Column | str, entropy_limit=DGA_ENTROPY, consonant_limit=DGA_CONSONANTS, bigram_limit=DGA_BIGRAMS) -> Column:
    """struct(is_dga, score): is the second-level label made by an algorithm?"""
    x = labels(domain)
    sld = F.coalesce(F.try_element_at(x, F.lit(-2)), F.lit(""))
    n = F.octet_length(sld)
    score = _score((entropy(sld) > entropy_limit, 0.35), (consonant_ratio(sld) > consonant_limit, 0.25), (bigram_score(sld) < bigram_limit, 0.25), (numeric_like(sld), 0.15), ((n < 4) | (n > 20), 0.1))
    few = F.size(x) < 2
    return F.struct((~few & (score > VERDICT)).alias("is_dga"), F.when(few, F.lit(0.1)).otherwise(score).alias("score"))


def analysed(domain: Column | str, compat: bool = False) -> Column:
    """struct(threat_type, confidence, is_tunnelling, is_dga). compat: with limits of 0."""
    t, g = (tunnelling(domain, 0.0, 0, 0), generated(domain, 0.0, 0.0, 0.0)) if compat else (tunnelling(domain), generated(domain))
    kind = F.when(t["is_tunnelling"], t["threat_type"]).when(g["is_dga"], "dga").otherwise("benign")
    sure = F.when(t["is_tunnelling"], t["score"]).when(g["is_dga"], g["score"]).otherwise(1.0 - F.greatest(t["score"], g["score"]))
    return F.struct(kind.alias("threat_type"), sure.alias("confidence"), t["is_tunnelling"].alias("is_tunnelling"), g["is_dga"].alias("is_dga"))


# ---- the second rule set, which reads names in lower case


def features_folded(domain: Column | str) -> dict[str, Column]:
    d = _c(domain)
    low, x = F.lower(d), F.split(d, "[.]")
    size = F.length(F.replace(low, F.lit("."), F.lit(""))).cast("double")
    many = lambda p: F.regexp_count(low, F.lit(p)).cast("double")
    rate = lambda n: F.coalesce(F.try_divide(n, size), F.lit(0.0))
    alpha, vowels = many("[a-z]"), many("[aeiou]")
    return {
        "length": F.length(d).cast("double"),
        "label_count": F.size(x).cast("double"),
        "max_label": F.array_max(F.transform(x, F.length)).cast("double"),
        "avg_label": F.aggregate(F.transform(x, F.length), F.lit(0), lambda a, v: a + v) / F.size(x).cast("double"),
        "alpha_ratio": rate(alpha),
        "digit_ratio": rate(many("[0-9]")),
        "special_ratio": rate(many("[^0-9a-z.]")),
        "entropy": entropy(low, "characters"),
        "vowel_ratio": vowels / (alpha - vowels + 1),
        "bigram_entropy": ngram_entropy(low, 2),
        "trigram_entropy": ngram_entropy(low, 3),
    }


def tunnelling_folded(domain: Column | str) -> Column:
    f = features_folded(domain)
    score = _score((f["entropy"] > 3.5, 0.3), (f["length"] > 50, 0.2), (f["label_count"] > 4, 0.2), (f["digit_ratio"] > 0.3, 0.15), (f["vowel_ratio"] < 0.1, 0.15))
    hit = score > 0.5
    kind = (
        F.when(hit & (f["entropy"] > 4.0) & (f["digit_ratio"] > 0.4), "dns_tunneling_encoded").when(hit & (f["label_count"] > 6), "dns_tunneling_exfiltration")
        .when(hit, "dns_tunneling_suspicious").otherwise("benign")
    )
    return F.struct(hit.alias("is_tunnelling"), score.alias("score"), kind.alias("threat_type"))


#: Letter frequencies of ordinary names.
LETTER_SHARES = {
    "e": 0.127, "t": 0.091, "a": 0.082, "o": 0.075, "i": 0.070, "n": 0.067, "s": 0.063, "h": 0.061,
    "r": 0.060, "d": 0.043, "l": 0.040, "c": 0.028, "u": 0.028, "m": 0.024, "w": 0.024,
}


def generated_folded(domain: Column | str) -> Column:
    x = F.split(F.lower(_c(domain)), "[.]")
    part = F.when(F.size(x) > 1, F.array_join(F.slice(x, 1, F.greatest(F.size(x) - 1, F.lit(1))), ".")).otherwise(F.element_at(x, 1))
    many = lambda p: F.regexp_count(part, F.lit(p)).cast("double")
    total = many("[a-z]")
    off = F.lit(0.0)
    for letter, expected in LETTER_SHARES.items():
        off = off + F.abs(F.try_divide(many(letter), total) - F.lit(expected))
    run = F.coalesce(F.array_max(F.transform(F.regexp_extract_all(part, F.lit("([b-df-hj-np-tv-z]+)"), F.lit(1)), F.length)), F.lit(0))
    score = _score(
        (F.length(part) > 20, 0.15), (F.coalesce(off > 0.5, F.lit(False)), 0.25), (entropy(part, "characters") > 3.8, 0.2), (run > 4, 0.2),
        (many("[0-9]") > 3, 0.1), ((many("[aeiou]") == 0) & (F.length(part) > 5), 0.1),
    )
    return F.struct((score > 0.5).alias("is_dga"), score.alias("score"))
