"""Personal data and secrets: detection, confidence, redaction. Built-in functions; a Python function only where offsets are needed."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wirespark.dims import PII_DEFAULT, PII_LEAST_CONFIDENCE, PII_PATTERNS, SECRET_PATTERNS, SENSITIVE_HEADERS


def java_pattern(pattern: str) -> str:
    """Word borders by ASCII letters, digits and underscore on both sides, as RE2 has them."""
    border = "(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"
    return pattern.replace(r"\b", border)


def found(text: Column, kind: str, patterns: dict[str, str] = PII_PATTERNS) -> Column:
    """All values of a type, whole matches, in order."""
    return F.regexp_extract_all(text, F.lit(java_pattern(patterns[kind])), F.lit(0))


def _typed(text: Column, kind: str, patterns: dict[str, str]) -> Column:
    return F.transform(found(text, kind, patterns), lambda v: F.struct(F.lit(kind).alias("type"), v.alias("value")))


def luhn_valid(value: Column) -> Column:
    """Digits of a number of 13 to 19 digits pass the check sum."""
    digits = F.regexp_replace(value, "[^0-9]", "")
    n = F.length(digits)

    def term(i: Column) -> Column:
        d = F.substring(digits, n - i, F.lit(1)).cast("int")
        return F.when(i % 2 == 0, d).otherwise(F.when(d > 4, d * 2 - 9).otherwise(d * 2))

    total = F.aggregate(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), F.lit(0), lambda acc, i: acc + F.coalesce(term(i), F.lit(0)))
    return n.between(13, 19) & (total % 10 == 0)


def confidence(kind: Column | str, value: Column) -> Column:
    kind = F.lit(kind) if isinstance(kind, str) else kind
    known = F.contains(value, F.lit("@gmail.")) | F.contains(value, F.lit("@yahoo.")) | F.contains(value, F.lit("@outlook."))
    return (
        F.when(kind == "email", F.when(known, 0.95).otherwise(0.85))
        .when(kind == "ssn", F.when(F.regexp_replace(value, "[- ]", "") == "000000000", 0.1).otherwise(0.9))
        .when(kind == "credit_card", F.when(luhn_valid(value), 0.95).otherwise(0.5))
        .when(kind == "jwt", F.lit(0.99)).when(kind == "api_key", F.when(F.octet_length(value) >= 32, 0.9).otherwise(0.7)).otherwise(F.lit(0.8))
    )


def matches(rows: DataFrame, text: str, kinds=PII_DEFAULT, custom: dict[str, str] | None = None, least: float = PII_LEAST_CONFIDENCE, whitelist: list[str] = ()) -> DataFrame:
    """One row for each value: the row's columns without its text, type, value, confidence. Explodes within a row; no shuffle."""
    patterns = {k: PII_PATTERNS[k] for k in kinds} | (custom or {})
    each = F.flatten(F.array(*(_typed(F.col(text), k, patterns) for k in patterns)))
    out = rows.withColumn("m", F.explode(each)).drop(text).select("*", "m.type", "m.value").drop("m")
    out = out.withColumn("confidence", confidence(F.col("type"), F.col("value"))).filter(F.col("confidence") >= least)
    for pattern in whitelist:
        out = out.filter(~F.regexp_like("value", F.lit(pattern)))
    return out


def secrets(rows: DataFrame, text: str) -> DataFrame:
    each = F.flatten(F.array(*(_typed(F.col(text), k, SECRET_PATTERNS) for k in SECRET_PATTERNS)))
    return rows.withColumn("m", F.explode(each)).drop(text).select("*", "m.type", "m.value", F.lit(0.95).alias("confidence")).drop("m")


def redacted_value(kind: Column, value: Column, mode: str) -> Column:
    """mask, hash, remove or label."""
    n = F.length(value)
    if mode == "mask":
        return F.when(F.octet_length(value) <= 4, F.repeat(F.lit("*"), n)).otherwise(F.concat(F.left(value, F.lit(1)), F.repeat(F.lit("*"), n - 2), F.right(value, F.lit(1))))
    if mode == "hash":
        return F.concat(F.lit("[SHA256:"), F.left(F.sha2(value, 256), F.lit(16)), F.lit("]"))
    if mode == "remove":
        return F.lit("")
    if mode == "label":
        return F.concat(F.lit("["), F.upper(kind), F.lit("]"))
    raise ValueError(f"no such mode: {mode}")


def spans(text: str, kinds=PII_DEFAULT) -> list[tuple[int, int, str, str]]:
    """Matches by start, the longest first, then by type; what overlaps an earlier one is left out."""
    hits = sorted((m.start(), -m.end(), k, m[0]) for k in kinds for m in re.finditer(PII_PATTERNS[k], text, re.ASCII))
    out, at = [], 0
    for start, end, kind, value in hits:
        if start >= at and _sure(kind, value):
            out.append((start, -end, kind, value))
            at = -end
    return out


def _sure(kind: str, value: str) -> bool:
    if kind == "ssn":
        return re.sub("[- ]", "", value) != "000000000"
    if kind == "credit_card":
        digits = [int(x) for x in reversed(re.sub("[^0-9]", "", value))]
        return sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(digits)) % 10 == 0
    return True


def redact(text: str, mode: str = "label", kinds=PII_DEFAULT) -> str:
    import hashlib

    out, at = [], 0
    for start, end, kind, value in spans(text, kinds):
        new = {
            "mask": "*" * len(value) if len(value.encode()) <= 4 else value[0] + "*" * (len(value) - 2) + value[-1],
            "hash": f"[SHA256:{hashlib.sha256(value.encode()).hexdigest()[:16]}]", "remove": "", "label": f"[{kind.upper()}]",
        }[mode]
        out += [text[at:start], new]
        at = end
    return "".join(out) + text[at:]


def redacted_text(text: Column, mode: str = "label", kinds=PII_DEFAULT) -> Column:
    """Whole texts, Arrow batches at a time."""

    @F.pandas_udf("string")
    def run(x: pd.Series) -> pd.Series:
        return x.map(lambda t: None if t is None else redact(t, mode, kinds))

    return run(text)


def redacted_headers(headers: Column, mode: str = "label") -> Column:
    """Sensitive headers in full; e-mail addresses in the others by pattern."""
    email = java_pattern(PII_PATTERNS["email"])
    return F.transform_values(headers, lambda k, v: F.when(F.lower(k).isin(*SENSITIVE_HEADERS), F.lit("[REDACTED]")).otherwise(F.regexp_replace(v, F.lit(email), F.lit("[EMAIL]"))))


UUID = "[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}"


def redacted_dns(name: Column) -> Column:
    email = java_pattern(PII_PATTERNS["email"])
    return F.when(F.regexp_like(name, F.lit(email)), F.regexp_replace(name, F.lit(email), F.lit("[EMAIL]"))).otherwise(F.regexp_replace(name, F.lit(UUID), F.lit("[UUID]")))


def is_text_content(content_type: Column) -> Column:
    low = F.lower(content_type)
    return F.coalesce(F.regexp_like(low, F.lit("^text/|json|xml|x-www-form-urlencoded|javascript")), F.lit(False))


def findings_kept(rows: DataFrame, most: int = 10_000, by: str = "row") -> DataFrame:
    """The newest findings: a top-k, so no more than that many rows meet."""
    return rows.orderBy(F.desc(by)).limit(most)
