"""Files, shares and pipes: names, magic numbers, markers, categories."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wirespark.dims import ADMIN_SHARES, CARVING, DANGEROUS_MIMES, EXTENSIONS, REMOTE_EXEC_TOOLS, SCRIPT_MARKERS, SCRIPT_TYPES, SERVICE_PIPES, SUSPICIOUS_CONTENT, UPLOAD_EXTENSIONS, WMI_PIPES, mapped


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _has(text: Column, words) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(text, F.lit(w))
    return out


def is_admin_share(share) -> Column:
    up = F.upper(_c(share))
    return _has(up, ADMIN_SHARES) | F.regexp_like(up, F.lit("^[A-Z][$]"))


def is_remote_exec(file, share) -> Column:
    up = F.upper(_c(file))
    return (F.contains(F.upper(_c(share)), F.lit("ADMIN$")) & _has(up, ["PSEXE", "PAEXEC"])) | _has(up, REMOTE_EXEC_TOOLS)


def is_service_pipe(file) -> Column:
    return _has(F.upper(_c(file)), SERVICE_PIPES)


def is_wmi_pipe(file) -> Column:
    return _has(F.upper(_c(file)), WMI_PIPES)


def is_suspicious_upload(file, share) -> Column:
    ends = F.lit(False)
    for x in UPLOAD_EXTENSIONS:
        ends = ends | F.endswith(F.upper(_c(file)), F.lit(x))
    return is_admin_share(share) & ends


#: Event, severity, points of the cumulative score.
LATERAL = [("ADMIN_SHARE_ACCESS", 7, 2), ("PSEXEC", 9, 3), ("SERVICE_CREATE", 8, 3), ("WMI_EXEC", 8, 3), ("SUSPICIOUS_UPLOAD", 8, 3)]
ALERT_SCORE = 3


def lateral_events(ops: DataFrame, file: str, share: str) -> DataFrame:
    """0 to 5 rows for each file operation."""
    tests = [is_admin_share(share), is_remote_exec(file, share), is_service_pipe(file), is_wmi_pipe(file), is_suspicious_upload(file, share)]
    each = [F.when(t, F.struct(F.lit(k).alias("kind"), F.lit(s).alias("severity"), F.lit(p).alias("points"))) for t, (k, s, p) in zip(tests, LATERAL)]
    return ops.withColumn("e", F.explode(F.array_compact(F.array(*each)))).select("*", "e.kind", "e.severity", "e.points").drop("e")


def lateral_scores(events: DataFrame, session: list[str], order: list[str]) -> DataFrame:
    """The score so far; an alert at every event from ALERT_SCORE on."""
    w = Window.partitionBy(*session).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return events.withColumn("score", F.sum("points").over(w)).withColumn("alert", F.col("score") >= ALERT_SCORE)


def lateral_totals(events: DataFrame, session: list[str]) -> DataFrame:
    k = F.col("kind")
    out = events.groupBy(*session).agg(
        F.count_if(k == "ADMIN_SHARE_ACCESS").alias("admin_hits"), F.count_if(k.isin("SERVICE_CREATE", "WMI_EXEC")).alias("pipes"), F.count_if(k == "SUSPICIOUS_UPLOAD").alias("uploads"), F.sum("points").alias("score")
    )
    part = lambda c, text: F.when(F.col(c) > 0, F.concat(F.col(c).cast("string"), F.lit(text)))
    return out.withColumn("summary", F.concat_ws(", ", part("admin_hits", " admin share accesses"), part("pipes", " pipe accesses"), part("uploads", " uploads")))


def sanitized(path: Column) -> Column:
    """The last part of a path with unsafe characters replaced; empty if it climbs."""
    base = F.element_at(F.split(F.element_at(F.split(path, "/"), -1), r"\\"), -1)
    safe = F.left(F.regexp_replace(F.regexp_replace(base, "[^a-zA-Z0-9._-]", "_"), "^[.]+", ""), F.lit(100))
    return F.when(F.contains(base, F.lit("..")), F.lit("")).otherwise(safe)


def extension_of(content_type: Column) -> Column:
    return mapped(F.lower(F.element_at(F.split(content_type, ";"), 1)), EXTENSIONS, ".bin")


def category_of(mime: Column) -> Column:
    has = lambda w: F.contains(mime, F.lit(w))
    return (
        F.when(F.startswith(mime, F.lit("image/")), "image").when(F.startswith(mime, F.lit("video/")) | F.startswith(mime, F.lit("audio/")), "media")
        .when((mime == "application/pdf") | has("document") | has("spreadsheet") | has("presentation"), "document")
        .when(mime.isin("application/zip", "application/x-tar", "application/gzip", "application/x-rar-compressed", "application/x-7z-compressed"), "archive")
        .when(has("executable") | (mime == "application/x-dosexec"), "executable").otherwise("other")
    )


def is_threat(mime: Column, text: Column) -> Column:
    """A dangerous type, or a script marker in the first 1024 characters (the case matters)."""
    return mime.isin(*DANGEROUS_MIMES) | _has(F.left(text, F.lit(1024)), SCRIPT_MARKERS)


#: Magic numbers in order.
MAGIC = [
    ("application/pdf", "25504446"), ("application/zip", "504B0304"), ("application/x-rar-compressed", "52617221"), ("application/gzip", "1F8B"),
    ("image/png", "89504E47"), ("image/jpeg", "FFD8FF"), ("image/gif", "47494638"), ("application/x-msdownload", "4D5A"),
]


def magic_mime(data: Column) -> Column:
    head = F.hex(F.substring(data, 1, 512))
    text = F.regexp_like(head, F.lit("^(?:(?:09|0A|0B|0C|0D|[2-6][0-9A-F]|7[0-9A-E]|[89AB][0-9A-F]))+$"))
    out = F.when(text, "text/plain").otherwise("application/octet-stream")
    for mime, magic in reversed(MAGIC):
        out = F.when(F.startswith(head, F.lit(magic)), mime).otherwise(out)
    return F.when(F.octet_length(data) < 4, "application/octet-stream").otherwise(out)


def suspicious_content(text: Column, file: Column) -> Column:
    """What makes a file suspicious, or null."""
    out = F.lit(None).cast("string")
    for w in reversed(SUSPICIOUS_CONTENT):
        out = F.when(F.contains(F.lower(text), F.lit(w)), f"Suspicious content: {w}").otherwise(out)
    for x, kind in reversed(SCRIPT_TYPES.items()):
        out = F.when(F.endswith(F.upper(file), F.lit(x)), kind).otherwise(out)
    return F.when(F.startswith(text, F.lit("MZ")), "Executable file").otherwise(out)


def signatures(spark: SparkSession, more: list[tuple] = ()) -> DataFrame:
    """The carving table; rows of one's own come after."""
    rows = [(k, *x) for k, x in enumerate([*CARVING, *more])]
    return spark.createDataFrame(rows, "line int, extension string, mime string, header string, footer string, most_mib int, category string, dangerous boolean")


def pattern_offsets(data: Column, pattern: str) -> Column:
    """Offsets of a pattern in bytes, as text without case, and as hex if it is; each once, in order."""
    low, hexed = pattern.lower().encode(), pattern.replace(" ", "")
    raw = bytes.fromhex(hexed) if hexed and len(hexed) % 2 == 0 and all(c in "0123456789abcdefABCDEF" for c in hexed) else None

    @F.pandas_udf("array<int>")
    def run(x: pd.Series) -> pd.Series:
        def find(b):
            if b is None:
                return None
            out = set()
            for hay, needle in ((bytes(b).lower(), low), (bytes(b), raw)):
                at = hay.find(needle) if needle else -1
                while at >= 0:
                    out.add(at)
                    at = hay.find(needle, at + 1)
            return sorted(out)

        return x.map(find)

    return run(data)
