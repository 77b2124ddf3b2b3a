"""Numbers as text."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def format_bytes(n: Column, decimals: int = 2) -> Column:
    """1024-based units."""
    out = F.concat(n.cast("string"), F.lit(" B"))
    for k, unit in enumerate(("KB", "MB", "GB", "TB"), 1):
        out = F.when(n >= 1024**k, F.concat(F.format_string(f"%.{decimals}f", n / F.lit(float(1024**k))), F.lit(f" {unit}"))).otherwise(out)
    return out


def format_duration(ms: Column) -> Column:
    return F.when(ms < 1000, F.concat(ms.cast("string"), F.lit("ms"))).when(ms < 60_000, F.format_string("%.1fs", ms / 1000.0)).otherwise(F.format_string("%.1fm", ms / 60_000.0))


def format_uptime(seconds: Column) -> Column:
    s = seconds.cast("long")
    return F.format_string("%02d:%02d:%02d", F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60)


def drop_rate(dropped: Column, captured: Column) -> Column:
    return F.coalesce(F.round(F.try_divide(dropped * 100.0, captured.cast("double")), 2), F.lit(0.0))
