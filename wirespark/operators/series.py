"""Ordered statistics: z-scores, quartile fences, median deviations, moving averages, seasons, windows, chains.

What is defined over a whole series takes `partition`: without it a series is one ordered stream, as the definition
wants; with it (by protocol, by host) the same statistic runs in parallel per key, which is the form for large data.
"""

from __future__ import annotations

import math
from bisect import bisect_left, insort
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WINDOW, Z_LIMIT, LEAST, DECAY, FENCE = 1000, 3.0, 100, 0.1, 1.5
#: Rows of a series that one task takes at a time, about; long series are cut.
PIECE = 20_000


def _over(partition, order):
    return Window.partitionBy(*(partition or [F.lit(0)])).orderBy(*order)


def zscores(samples: DataFrame, features: list[str], order: list[str], partition: list[str] | None = None, limit: float = Z_LIMIT, least: int = LEAST) -> DataFrame:
    """Running mean and sample deviation up to and with each row; score: root mean square of the features' z. One sort for all features."""
    w = _over(partition, order).rowsBetween(Window.unboundedPreceding, 0)
    z = []
    for name in features:
        spread = F.stddev_samp(name).over(w)
        z.append(F.when(F.coalesce(spread, F.lit(0.0)) > 1e-9, (F.col(name) - F.avg(name).over(w)) / spread).otherwise(F.lit(0.0)).alias(f"z_{name}"))
    out = samples.select("*", F.count("*").over(w).alias("n"), *z)
    total = sum((F.col(f"z_{name}") * F.col(f"z_{name}") for name in features), F.lit(0.0))
    out = out.withColumn("score", F.sqrt(total / len(features)))
    return out.withColumn("is_anomaly", (F.col("n") >= least) & (F.col("score") > limit))


def contributions(scored: DataFrame, features: list[str]) -> Column:
    """Features by size of their z, largest first."""
    each = F.array(*(F.struct(F.abs(f"z_{n}").alias("size"), F.lit(n).alias("feature"), F.col(f"z_{n}").alias("z")) for n in features))
    return F.transform(F.array_sort(each, lambda a, b: F.when(a["size"] > b["size"], -1).when(a["size"] < b["size"], 1).when(a["feature"] < b["feature"], -1).otherwise(1)), lambda x: F.struct(x["feature"].alias("feature"), x["z"].alias("z")))


def _by_pieces(samples: DataFrame, order: list[str], partition: list[str] | None, before: int, run: Callable, added: str, piece: int) -> DataFrame:
    """samples with columns more, by run(columns, n of the first row, first own row) -> lists for the own rows.

    A series is cut into pieces of `piece` rows, each with the `before` rows ahead of it, so that a task's share is
    bounded however long a series is. Each row goes to two pieces at most.
    """
    piece = max(piece, before)
    n = F.row_number().over(_over(partition, order)) - 1
    own = F.floor(F.col("_n") / piece)
    rows = samples.withColumn("_n", n).withColumn("_piece", F.explode(F.when(F.col("_n") % piece >= piece - before, F.array(own, own + 1)).otherwise(F.array(own))))
    names = samples.columns
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in samples.schema.fields), added])

    def of_piece(key, group):
        group = group.sort_by("_n")
        numbers = group.column("_n").to_pylist()
        first = bisect_left(numbers, key[-1].as_py() * piece)
        out = group.select(names).slice(first)
        for name, values, kind in run(group, numbers[0] if numbers else 0, first):
            out = out.append_column(name, pa.array(values, kind))
        return out

    return rows.groupBy(*(partition or []), "_piece").applyInArrow(of_piece, schema)


class Frame:
    """The last `window` values of a series, in order of size; nulls take a place in the series but not here."""

    def __init__(self, window: int):
        self.window, self.seen, self.sorted = window, [], []

    def add(self, x: float | None) -> None:
        self.seen.append(x)
        if x is not None:
            insort(self.sorted, x)
        old = self.seen[-self.window - 1] if len(self.seen) > self.window else None
        if old is not None:
            del self.sorted[bisect_left(self.sorted, old)]

    def quantile(self, p: float) -> float | None:
        """Linear on (n - 1) p."""
        if not self.sorted:
            return None
        at = (len(self.sorted) - 1) * p
        low = math.floor(at)
        a, b = self.sorted[low], self.sorted[min(low + 1, len(self.sorted) - 1)]
        return a + (b - a) * (at - low)

    def _nearest(self, middle: float, k: int) -> float:
        """The k-th smallest distance to `middle`: the k nearest values stand side by side."""
        s, low, high = self.sorted, 0, len(self.sorted) - k
        while low < high:
            i = (low + high) // 2
            if middle - s[i] > s[i + k - 1] - middle:
                low = i + 1
            else:
                high = i
        return min(max(middle - s[i], s[i + k - 1] - middle) for i in (low, low - 1) if i >= 0)

    def deviation(self) -> tuple[float, float]:
        """Median, and median distance to it."""
        s, n = self.sorted, len(self.sorted)
        if not n:
            return 0.0, 0.0
        middle = (s[(n - 1) // 2] + s[n // 2]) / 2.0
        return middle, (self._nearest(middle, (n + 1) // 2) + self._nearest(middle, n // 2 + 1)) / 2.0


def _values(group, name: str) -> list[float | None]:
    return [None if x is None else float(x) for x in group.column(name).to_pylist()]


def quartile_fence(samples: DataFrame, features: list[str], order: list[str], partition=None, window: int = WINDOW, fence: float = FENCE, piece: int = PIECE) -> DataFrame:
    """Outliers against the quartiles of the last `window` rows; an anomaly if more than a third (whole division) of the features are."""

    def run(group, _, first):
        votes = [0] * (group.num_rows - first)
        for name in features:
            frame = Frame(window)
            for i, x in enumerate(_values(group, name)):
                frame.add(x)
                if i >= first and x is not None:
                    low, high = frame.quantile(0.25), frame.quantile(0.75)
                    votes[i - first] += x < low - fence * (high - low) or x > high + fence * (high - low)
        return [("outliers", votes, pa.int32()), ("is_anomaly", [v > len(features) // 3 for v in votes], pa.bool_())]

    return _by_pieces(samples, order, partition, window - 1, run, "outliers int, is_anomaly boolean", piece)


def median_deviation(samples: DataFrame, features: list[str], order: list[str], partition=None, window: int = WINDOW, limit: float = Z_LIMIT, piece: int = PIECE) -> DataFrame:
    """Modified z 0.6745 (x - median) / MAD over the last `window` rows; score: root mean square (null where a value is)."""

    def run(group, _, first):
        out, totals = [], [0.0] * (group.num_rows - first)
        for name in features:
            frame, z = Frame(window), []
            for i, x in enumerate(_values(group, name)):
                frame.add(x)
                if i >= first:
                    middle, spread = frame.deviation()
                    z.append(0.0 if not spread > 0 else None if x is None else 0.6745 * (x - middle) / spread)
            out.append((f"m_{name}", z, pa.float64()))
            totals = [None if t is None or v is None else t + v * v for t, v in zip(totals, z)]
        score = [None if t is None else math.sqrt(t / len(features)) for t in totals]
        return [*out, ("score", score, pa.float64()), ("is_anomaly", [None if x is None else x > limit for x in score], pa.bool_())]

    added = ", ".join([*(f"m_{n} double" for n in features), "score double", "is_anomaly boolean"])
    return _by_pieces(samples, order, partition, window - 1, run, added, piece)


def forgotten_after(alpha: float) -> int:
    """Rows after which an exponential mean holds less than 1e-18 of what was before: below the precision of doubles."""
    return math.ceil(math.log(1e-18) / math.log(1 - alpha)) if alpha < 1 else 1


def moving_average(samples: DataFrame, value: str, order: list[str], partition: list[str], alpha: float = DECAY, least: int = 10, limit: float = Z_LIMIT, piece: int = PIECE) -> DataFrame:
    """Exponential mean and variance of each key's series, and whether a value is far from what came before.

    Pieces of a long series begin far enough ahead of their first row for nothing of the rows before to be left.
    """

    def run(group, start, first):
        mean = var = 0.0
        means, variances, odd = [], [], []
        for n, x in enumerate(_values(group, value)):
            spread = var**0.5
            odd.append(x is not None and start + n >= least and spread > 0 and abs(x - mean) / spread > limit)
            if n == 0:
                mean = x or 0.0
            elif x is not None:
                delta = x - mean
                mean += alpha * delta
                var = (1 - alpha) * (var + alpha * delta * delta)
            means.append(mean)
            variances.append(var)
        return [("ema", means[first:], pa.float64()), ("em_var", variances[first:], pa.float64()), ("is_anomaly", odd[first:], pa.bool_())]

    return _by_pieces(samples, order, partition, forgotten_after(alpha), run, "ema double, em_var double, is_anomaly boolean", piece)


def last_average(samples: DataFrame, value: str, order: list[str], partition: list[str], alpha: float = DECAY) -> DataFrame:
    """The exponential mean at the end of each key's series, as a weighted sum: combined before the shuffle's end, no series is gathered."""
    w = Window.partitionBy(*partition).orderBy(*order)
    back = F.count("*").over(Window.partitionBy(*partition)) - F.row_number().over(w)  # rows after this one
    first = F.row_number().over(w) == 1
    weight = F.pow(F.lit(1.0 - alpha), back) * F.when(first, 1.0).otherwise(alpha)
    return samples.withColumn("_w", weight).groupBy(*partition).agg(F.sum(F.col("_w") * F.col(value)).alias("ema"))


def seasonal(samples: DataFrame, value: str, order: str, period: int, partition: list[str] | None = None) -> DataFrame:
    """Trend (mean of `period` values around each, half weights at the ends if even), phase means of what is left, residual and its z."""
    part = partition or []
    base = Window.partitionBy(*(part or [F.lit(0)]))
    w = base.orderBy(order)
    half = period // 2
    around = w.rowsBetween(-half, half)
    total = F.sum(value).over(around)
    if period % 2 == 0:
        total = total - 0.5 * (F.lag(value, half).over(w) + F.lead(value, half).over(w))
    n = F.row_number().over(w)
    out = samples.withColumn("phase", (n - 1) % period).withColumn("full", F.count(value).over(around) == 2 * half + 1)
    out = out.withColumn("trend", F.when(F.col("full"), total / period))
    detrended = F.col(value) - F.col("trend")
    by_phase = Window.partitionBy(*part, "phase") if part else Window.partitionBy("phase")
    out = out.withColumn("season", F.avg(detrended).over(by_phase)).withColumn("residual", detrended - F.col("season"))
    spread = F.stddev_pop("residual").over(base)
    return out.withColumn("z", F.when(spread > 0, (F.col("residual") - F.avg("residual").over(base)) / spread)).drop("full")


def inter_arrival(packets: DataFrame, partition: list[str] = ("flow_id",)) -> DataFrame:
    w = Window.partitionBy(*partition).orderBy("packet_id")
    return packets.withColumn("iat_nano", F.col("ts_nano") - F.lag("ts_nano").over(w))


def feature_stats(samples: DataFrame, features: list[str]) -> DataFrame:
    """One row a feature: n, mean, sample variance and deviation, least, most. One pass over the data."""
    parts = [F.struct(F.lit(f).alias("feature"), F.count(f).alias("n"), F.avg(f).alias("mean"), F.var_samp(f).alias("variance"), F.stddev_samp(f).alias("std"), F.min(f).alias("least"), F.max(f).alias("most")) for f in features]
    return samples.agg(F.array(*parts).alias("x")).select(F.inline("x"))


def variance_ranking(samples: DataFrame, features: list[str], threshold: float, top: int) -> DataFrame:
    """Features by population variance; those both above the threshold and among the first `top`."""
    parts = [F.struct(F.lit(f).alias("feature"), F.var_pop(f).alias("variance")) for f in features]
    rows = samples.agg(F.array(*parts).alias("x")).select(F.inline("x"))
    rank = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("variance"), "feature"))  # one row a feature
    return rows.withColumn("rank", rank).withColumn("selected", (F.col("variance") > threshold) & (F.col("rank") <= top))


def fitted(samples: DataFrame, features: list[str]) -> dict[str, dict[str, float]]:
    """Mean, population deviation, least and most of each feature: a few numbers."""
    row = samples.agg(*(g(f).alias(f"{f}|{n}") for f in features for n, g in (("mean", F.avg), ("std", F.stddev_pop), ("min", F.min), ("max", F.max)))).first()
    return {f: {n: row[f"{f}|{n}"] for n in ("mean", "std", "min", "max")} for f in features}


def normalized(samples: DataFrame, features: list[str], fit: dict | None, method: str = "zscore") -> DataFrame:
    """Scaled by a fit; zero where there is no spread, unchanged without a fit."""
    if not fit:
        return samples
    out = samples
    for f in features:
        x = fit[f]
        span = x["std"] if method == "zscore" else (x["max"] or 0) - (x["min"] or 0)
        from_ = x["mean"] if method == "zscore" else x["min"]
        out = out.withColumn(f, (F.col(f) - from_) / span if span else F.lit(0.0))
    return out


def percentiles(samples: DataFrame, value: str, shares: list[float], by: list[str] = ()) -> DataFrame:
    """Exact, interpolated linearly on (n - 1) p."""
    return samples.groupBy(*by).agg(*(F.percentile(F.col(value).cast("double"), F.lit(p)).alias(f"p{round(p * 100):02d}") for p in shares))


def histogram(samples: DataFrame, value: str, bounds: list[float], by: list[str] = ()) -> DataFrame:
    """Cumulative buckets (at most the bound), +Inf, sum and count."""
    tops = [F.struct(F.lit(str(b)).alias("le"), F.count_if(F.col(value) <= b).alias("count")) for b in bounds] + [F.struct(F.lit("+Inf").alias("le"), F.count("*").alias("count"))]
    return samples.groupBy(*by).agg(F.array(*tops).alias("x"), F.sum(value).alias("sum"), F.count("*").alias("total")).select(*by, F.inline("x"), "sum", "total")


def nearest_rank(values: Column, p: float) -> Column:
    """The element at floor(n p) of a sorted array."""
    s = F.array_sort(values)
    return F.element_at(s, F.least(F.floor(F.size(s) * p).cast("int") + 1, F.size(s)))


def sliding_windows(packets: DataFrame, size: int, step: int, time: str = "ts_nano") -> DataFrame:
    """Windows from the first packet on, each `step` after the other, that begin before the last; half-open, empty ones left out.

    A packet is put into its at most size / step windows by arithmetic: no range join.
    """
    first, last = F.min(time), F.max(time)
    span = packets.agg(first.alias("first"), last.alias("last")).first()  # two numbers
    if span["first"] is None:
        return packets.select("*", F.lit(0).cast("long").alias("window_start")).limit(0)
    begin, end = span["first"], span["last"]
    since = F.col(time) - begin
    low = F.greatest(F.floor((since - size) / step).cast("long") + 1, F.lit(0))
    ids = F.sequence(low, F.floor(since / step).cast("long"))
    rows = packets.withColumn("w", F.explode(F.when(low <= F.floor(since / step), ids).otherwise(F.array().cast("array<bigint>"))))
    rows = rows.withColumn("window_start", F.col("w") * step + begin).drop("w")
    return rows.filter((F.col(time) < F.col("window_start") + size) & (F.col("window_start") < end))


def window_features(windowed: DataFrame, by: list[str] = ("window_start",)) -> DataFrame:
    """Sizes and protocol shares of each window's packets."""
    n = F.col("length").cast("double")
    return windowed.groupBy(*by).agg(
        F.count("*").alias("packets"), F.sum("length").alias("bytes"), F.min(n).alias("min_len"), F.max(n).alias("max_len"), F.avg(n).alias("mean_len"), F.stddev_pop(n).alias("std_len"),
        F.count_if(F.col("protocol") == "TCP").alias("tcp"), F.count_if(F.col("protocol") == "UDP").alias("udp"),
    )


def sessions(packets: DataFrame, gap_nano: int, key: str = "flow_id") -> DataFrame:
    """Activity of a key that no pause longer than the gap divides."""
    w = Window.partitionBy(key).orderBy("ts_nano", "packet_id")
    new = F.coalesce(((F.col("ts_nano") - F.lag("ts_nano").over(w)) > gap_nano).cast("int"), F.lit(1))
    rows = packets.withColumn("new", new).withColumn("session", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(key, "session").agg(F.min("ts_nano").alias("start_nano"), F.max("ts_nano").alias("end_nano"), F.count("*").alias("packets"), F.sum("length").alias("bytes"))
