"""Ordered statistics against plain loops, with series cut into small pieces."""

import math
import random
import statistics

from wirespark.operators import series


def rows():
    random.seed(3)
    out = []
    for key in "abc":
        for i in range({"a": 700, "b": 45, "c": 1}[key]):
            x = None if i % 41 == 7 else float(random.choice([random.randint(0, 9), random.randint(0, 400)]))
            out.append((key, i, x, float(i % 13)))
    random.shuffle(out)
    return out


def by_key(data):
    out = {}
    for key, i, x, y in sorted(data):
        out.setdefault(key, []).append((i, x, y))
    return out


def quantile(values, p):
    s = sorted(values)
    at = (len(s) - 1) * p
    return s[math.floor(at)] + (s[math.ceil(at)] - s[math.floor(at)]) * (at - math.floor(at))


def test_fence_and_deviation(spark):
    data = rows()
    frame = spark.createDataFrame(data, "key string, i int, x double, y double").repartition(3)
    fence = {(r.key, r.i): (r.outliers, r.is_anomaly) for r in series.quartile_fence(frame, ["x", "y"], ["i"], ["key"], window=30, piece=50).collect()}
    mad = {(r.key, r.i): r for r in series.median_deviation(frame, ["x", "y"], ["i"], ["key"], window=30, piece=50).collect()}
    assert len(fence) == len(mad) == len(data)
    for key, own in by_key(data).items():
        for k, (i, *now) in enumerate(own):
            votes, total = 0, 0.0
            for f, x in enumerate(now, 1):
                seen = [r[f] for r in own[max(0, k - 29) : k + 1] if r[f] is not None]
                a, b = (quantile(seen, 0.25), quantile(seen, 0.75)) if seen else (0, 0)
                votes += x is not None and (x < a - 1.5 * (b - a) or x > b + 1.5 * (b - a))
                m = statistics.median(seen) if seen else 0.0
                spread = statistics.median([abs(v - m) for v in seen]) if seen else 0.0
                z = 0.0 if not spread else None if x is None else 0.6745 * (x - m) / spread
                total = None if total is None or z is None else total + z * z
            assert fence[key, i] == (votes, votes > 0)
            got = mad[key, i]
            assert got.score is None if total is None else math.isclose(got.score, math.sqrt(total / 2), abs_tol=1e-9)


def test_moving_averages_of_long_series(spark):
    random.seed(4)
    data = [(k, i, random.random() * (50 if i % 97 == 0 else 1)) for k in ("a", "b") for i in range(3000 if k == "a" else 5)]
    frame = spark.createDataFrame(data, "key string, i int, x double").repartition(3)
    got = {(r.key, r.i): r for r in series.moving_average(frame, "x", ["i"], ["key"], piece=500).collect()}
    last = {r.key: r.ema for r in series.last_average(frame, "x", ["i"], ["key"]).collect()}
    for key in ("a", "b"):
        mean = var = 0.0
        for i, (_, _, x) in enumerate(sorted(r for r in data if r[0] == key)):
            odd = i >= 10 and var > 0 and abs(x - mean) / math.sqrt(var) > 3
            mean, var = (x, 0.0) if i == 0 else (mean + 0.1 * (x - mean), 0.9 * (var + 0.1 * (x - mean) ** 2))
            r = got[key, i]
            assert math.isclose(r.ema, mean, rel_tol=1e-12) and math.isclose(r.em_var, var, rel_tol=1e-9, abs_tol=1e-15) and r.is_anomaly == odd
        assert math.isclose(last[key], mean, rel_tol=1e-12)
    assert sum(r.is_anomaly for r in got.values()) > 0


def test_without_partition_and_empty(spark):
    frame = spark.createDataFrame([(i, float(i)) for i in range(20)], "i int, x double")
    assert series.quartile_fence(frame, ["x"], ["i"], window=5, piece=7).count() == 20
    assert series.median_deviation(frame.limit(0), ["x"], ["i"], window=5).count() == 0
