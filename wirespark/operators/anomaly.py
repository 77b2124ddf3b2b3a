"""Isolation forest, local outlier factor, and the two joined with z-scores.

Forests are fitted on a bounded sample (a parameter) and applied to all rows by Arrow batches; the factor of all rows
against all rows (lof_scores) and the forest's threshold (contamination_limit) leave none out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wirespark.sources.files import scratch

TREES, SAMPLE, DEPTH, CONTAMINATION, NEIGHBOURS = 100, 256, 8, 0.1, 20
WEIGHTS = {"z": 0.4, "forest": 0.35, "lof": 0.25}


def average_path(n):
    n = np.asarray(n, float)
    return np.where(n > 1, 2 * (np.log(np.maximum(n - 1, 1)) + 0.5772156649015329) - 2 * (n - 1) / np.maximum(n, 1), 0.0)


class IsolationForest:
    """Trees as arrays: feature, threshold, children, depth plus the expected rest at leaves."""

    def __init__(self, data: np.ndarray, trees: int = TREES, sample: int = SAMPLE, depth: int = DEPTH, contamination: float = CONTAMINATION, seed: int = 1):
        rng, self.trees = np.random.default_rng(seed), []
        self.size = min(sample, len(data))
        for _ in range(trees):
            nodes: list[list[float]] = []
            rows = data[rng.choice(len(data), self.size, replace=False)]
            self._grow(rows, 0, depth, rng, nodes)
            self.trees.append(np.array(nodes))
        scores = np.sort(self.score(data))
        self.threshold = float(scores[min(len(scores) - 1, int(len(scores) * (1 - contamination)))])

    def _grow(self, rows, level, depth, rng, nodes) -> int:
        me = len(nodes)
        nodes.append([-1, 0, 0, 0, level + float(average_path(len(rows)))])
        low, high = (rows.min(0), rows.max(0)) if len(rows) else (0, 0)
        open_ = np.flatnonzero(np.asarray(high) > np.asarray(low)) if len(rows) > 1 else []
        if level >= depth or not len(open_):
            return me
        feature = int(rng.choice(open_))
        at = rng.uniform(low[feature], high[feature])
        left = rows[:, feature] < at
        a = self._grow(rows[left], level + 1, depth, rng, nodes)
        b = self._grow(rows[~left], level + 1, depth, rng, nodes)
        nodes[me][:4] = [feature, at, a, b]
        return me

    def score(self, data: np.ndarray) -> np.ndarray:
        """2^(-mean path / expected path): near 1 for what is cut off early."""
        total = np.zeros(len(data))
        for tree in self.trees:
            at = np.zeros(len(data), np.int64)
            while True:
                feature = tree[at, 0].astype(np.int64)
                inner = np.flatnonzero(feature >= 0)
                if not len(inner):
                    break
                left = data[inner, feature[inner]] < tree[at[inner], 1]
                at[inner] = np.where(left, tree[at[inner], 2], tree[at[inner], 3]).astype(np.int64)
            total += tree[at, 4]
        return 2.0 ** (-(total / len(self.trees)) / max(float(average_path(self.size)), 1e-9))


class LocalOutlierFactor:
    """Density of a point against its neighbours', among the fitted rows (more than k of them)."""

    def __init__(self, data: np.ndarray, k: int = NEIGHBOURS):
        if len(data) <= k:
            raise ValueError("more rows than neighbours are needed")
        self.data, self.k = data, k
        d = self._distances(data)
        np.fill_diagonal(d, np.inf)
        near = np.argsort(d, 1, kind="stable")[:, :k]
        self.reach = d[np.arange(len(d)), near[:, -1]]
        self.density = self._density(np.take_along_axis(d, near, 1), near)

    def _distances(self, x: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum((x**2).sum(1)[:, None] + (self.data**2).sum(1)[None] - 2 * x @ self.data.T, 0))

    def _density(self, distance: np.ndarray, near: np.ndarray) -> np.ndarray:
        return 1.0 / np.maximum(np.maximum(distance, self.reach[near]).mean(1), 1e-12)

    def score(self, x: np.ndarray) -> np.ndarray:
        """(factor - 1) / 2, between 0 and 1."""
        d = self._distances(x)
        near = np.argsort(d, 1, kind="stable")[:, : self.k]
        own = self._density(np.take_along_axis(d, near, 1), near)
        return np.clip((self.density[near].mean(1) / own - 1) / 2, 0, 1)


def sampled(rows: DataFrame, features: list[str], most: int, key: str) -> np.ndarray:
    """At most `most` rows, the first by hash of their key: the same for every partitioning."""
    got = rows.select(*(F.col(f).cast("double") for f in features), F.xxhash64(key).alias("_h"), F.col(key).alias("_k")).orderBy("_h", "_k").limit(most).drop("_h", "_k").toPandas()
    return got.to_numpy(float)


def scored(rows: DataFrame, features: list[str], model, name: str) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(model)  # bounded by the sample it was fitted on

    @F.pandas_udf("double")
    def run(*columns: pd.Series) -> pd.Series:
        x = np.stack([c.to_numpy(float) for c in columns], 1)
        return pd.Series(shared.value.score(x) if len(x) else np.zeros(0))

    return rows.withColumn(name, run(*(F.col(f).cast("double") for f in features)))


def contamination_limit(rows: DataFrame, score: str, contamination: float = CONTAMINATION) -> float:
    """The score that the given share of all rows exceeds, as IsolationForest has it for the rows it was fitted on."""
    n = rows.count()
    at = min(n - 1, int(n * (1 - contamination)))
    return float(rows.select(score).orderBy(score).rdd.zipWithIndex().filter(lambda x: x[1] == at).first()[0][0])


def _staged(df: DataFrame, name: str) -> DataFrame:
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _nearest(q: np.ndarray, q_ids: np.ndarray, x: np.ndarray, x_ids: np.ndarray, k: int):
    """Rows of q, rows of x and distances of the k nearest to each of q among x but itself; ties go to the earlier of x.

    A matrix product finds who may be among the k, within its rounding error; their distances are summed from differences.
    """
    k, squares = min(k, len(x)), (x**2).sum(1)
    for start in range(0, len(q), 256):
        part = q[start : start + 256]
        own = (part**2).sum(1)[:, None]
        d = own + squares[None] - 2 * part @ x.T
        d[q_ids[start : start + 256, None] == x_ids[None]] = np.inf
        error = 8 * x.shape[1] * np.finfo(float).eps * (own + squares.max())
        row, other = np.nonzero(d <= np.partition(d, k - 1, 1)[:, k - 1 : k] + error)
        exact = np.empty(len(row))
        for at in range(0, len(row), 1 << 16):  # copies may make many of them
            r, o = row[at : at + (1 << 16)], other[at : at + (1 << 16)]
            exact[at : at + (1 << 16)] = ((part[r] - x[o]) ** 2).sum(1)
        exact[q_ids[start + row] == x_ids[other]] = np.inf
        order = np.lexsort((other, exact, row))
        first = np.searchsorted(row, np.arange(len(part)))  # row is in order already, and stays so
        order = order[np.arange(len(row)) - first[row] < k]
        order = order[np.isfinite(exact[order])]
        yield row[order] + start, other[order], np.sqrt(exact[order])


def neighbours(rows: DataFrame, features: list[str], key: str, k: int, block_rows: int = 4096) -> DataFrame:
    """id, other, distance, rank: the k nearest of all other rows. Blocks of bounded size meet in pairs, and the best of
    each pair are merged, so no task holds all rows. key is unique; rows with a feature that is null or not finite take no part."""
    far = float("inf")
    sound = rows.select(F.col(key).cast("long").alias("id"), *(F.col(f).cast("double") for f in features)).filter(" AND ".join(f"abs({f}) < double('{far}') AND NOT isnan({f})" for f in features))
    n = sound.count()
    if n <= k:
        raise ValueError("more rows than neighbours are needed")
    shards, width = -(-n // block_rows), len(features)

    def packed(group_key, group):
        group = group.sort_by("id")
        data = np.stack([group.column(f).to_numpy() for f in features], 1)
        return pa.table({"shard": pa.array([group_key[0].as_py()], pa.int64()), "ids": [group.column("id").to_numpy().tobytes()], "data": [data.tobytes()]})

    blocks = _staged(sound.withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shards))).groupBy("shard").applyInArrow(packed, "shard long, ids binary, data binary"), "blocks")

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                q_ids, x_ids = np.frombuffer(r["q_ids"], np.int64), np.frombuffer(r["ids"], np.int64)
                q, x = np.frombuffer(r["q_data"]).reshape(-1, width), np.frombuffer(r["data"]).reshape(-1, width)
                for a, b, d in _nearest(q, q_ids, x, x_ids, k):
                    yield pa.record_batch([pa.array(q_ids[a]), pa.array(x_ids[b]), pa.array(d)], ["id", "other", "distance"])

    queries = blocks.select(F.col("shard").alias("q"), F.col("ids").alias("q_ids"), F.col("data").alias("q_data"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))).alias("shard"))
    pairs = queries.join(blocks, "shard").repartition(min(shards * shards, 10_000), "q", "shard")
    found = pairs.select("q_ids", "q_data", "ids", "data").mapInArrow(run, "id long, other long, distance double")
    rank = F.row_number().over(Window.partitionBy("id").orderBy("distance", "other"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)


def lof_scores(rows: DataFrame, features: list[str], key: str, name: str, k: int = NEIGHBOURS, block_rows: int = 4096) -> DataFrame:
    """rows with LocalOutlierFactor(all rows).score of each, null where a feature is null or not finite.

    As in the model, densities are of the k nearest others, and a row that is scored is its own first neighbour.
    """
    near = _staged(neighbours(rows, features, key, k, block_rows), "neighbours")
    reach = near.filter(F.col("rank") == k).select(F.col("id").alias("other"), F.col("distance").alias("reach"))
    far = near.join(reach, "other").withColumn("far", F.greatest("distance", "reach"))
    own_reach = F.max(F.when(F.col("rank") == k, F.col("distance")))
    inner = F.coalesce(F.sum(F.when(F.col("rank") < k, F.col("far"))), F.lit(0.0))
    density = far.groupBy("id").agg(
        (1 / F.greatest(F.avg("far"), F.lit(1e-12))).alias("density"),
        (1 / F.greatest((inner + own_reach) / k, F.lit(1e-12))).alias("own"),
    )
    density = _staged(density, "densities")
    others = near.filter(F.col("rank") < k).join(density.select(F.col("id").alias("other"), F.col("density").alias("d")), "other").groupBy("id").agg(F.sum("d").alias("d"))
    score = density.join(others, "id", "left").select(
        "id", F.greatest(F.lit(0.0), F.least(F.lit(1.0), (((F.coalesce("d", F.lit(0.0)) + F.col("density")) / k) / F.col("own") - 1) / 2)).alias(name)
    )
    return rows.join(score.withColumnRenamed("id", "_id"), F.col(key).cast("long") == F.col("_id"), "left").drop("_id")


def ensemble(z: Column, forest: Column, lof: Column, limit: float = 3.0) -> Column:
    """struct(score, is_anomaly)."""
    score = WEIGHTS["z"] * F.least(F.lit(1.0), z / limit) + WEIGHTS["forest"] * forest + WEIGHTS["lof"] * lof
    return F.struct(score.alias("score"), (score > 0.5).alias("is_anomaly"))


def onnx_scores(rows: DataFrame, features: list[str], path: str, name: str = "probabilities", least: float = 0.5) -> DataFrame:
    """Probabilities of an ONNX model, a session for each task and real batches; top3 and label (null under `least`)."""

    @F.pandas_udf("array<double>")
    def run(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        import onnxruntime

        session = onnxruntime.InferenceSession(path, providers=["CPUExecutionProvider"])
        for columns in batches:
            x = np.stack([c.to_numpy(np.float32) for c in columns], 1)
            out = session.run(None, {session.get_inputs()[0].name: x})[-1]
            yield pd.Series([np.asarray(r, float).tolist() for r in out])

    p = rows.withColumn(name, run(*features))
    ranked = F.array_sort(F.transform(name, lambda v, i: F.struct((-v).alias("p"), i.alias("label"))))
    top = F.transform(F.slice(ranked, 1, 3), lambda r: F.struct(r["label"].alias("label"), (-r["p"]).alias("probability")))
    return p.withColumn("top3", top).withColumn("label", F.when(F.get("top3", F.lit(0))["probability"] >= least, F.get("top3", F.lit(0))["label"]))
