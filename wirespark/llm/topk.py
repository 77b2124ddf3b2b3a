"""Operator 3: exact top-k inner products by ball-tree branch and bound.

Vectors become integers, floor(256 x). Rows are dealt by a hash of their id to shards of bounded size; each shard's ball
tree (median splits along the widest dimension) is built once and kept in a file of the shared folder. A query meets a
node's upper bound q.c + |q| r, never more than its parent's, goes first to the child with the higher bound, and leaves
out what is below its current k-th score. Queries go down a tree together, each by its own order.

The k-th score is shared: shards are searched in waves, the first of one shard and each later one of WAVE times as many,
and every query starts a wave with the k-th score of all waves before as its floor. Queries travel in blocks of bounded
size; tasks get names of files, so no task holds all rows or all queries, and neither trees nor vectors are shuffled
once for each pair. How many vectors were scored, of how many, is logged.

Defined results: vectors that are null, or hold null or non-finite components, take no part; vectors are compared with
those of the same number of components; repeated rows count as rows (a query is never matched with its own id); ties go
to the smaller vec_id; an empty table gives no rows; other columns are ignored. Scores beyond a long are held at its ends.
"""

from __future__ import annotations

import logging

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wirespark.llm.common import shared_path, staged, table
from wirespark.llm.katz import pack, unpack
from wirespark.llm.storage import open_file, write_file

LEAF = 128
WAVE = 8
NONE = -(1 << 63)


class BallTree:
    """Nodes in arrays: begin, end (rows), left child (0 for a leaf; the right one comes after it), centre, radius. Node 0 is the root."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, nodes: tuple):
        self.ids, self.vectors = ids, vectors
        self.begin, self.end, self.child, self.centres, self.radii = nodes

    @classmethod
    def build(cls, ids: np.ndarray, vectors: np.ndarray, leaf: int = LEAF) -> BallTree:
        order = np.lexsort((ids,))
        ids, vectors = ids[order], vectors[order].astype(np.int64)
        rows, begin, end, child = np.arange(len(ids)), [0], [len(ids)], [0]
        at = 0
        while at < len(begin):
            a, b = begin[at], end[at]
            if b - a > leaf:
                part = rows[a:b]
                x = vectors[part]
                widest = int(np.argmax(x.max(0) - x.min(0))) if x.shape[1] else 0
                by = np.argsort(x[:, widest], kind="stable") if x.shape[1] else np.arange(b - a)
                half = (b - a) // 2
                rows[a : a + half], rows[a + half : b] = np.sort(part[by[:half]]), np.sort(part[by[half:]])
                child[at] = len(begin)
                begin += [a, a + half]
                end += [a + half, b]
                child += [0, 0]
            at += 1
        vectors, ids = vectors[rows], ids[rows]
        x = vectors.astype(np.float64)
        centres = np.stack([x[a:b].mean(0) if b > a else np.zeros(x.shape[1]) for a, b in zip(begin, end)])
        radii = np.array([np.sqrt(((x[a:b] - c) ** 2).sum(1).max(initial=0.0)) for a, b, c in zip(begin, end, centres)])
        return cls(ids, vectors, (np.array(begin), np.array(end), np.array(child), centres, radii))

    def to_bytes(self) -> bytes:
        return pack(self.ids, self.vectors.reshape(-1), self.begin, self.end, self.child, self.centres.reshape(-1), self.radii)

    @classmethod
    def of_bytes(cls, data: bytes) -> BallTree:
        ids, flat, begin, end, child, centres, radii = unpack(data)
        return cls(ids, flat.reshape(len(ids), -1 if len(ids) else 0), (begin, end, child, centres.reshape(len(begin), -1), radii))

    def search(self, query_ids: np.ndarray, queries: np.ndarray, floors: list[int | None], k: int) -> tuple[list[tuple[int, int, int]], np.ndarray]:
        """(query_id, vec_id, score) of each query's k best here that reach its floor, its own id left out; and how many vectors each query scored."""
        n = len(query_ids)
        q = queries.astype(np.float64)
        norms = np.sqrt((q**2).sum(1))
        top = max((int(np.abs(x).max()) for x in (self.vectors, queries) if x.size), default=0)
        exact = top < 1 << 26 and top * top * max(1, queries.shape[1]) < 1 << 53  # then sums in doubles are exact
        rows = self.vectors.astype(np.float64) if exact else None
        kth = np.array([-np.inf if x is None else float(x) for x in floors])
        floors_exact: list = [None if x is None else int(x) for x in floors]
        best: list[list[tuple[int, int]]] = [[] for _ in range(n)]  # (-score, id), in order
        scored = np.zeros(n, np.int64)

        def bound(node: int, some: np.ndarray) -> np.ndarray:
            b = q[some] @ self.centres[node] + norms[some] * self.radii[node]
            return b + 1e-6 * (1 + np.abs(b))  # rounding may not hide a row

        def leaf(node: int, some: np.ndarray) -> None:
            a, b = int(self.begin[node]), int(self.end[node])
            scored[some] += b - a
            if exact:
                scores = q[some] @ rows[a:b].T
                for j in np.flatnonzero((scores >= kth[some][:, None]).any(1)).tolist():
                    i = int(some[j])
                    at = np.flatnonzero(scores[j] >= kth[i])
                    add(i, list(zip((-scores[j, at]).astype(np.int64).tolist(), self.ids[a + at].tolist())))
            else:
                for i in some.tolist():
                    own = queries[i].tolist()
                    add(i, [(-sum(x * y for x, y in zip(row, own)), v) for row, v in zip(self.vectors[a:b].tolist(), self.ids[a:b].tolist())])

        def add(i: int, found: list[tuple[int, int]]) -> None:
            found = [x for x in found if x[1] != query_ids[i] and (floors_exact[i] is None or -x[0] >= floors_exact[i])]
            if found:
                best[i] = sorted(best[i] + found)[:k]
                if len(best[i]) == k and (floors_exact[i] is None or -best[i][-1][0] > floors_exact[i]):
                    floors_exact[i] = -best[i][-1][0]
                    kth[i] = np.nextafter(float(floors_exact[i]), -np.inf) if not exact else float(floors_exact[i])

        def visit(node: int, some: np.ndarray, above: np.ndarray) -> None:
            """The queries `some`, whose bound here is `above`."""
            some, above = some[above >= kth[some]], above[above >= kth[some]]
            if not len(some) or self.begin[node] == self.end[node]:
                return
            left = int(self.child[node])
            if not left:
                leaf(node, some)
                return
            b1, b2 = np.minimum(above, bound(left, some)), np.minimum(above, bound(left + 1, some))
            first = b1 >= b2
            visit(left, some[first], b1[first])
            visit(left + 1, some[~first], b2[~first])
            visit(left + 1, some[first], b2[first])
            visit(left, some[~first], b1[~first])

        everyone = np.arange(n)
        visit(0, everyone, bound(0, everyone))
        return [(int(query_ids[i]), v, -s) for i in range(n) for s, v in best[i]], scored


def integers(embeddings: DataFrame, vec_id: str = "vec_id", column: str = "embedding") -> DataFrame:
    """vec_id, dim and v: floor(256 x) as array<long>, of the vectors that take part."""
    v = F.transform(F.col(column), lambda x: x.cast("double"))
    fit = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    kept = embeddings.select(F.col(vec_id).cast("long").alias("vec_id"), v.alias("v")).filter(F.coalesce(fit, F.lit(False)) & F.col("vec_id").isNotNull())
    return kept.select("vec_id", F.size("v").alias("dim"), F.transform("v", lambda x: F.floor(F.lit(256.0) * x)).alias("v"))


def _grouped(rows: DataFrame, label: str, groups: int, folder: str) -> DataFrame:
    """Groups of rows as files: dim, label, path. A group's file has a tree (shards), or ids and vectors (blocks of queries)."""

    def run(key, group):
        dim = key[0].as_py()
        ids = np.array(group.column("vec_id").to_pylist(), np.int64)
        flat = np.array([x for v in group.column("v").to_pylist() for x in v], np.int64)
        path = f"{folder}/{label}-{dim}-{key[1].as_py()}"  # attempts write the same bytes
        order = np.lexsort((ids,))
        vectors = flat.reshape(len(ids), dim)
        write_file(path, [BallTree.build(ids, vectors).to_bytes() if label == "shard" else pack(ids[order], vectors[order].reshape(-1))])
        return pa.table({"dim": pa.array([dim], pa.int32()), label: pa.array([key[1].as_py()], pa.int32()), "path": [path]})

    part = F.pmod(F.xxhash64("vec_id", F.hash("v")), F.lit(groups)).cast("int")
    return staged(rows.withColumn(label, part).groupBy("dim", label).applyInArrow(run, f"dim int, {label} int, path string"), label)


def _read(path: str) -> bytes:
    file = open_file(path)
    try:
        return file.read()
    finally:
        file.close()


def top_k(base: DataFrame, queries: DataFrame, k: int, shard_rows: int = 8192, block_rows: int = 2048) -> DataFrame:
    """base and queries: vec_id, dim, v. Gives query_id, rank, vec_id, score."""
    spark = base.sparkSession
    base, queries = staged(base, "vectors"), staged(queries, "queries")
    folder = shared_path(spark, "trees")
    n_base = base.count()
    shards, blocks = max(1, -(-n_base // shard_rows)), max(1, -(-queries.count() // block_rows))
    trees = _grouped(base, "shard", shards, folder).withColumnRenamed("path", "tree")
    asked = _grouped(queries, "block", blocks, folder).withColumnRenamed("path", "block_file")

    def searched(pairs: DataFrame) -> DataFrame:
        """Rows of found vectors, and for each query of a pair one of how many it scored (vec_id null)."""

        def run(batches):
            last, tree = None, None
            for batch in batches:
                for r in batch.to_pylist():
                    if r["tree"] != last:  # pairs come in the order of their trees
                        last, tree = r["tree"], BallTree.of_bytes(_read(r["tree"]))
                    query_ids, flat = unpack(_read(r["block_file"]))
                    known = {x["query_id"]: x["floor"] for x in r["floors"] or []}
                    found, scored = tree.search(query_ids, flat.reshape(len(query_ids), r["dim"]), [known.get(x) for x in query_ids.tolist()], k)
                    ends = 1 << 63
                    rows = [(r["dim"], r["block"], q, v, max(-ends, min(ends - 1, s)), None) for q, v, s in found]
                    rows.append((r["dim"], r["block"], None, None, None, int(scored.sum())))
                    columns = list(zip(*rows))
                    yield pa.record_batch([pa.array(c, pa.int64()) for c in columns], ["dim", "block", "query_id", "vec_id", "score", "scored"])

        return pairs.mapInArrow(run, "dim long, block long, query_id long, vec_id long, score long, scored long")

    found, begin, end = None, 0, 1
    while begin < shards:
        wave = trees.filter((F.col("shard") >= begin) & (F.col("shard") < end))
        pairs = asked.join(F.broadcast(wave) if end == 1 else wave, "dim")  # the first wave has one shard of each dimension
        if found is None:
            pairs = pairs.withColumn("floors", F.lit(None).cast("array<struct<query_id:bigint,floor:bigint>>"))
        else:
            by = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
            best = found.filter("vec_id is not null").withColumn("rank", F.row_number().over(by)).filter(F.col("rank") == k)
            floors = best.groupBy("dim", "block").agg(F.collect_list(F.struct("query_id", F.col("score").alias("floor"))).alias("floors"))  # of a block's queries
            pairs = pairs.join(floors, ["dim", "block"], "left")
        tasks = max(1, min(end, shards) - begin) * blocks
        more = staged(searched(pairs.repartitionByRange(tasks, "tree", "block").sortWithinPartitions("tree", "block")), "found")
        found = more if found is None else found.unionByName(more)
        begin, end = end, end + WAVE * (end - begin)
    total = found.agg(F.sum("scored")).first()[0] or 0
    logging.getLogger(__name__).info("scored %d of %d pairs of a query and a vector", total, n_base * queries.count())
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.filter("vec_id is not null").withColumn("rank", F.row_number().over(by))
    return ranked.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op3_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = integers(table(spark, sf_dir, "embeddings"))
    asked = base.filter("vec_id % 50 = 0").groupBy("vec_id").agg(F.min(F.struct("dim", "v")).alias("x")).select("vec_id", "x.dim", "x.v")
    return top_k(base, asked, 5)
