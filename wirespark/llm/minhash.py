"""Operator 10: near-duplicates by min-max hashing.

Each permutation of the shingles keeps its minimum and its maximum, so half as many hash evaluations give a signature
of the same length; both are unbiased and their estimates vary less than those of minima alone. Signatures are banded:
BANDS bands of ROWS values meet at similarity 0.85 but for a chance of 6e-11, at 0.8 of 5e-8. Sets of candidates are
compared in full, so no link is taken on an estimate. The last step below leaves out pairs of a band whose signatures
agree so little that a similar pair would do so with a chance of LOSS at most; that is small beside what banding misses.

Equal sets are one class, found by digest. Classes that share a band are first compared with the smallest class of that
band (as many pairs as classes, not all pairs), then, where members are still in different components, with another
class, a different one for each band; the links found give components. Members that are in different components even so
are compared with each other inside tasks of bounded groups, most similar first, skipping
pairs that have become connected: every link that matters is found, and rows never grow with the square of a group.
Full sets stay in files of the shared folder, and rows carry pointers to them, so sets are never shuffled.

Defined results: null text and text without words have an empty set and are linked with nothing; fewer words than a
shingle make one shingle; ties go to the smaller doc_id; repeated rows are members of the same class, each returned;
an empty table gives no rows; other columns are ignored. Shingles are 64-bit hashes: the chance that two of a pair of
20,000-word texts collide is about one in 10^11.
"""

from __future__ import annotations

import math
import uuid
from collections import OrderedDict

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wirespark.llm.common import doc_texts, release, shared_path, staged, table
from wirespark.llm.graph import components
from wirespark.llm.katz import pack, small, unpack
from wirespark.llm.storage import filesystem, open_file

PERMUTATIONS, ROWS = 64, 4
BANDS = 2 * PERMUTATIONS // ROWS
SIGNATURE_BYTES = 8 * PERMUTATIONS
#: Members of a band that one task compares with each other at a time.
GROUP = 1024


#: The chance, for a pair at the threshold, that its signatures agree in fewer values than least_agreeing() asks for.
LOSS = 1e-12
#: Documents whose bands one task brings together, about.
PART_DOCUMENTS = 8192


def least_agreeing(percent: int, loss: float = LOSS) -> int:
    """The most values k of a signature such that a pair of the given similarity agrees in fewer than k with a chance of at most `loss`."""
    n, s, below = 2 * PERMUTATIONS, percent / 100, 0.0
    for k in range(n + 1):
        below += math.comb(n, k) * s**k * (1 - s) ** (n - k)
        if below > loss:
            return k
    return n


_rng = np.random.default_rng(20240501)
_FACTORS = (_rng.integers(0, 1 << 31, PERMUTATIONS, dtype=np.uint32) << np.uint32(1)) | np.uint32(1)
_SHIFTS = _rng.integers(0, 1 << 32, PERMUTATIONS, dtype=np.uint32)
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD], np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _MIX[3]
    x = (x ^ (x >> np.uint64(29))) * _MIX[4]
    return x ^ (x >> np.uint64(32))


def shingle_set(text: str, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles. Bytes lower-case and split by ASCII rules."""
    words = text.encode().lower().split()
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, n)
    if n < size:
        h = np.array([xxhash.xxh3_64_intdigest(h.tobytes(), n)], np.uint64)
        return h
    x = np.zeros(n - size + 1, np.uint64)
    for k in range(size):
        x = _mixed(x * _MIX[0] + h[k : n - size + 1 + k] + _MIX[1])
    return np.unique(x)


def signature(shingles: np.ndarray) -> np.ndarray:
    """Minimum and maximum under each permutation, 32 bits each, next to each other."""
    low, high = np.full(PERMUTATIONS, 0xFFFFFFFF, np.uint32), np.zeros(PERMUTATIONS, np.uint32)
    short = (shingles >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(short), 8192):
        x = (short[None, at : at + 8192] ^ _SHIFTS[:, None]) * _FACTORS[:, None]
        np.minimum(low, x.min(1), out=low)
        np.maximum(high, x.max(1), out=high)
    return np.stack([low, high], 1).reshape(-1)


def band_keys(signatures: np.ndarray) -> np.ndarray:
    """(documents, BANDS) 64-bit keys, each of the band's number and values."""
    parts = signatures.reshape(len(signatures), BANDS, ROWS).astype(np.uint64)
    x = np.broadcast_to(np.arange(BANDS, dtype=np.uint64) * _MIX[2], parts.shape[:2])
    for k in range(ROWS):
        x = _mixed(x * _MIX[0] + parts[:, :, k] + _MIX[1])
    return x.view(np.int64)


def signatures(docs: DataFrame, size: int, folder: str) -> DataFrame:
    """row, doc_id, text_hash, n_shingles, digest, and file, at: where signature and full set are, one after the other."""

    def run(batches):
        release()
        file = uuid.uuid4().hex  # an attempt's own file: rows of the attempt that counts name it
        fs, name = filesystem(f"{folder}/{file}.sets")
        fs.create_dir(name.rpartition("/")[0], recursive=True)
        with fs.open_output_stream(name) as out:
            at = 0
            for batch in batches:
                rows = []
                for text in batch.column("text").to_pylist():
                    s = shingle_set(text, size)
                    if not len(s):
                        rows.append((0, None, at))
                        continue
                    data = signature(s).tobytes() + s.tobytes()
                    rows.append((len(s), xxhash.xxh3_128_digest(s.tobytes()), at))
                    out.write(data)
                    at += len(data)
                columns = list(zip(*rows)) or [()] * 3
                yield pa.record_batch(
                    [batch.column("doc_id"), batch.column("text_hash"), *(pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.binary(), pa.int64()))), pa.array([file] * len(rows), pa.string())],
                    ["doc_id", "text_hash", "n_shingles", "digest", "at", "file"],
                )

    rows = doc_texts(docs).withColumn("text_hash", F.xxhash64("text"))
    return rows.mapInArrow(run, "doc_id long, text_hash long, n_shingles long, digest binary, at long, file string").withColumn("row", F.monotonically_increasing_id())


class SetStore:
    """Reads signatures and sets by pointer (file, at, n); keeps the files open and the latest sets."""

    def __init__(self, folder: str, most: int = 600):
        self.folder, self.most = folder, most
        self.files: dict = {}
        self.sets: OrderedDict = OrderedDict()

    def read(self, file: str, at: int, size: int) -> bytes:
        if file not in self.files:
            if len(self.files) > 100:
                self.files.popitem()[1].close()
            self.files[file] = open_file(f"{self.folder}/{file}.sets")
        self.files[file].seek(at)
        return self.files[file].read(size)

    def signature(self, file: str, at: int) -> np.ndarray:
        return np.frombuffer(self.read(file, at, SIGNATURE_BYTES), np.uint32)

    def get(self, file: str, at: int, n: int) -> np.ndarray:
        key = file, at
        if key not in self.sets:
            self.sets[key] = np.frombuffer(self.read(file, at + SIGNATURE_BYTES, 8 * n), np.uint64)
            if len(self.sets) > self.most:
                self.sets.popitem(last=False)
        self.sets.move_to_end(key)
        return self.sets[key]

    def similar(self, a: tuple, b: tuple, percent: int) -> bool:
        both = len(np.intersect1d(self.get(*a), self.get(*b), assume_unique=True))
        return 100 * both >= percent * (a[2] + b[2] - both)


def bands(classes: DataFrame, folder: str, parts: int) -> DataFrame:
    """key, node, n, head, head_n for each band of two classes or more; head is its smallest class.

    Band keys travel as packed arrays, so a band of many classes is one of many in a part, and rows are made for shared bands only.
    """

    def send(batches):
        store = SetStore(folder)
        for batch in batches:
            nodes, sizes = np.array(batch.column("node")), np.array(batch.column("n"))
            pointers = zip(batch.column("file").to_pylist(), batch.column("at").to_pylist())
            sigs = np.stack([store.signature(*x) for x in pointers]) if batch.num_rows else np.zeros((0, 2 * PERMUTATIONS), np.uint32)
            keys = band_keys(sigs).reshape(-1)
            part = (keys.view(np.uint64) >> np.uint64(20)) % np.uint64(parts)
            nodes, sizes = np.repeat(nodes, BANDS), np.repeat(sizes, BANDS)
            by = np.argsort(part, kind="stable")
            ends = np.searchsorted(part[by], np.arange(parts + 1).astype(np.uint64))
            data = [pack(keys[i], nodes[i], small(sizes[i])) for i in (by[a:b] for a, b in zip(ends, ends[1:]))]
            yield pa.record_batch([pa.array(range(parts), pa.int32()), pa.array(data, pa.binary())], ["part", "data"])

    def meet(key, group):
        arrays = [unpack(x) for x in group.column("data").to_pylist()]
        keys, nodes, sizes = (np.concatenate([a[k] for a in arrays]) for k in range(3))
        by = np.lexsort((nodes, keys))
        keys, nodes, sizes = keys[by], nodes[by], sizes[by].astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])[: len(keys)])
        many = np.diff(np.append(first, len(keys)))
        head, keep = np.repeat(first, many), np.repeat(many, many) > 1
        return pa.table({"key": keys[keep], "node": nodes[keep], "n": sizes[keep], "head": nodes[head][keep], "head_n": sizes[head][keep]})

    near = classes.repartition(parts, "file", F.floor(F.col("at") / (8 << 20))).sortWithinPartitions("file", "at")
    sent = near.select("node", "n", "file", "at").mapInArrow(send, "part int, data binary")
    return sent.groupBy("part").applyInArrow(meet, "key long, node long, n long, head long, head_n long")


_POINTERS = ("file", "at", "n")


def _verified(pairs: DataFrame, classes: DataFrame, percent: int, parts: int, folder: str) -> DataFrame:
    """The links among pairs a, b."""

    def run(batches):
        store = SetStore(folder)
        for batch in batches:
            r = batch.to_pydict()
            a, b = (list(zip(*(r[f"{x}_{k}"] for k in _POINTERS))) for x in "ab")
            good = [i for i in sorted(range(len(a)), key=lambda i: a[i]) if store.similar(a[i], b[i], percent)]
            yield pa.record_batch([pa.array([r[x][i] for i in good], pa.int64()) for x in "ab"], ["a", "b"])

    for x in "ab":
        pairs = pairs.join(classes.select(F.col("node").alias(x), *(F.col(k).alias(f"{x}_{k}") for k in _POINTERS)), x)
    return pairs.repartition(parts).mapInArrow(run, "a long, b long")


def links_among(nodes: list[int], components_: list[int], heads: set[int], pointers: list[tuple], sigs: np.ndarray, percent: int, store: SetStore, left: list[int], right: list[int]) -> list[tuple[int, int]]:
    """Links that connect members of one band which are in different components; each member tries the most similar of the others first.

    Members that have become connected aren't compared any more. Memory is in proportion to the members, not to their pairs.
    """
    own, sizes = np.array(components_), np.array([p[2] for p in pointers])
    tested = np.array([n in heads for n in nodes])  # the head has met all members before
    others_of, found = np.array(right, np.int64), []
    for i in left:
        others = others_of[others_of > i] if left is right else others_of
        fits = (own[others] != own[i]) & ~tested[others] & (100 * np.minimum(sizes[others], sizes[i]) >= percent * np.maximum(sizes[others], sizes[i]))
        near = others[fits]
        if tested[i] or not len(near):
            continue
        agree = (sigs[near] == sigs[i]).sum(1)
        likely = np.flatnonzero(agree >= least_agreeing(percent))
        for j in near[likely[np.argsort(-agree[likely], kind="stable")]].tolist():
            if own[i] != own[j] and store.similar(pointers[i], pointers[j], percent):
                own[own == own[j]] = own[i]
                found.append((nodes[i], nodes[j]))
    return found


def _open_members(shared: DataFrame, labels: DataFrame) -> DataFrame:
    """Members of bands, without their heads, where these are in different components; m: how many."""
    member = shared.filter("node != head").join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    open_ = member.groupBy("key").agg(F.min("component").alias("c1"), F.max("component").alias("c2"), F.count("*").alias("m")).filter("c1 != c2").select("key", "m")
    return member.join(open_, "key")


def _second_star(shared: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """Pairs of members of open bands with another centre, a different one for each band."""
    member = _open_members(shared, labels)
    centre = member.groupBy("key").agg(F.min(F.struct(F.xxhash64("node", "key").alias("x"), "node", "n", "component")).alias("c"))
    pairs = member.join(centre, "key").filter("component != c.component")
    fits = 100 * F.least("n", "c.n") >= percent * F.greatest("n", "c.n")
    return pairs.filter(fits).select(F.least("node", "c.node").alias("a"), F.greatest("node", "c.node").alias("b")).distinct()


def _remaining(shared: DataFrame, labels: DataFrame, classes: DataFrame, percent: int, folder: str) -> DataFrame:
    """Links between members of a band (none its head) that are still in different components."""
    rows = _open_members(shared, labels).withColumn("blocks", F.ceil(F.col("m") / GROUP).cast("int")).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "component", "head", "n")
    rows = rows.join(classes.select("node", "file", "at"), "node")

    def run(batches):
        store, at, group = SetStore(folder), None, []

        def done():
            everyone = list(range(len(group)))
            pointers = [tuple(r[k] for k in _POINTERS) for r in group]
            sigs = np.stack([store.signature(*x[:2]) for x in pointers])
            left = [k for k in everyone if group[k]["block"] == at[1]]
            right = left if at[1] == at[2] else [k for k in everyone if group[k]["block"] == at[2]]
            return links_among([r["node"] for r in group], [r["component"] for r in group], {group[0]["head"]}, pointers, sigs, percent, store, left, right)

        for batch in batches:
            found = []
            for r in batch.to_pylist():
                key = r["key"], r["i"], r["j"]
                if key != at:
                    found += done() if group else []
                    at, group = key, []
                group.append(r)
            yield _pairs(found)
        yield _pairs(done() if group else [])

    return rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "node").mapInArrow(run, "a long, b long")


def _pairs(found):
    return pa.record_batch([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], ["a", "b"])


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """row, doc_id, text_hash, n_shingles, component (a number of its own for each), component_id (the smallest doc_id reachable)."""
    spark = docs.sparkSession
    folder = shared_path(spark, "sets")
    rows = staged(signatures(docs, size, folder), "signatures")
    parts = max(1, -(-rows.count() // PART_DOCUMENTS))
    by_digest = rows.filter("n_shingles > 0").groupBy("digest").agg(F.min(F.struct("row", "n_shingles", "file", "at")).alias("r"), F.min("doc_id").alias("low"))
    classes = staged(by_digest.select("digest", "low", F.col("r.row").alias("node"), F.col("r.n_shingles").alias("n"), "r.file", "r.at"), "classes")
    shared = staged(bands(classes, folder, parts), "bands")
    fits = 100 * F.least("n", "head_n") >= percent * F.greatest("n", "head_n")
    star = shared.filter((F.col("node") != F.col("head")) & fits).select(F.col("head").alias("a"), F.col("node").alias("b")).distinct()
    links = staged(_verified(star, classes, percent, parts, folder), "links")
    labels = staged(components(links), "labels")
    for step in (1, 2):
        if step == 1:
            more = _verified(_second_star(shared, labels, percent), classes, percent, parts, folder)
        else:
            more = _remaining(shared, labels, classes, percent, folder)
        more = staged(more, "links")
        if not more.isEmpty():
            links = links.unionByName(more)
            labels = staged(components(links), "labels")
    named = classes.select("digest", "low", "node").join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = named.groupBy("component").agg(F.min("low").alias("component_id"))
    of_class = named.join(least, "component").select("digest", "component", "component_id")
    full = rows.select("row", "doc_id", "text_hash", "n_shingles", "digest").join(of_class, "digest", "left")
    alone = -F.col("row") - 1  # what has no words is in no class
    return full.select("row", "doc_id", "text_hash", "n_shingles", F.coalesce("component", alone).alias("component"), F.coalesce("component_id", "doc_id").alias("component_id"))


def without_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """The document with the smallest doc_id of each component, all columns as they are."""
    found = near_duplicates(docs, size, percent)
    best = found.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row", "text_hash")).alias("b"))
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(0))
    kept = best.select(F.coalesce("b.doc_id", F.lit(0)).alias("k1"), F.col("b.text_hash").alias("k2")).withColumn("k3", F.lit(1))
    rows = docs.select(F.struct("*").alias("r"), key.alias("k1"), F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("k2"))
    return rows.join(kept, ["k1", "k2"], "left_semi").dropDuplicates(["k1", "k2"]).select("r.*")


def op10_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"), size=3, percent=85)
    return found.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
