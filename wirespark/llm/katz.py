"""Operator 8: Katz backoff, with Good-Turing discounts and exactly normalised backoff weights.

P(w | v) = d(c) c(v, w) / c(v) where the pair was seen c times in training, else alpha(v) P(w); P(w) is discounted alike,
and the mass it leaves is that of unknown words. alpha(v) is what v's pairs leave, over what P leaves to words not seen
after v, so that every history sums to one. Counts up to MOST_DISCOUNTED are discounted.

The corpus is dealt in blocks of about BLOCK tokens. A block's tokens stay in a file of the shared folder; what is
shuffled are packed arrays:
  1. each block sends its distinct words to the partitions of the word table, and gets their total counts and ids back;
  2. each block sends its distinct pairs to the partitions of the pair table, by history, and gets back how often each
     was seen in all, and for histories with unseen pairs what alpha needs;
  3. each block evaluates its tokens.
Both tables are partitioned by hash; the pairs of a very frequent history are spread over partitions by their second
word. The frequent histories' sums, at most HOT_MOST of them, are the only part of the model that reaches the driver;
the counts of counts are a few numbers.

Defined results: null text is the empty text, one end token after the start; words are compared by 64-bit hashes (for
10^9 distinct words the chance of any collision is 3 %); repeated rows count and are scored as often as they occur;
without training tokens N = V = 0, base_score uses them so and every token is unknown with probability 1; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import struct
import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wirespark.llm.common import doc_texts, fold, release, shared_path, staged, table
from wirespark.llm.storage import filesystem, open_file

BLOCK = 1 << 21
MOST_DISCOUNTED = 5
#: Bytes of text for each partition of the word and pair tables, so that a task's share doesn't grow with the corpus.
PART_BYTES = 16 << 20
HOT_MOST = 10_000
HOT_LEAST = 200_000

#: No word is white space, so these stand for the start of a text (a history only) and its end (a token).
START, END = (np.uint64(xxhash.xxh3_64_intdigest(x)) for x in (b"\r", b"\n"))


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed byte string."""
    head = struct.pack("<I", len(arrays)) + b"".join(struct.pack("<4sQ", x.dtype.str.encode(), len(x)) for x in arrays)
    body = head + b"".join(np.ascontiguousarray(x).tobytes() for x in arrays)
    return struct.pack("<Q", len(body)) + pa.compress(body, codec="zstd", asbytes=True)


def unpack(data: bytes) -> list[np.ndarray]:
    body = pa.decompress(data[8:], decompressed_size=struct.unpack("<Q", data[:8])[0], codec="zstd", asbytes=True)
    (n,) = struct.unpack("<I", body[:4])
    at, out = 4 + 12 * n, []
    for k in range(n):
        kind, size = struct.unpack("<4sQ", body[4 + 12 * k : 16 + 12 * k])
        dtype = np.dtype(kind.rstrip(b"\0").decode())
        out.append(np.frombuffer(body, dtype, size, at))
        at += size * dtype.itemsize
    return out


def small(x: np.ndarray) -> np.ndarray:
    """The narrowest unsigned type that holds x."""
    top = int(x.max(initial=0))
    return x.astype(np.uint8 if top < 256 else np.uint16 if top < 1 << 16 else np.uint32 if top < 1 << 32 else np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x.astype(np.uint64) ^ np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(31))


def hashes(text: str) -> np.ndarray:
    """Words of the text, lower-cased and split by ASCII rules, and the end."""
    words = text.encode().lower().split()
    out = np.empty(len(words) + 1, np.uint64)
    out[:-1] = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    out[-1] = END
    return out


def discounts(counts_of_counts: list[int], most: int = MOST_DISCOUNTED) -> np.ndarray:
    """d(r) for r = 0 ... most: Good-Turing in Katz's form; where the counts of counts don't allow it, one half is taken off."""
    n = [0, *counts_of_counts]
    out = np.ones(most + 1)
    top = (most + 1) * n[most + 1] / n[1] if n[1] else 1.0
    for r in range(1, most + 1):
        turing = (r + 1) * n[r + 1] / (n[r] * r) if n[r] else 0.0
        d = (turing - top) / (1 - top) if top < 1 else 0.0
        out[r] = d if 0 < d < 1 else 1 - 0.5 / r
    return out


def discounted(counts: np.ndarray, d: np.ndarray) -> np.ndarray:
    return counts * d[np.where(counts < len(d), counts, 0)]


class Unigrams:
    """P(w) from a count; the share that is left goes to unknown words."""

    def __init__(self, total: int, types: int, counts_of_counts: list[int]):
        self.total, self.types = total, types
        self.d = discounts(counts_of_counts)
        mass = sum((1 - self.d[r]) * r * counts_of_counts[r - 1] for r in range(1, MOST_DISCOUNTED + 1))
        self.scale = 1.0 / total if mass > 0 else 1.0 / (total + 1)  # without a discounted word one more token is reckoned
        self.unknown = mass / total if mass > 0 else 1.0 / (total + 1)

    def probability(self, counts: np.ndarray) -> np.ndarray:
        return np.where(counts > 0, discounted(counts, self.d) * self.scale, self.unknown)


class BlockFile:
    """A block in shared storage: doc_ids, which documents have one, which are held out, tokens of each, and tokens as places in `words`."""

    @staticmethod
    def read(file: str, at: int, size: int) -> list[np.ndarray]:
        f = open_file(file)
        try:
            f.seek(at)
            return unpack(f.read(size))
        finally:
            f.close()


def pairs_of(tokens: np.ndarray, sizes: np.ndarray, held_out: np.ndarray, words: int, start: int):
    """Distinct pairs of a block: history and word (places in the block's words), times in training, and the pair of each token."""
    history = np.empty(len(tokens), np.int64)
    history[1:] = tokens[:-1]
    history[np.cumsum(sizes) - sizes] = start
    keys, of_token = np.unique(history * words + tokens, return_inverse=True)
    train = np.repeat(~held_out, sizes)
    times = np.bincount(of_token[train], minlength=len(keys))
    return keys // words, keys % words, times, of_token


def tokenised(docs: DataFrame, held_out: Column, folder: str, parts: int, block: int = BLOCK) -> DataFrame:
    """Step 1, out: block, part, its distinct words of that part with their training counts, and the block's pointer."""

    def run(batches):
        from pyspark import TaskContext

        release()
        task = TaskContext.get().partitionId()
        path = f"{folder}/{uuid.uuid4().hex}.tokens"  # an attempt's own file; equal attempts write equal blocks
        fs, name = filesystem(path)
        fs.create_dir(name.rpartition("/")[0], recursive=True)
        ids, held, found, size, at, number = [], [], [], 0, 0, 0

        def close(out):
            nonlocal ids, held, found, size, at, number
            tokens = np.concatenate([np.array([START]), *found])
            words, places = np.unique(tokens, return_inverse=True)
            sizes, flags = np.array([len(x) for x in found], np.int64), np.array(held, bool)
            counts = np.bincount(places[1:][np.repeat(~flags, sizes)], minlength=len(words))
            counts[places[0]] = (~flags).sum()  # the start, a history as often as there are training texts
            named = np.array([x is not None for x in ids], bool)
            data = pack(np.array([x or 0 for x in ids], np.int64), named, flags, small(sizes), small(places[1:]), words)
            out.write(data)
            part = (mixed(words) % np.uint64(parts)).astype(np.int64)
            rows = [(p, small(words[part == p]), small(counts[part == p])) for p in range(parts)]
            n = len(rows)
            batch = pa.record_batch(
                [pa.array([p for p, _, _ in rows], pa.int32()), pa.array([task << 24 | number] * n, pa.int64()), pa.array([pack(w.astype(np.uint64), c) for _, w, c in rows], pa.binary()), pa.array([path] * n, pa.string()), pa.array([at] * n, pa.int64()), pa.array([len(data)] * n, pa.int64())],
                ["part", "block", "data", "file", "at", "size"],
            )
            ids, held, found, size, at, number = [], [], [], 0, at + len(data), number + 1
            return batch

        with fs.open_output_stream(name) as out:
            for batch in batches:
                for doc_id, text, flag in zip(*(batch.column(k).to_pylist() for k in ("doc_id", "text", "held_out"))):
                    ids.append(doc_id)
                    held.append(bool(flag))
                    found.append(hashes(text))
                    size += len(found[-1])
                    if size >= block:
                        yield close(out)
            if ids:
                yield close(out)

    rows = doc_texts(docs, F.coalesce(held_out, F.lit(False)).alias("held_out"))
    return rows.mapInArrow(run, "part int, block long, data binary, file string, at long, size long")


def counted_words(sent: DataFrame, parts: int) -> DataFrame:
    """Step 1, back: for each part and block the total counts and ids of the words sent; one row a part (block null) has its sums."""
    stats = [f"n{r}" for r in range(1, MOST_DISCOUNTED + 2)]

    def run(key, group):
        p = key[0].as_py()
        blocks = [unpack(x) for x in group.column("data").to_pylist()]
        words, places = np.unique(np.concatenate([b[0] for b in blocks]), return_inverse=True)
        totals = np.zeros(len(words), np.int64)
        np.add.at(totals, places, np.concatenate([b[1] for b in blocks]).astype(np.int64))
        real = totals[words != START]
        ids = np.arange(len(words), dtype=np.int64) * parts + p
        out, at = [], 0
        for b in blocks:
            mine = places[at : at + len(b[0])]
            out.append(pack(small(totals[mine]), small(ids[mine])))
            at += len(b[0])
        n = len(out)
        sums = [int(real.sum()), int((real > 0).sum()), *(int((real == r).sum()) for r in range(1, MOST_DISCOUNTED + 2))]
        columns = {"part": [p] * (n + 1), "block": [*group.column("block").to_pylist(), None], "data": [*out, None]}
        columns |= {k: [*group.column(k).to_pylist(), None] for k in ("file", "at", "size")}
        columns |= {name: [None] * n + [x] for name, x in zip(["tokens", "types", *stats], sums)}
        return pa.table(columns, schema=pa.schema([("part", pa.int32()), ("block", pa.int64()), ("data", pa.binary()), ("file", pa.string()), ("at", pa.int64()), ("size", pa.int64())] + [(k, pa.int64()) for k in ["tokens", "types", *stats]]))

    schema = "part int, block long, data binary, file string, at long, size long, tokens long, types long, " + ", ".join(f"{x} long" for x in stats)
    return sent.groupBy("part").applyInArrow(run, schema)


def _own_words(group, words: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Total count and id of each of the block's words, from the replies of all parts."""
    part = (mixed(words) % np.uint64(parts)).astype(np.int64)
    counts, ids = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
    for p, data in zip(group.column("part").to_pylist(), group.column("data").to_pylist()):
        at = np.flatnonzero(part == p)
        counts[at], ids[at] = unpack(data)
    return counts, ids


def _part_of_pairs(history_ids: np.ndarray, history_counts: np.ndarray, word_ids: np.ndarray, hot: int, parts: int) -> np.ndarray:
    """By history; a history of more than `hot` tokens is spread by word over as many slices as it has times that."""
    slices = np.maximum(1, -(-history_counts // hot))
    slice_ = mixed(word_ids + 77) % slices.astype(np.uint64)
    return (mixed(mixed(history_ids) + slice_) % np.uint64(parts)).astype(np.int64)


def sent_pairs(replies: DataFrame, parts: int, unigrams: Unigrams, hot: int) -> DataFrame:
    """Step 2, out: each block's distinct pairs by part, and where the block's words have their counts and ids."""

    def run(key, group):
        file, at, size = (group.column(k)[0].as_py() for k in ("file", "at", "size"))
        _, _, held, sizes, tokens, words = BlockFile.read(file, at, size)
        counts, ids = _own_words(group, words, parts)
        start = int(np.searchsorted(words, START))
        v, w, times, _ = pairs_of(tokens.astype(np.int64), sizes.astype(np.int64), held, len(words), start)
        part = _part_of_pairs(ids[v], counts[v], ids[w], hot, parts)
        by = np.argsort(part, kind="stable")
        bounds = np.searchsorted(part[by], np.arange(parts + 1))
        rows = []
        for p in range(parts):
            mine = by[bounds[p] : bounds[p + 1]]
            new = np.flatnonzero(np.diff(v[mine], prepend=-1))  # pairs are in the order of their histories
            rows.append(pack(small(ids[v[mine][new]]), small(counts[v[mine][new]]), small(np.diff(np.append(new, len(mine)))), small(ids[w[mine]]), small(times[mine]), small(counts[w[mine]])))
        n = parts
        return pa.table({"part": pa.array(range(n), pa.int32()), "block": pa.array([key[0].as_py()] * n, pa.int64()), "data": pa.array(rows, pa.binary())})

    return replies.groupBy("block").applyInArrow(run, "part int, block long, data binary")


def counted_pairs(sent: DataFrame, unigrams: Unigrams, hot: int) -> DataFrame:
    """Step 2, back: for each part and block how often each pair was seen, and the sums of histories that need them: those
    with unseen pairs in the block, and those without a discounted pair.

    A part's own row (block null) has counts of counts, and the sums of its slices of hot histories.
    """
    width = MOST_DISCOUNTED + 2

    def run(key, group):
        p = key[0].as_py()
        blocks = [unpack(x) for x in group.column("data").to_pylist()]
        histories, which = np.unique(np.concatenate([b[0] for b in blocks]).astype(np.int64), return_inverse=True)
        history_counts = np.zeros(len(histories), np.int64)
        history_counts[which] = np.concatenate([b[1] for b in blocks])
        runs = np.concatenate([b[2] for b in blocks]).astype(np.int64)
        of_pair = np.repeat(which, runs)
        word_ids = np.concatenate([b[3] for b in blocks]).astype(np.uint64)
        by = np.lexsort((word_ids, of_pair))
        new = np.ones(len(by), bool)
        new[1:] = (np.diff(of_pair[by]) != 0) | (word_ids[by][1:] != word_ids[by][:-1])
        group_of = np.empty(len(by), np.int64)
        group_of[by] = np.cumsum(new) - 1
        totals = np.bincount(group_of, weights=np.concatenate([b[4] for b in blocks]), minlength=int(new.sum())).astype(np.int64)
        first = by[new]
        p1 = unigrams.probability(np.concatenate([b[5] for b in blocks]).astype(np.int64)[first])
        seen = totals > 0
        # for each history: pairs seen once, twice, ... at most MOST_DISCOUNTED times, tokens of the others, and P of all seen words
        sums = np.zeros((len(histories), width))
        row = of_pair[first][seen]
        few = totals[seen] <= MOST_DISCOUNTED
        np.add.at(sums, (row[few], totals[seen][few] - 1), 1)
        np.add.at(sums, (row[~few], MOST_DISCOUNTED), totals[seen][~few])
        np.add.at(sums, (row, MOST_DISCOUNTED + 1), p1[seen])
        out, at, at_run = [], 0, 0
        for b in blocks:
            n = len(b[3])
            mine = totals[group_of[at : at + n]]
            unseen = np.zeros(len(b[0]), bool)
            unseen[np.repeat(np.arange(len(b[0])), b[2].astype(np.int64))[mine == 0]] = True
            own = sums[which[at_run : at_run + len(b[0])]]
            need = np.flatnonzero((unseen | (own[:, :MOST_DISCOUNTED].sum(1) == 0)) & (b[1] <= hot))
            of = own[need]
            out.append(pack(small(mine), small(need), *(small(of[:, k]) for k in range(width - 1)), of[:, -1]))
            at, at_run = at + n, at_run + len(b[0])
        is_hot = history_counts > hot
        stats = [int((totals == r).sum()) for r in range(1, MOST_DISCOUNTED + 2)]
        own = pack(np.array(stats, np.int64), histories[is_hot], *(sums[is_hot][:, k] for k in range(width)))
        return pa.table({"part": pa.array([p] * (len(out) + 1), pa.int32()), "block": pa.array([*group.column("block").to_pylist(), None], pa.int64()), "data": pa.array([*out, own], pa.binary())})

    return sent.groupBy("part").applyInArrow(run, "part int, block long, data binary")


def backoff(sums: np.ndarray, history_counts: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(factor of seen pairs, alpha) of each history. Where no pair is discounted, one token more is reckoned to the history."""
    r = np.arange(1, MOST_DISCOUNTED + 1)
    left = (sums[:, :MOST_DISCOUNTED] * r * (1 - d[1:])).sum(1)
    n = np.maximum(history_counts, 1)
    none = sums[:, :MOST_DISCOUNTED].sum(1) == 0
    factor = np.where(none, n / (n + 1.0), 1.0)
    share = np.where(none, 1.0 / (n + 1.0), left / n)
    share = np.where(history_counts > 0, share, 1.0)
    return factor, share / np.maximum(1.0 - sums[:, -1], 1e-12)


def evaluated(replies: DataFrame, pairs: DataFrame, parts: int, unigrams: Unigrams, d: np.ndarray, hot: int, hot_sums: tuple) -> DataFrame:
    """Step 3: the documents of each block."""
    hot_ids, hot_values = hot_sums  # at most HOT_MOST rows

    def run(key, words_in, pairs_in):
        file, at, size = (words_in.column(k)[0].as_py() for k in ("file", "at", "size"))
        doc_ids, named, held, sizes, tokens, words = BlockFile.read(file, at, size)
        sizes, tokens = sizes.astype(np.int64), tokens.astype(np.int64)
        counts, ids = _own_words(words_in, words, parts)
        start = int(np.searchsorted(words, START))
        v, w, _, of_token = pairs_of(tokens, sizes, held, len(words), start)
        part = _part_of_pairs(ids[v], counts[v], ids[w], hot, parts)
        seen = np.zeros(len(v), np.int64)
        sums, known = np.zeros((len(words), MOST_DISCOUNTED + 2)), np.zeros(len(words), bool)
        for p, data in zip(pairs_in.column("part").to_pylist(), pairs_in.column("data").to_pylist()):
            mine = np.flatnonzero(part == p)
            got = unpack(data)
            seen[mine] = got[0]
            if len(got[1]):
                own = v[mine]
                own = own[np.flatnonzero(np.diff(own, prepend=-1))][got[1].astype(np.int64)]
                sums[own], known[own] = np.stack([x.astype(float) for x in got[2:]], 1), True
        places = np.flatnonzero(counts > hot)
        if len(places):
            sums[places], known[places] = hot_values[np.searchsorted(hot_ids, ids[places])], True
        factor, alpha = backoff(sums, counts, d)
        factor = np.where(known, factor, 1.0)
        p1 = unigrams.probability(counts)
        p = np.where(seen > 0, discounted(seen, d) / np.maximum(counts[v], 1) * factor[v], alpha[v] * p1[w])
        score = np.log10(p)[of_token]
        base = np.log10((counts[tokens] + 1.0) / (unigrams.total + unigrams.types + 1.0))
        starts = np.cumsum(sizes) - sizes
        return pa.table({
            "doc_id": pa.array(doc_ids, pa.int64(), mask=~named), "held_out": pa.array(held, pa.bool_()), "n_tokens": pa.array(sizes, pa.int64()),
            "n_known": pa.array(np.add.reduceat((counts[tokens] > 0).astype(np.int64), starts), pa.int64()),
            "base_score": pa.array(np.add.reduceat(base, starts), pa.float64()), "score": pa.array(np.add.reduceat(score, starts), pa.float64()),
        })

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"
    return replies.groupBy("block").cogroup(pairs.groupBy("block")).applyInArrow(run, schema)


def _hot_and_counts(pairs: DataFrame) -> tuple[list[int], tuple[np.ndarray, np.ndarray]]:
    """Counts of counts of all pairs, and the summed slices of the frequent histories (at most HOT_MOST rows)."""
    width = MOST_DISCOUNTED + 2
    names = [f"s{k}" for k in range(width)]

    def run(batches):
        for batch in batches:
            for data in batch.column("data").to_pylist():
                stats, histories, *sums = unpack(data)
                columns = [np.append(-1, histories), *(np.append(stats[k] if k < len(stats) else 0, x) for k, x in enumerate(sums))]
                yield pa.record_batch([pa.array(columns[0], pa.int64()), *(pa.array(x, pa.float64()) for x in columns[1:])], ["history", *names])

    rows = pairs.filter("block is null").select("data").mapInArrow(run, "history long, " + ", ".join(f"{x} double" for x in names))
    got = rows.groupBy("history").agg(*(F.sum(x).alias(x) for x in names)).orderBy("history").collect()
    stats = [int(got[0][f"s{k}"]) for k in range(MOST_DISCOUNTED + 1)] if got else [0] * (MOST_DISCOUNTED + 1)
    hot = got[1:]
    return stats, (np.array([r.history for r in hot], np.int64), np.array([[r[x] for x in names] for r in hot]).reshape(-1, width))


def score_documents(docs: DataFrame, held_out: Column, block: int = BLOCK, hot_least: int = HOT_LEAST, part_bytes: int = PART_BYTES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score; documents that are not held out train the model."""
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0
    parts = max(1, -(-size // part_bytes))
    words = staged(counted_words(tokenised(docs, held_out, shared_path(spark, "blocks"), parts, block), parts), "words")
    sums = words.filter("block is null").agg(*(F.coalesce(F.sum(x), F.lit(0)).alias(x) for x in ["tokens", "types", *(f"n{r}" for r in range(1, MOST_DISCOUNTED + 2))])).first()
    unigrams = Unigrams(max(sums[0], 0), sums[1], list(sums[2:]))
    hot = max(hot_least, unigrams.total // HOT_MOST)
    replies = words.filter("block is not null").select("part", "block", "data", "file", "at", "size")
    pairs = staged(counted_pairs(sent_pairs(replies, parts, unigrams, hot), unigrams, hot), "pairs")
    stats, hot_sums = _hot_and_counts(pairs)
    found = evaluated(replies, pairs.filter("block is not null"), parts, unigrams, discounts(stats), hot, hot_sums)
    return found.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(unigrams.total).cast("long").alias("train_tokens"), "base_score", "score")


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"), fold("doc_id", 7) == 2)
