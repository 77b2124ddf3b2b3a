"""Operator 7: best-fit packing of token sequences by swap-based local search.

Documents are tokenised, ended by one id and, where longer than a sequence, cut into full pieces. Pieces shorter than
a sequence are dealt to shards of bounded size. In a shard bins are filled in the order of the documents, and local
search does the packing, in two kinds of rounds. Bins take: those with the longest documents first, each gets from any
underfull bin the document that, moved to it or exchanged for a shorter one, leaves it the least room. Bins give: the
emptiest first, one or two of their documents are moved to any underfull bin, or exchanged for one shorter document of
it, where that is left with the least room. Each step raises the sum of squared fills, and bins empty; it ends when no
step is left or the lower bound of bins is met.

Then bins of all shards that are less than KEEP full meet in new shards, and the same search goes on from there: nothing
gets worse by it, and the number of shards costs few sequences. SHARD_ROWS and KEEP are the only parameters; neither
drops a step that could be made inside a shard.

Defined results: null text is the empty text, a document of one id; repeated rows are packed as often as they occur;
ties go to the earlier piece; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wirespark.llm.common import doc_texts, staged, table, without_gc
from wirespark.llm.words import tokens_of

#: Pieces that one task packs at a time, about.
SHARD_ROWS = 20_000
#: Bins of a shard that are at least so full are done; the others meet those of other shards.
KEEP = 0.98
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces_of(docs: DataFrame, path: str, most: int, end_id: int = 0) -> DataFrame:
    """One row for each piece of at most `most` ids of each document with its end id."""

    def run(batches):
        codec = tokens_of(path, False)  # this tokenizer drops white space, so a chunk has the same ids everywhere
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), codec.encode(batch.column("text").to_pylist())):
                data = np.append(ids, end_id).astype("<u4")
                rows += [(doc_id, k, at, min(most, len(data) - at), zlib.crc32(data[at : at + most].tobytes())) for k, at in enumerate(range(0, len(data), most))]
            columns = list(zip(*rows)) or [()] * 5
            yield pa.record_batch(
                [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))],
                ["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return doc_texts(docs).mapInArrow(without_gc(run), PIECES)


def in_order(lengths: list[int], most: int) -> list[list[int]]:
    """Bins filled one after the other: the start of the search."""
    bins: list[list[int]] = []
    room = 0
    for i, n in enumerate(lengths):
        if not bins or n > room:
            bins.append([])
            room = most
        bins[-1].append(i)
        room -= n
    return bins


class LocalSearch:
    """Moves and exchanges between underfull bins.

    An underfull bin has a slot for each different length among its items, and one of length 0, so that a move is an
    exchange for nothing. Slots are arrays, and those of all bins are tried at once.
    """

    BLOCK = 4096

    def __init__(self, items: list[list[int]], lengths: list[int], most: int):
        self.items, self.lengths, self.most = [list(x) for x in items], lengths, most
        self.room = [most - sum(lengths[i] for i in x) for x in items]
        self.left = len(items)
        self.moves = self.exchanges = 0

    def _slots_of(self, b: int) -> list[int]:
        """The items of a bin that stand for their length; -1 for none. Bins that are full or empty have nothing to gain."""
        if not self.room[b] or not self.items[b]:
            return []
        return [-1, *{self.lengths[i]: i for i in reversed(self.items[b])}.values()]

    def _index(self) -> None:
        self.slots: dict[int, list[int]] = {}
        found: list[tuple[int, int]] = []
        for b in range(len(self.items)):
            if own := self._slots_of(b):
                self.slots[b] = list(range(len(found), len(found) + len(own)))
                found += [(b, i) for i in own]
        self.n, self.idle = len(found), 0
        size = self.n + self.n // 2 + 64
        self.bin, self.item, self.length, self.free = (np.zeros(size, np.int64) for _ in range(4))
        for k, (b, i) in enumerate(found):
            self._set(k, b, i)

    def _set(self, k: int, b: int, i: int) -> None:
        self.bin[k], self.item[k], self.length[k], self.free[k] = b, i, 0 if i < 0 else self.lengths[i], self.room[b]

    def run(self, bound: int) -> list[list[int]]:
        """Rounds of taking and giving, until both change nothing."""
        steps = -1
        while steps != self.moves + self.exchanges and self.left > bound:
            steps = self.moves + self.exchanges
            self._take(bound)
            self._give(bound)
        return [x for x in self.items if x]

    def _take(self, bound: int) -> None:
        """Bins with the longest documents take first, one document at a time."""
        where: list[dict[int, None]] = [{} for _ in range(self.most + 1)]  # by length: the underfull bins that have such a document
        mask = 0
        underfull = [b for b, x in enumerate(self.items) if x and self.room[b]]
        lengths = {b: {self.lengths[i]: i for i in reversed(self.items[b])} for b in underfull}

        def enter(b: int) -> None:
            nonlocal mask
            lengths[b] = {self.lengths[i]: i for i in reversed(self.items[b])} if self.room[b] else {}
            for x in lengths[b]:
                where[x][b] = None
                mask |= 1 << x

        def leave(b: int) -> None:
            nonlocal mask
            for x in lengths[b]:
                del where[x][b]
                if not where[x]:
                    mask &= ~(1 << x)

        for b in underfull:
            enter(b)
        for taker in sorted(underfull, key=lambda b: (-max(lengths[b]), b)):
            leave(taker)
            while self.left > bound and self.items[taker] and (room := self.room[taker]):
                best = 0, 0, 0, -1
                for out in (0, *{self.lengths[i] for i in self.items[taker]}):
                    into = (mask & (1 << room + out + 1) - 1).bit_length() - 1  # the longest that fits
                    if into - out > best[0]:
                        giver = next((b for b in where[into] if room - (into - out) < self.room[b]), -1)
                        best = (into - out, into, out, giver) if giver >= 0 else best
                gain, into, out, giver = best
                if not gain:
                    break
                leave(giver)
                item, back = lengths[giver][into], [next(i for i in self.items[taker] if self.lengths[i] == out)] if out else []
                self.items[giver] = [i for i in self.items[giver] if i != item] + back
                self.items[taker] = [i for i in self.items[taker] if i not in back] + [item]
                self.room[giver] += gain
                self.room[taker] -= gain
                enter(giver)
                self.left -= not self.items[giver]
                self.moves += not out
                self.exchanges += bool(out)
            enter(taker)

    def _give(self, bound: int) -> None:
        """The emptiest bins give first, one or two documents at a time, until a whole round changes nothing."""
        self._index()
        changed = True
        while changed and self.left > bound:
            changed = False
            for giver in sorted(self.slots, key=lambda b: (-self.room[b], b)):
                while self.left > bound and self.items[giver] and self.room[giver] and self._step(giver):
                    changed = True
                    if self.idle * 2 > self.n:
                        self._index()
            self._index()

    def _step(self, giver: int) -> bool:
        """One or two items of the giver for one shorter item, or none, of another bin, which ends fuller than the giver was (so
        the squared fill rises, and this ends): of all such bins the one that is left with the least room."""
        own: dict[int, list[int]] = {}
        for i in self.items[giver]:
            own.setdefault(self.lengths[i], []).append(i)
        sizes = np.array(sorted(own))
        twice = np.array([x for x in own if len(own[x]) > 1], np.int64)
        both = np.zeros(self.most + 1, np.int64)  # lengths that one or two items make
        both[sizes] = sizes
        sums = np.append((sizes[:, None] + sizes[None])[np.triu_indices(len(sizes), 1)], 2 * twice)
        sums = sums[sums <= self.most]
        both[sums] = sums
        floor = np.maximum.accumulate(both)
        best, k, room = self.most, -1, self.room[giver]
        for a in range(0, self.n, self.BLOCK):
            part = slice(a, min(a + self.BLOCK, self.n))
            length, free = self.length[part], self.free[part]
            gain = floor[length + free] - length
            rest = free - gain
            rest = np.where((gain > 0) & (rest < room) & (self.bin[part] != giver), rest, self.most)
            j = int(rest.argmin())
            if rest[j] < best:
                best, k = int(rest[j]), a + j
                if not best:
                    break  # none can be left with less
        if k < 0:
            return False
        taker, out = int(self.bin[k]), int(self.item[k])
        total = int(self.length[k] + self.free[k]) - best
        into = own[total][:1] if total in own else next([own[x][0], own[total - x][-1]] for x in own if total - x in own and (total != 2 * x or len(own[x]) > 1))
        for b, less, more in ((giver, into, [out]), (taker, [out], into)):
            self.items[b] = [i for i in self.items[b] if i not in less] + [i for i in more if i >= 0]
            self.room[b] = self.most - sum(self.lengths[i] for i in self.items[b])
            self._refresh(b)
        self.moves += out < 0
        self.exchanges += out >= 0
        self.left -= not self.items[giver]
        return True

    def _refresh(self, b: int) -> None:
        """The slots of a changed bin; those that it no longer needs hold nothing until they are counted anew."""
        old, new = self.slots[b], self._slots_of(b)
        while len(old) < len(new):
            if self.n == len(self.bin):
                for name in ("bin", "item", "length", "free"):
                    setattr(self, name, np.append(getattr(self, name), np.zeros(self.n // 2 + 64, np.int64)))
            old.append(self.n)
            self.n += 1
        for k, i in zip(old, new):
            self._set(k, b, i)
        for k in old[len(new) :]:
            self.length[k] = self.free[k] = 0  # nothing fits in
        self.idle += len(old) - len(new)
        del old[len(new) :]


def pack(lengths: list[int], most: int, bins: list[list[int]] | None = None) -> tuple[list[list[int]], int, int]:
    """Bins of item numbers, and the moves and exchanges that made them from `bins`, or from bins filled in order."""
    search = LocalSearch(in_order(lengths, most) if bins is None else bins, lengths, most)
    found = search.run(-(-sum(lengths) // most))
    return found, search.moves, search.exchanges


def packed(pieces: DataFrame, most: int = 2048, shard_rows: int = SHARD_ROWS, keep: float = KEEP) -> DataFrame:
    """pieces (staged, `row` a number of its own for each) with sequence_id (the smallest row of the sequence), offset, and the
    moves and exchanges of the last search that the piece took part in. shard_rows bounds what one task packs at a time."""
    full = pieces.filter(F.col("length") >= most).select("*", F.col("row").alias("sequence_id"), *(F.lit(0).cast("long").alias(x) for x in ("offset", "moves", "exchanges")))
    rest = pieces.filter(F.col("length") < most)
    first = staged(_searched(rest, F.xxhash64("row"), _shards(rest, shard_rows), most, keep), "packed")
    left = first.filter("offset < 0").select(*pieces.columns, "sequence_id")
    again = _searched(left, F.xxhash64("sequence_id"), _shards(left, shard_rows), most, 0.0)
    return full.unionByName(first.filter("offset >= 0")).unionByName(again).drop("row")


def _shards(rows: DataFrame, most: int) -> int:
    return max(1, -(-rows.count() // most))


def _searched(rest: DataFrame, by: Column, shards: int, most: int, keep: float) -> DataFrame:
    """Search each shard, from the bins named by sequence_id if there are any; pieces of bins less than `keep` full come back with offset -1."""
    names = [*(x for x in rest.columns if x != "sequence_id"), "sequence_id", "offset", "moves", "exchanges"]
    schema = ", ".join([*(f"{x} {rest.schema[x].dataType.simpleString()}" for x in names[:-4]), *(f"{x} long" for x in names[-4:])])

    def run(group):
        group = group.drop_columns(["shard"]).sort_by([("doc_id", "ascending"), ("piece", "ascending"), ("row", "ascending")])
        lengths, rows = group.column("length").to_pylist(), group.column("row").to_pylist()
        bins = None
        if "sequence_id" in group.column_names:
            named: dict[int, list[int]] = {}
            for i, x in enumerate(group.column("sequence_id").to_pylist()):
                named.setdefault(x, []).append(i)
            bins, group = list(named.values()), group.drop_columns(["sequence_id"])
        found, moves, exchanges = pack(lengths, most, bins)
        offset, sequence = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
        for items in found:
            sequence[items] = min(rows[i] for i in items)
            ends = np.cumsum([lengths[i] for i in items])
            offset[items] = np.append(0, ends[:-1]) if ends[-1] >= keep * most else -1
        for name, values in (("sequence_id", sequence), ("offset", offset), ("moves", np.full(len(lengths), moves)), ("exchanges", np.full(len(lengths), exchanges))):
            group = group.append_column(name, pa.array(values, pa.int64()))
        return group.select(names)

    return rest.withColumn("shard", F.pmod(by, F.lit(shards))).groupBy("shard").applyInArrow(run, schema)


def pack_documents(docs: DataFrame, path: str, most: int = 2048) -> DataFrame:
    pieces = staged(pieces_of(docs, path, most).withColumn("row", F.monotonically_increasing_id()), "pieces")
    return packed(pieces, most)


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
