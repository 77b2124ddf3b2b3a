"""Operator 9: token ids as binary files, coded by a canonical length-limited Huffman code.

Ids of all documents are counted first; the code is made from these global counts by package-merge, so that no code
word is longer than LIMIT bits. A file holds blocks of at most BLOCK ids that decode by themselves: the header has the
bit offset of each block, so a reader can start at any of them. Blocks are decoded side by side, one table look-up for
each id of each block.

File format (numbers little-endian): magic "HUFT", u32 version, u32 symbols, u8 code length of each symbol; then
sections of about SECTION ids: u64 documents, u64 blocks, u64 ids, u64 bytes of the bits; per document i64 doc_id,
u64 ids and u8 whether it has a doc_id; per block u64 bit offset; the bits, first bit highest in its byte, padded by 8
zero bytes.

Files hold ranges of ascending doc_id, in the order of their names. Defined results: null text is the empty text, just the end id;
repeated doc_ids are neighbours in the order of their contents; rows without a
doc_id come first; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wirespark.llm.common import doc_texts, release, shared_path, staged, table, without_gc
from wirespark.llm.katz import pack, small, unpack
from wirespark.llm.storage import open_file, write_file
from wirespark.llm.words import WordTokens, tokens_of

LIMIT = 18
BLOCK = 1024
MAGIC = b"HUFT"
#: Ids after which a section of a file is closed.
SECTION = 1 << 20
#: Ids of a file, about: files are as many as the ids of all documents ask for.
FILE_IDS = 1 << 23
INDEX = np.dtype([("doc_id", "<i8"), ("n", "<u8"), ("named", "u1")])


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Optimal code lengths of at most `limit` bits (package-merge); 0 for symbols that don't occur."""
    lengths = np.zeros(len(counts), np.uint8)
    used = np.flatnonzero(counts)
    if len(used) < 2:
        lengths[used] = 1
        return lengths
    if len(used) > 1 << limit:
        raise ValueError("more symbols than code words")
    order = used[np.argsort(counts[used], kind="stable")]
    weights = counts[order].astype(np.float64)
    n = len(order)
    level_weights, levels = weights, []  # a level: how many of its first k entries are single symbols
    for _ in range(limit - 1):
        pairs = level_weights[: len(level_weights) // 2 * 2].reshape(-1, 2).sum(1)
        merged = np.concatenate([weights, pairs])
        by = np.argsort(merged, kind="stable")
        levels.append(np.cumsum(by < n))
        level_weights = merged[by]
    take = 2 * n - 2
    for singles in reversed(levels):
        own = int(singles[take - 1]) if take else 0
        lengths[order[:own]] += 1
        take = 2 * (take - own)
    lengths[order[:take]] += 1
    return lengths


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Code words: by length, then by symbol."""
    codes = np.zeros(len(lengths), np.uint32)
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    if len(order):
        sizes = lengths[order].astype(np.int64)
        spans = np.left_shift(1, int(sizes[-1]) - sizes)
        codes[order] = ((np.cumsum(spans) - spans) >> (int(sizes[-1]) - sizes)).astype(np.uint32)
    return codes


def decode_table(lengths: np.ndarray) -> tuple[np.ndarray, int]:
    """(symbol << 5 | length) for each window of as many bits as the longest code word has."""
    width = int(lengths.max(initial=1))
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    spans = np.left_shift(1, width - lengths[order].astype(np.int64))
    entries = np.repeat(order.astype(np.int64) << 5 | lengths[order], spans)
    return np.concatenate([entries, np.zeros((1 << width) - len(entries), np.int64)]), width


def pack_bits(ids: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bits of ids as bytes, and the bit at which each block begins."""
    sizes = lengths[ids].astype(np.int64)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    words = np.zeros((int(ends[-1]) >> 5) + 3 if len(ids) else 2, np.uint64)
    shifted = codes[ids].astype(np.uint64) << (64 - (starts & 31) - sizes).astype(np.uint64)  # in the 64 bits from a 32-bit border
    at = starts >> 5
    for part, offset in ((shifted >> np.uint64(32), 0), (shifted & np.uint64(0xFFFFFFFF), 1)):
        if len(ids):
            first = np.flatnonzero(np.diff(at, prepend=-1))
            words[at[first] + offset] |= np.bitwise_or.reduceat(part, first)
    return words.astype(">u4").view(np.uint8), starts[::BLOCK]


def unpack_bits(data: np.ndarray, offsets: np.ndarray, n: int, lookup: np.ndarray, width: int) -> np.ndarray:
    """n ids from blocks that begin at the given bits; all blocks advance together, one id at a time."""
    out = np.zeros((len(offsets), BLOCK), np.uint32)
    bits = np.array(offsets, np.int64)
    padded = np.concatenate([data, np.zeros(8, np.uint8)]).astype(np.uint32)
    windows = padded[:-3] << 24 | padded[1:-2] << 16 | padded[2:-1] << 8 | padded[3:]  # 32 bits from each byte on
    last = n - (len(offsets) - 1) * BLOCK
    for k in range(min(BLOCK, n)):
        if k == last and len(offsets) > 1:
            bits = bits[:-1]
        entry = lookup[(windows[bits >> 3] << (bits & 7).astype(np.uint32)) >> np.uint32(32 - width)]
        out[: len(bits), k] = entry >> 5
        bits = bits + (entry & 31)
    return out.reshape(-1)[:n]


def file_head(lengths: np.ndarray) -> bytes:
    return MAGIC + struct.pack("<II", 1, len(lengths)) + lengths.astype(np.uint8).tobytes()


def section(doc_ids: list[int | None], ids: list[np.ndarray], lengths: np.ndarray, codes: np.ndarray) -> Iterator[bytes]:
    flat = np.concatenate(ids) if ids else np.zeros(0, np.uint32)
    data, offsets = pack_bits(flat, codes, lengths)
    index = np.zeros(len(doc_ids), INDEX)
    index["doc_id"], index["n"] = [x or 0 for x in doc_ids], [len(x) for x in ids]
    index["named"] = [x is not None for x in doc_ids]
    yield struct.pack("<QQQQ", len(doc_ids), len(offsets), len(flat), len(data) + 8)
    yield index.tobytes()
    yield offsets.astype("<u8").tobytes()
    yield data.tobytes() + bytes(8)


def file_parts(documents: Iterable[tuple[int | None, np.ndarray]], lengths: np.ndarray) -> Iterator[bytes]:
    """A file of documents (doc_id, ids), a section at a time."""
    codes = canonical(lengths)
    yield file_head(lengths)
    doc_ids, ids, size = [], [], 0
    for doc_id, x in documents:
        doc_ids.append(doc_id)
        ids.append(x)
        size += len(x)
        if size >= SECTION:
            yield from section(doc_ids, ids, lengths, codes)
            doc_ids, ids, size = [], [], 0
    if doc_ids:
        yield from section(doc_ids, ids, lengths, codes)


class TokenFile:
    """A file of this format; a section's index is held at a time, and its documents are decoded in groups of blocks."""

    def __init__(self, path: str):
        self.file = open_file(path)
        magic, version, symbols = struct.unpack("<4sII", self.file.read(12))
        if magic != MAGIC or version != 1:
            raise ValueError(f"{path} is not a token file")
        self.lookup, self.width = decode_table(np.frombuffer(self.file.read(symbols), np.uint8))

    def _section(self) -> bool:
        head = self.file.read(32)
        if len(head) < 32:
            return False
        docs, blocks, self.n, self.size = struct.unpack("<QQQQ", head)
        self.index = np.frombuffer(self.file.read(INDEX.itemsize * docs), INDEX)
        self.offsets = np.frombuffer(self.file.read(8 * blocks), "<u8").astype(np.int64)
        self.bits_at = self.file.tell()
        return True

    def blocks(self, first: int, most: int) -> np.ndarray:
        """The ids of blocks first, first + 1, ... of this section (at most so many)."""
        offsets = self.offsets[first : first + most]
        begin = int(offsets[0] >> 3)
        end = int(self.offsets[first + most] >> 3) + 8 if first + most < len(self.offsets) else self.size
        self.file.seek(self.bits_at + begin)
        data = np.frombuffer(self.file.read(end - begin), np.uint8)
        n = min(self.n, (first + len(offsets)) * BLOCK) - first * BLOCK
        return unpack_bits(data, offsets - (offsets[0] & ~7), n, self.lookup, self.width)

    def documents(self, group: int = 1024) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(doc_id, ids before it in this file, ids) in order."""
        before = 0
        while self._section():
            held, held_at, at, block = np.zeros(0, np.uint32), 0, 0, 0
            for doc_id, n, named in self.index.tolist():
                parts = [held]
                have = held_at + len(held)
                while have < at + n:
                    parts.append(self.blocks(block, group))
                    block += group
                    have += len(parts[-1])
                if len(parts) > 1:
                    held = np.concatenate([parts[0][at - held_at :], *parts[1:]])
                    held_at = at
                yield doc_id if named else None, before + at, held[at - held_at : at - held_at + n]
                at += n
            before += self.n
            self.file.seek(self.bits_at + self.size)

    def close(self) -> None:
        self.file.close()


def encode_table(docs: DataFrame, path: str, end_id: int = 0) -> DataFrame:
    """doc_id, ids (2 or 4 bytes each) with the end id; and one row for each task, with ids null, that has its counts of ids."""

    def run(batches):
        codec = tokens_of(path, True)
        end = np.array([end_id], codec.wide).tobytes()
        total = np.zeros(codec.size, np.int64)
        for batch in batches:
            codes = [x.tobytes() + end for x in codec.encode(batch.column("text").to_pylist())]
            for at in range(0, len(codes), 512):
                total += np.bincount(np.frombuffer(b"".join(codes[at : at + 512]), codec.wide), minlength=codec.size)
            yield pa.record_batch([batch.column("doc_id"), pa.array(codes, pa.binary()), pa.nulls(len(codes), pa.binary())], ["doc_id", "ids", "counts"])
        used = np.flatnonzero(total)
        if len(used):
            yield pa.record_batch([pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([pack(used, small(total[used]))], pa.binary())], ["doc_id", "ids", "counts"])

    return doc_texts(docs).mapInArrow(without_gc(run), "doc_id long, ids binary, counts binary")


def global_counts(encoded: DataFrame, symbols: int) -> np.ndarray:
    """How often each id occurs in all documents; what reaches the driver is one row for each id of the vocabulary at most."""

    def run(batches):
        total = np.zeros(symbols, np.int64)
        for batch in batches:
            for data in batch.column("counts").to_pylist():
                used, n = unpack(data)
                total[used] += n.astype(np.int64)
        used = np.flatnonzero(total)
        yield pa.record_batch([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], ["id", "n"])

    counts = np.zeros(symbols, np.int64)
    rows = encoded.select("counts").filter("counts is not null").mapInArrow(run, "id long, n long")
    for row in rows.groupBy("id").agg(F.sum("n").alias("n")).collect():
        counts[row.id] = row.n
    return counts


def write_files(encoded: DataFrame, folder: str, wide: np.dtype, lengths: np.ndarray, files: int) -> DataFrame:
    """Range-partition by doc_id and write one file for each partition. Gives path, part, n (ids) and bytes of each file."""

    def run(batches):
        from pyspark import TaskContext

        release()
        total = 0

        def documents():
            nonlocal total
            for batch in batches:
                for doc_id, code in zip(batch.column("doc_id").to_pylist(), batch.column("ids")):
                    ids = np.frombuffer(code.as_buffer(), wide).copy()
                    total += len(ids)
                    yield doc_id, ids

        part = TaskContext.get().partitionId()
        path = f"{folder}/part-{part:06d}.huft"
        size = write_file(path, file_parts(documents(), lengths))
        yield pa.record_batch([pa.array([path]), pa.array([part], pa.int64()), pa.array([total], pa.int64()), pa.array([size], pa.int64())], ["path", "part", "n", "bytes"])

    return encoded.repartitionByRange(files, "doc_id").sortWithinPartitions("doc_id", "ids").mapInArrow(run, "path string, part long, n long, bytes long")


def read_files(listed: DataFrame) -> DataFrame:
    """Decode files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32 (of the ids as 32-bit numbers)."""
    names, most = ["doc_id", "start", "n_tokens", "ids_crc32"], 1 << 16

    def rows_of(rows):
        columns = list(zip(*rows)) or [()] * 4
        return pa.record_batch([pa.array(c, pa.int64()) for c in columns], names)

    def run(batches):
        for batch in batches:
            release()
            for path, before in zip(batch.column("path").to_pylist(), batch.column("before").to_pylist()):
                file, rows = TokenFile(path), []
                for doc_id, at, ids in file.documents():
                    rows.append((doc_id, before + at, len(ids), zlib.crc32(ids.astype("<u4", copy=False).tobytes())))
                    if len(rows) >= most:
                        yield rows_of(rows)
                        rows = []
                file.close()
                yield rows_of(rows)

    return listed.select("path", "before").mapInArrow(run, ", ".join(f"{x} long" for x in names))


def token_files(docs: DataFrame, path: str, folder: str, file_ids: int = FILE_IDS) -> DataFrame:
    """Encode, count, write; gives the list of files (path, before: ids in all files before it), one row a file."""
    spark = docs.sparkSession
    codec = WordTokens(path, True)  # for its size; the driver keeps no memo
    encoded = staged(encode_table(docs, path), "ids")
    counts = global_counts(encoded, codec.size)
    files = max(1, -(-int(counts.sum()) // file_ids))
    written = staged(write_files(encoded.filter("ids is not null").select("doc_id", "ids"), folder, codec.wide, code_lengths(counts), files), "files")
    rows = sorted((r.part, r.path, r.n) for r in written.collect())  # one row for each file
    before, out = 0, []
    for _, name, n in rows:
        out.append((name, before))
        before += n
    return spark.createDataFrame(out, "path string, before long").repartition(max(1, len(out)))


def op9_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents")
    return read_files(token_files(docs, public_tokenizers.path("byte_bpe_50k.json"), shared_path(spark, "token-files")))
