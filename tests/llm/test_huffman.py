import heapq
import random
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from wirespark.llm import huffman
from wirespark.llm.huffman import BLOCK, TokenFile, canonical, code_lengths, decode_table, file_parts, op9_token_binary, pack_bits, unpack_bits
from wirespark.llm.storage import write_file


def unlimited_cost(counts):
    heap = [int(c) for c in counts if c]
    heapq.heapify(heap)
    cost = 0
    while len(heap) > 1:
        a = heapq.heappop(heap) + heapq.heappop(heap)
        cost += a
        heapq.heappush(heap, a)
    return cost


def test_lengths_are_optimal_and_limited():
    rng = np.random.default_rng(1)
    for n in (2, 3, 7, 100, 5000):
        counts = rng.zipf(1.3, n) % 100_000
        counts[0] = 5
        lengths = code_lengths(counts, 18)
        if (counts > 0).sum() > 1:
            assert abs(sum(2.0 ** -int(x) for x in lengths if x) - 1) < 1e-9
        assert (lengths > 0).tolist() == (counts > 0).tolist()
        if unlimited_cost(counts) and (counts > 0).sum() > 1 and lengths.max() < 18:
            assert (lengths.astype(int) * counts).sum() == unlimited_cost(counts)
    steep = np.array([2**k for k in range(40)])
    lengths = code_lengths(steep, 8)
    assert lengths.max() <= 8 and sum(2.0 ** -int(x) for x in lengths) <= 1
    assert code_lengths(np.array([0, 7, 0])).tolist() == [0, 1, 0]


def test_bits_round_trip_from_any_checkpoint():
    rng = np.random.default_rng(2)
    for n in (0, 1, 2, BLOCK - 1, BLOCK, BLOCK + 1, 10 * BLOCK + 17):
        ids = (rng.zipf(1.2, n) % 3000).astype(np.uint32)
        lengths = code_lengths(np.bincount(ids, minlength=3000))
        data, offsets = pack_bits(ids, canonical(lengths), lengths)
        lookup, width = decode_table(lengths)
        if n:
            assert unpack_bits(data, offsets, n, lookup, width).tolist() == ids.tolist()


def test_file_round_trip_with_bounded_groups(tmp_path, monkeypatch):
    rng = np.random.default_rng(3)
    docs = [(rng.zipf(1.3, int(n)) % 500).astype(np.uint32) for n in [0, 1, 5000, 3, 20_000, 1024, 0]]
    lengths = code_lengths(np.bincount(np.concatenate(docs), minlength=500))
    monkeypatch.setattr(huffman, "SECTION", 5000)
    write_file(f"{tmp_path}/a.huft", file_parts(enumerate(docs), lengths))
    for group in (1, 3, 4096):
        at = 0
        for (doc_id, start, ids), want in zip(TokenFile(f"{tmp_path}/a.huft").documents(group), docs):
            assert start == at and ids.tolist() == want.tolist()
            at += len(want)


def test_query(spark, tables):
    random.seed(4)
    texts = [" ".join(random.choices(["alpha", "béta", "gamma\n", "😀"], k=random.randint(0, 300))) for _ in range(150)] + [None, "", "x" * 9000, "same", "same"]
    rows = [(i * 7 % 155, t, 1, 2) for i, t in enumerate(texts)]
    rows += [(None, "no id", 1, 2), (-(1 << 63), "the smallest id", 1, 2), ((1 << 63) - 1, "a <|endoftext|> b", 1, 2)]
    tables.make("documents", rows, "doc_id long, text string, ids int, n int")
    tokens = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want, at = [], 0
    for doc_id, text, *_ in sorted(rows, key=lambda r: (r[0] is not None, r[0])):
        ids = np.array([*tokens.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        want.append((doc_id, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert sorted((tuple(r) for r in op9_token_binary(spark, tables).collect()), key=lambda r: r[1]) == want
    tables.make("documents", [], "doc_id long, text string")
    assert op9_token_binary(spark, tables).count() == 0
