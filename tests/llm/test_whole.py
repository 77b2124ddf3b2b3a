"""What holds only if no step of an operator stops early."""

import itertools
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from wirespark.llm.huffman import op9_token_binary
from wirespark.llm.packing import op7_best_fit_packing, pack, tokens_of


def test_local_search_goes_on_until_no_exchange_is_left():
    random.seed(5)
    lengths = [random.randint(400, 800) for _ in range(1000)]
    bins, *_ = pack(lengths, 2048)
    assert sorted(i for b in bins for i in b) == list(range(len(lengths)))
    under = [b for b in bins if sum(lengths[i] for i in b) < 2048]
    assert len(under) > 20
    for giver, taker in itertools.permutations(under, 2):
        room, own = 2048 - sum(lengths[i] for i in taker), [lengths[i] for i in giver]
        if room > 2048 - sum(own):
            continue
        coming = own + [x + y for x, y in itertools.combinations(own, 2)]
        assert not any(0 < x - out <= room for x in coming for out in (0, *(lengths[i] for i in taker)))


def test_local_search_saves_sequences_of_a_large_shard():
    random.seed(5)
    lengths = [random.randint(400, 800) for _ in range(4000)]
    assert len(pack(lengths, 2048)[0]) <= 1.015 * sum(lengths) / 2048


@pytest.mark.parametrize("name,lead", [("word_bpe_49k.json", False), ("byte_bpe_50k.json", True)])
def test_added_tokens_in_texts_are_the_library_s(name, lead):
    random.seed(4)
    parts = ["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|endoftext|", "<|", " ", "  ", "\n", "a", "b.", "it's", "é", "\u0301", "中"]
    texts = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|>y", ""] + ["".join(random.choices(parts, k=random.randint(0, 12))) for _ in range(3000)]
    untouched = Tokenizer.from_file(public_tokenizers.path(name))
    for text, got in zip(texts, tokens_of(public_tokenizers.path(name), lead).encode(texts), strict=True):
        assert got.tolist() == untouched.encode(text, add_special_tokens=False).ids, text


@pytest.mark.parametrize("query,name", [(op7_best_fit_packing, "word_bpe_49k.json"), (op9_token_binary, "byte_bpe_50k.json")])
def test_queries_give_the_library_s_ids_for_added_tokens(spark, tables, query, name):
    rows = [(0, "a <|endoftext|> b"), (1, "<|endoftext|>"), (2, "plain")]
    tables.make("documents", rows, "doc_id long, text string")
    untouched = Tokenizer.from_file(public_tokenizers.path(name))
    want = {i: zlib.crc32(np.array([*untouched.encode(t, add_special_tokens=False).ids, 0], "<u4").tobytes()) for i, t in rows}
    assert {r.doc_id: r.ids_crc32 for r in query(spark, tables).collect()} == want
