import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from wirespark.llm.packing import in_order, op7_best_fit_packing, pack, packed
from wirespark.llm.words import WordTokens


def fresh(name):
    t = Tokenizer.from_file(public_tokenizers.path(name))
    t.encode_special_tokens = True
    return t


@pytest.mark.parametrize("name,lead", [("word_bpe_49k.json", False), ("byte_bpe_50k.json", True)])
def test_chunked_ids_are_the_library_s(name, lead):
    random.seed(3)
    symbols = list("abcdefgthe  \n\t'sréΣÀ中文𝄞ß1٣²Ⅷ\x1c\x85\0   .,!'ll've😀́̈")
    texts = ["".join(random.choices(symbols, k=random.randint(0, 60))) for _ in range(3000)] + ["", " ", "<|endoftext|> x", "a" * 3000, "\n", "a\n", "\nb", "a\nb. c\n\nd", "Éa,\nŞb! ǅx İi ßẞ ſ ŉ"]
    for text, got, want in zip(texts, WordTokens(public_tokenizers.path(name), lead).encode(texts), fresh(name).encode_batch(texts, add_special_tokens=False)):
        assert got.tolist() == want.ids, text


def test_pack_is_whole_and_tight():
    random.seed(1)
    for lengths in ([random.randint(1, 900) for _ in range(3000)], [1] * 5000, [2047] * 50, [random.choice([500, 520, 700, 333]) for _ in range(500)], []):
        bins, *_ = pack(lengths, 2048)
        assert sorted(i for b in bins for i in b) == list(range(len(lengths)))
        assert all(sum(lengths[i] for i in b) <= 2048 for b in bins)
    assert len(pack([random.randint(1, 900) for _ in range(3000)], 2048)[0]) <= 1.01 * 3000 * 450 / 2048 + 2


def squares(bins, lengths):
    return sum(sum(lengths[i] for i in b) ** 2 for b in bins)


def test_search_empties_bins_and_raises_the_squared_fill():
    random.seed(5)
    for lengths in ([random.randint(300, 900) for _ in range(1500)], [random.randint(400, 800) for _ in range(1500)], [random.randint(1, 2047) for _ in range(1000)]):
        start = in_order(lengths, 2048)
        bins, moves, exchanges = pack(lengths, 2048)
        assert moves > 0 and exchanges > 0
        assert len(bins) < len(start) and squares(bins, lengths) > squares(start, lengths)
        again, *_ = pack(lengths, 2048, bins)  # going on from there makes nothing worse
        assert len(again) <= len(bins) and squares(again, lengths) >= squares(bins, lengths)
    assert len(pack([random.randint(300, 900) for _ in range(1500)], 2048)[0]) <= 1.03 * 1500 * 600 / 2048


def test_two_documents_for_one():
    # filled in order: 60+35, 50+20+20, 15; only 60+20+20 and 50+35+15 make two
    lengths = [60, 35, 50, 20, 20, 15]
    bins, _, exchanges = pack(lengths, 100)
    assert len(in_order(lengths, 100)) == 3 and sorted(sorted(lengths[i] for i in b) for b in bins) == [[15, 35, 50], [20, 20, 60]] and exchanges > 0


def check(rows, got):
    by_doc, fill = {}, {}
    for r in sorted(got, key=lambda r: (r.doc_id, r.piece)):
        by_doc.setdefault(r.doc_id, []).append(r)
        fill.setdefault(r.sequence_id, []).append(r)
    tokens = fresh("word_bpe_49k.json")
    for doc_id, text in rows:
        ids = np.array([*tokens.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        want = [(k, at, min(2048, len(ids) - at), zlib.crc32(ids[at : at + 2048].tobytes())) for k, at in enumerate(range(0, len(ids), 2048))]
        assert set(want) == {(r.piece, r.start, r.length, r.ids_crc32) for r in by_doc[doc_id]}
    for parts in fill.values():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
    return len(fill)


def test_query(spark, tables):
    rows = [(i, f"Wörter und words {i} " * (i % 700)) for i in range(300)] + [(300, None), (301, ""), (302, "long text. " * 9000)]
    tables.make("documents", [(*r, "x") for r in rows], "doc_id long, text string, length string")
    got = op7_best_fit_packing(spark, tables).collect()
    assert check(rows, got) <= -(-sum(r.length for r in got) // 2048) + 2
    assert max(r.moves for r in got) > 0 and max(r.exchanges for r in got) > 0
    tables.make("documents", [(1, "a b"), (1, "a b")], "doc_id long, text string")
    assert op7_best_fit_packing(spark, tables).count() == 2
    tables.make("documents", [], "doc_id long, text string")
    assert op7_best_fit_packing(spark, tables).count() == 0


def test_shards_meet_again(spark):
    pieces = spark.range(3000).selectExpr("id doc_id", "0 piece", "0L start", "id % 900 + 1 length", "0L ids_crc32", "id row")
    got = packed(pieces, 2048, shard_rows=500).collect()
    assert len(got) == 3000
    assert len({r.sequence_id for r in got}) <= 1.02 * sum(r.length for r in got) / 2048


def test_rows_without_an_id(spark, tables):
    tables.make("documents", [(None, "some words here", "en"), (None, None, None), (1, "some words here", "en")], "doc_id long, text string, lang string")
    assert sorted(str(r.doc_id) for r in op7_best_fit_packing(spark, tables).collect()) == ["1", "None", "None"]
