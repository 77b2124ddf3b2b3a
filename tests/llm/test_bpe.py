import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from wirespark.llm.bpe import BpeTransducer, ByteBpe, Utf8Stream, decode_documents, encode_documents, load_ranks, op1_byte_bpe

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def expected():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=load_ranks(PATH), special_tokens={})


def test_same_ids_as_tiktoken_on_odd_texts():
    random.seed(5)
    symbols = list("abcdefgthe  \n\t'sré中文𝄞ß1٣²Ⅷ\x1c\x85   .,!'ll've😀")
    texts = ["".join(random.choices(symbols, k=random.randint(0, 60))) for _ in range(3000)]
    texts += ["", " ", "a" * 5000, "\n\n  x", "  a  b ", "x\x1cy \x1c z", " lead", "trail "]
    codec, other = ByteBpe(load_ranks(PATH), public_tokenizers.PATTERN), expected()
    for text, ids in zip(texts, codec.encode(texts)):
        assert ids.tolist() == other.encode_ordinary(text), text
        assert b"".join(codec.decoder.decode(ids, 7)) == text.encode() and codec.decoder.valid


def test_decoder_holds_open_characters_and_passes_faults():
    codec = ByteBpe(load_ranks(PATH), public_tokenizers.PATTERN)
    random.seed(6)
    for _ in range(300):
        data = bytes(random.choices(b"ab\xe4\xb8\xad\xf0\x9f\x98\x80\xc3\xa9\xff", k=random.randint(0, 12)))
        ids = np.array(codec.fst.encode(data), np.int64)
        parts = list(codec.decoder.decode(ids, 1))
        try:
            data.decode()
            valid = True
        except UnicodeDecodeError:
            valid = False
        assert b"".join(parts) == data and codec.decoder.valid == valid
        if valid:
            assert "".join(x.decode() for x in parts) == data.decode()  # no part ends within a character


def test_utf8_stream_holds_open_characters_and_refuses_faults():
    s = Utf8Stream()
    data = "aé中😀".encode()
    assert "".join(s.feed(data[i : i + 1]) for i in range(len(data))) == "aé中😀" and s.close()
    for bad in (b"\xc0\x80", b"\xed\xa0\x80", b"\xf5", b"\xe0\x80\x80", b"\x80"):
        with pytest.raises(UnicodeDecodeError):
            Utf8Stream().feed(bad)
    half = Utf8Stream()
    assert half.feed(b"\xf0\x9f") == "" and not half.close()


def test_query_and_round_trip(spark, tables):
    rows = [(1, "Hello  wörld\n", "en", 1), (2, None, None, None), (3, "", "en", 0), (3, "", "en", 0), (4, "x y " * 40000, "en", 2)]
    tables.make("documents", rows, "doc_id long, text string, lang string, ids int")
    got = {r.doc_id: r for r in op1_byte_bpe(spark, tables).collect()}
    other = expected()
    for doc_id, text, *_ in rows:
        ids = other.encode_ordinary(text or "")
        assert got[doc_id].n_tokens == len(ids)
        assert got[doc_id].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[doc_id].decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    back = decode_documents(encode_documents(docs, PATH, public_tokenizers.PATTERN), PATH, public_tokenizers.PATTERN)
    assert sorted((r.doc_id, r.text) for r in back.collect()) == sorted((r[0], r[1] or "") for r in rows)
    tables.make("documents", [], "doc_id long, text string")
    assert op1_byte_bpe(spark, tables).count() == 0


def test_stream_emits_after_bounded_lookahead_and_survives_small_memos():
    ranks = load_ranks(PATH)
    fst = BpeTransducer(ranks, most_states=50)
    data = ("thndouha ünd thre" * 400).encode()
    whole, got, held, most = BpeTransducer(ranks).encode(data), [], 0, 0
    for part in fst.stream(data[i : i + 7] for i in range(0, len(data), 7)):
        got += part
        held = min(len(data), held + 7) - sum(fst.size[x] for x in part)
        most = max(most, held)
    assert got == whole == fst.encode(data)
    assert most <= 4 * max(map(len, ranks))
    assert b"".join(fst.token_bytes[x] for x in got) == data


def test_rows_without_an_id(spark, tables):
    tables.make("documents", [(None, "some words here", "en"), (None, None, None), (1, "some words here", "en")], "doc_id long, text string, lang string")
    assert sorted(str(r.doc_id) for r in op1_byte_bpe(spark, tables).collect()) == ["1", "None", "None"]
