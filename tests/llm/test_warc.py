import gzip
import random
import zlib

import pytest
from pyspark.sql.datasource import EqualTo, In

from wirespark.llm.warc import WarcReader, crc_joined, digest, op2_warc, read_archives, records, records_of, write_archives

SCHEMA = "page_id long, url string, html string, type string"


def rows():
    random.seed(1)
    out = [(i, f"http://h/{i}", f"<p>{random.choice('abcdefghé') * (i % 7)}</p>" * (i % 5), "x") for i in range(120)]
    return out + [(200, None, None, None), (201, "u", "", "y"), (202, "a\r\nWARC-Type: evil", "z\r\n\r\nWARC/1.0" * 3, "z"), (203, "b", "big " * 100_000, "q"), (2, "http://h/2", out[2][2], "x")]


def expected(rows, least=0):
    out = []
    for page_id, _, html, _ in rows:
        data = (html or "").encode()
        first = min(i for i, _, h, _ in rows if (h or "").encode() == data)
        again = first != page_id and len(data) >= least
        out.append((page_id, len(data), digest(data), "revisit" if again else "response", first if again else None))
    return sorted(out, key=str)


def test_crc_of_joined_parts():
    for a, b in ((b"", b""), (b"a", b""), (b"", b"b"), (b"head" * 9, b"payload" * 1000)):
        assert crc_joined(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)


def test_query(spark, tables):
    tables.make("pages", rows(), SCHEMA)
    assert sorted((tuple(r) for r in op2_warc(spark, tables).collect()), key=str) == expected(rows())
    tables.make("pages", [(None, "u", "same", "x"), (1, "u", "same", "x")], SCHEMA)
    assert {(r.page_id, r.record_type) for r in op2_warc(spark, tables).collect()} == {(None, "response"), (1, "response")}
    tables.make("pages", [], SCHEMA)
    assert op2_warc(spark, tables).count() == 0


def test_archives_are_gzip_and_push_down_skips(spark, tmp_path):
    pages = spark.createDataFrame(rows(), SCHEMA)
    folder = f"file://{tmp_path}/w"
    write_archives(pages, folder, least=30)
    files = sorted((tmp_path / "w").glob("*.warc.gz"))
    text = b"".join(gzip.open(f).read() for f in files)  # whole gzip members with right checksums
    assert text.count(b"WARC/1.0\r\nWARC-Type: ") == len(rows())
    full = read_archives(spark, folder)
    got = sorted(((r.page_id, r.payload_length, r.payload_digest, r.type, int(r.refers_to.rpartition(":")[2]) if r.refers_to else None) for r in full.collect()), key=str)
    assert got == expected(rows(), 30)
    one = full.filter("type = 'response' and record_id = 'urn:x-page:203'")
    assert [r.payload for r in one.collect()] == [b"big " * 100_000]
    reader = WarcReader(folder, ["page_id"], False)
    assert list(reader.pushFilters([EqualTo(("type",), "response"), In(("record_id",), ("urn:x-page:203", "q")), EqualTo(("page_id",), 203)])) == [EqualTo(("page_id",), 203)]
    assert [r.column("page_id").to_pylist() for p in reader.partitions() for r in reader.read(p)] == [[203]]
    assert full.filter("type in ('revisit', 'other')").count() == sum(r[3] == "revisit" for r in expected(rows(), 30))
    assert all(r["payload"] is None for f in files for r in records(str(f), {"type": {"response"}}, False))


def foreign(kind, number, block):
    head = f"WARC/1.1\r\nWARC-Type: {kind}\r\nwarc-record-id: <urn:uuid:{number}>\r\nWARC-Target-URI:  http://f/{number}\r\nContent-Length: {len(block)}\r\n\r\n"
    return head.encode() + block + b"\r\n\r\n"


def test_archives_of_other_writers(spark, tmp_path):
    blocks = [b"software: x\r\n", b"HTTP/1.1 200 OK\r\n\r\n<p>" + b"long " * 400_000, b"", b"\r\n\r\nodd\r\n\r\n"]
    whole = [foreign(k, i, x) for i, (k, x) in enumerate(zip(("warcinfo", "response", "request", "response"), blocks))]
    folder = tmp_path / "f"
    folder.mkdir()
    (folder / "a.warc.gz").write_bytes(b"".join(map(gzip.compress, whole)))
    (folder / "b.warc.gz").write_bytes(gzip.compress(b"".join(whole)))
    (folder / "c.warc").write_bytes(b"".join(whole))
    back = read_archives(spark, f"file://{folder}", verify=True)
    got = sorted((r.record_id, r.type, r.uri, bytes(r.payload), r.page_id) for r in back.collect())
    assert got == sorted((f"urn:uuid:{i}", k, f"http://f/{i}", x, None) for i, (k, x) in enumerate(zip(("warcinfo", "response", "request", "response"), blocks)) for _ in range(3))
    assert back.filter("type = 'request'").count() == 3
    (folder / "d.warc").write_bytes(b"no archive\r\n\r\n")
    with pytest.raises(ValueError):
        list(records(str(folder / "d.warc"), {}, True))
    (folder / "e.warc.gz").write_bytes(gzip.compress(whole[1])[:-2000])
    with pytest.raises(ValueError):
        list(records(str(folder / "e.warc.gz"), {}, True))


def test_very_frequent_payloads(spark):
    pages = spark.createDataFrame([(i, "u", "same" if i % 3 else str(i)) for i in range(300)], "page_id long, url string, html string")
    got = {r.page_id: (r.kind, r.refers_to) for r in records_of(pages, hot_pages=50).collect()}
    assert got == {i: ("response", None) if i % 3 == 0 or i == 1 else ("revisit", 1) for i in range(300)}
