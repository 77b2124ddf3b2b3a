"""Operator 2: WARC archives as a PySpark data source.

Writing: one gzip member for each record, with its compressed length in the member's extra field. Payloads are
deflated and digested where the pages are read, and stay in a file of the shared folder until their record is written;
what is shuffled are ids and digests, so that a payload with very many copies is no load. Which page is the first of a
digest is counted before the shuffle; digests with very many pages get their answer by a broadcast of bounded size.

Reading: format "warc" plans one partition for each .warc.gz or .warc file, takes record-type and header predicates
(=, IN on type, uri, record id, digest, refers_to), parses a record's headers first, and skips what the predicates or
the chosen columns don't want. In archives of this writer a payload is skipped by the member's length without inflating;
in others (members without that field, one member for many records, no compression) by Content-Length.
In those `payload` is the record's block, page_id is null, and payload_length and digest are what the headers say.

Defined results: null html is an empty payload; equal payloads of at least `least` bytes become one response, that of
the smallest page_id, and revisits; smaller ones stay responses; repeated rows (the same page_id and payload) are
responses if they are the first of their payload, else revisits; rows without
a page_id are responses; an empty table gives no records; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, WriterCommitMessage

from wirespark.llm.common import shared_path, staged, table
from wirespark.llm.storage import filesystem, list_files, open_file, write_file

SCHEMA = "record_id string, type string, uri string, date string, refers_to string, payload_digest string, payload_length long, page_id long, payload binary"
#: Which header gives which column.
HEADERS = {"record_id": "WARC-Record-ID", "type": "WARC-Type", "uri": "WARC-Target-URI", "date": "WARC-Date", "refers_to": "WARC-Refers-To", "payload_digest": "WARC-Payload-Digest"}
LENGTH_HEADER = "WARC-X-Payload-Length"
URN = "urn:x-page:"
FILE_BYTES = 64 << 20
#: Pages of a task that writes, about.
FILE_PAGES = 20_000
#: Digests with more pages are answered by a broadcast.
HOT_PAGES = 100_000
_POLY = 0xEDB88320


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _times(a: int, b: int) -> int:
    """Product of two polynomials over GF(2) modulo that of CRC-32 (bits reversed)."""
    out = 0
    while a:
        if a & 0x80000000:
            out ^= b
        a = a << 1 & 0xFFFFFFFF
        b = b >> 1 ^ (_POLY if b & 1 else 0)
    return out


def _powers() -> list[int]:
    """x^(8 * 2^k)."""
    out = [0x00800000]
    while len(out) < 40:
        out.append(_times(out[-1], out[-1]))
    return out


_SHIFTS = _powers()


def crc_joined(first: int, second: int, second_length: int) -> int:
    """CRC-32 of two byte strings one after the other, from the CRC-32 of each."""
    k = 0
    while second_length:
        if second_length & 1:
            first = _times(_SHIFTS[k], first)
        second_length >>= 1
        k += 1
    return first ^ second


def deflated(payload: bytes, level: int = 6) -> bytes:
    c = zlib.compressobj(level, zlib.DEFLATED, -15)
    return c.compress(payload) + c.flush()


def member(head: bytes, body: bytes = b"", body_crc: int = 0, body_length: int = 0) -> bytes:
    """A gzip member of head and an already deflated body; the extra field SL has the lengths of the member and of its first block."""
    c = zlib.compressobj(6, zlib.DEFLATED, -15)
    block = c.compress(head) + c.flush(zlib.Z_FULL_FLUSH if body else zlib.Z_FINISH)
    crc = crc_joined(zlib.crc32(head), body_crc, body_length)
    total = 10 + 2 + 12 + len(block) + len(body) + 8
    start = b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H", 12) + b"SL" + struct.pack("<HII", 8, total, len(block))
    return start + block + body + struct.pack("<II", crc, (len(head) + body_length) & 0xFFFFFFFF)


def header(kind: str, page_id: int, url: str | None, payload_digest: str, payload_length: int, refers_to: int | None, content_length: int, date: str) -> bytes:
    uri = " ".join((url or "").split())
    lines = ["WARC/1.0", f"WARC-Type: {kind}", f"WARC-Record-ID: <{URN}{page_id}>", f"WARC-Date: {date}"]
    lines += [f"WARC-Target-URI: {uri}"] if uri else []
    lines += [f"WARC-Payload-Digest: sha1:{payload_digest}", f"{LENGTH_HEADER}: {payload_length}"]
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <{URN}{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"]
    lines += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {content_length}", "", ""]
    return "\r\n".join(lines).encode()


#: What ends a record stands in its own deflate block.
_END = b"\r\n\r\n"


def record(kind, page_id, url, sha, payload_length, refers_to, body, body_crc, date) -> bytes:
    """body: the deflated payload and record end of a response; a revisit has none."""
    payload_digest = base64.b32encode(bytes.fromhex(sha)).decode()
    if kind == "response":
        return member(header(kind, page_id, url, payload_digest, payload_length, None, payload_length, date), body, body_crc, payload_length + len(_END))
    return member(header(kind, page_id, url, payload_digest, payload_length, refers_to, 0, date) + _END)


class Bodies:
    """Deflated payloads in files of the shared folder, one file open at a time."""

    def __init__(self):
        self.path, self.file = None, None

    def read(self, path: str, at: int, n: int) -> bytes:
        if path != self.path:
            self.close()
            self.path, self.file = path, open_file(path)
        self.file.seek(at)
        return self.file.read(n)

    def close(self) -> None:
        if self.file:
            self.file.close()
        self.path, self.file = None, None


class WarcWriter(DataSourceArrowWriter):
    """Rows of kind, page_id, url, sha (SHA-1 in hex), payload_length, refers_to, body_crc and where the body is, as files of a bounded size."""

    def __init__(self, folder: str, date: str):
        self.folder, self.date = folder, date

    def write(self, iterator):
        from pyspark import TaskContext

        part, names, held, size = TaskContext.get().partitionId(), [], [], 0
        bodies = Bodies()
        own = uuid.uuid4().hex[:8]  # attempts of the same task don't meet

        def close():
            name = f"{self.folder}/pages-{part:06d}-{len(names):04d}-{own}.warc.gz"
            write_file(name + ".open", held)
            names.append(name)

        for batch in iterator:
            columns = [batch.column(k).to_pylist() for k in ("file", "at", "size", "kind", "page_id", "url", "sha", "payload_length", "refers_to", "body_crc")]
            for file, at, n, *row, crc in zip(*columns):
                body = bodies.read(file, at, n) if row[0] == "response" else b""
                held.append(record(*row, body, crc, self.date))
                size += len(held[-1])
                if size >= FILE_BYTES:
                    close()
                    held, size = [], 0
        if held:
            close()
        bodies.close()
        message = WriterCommitMessage()
        message.names = names
        return message

    def commit(self, messages):
        """Only files of tasks that count get their final name."""
        for message in messages:
            for name in message.names if message else []:
                fs, at = filesystem(name)
                fs.move(at + ".open", at)

    def abort(self, messages):
        for message in messages:
            for name in message.names if message else []:
                fs, at = filesystem(name)
                fs.delete_file(at + ".open")


class WarcFile(InputPartition):
    def __init__(self, path: str):
        self.value = path


class WarcReader(DataSourceReader):
    def __init__(self, folder: str, columns: list[str], verify: bool):
        self.folder, self.columns, self.verify = folder, columns, verify
        self.wanted: dict[str, set] = {}

    def pushFilters(self, filters):
        for f in filters:
            name = f.attribute[0] if isinstance(f, (EqualTo, In)) and len(f.attribute) == 1 else None
            if name in HEADERS:
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.wanted[name] = self.wanted.get(name, values) & values
            else:
                yield f

    def partitions(self):
        return [WarcFile(path) for suffix in (".warc.gz", ".warc") for path, _ in list_files(self.folder, suffix)] or [WarcFile("")]

    def read(self, partition) -> Iterator[pa.RecordBatch]:
        if not partition.value:
            return
        rows, size = [], 0
        schema = pa.schema([(n, pa.int64() if n in ("payload_length", "page_id") else pa.binary() if n == "payload" else pa.string()) for n in self.columns])
        for row in records(partition.value, self.wanted, self.verify or "payload" in self.columns):
            if self.verify and row["type"] == "response" and row["payload_length"] is not None and (len(row["payload"]) != row["payload_length"] or digest(row["payload"]) != row["payload_digest"]):
                raise ValueError(f"{partition.value}: {row['record_id']} has another payload than its header says")
            rows.append({name: row[name] for name in self.columns})
            size += len(row["payload"] or b"") + 200
            if size > 8 << 20:
                yield pa.RecordBatch.from_pylist(rows, schema)
                rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)


def parse_header(head: bytes, path: str = "") -> dict:
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"{path} has no WARC record where one should begin: {lines[0][:40]!r}")
    named = {name.strip().lower(): value.strip() for name, sep, value in (line.partition(":") for line in lines[1:]) if sep}
    row = {column: named.get(name.lower()) for column, name in HEADERS.items()}
    for column in ("record_id", "refers_to"):
        row[column] = row[column].strip("<>") if row[column] else None
    row["payload_digest"] = row["payload_digest"].removeprefix("sha1:") if row["payload_digest"] else None
    row["payload_length"] = int(named[LENGTH_HEADER.lower()]) if LENGTH_HEADER.lower() in named else None
    row["page_id"] = int(number) if (row["record_id"] or "").startswith(URN) and (number := row["record_id"].removeprefix(URN)) != "None" else None
    row["content_length"] = int(named.get("content-length", 0))
    return row


def records(path: str, wanted: dict[str, set], payloads: bool) -> Iterator[dict]:
    """Records of a file; headers first, the rest of a record only if wanted."""
    file = open_file(path)
    try:
        start = file.read(16)
        if start[:4] == b"\x1f\x8b\x08\x04" and start[12:16] == b"SL\x08\0":
            found = _own_records(file, path, wanted, payloads)
        else:
            file.seek(0)
            found = _foreign_records(Inflated(file) if start[:2] == b"\x1f\x8b" else file, path, wanted, payloads)
        yield from found
    finally:
        file.close()


def _own_records(file, path: str, wanted: dict[str, set], payloads: bool) -> Iterator[dict]:
    """Members with their lengths in the extra field: the next one is a seek away."""
    at, end = 0, file.size()
    while at < end:
        file.seek(at)
        start = file.read(24)
        if start[:4] != b"\x1f\x8b\x08\x04" or start[12:16] != b"SL\x08\0":
            raise ValueError(f"{path} has a member without its length at {at}")
        total, first = struct.unpack("<II", start[16:24])
        inflate = zlib.decompressobj(-15)
        head, _, rest = inflate.decompress(file.read(first)).partition(b"\r\n\r\n")
        row = parse_header(head, path)
        if all(row[name] in values for name, values in wanted.items()):
            row["payload"] = None
            if payloads:
                body = rest + (inflate.decompress(file.read(total - 24 - first - 8)) if not inflate.eof else b"")
                row["payload"] = body[: row["content_length"]]
            yield row
        at += total


class Inflated:
    """The text of a gzip file of one member or many, read on and on."""

    def __init__(self, file, step: int = 1 << 18):
        self.file, self.step, self.inflate, self.rest = file, step, None, b""

    def read(self, n: int) -> bytes:
        out = []
        while n > 0:
            if self.inflate is None or self.inflate.eof:
                self.rest = (self.inflate.unused_data if self.inflate else self.rest) or self.file.read(self.step)
                if not self.rest:
                    break
                self.inflate = zlib.decompressobj(31)
            elif not self.rest:
                self.rest = self.file.read(self.step)
                if not self.rest:
                    raise ValueError("a gzip member ends early")
            data = self.inflate.decompress(self.rest, n)
            self.rest = self.inflate.unconsumed_tail
            out.append(data)
            n -= len(data)
        return b"".join(out)


def _foreign_records(file, path: str, wanted: dict[str, set], payloads: bool, step: int = 1 << 20, most: int = 1 << 20) -> Iterator[dict]:
    """Records one after the other; blocks that aren't wanted are passed over in steps."""
    held = b""
    while True:
        held = held.lstrip(b"\r\n")
        while b"\r\n\r\n" not in held:
            more = file.read(4096)
            if not more or len(held) > most:
                if held.strip():
                    raise ValueError(f"{path} has a record header without an end")
                return
            held = (held + more).lstrip(b"\r\n")
        head, _, held = held.partition(b"\r\n\r\n")
        row = parse_header(head, path)
        left, keep = row["content_length"], payloads and all(row[name] in values for name, values in wanted.items())
        parts = [held[:left]]
        left, held = left - len(parts[0]), held[left:]
        while left:
            data = file.read(min(left, step))
            if not data:
                raise ValueError(f"{path} ends within a record")
            left -= len(data)
            parts = [*parts, data] if keep else []
        if all(row[name] in values for name, values in wanted.items()):
            row["payload"] = b"".join(parts) if payloads else None
            yield row


class WarcSource(DataSource):
    """spark.read.format("warc").load(folder); df.write.format("warc").save(folder). Option columns: comma-separated names to read."""

    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        names = self.options.get("columns")
        return SCHEMA if not names else ", ".join(x for x in SCHEMA.split(", ") if x.split()[0] in names.split(","))

    def reader(self, schema):
        return WarcReader(self.options["path"], schema.fieldNames(), self.options.get("verify") == "true")

    def writer(self, schema, overwrite):
        return WarcWriter(self.options["path"], self.options.get("date", "2024-01-01T00:00:00Z"))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def records_of(pages: DataFrame, least: int = 0, hot_pages: int = HOT_PAGES) -> DataFrame:
    """Rows for WarcWriter: where each page's compressed payload is, and which record it revisits."""
    spark = pages.sparkSession
    folder = shared_path(spark, "bodies")

    def run(batches):
        path = f"{folder}/{uuid.uuid4().hex}"  # an attempt's own file: rows of the attempt that counts name it
        fs, name = filesystem(path)
        fs.create_dir(name.rpartition("/")[0], recursive=True)
        with fs.open_output_stream(name) as out:
            at = 0
            for batch in batches:
                rows = []
                for html in batch.column("html").to_pylist():
                    payload = (html or "").encode()
                    body = deflated(payload + _END)
                    rows.append((hashlib.sha1(payload).hexdigest(), len(payload), path, at, len(body), zlib.crc32(payload + _END)))
                    out.write(body)
                    at += len(body)
                columns = list(zip(*rows)) or [()] * 6
                types = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64())
                yield pa.record_batch(
                    [batch.column("page_id"), batch.column("url"), *(pa.array(c, t) for c, t in zip(columns, types))],
                    ["page_id", "url", "sha", "payload_length", "file", "at", "size", "body_crc"],
                )

    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    schema = "page_id long, url string, sha string, payload_length long, file string, at long, size long, body_crc long"
    rows = staged(pages.mapInArrow(run, schema), "payloads")
    first = staged(rows.groupBy("sha").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n")), "digests")
    most = max(hot_pages, rows.count() // 10_000)
    hot = first.filter(F.col("n") > most).select("sha", F.col("first_id").alias("hot_id"), F.lit(True).alias("hot"))  # 10,000 rows at most
    by_hot = rows.join(F.broadcast(hot), "sha", "left")
    others = by_hot.filter("hot is null").drop("hot", "hot_id").join(first.select("sha", "first_id"), "sha")
    rows = by_hot.filter("hot").drop("hot").withColumnRenamed("hot_id", "first_id").unionByName(others)
    revisit = F.coalesce((F.col("payload_length") >= least) & (F.col("page_id") != F.col("first_id")), F.lit(False))
    return rows.select(
        F.when(revisit, "revisit").otherwise("response").alias("kind"), "page_id", "url", "sha", "payload_length",
        F.when(revisit, F.col("first_id")).alias("refers_to"), "body_crc", "file", "at", "size",
    )


def write_archives(pages: DataFrame, folder: str, least: int = 0) -> None:
    register(pages.sparkSession)
    rows = staged(records_of(pages, least), "records")
    spread = rows.repartition(max(1, -(-rows.count() // FILE_PAGES)), "file", F.floor(F.col("at") / (8 << 20)))  # neighbours stay together
    spread.sortWithinPartitions("file", "at").write.format("warc").mode("append").save(folder)


def read_archives(spark: SparkSession, folder: str, columns: str | None = None, verify: bool = False) -> DataFrame:
    """verify: inflate each response payload and hold it against the length and digest of its header."""
    register(spark)
    reader = spark.read.format("warc").option("verify", str(verify).lower())
    return (reader.option("columns", columns) if columns else reader).load(folder)


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_path(spark, "warc")
    write_archives(table(spark, sf_dir, "pages"), folder)
    back = read_archives(spark, folder, "page_id,payload_length,payload_digest,type,refers_to", verify=True)
    return back.select(
        "page_id", F.col("payload_length").alias("payload_bytes"), "payload_digest", F.col("type").alias("record_type"),
        F.regexp_extract("refers_to", "([0-9-]+)$", 1).try_cast("long").alias("refers_to"),
    )
