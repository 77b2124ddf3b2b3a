"""Packet captures as a data source: spark.read.format("pcap").load(folder or file).

One partition for each file. Time, port, protocol and address filters are taken where they are given as comparisons, and
frames that fail them aren't turned into rows. Classic captures of either byte order, with micro- or nanoseconds.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

from wirespark.functions.parsers.packet import decode

SCHEMA = (
    "file string, number long, ts_nano long, capture_length long, length long, src_ip string, dst_ip string, src_port int, dst_port int, ip_proto int, "
    "ttl int, tcp_flags int, seq long, ack long, payload binary, frame binary"
)
#: Magic number -> byte order, nanoseconds per unit.
MAGIC = {b"\xd4\xc3\xb2\xa1": ("<", 1000), b"\xa1\xb2\xc3\xd4": (">", 1000), b"\x4d\x3c\xb2\xa1": ("<", 1), b"\xa1\xb2\x3c\x4d": (">", 1)}
MOST_FRAME = 256 << 10
BATCH_BYTES = 8 << 20
_TESTS = {EqualTo: lambda a, b: a == b, GreaterThan: lambda a, b: a > b, GreaterThanOrEqual: lambda a, b: a >= b, LessThan: lambda a, b: a < b, LessThanOrEqual: lambda a, b: a <= b, In: lambda a, b: a in b}
_PUSHED = {"ts_nano", "src_ip", "dst_ip", "src_port", "dst_port", "ip_proto", "length"}


def frames(read) -> Iterator[tuple[int, int, int, bytes]]:
    """(nanoseconds, length on the wire, link type, frame) of a capture; read(n) gives bytes. A damaged record ends it."""
    head = read(24)
    if len(head) < 24 or head[:4] not in MAGIC:
        raise ValueError("not a packet capture")
    order, unit = MAGIC[head[:4]]
    link = struct.unpack(order + "I", head[20:24])[0] & 0xFFFF
    while len(h := read(16)) == 16:
        seconds, part, size, length = struct.unpack(order + "IIII", h)
        if size > MOST_FRAME:
            return
        frame = read(size)
        if len(frame) < size:
            return
        yield seconds * 10**9 + part * unit, length, link, frame


class CaptureFile(InputPartition):
    def __init__(self, path: str):
        self.value = path


class PcapReader(DataSourceReader):
    def __init__(self, path: str, columns: list[str]):
        self.path, self.columns, self.tests = path, columns, []

    def pushFilters(self, filters):
        for f in filters:
            if type(f) in _TESTS and len(f.attribute) == 1 and f.attribute[0] in _PUSHED:
                self.tests.append((f.attribute[0], type(f), f.value))
            else:
                yield f

    def partitions(self):
        from pyarrow.fs import FileSelector, FileType

        from wirespark.sources.files import filesystem

        fs, name = filesystem(self.path)
        info = fs.get_file_info(name)
        if info.type == FileType.File:
            return [CaptureFile(self.path)]
        found = sorted(x.base_name for x in fs.get_file_info(FileSelector(name)) if x.type == FileType.File and x.base_name.endswith((".pcap", ".cap")))
        return [CaptureFile(f"{self.path.rstrip('/')}/{x}") for x in found]

    def read(self, partition):
        from wirespark.sources.files import filesystem

        fs, name = filesystem(partition.value)
        wide = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}
        kinds = dict(x.split() for x in SCHEMA.split(", "))
        schema = pa.schema([(c, wide[kinds[c]]) for c in self.columns])
        rows, size = [], 0
        of_record = [t for t in self.tests if t[0] in ("ts_nano", "length")]  # answered by the record's header, before a frame is decoded
        of_frame = [t for t in self.tests if t not in of_record]
        decoded = bool(of_frame) or any(c not in ("file", "number", "ts_nano", "capture_length", "length", "frame") for c in self.columns)
        holds = lambda row, tests: all(row.get(c) is not None and _TESTS[kind](row[c], v) for c, kind, v in tests)
        with fs.open_input_stream(name) as f:
            for number, (nano, length, link, frame) in enumerate(frames(f.read)):
                row = {"file": partition.value, "number": number, "ts_nano": nano, "capture_length": len(frame), "length": length, "frame": frame}
                if not holds(row, of_record):
                    continue
                if decoded:
                    row |= decode(frame, link) or {}
                if holds(row, of_frame):
                    rows.append({c: row.get(c) for c in self.columns})
                    size += len(frame) + 200
                    if size > BATCH_BYTES:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)


class PcapWriter(DataSourceArrowWriter):
    """Rows of ts_nano and frame as captures with nanoseconds, one for each task."""

    def __init__(self, path: str):
        self.path = path

    def write(self, iterator):
        import uuid

        from wirespark.sources.files import filesystem

        name = f"part-{uuid.uuid4().hex}.pcap"
        fs, at = filesystem(self.path)
        fs.create_dir(at, recursive=True)
        with fs.open_output_stream(f"{at}/.{name}") as out:
            out.write(struct.pack("<IHHiIII", 0xA1B23C4D, 2, 4, 0, 0, MOST_FRAME, 1))
            for batch in iterator:
                for nano, frame in zip(batch.column("ts_nano").to_pylist(), batch.column("frame").to_pylist()):
                    out.write(struct.pack("<IIII", nano // 10**9, nano % 10**9, len(frame), len(frame)) + frame)
        message = WriterCommitMessage()
        message.name = name
        return message

    def commit(self, messages):
        from wirespark.sources.files import filesystem

        fs, at = filesystem(self.path)
        for m in messages:
            if m:
                fs.move(f"{at}/.{m.name}", f"{at}/{m.name}")

    def abort(self, messages):
        from wirespark.sources.files import filesystem

        fs, at = filesystem(self.path)
        for m in messages:
            if m:
                fs.delete_file(f"{at}/.{m.name}")


class PcapSource(DataSource):
    @classmethod
    def name(cls):
        return "pcap"

    def schema(self):
        names = self.options.get("columns")
        return SCHEMA if not names else ", ".join(x for x in SCHEMA.split(", ") if x.split()[0] in names.split(","))

    def reader(self, schema):
        return PcapReader(self.options["path"], schema.fieldNames())

    def writer(self, schema, overwrite):
        return PcapWriter(self.options["path"])


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PcapSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
