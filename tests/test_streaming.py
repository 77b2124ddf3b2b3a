"""What a stream gives over all its input is what the batch form gives."""

import pytest
from pyspark.sql import functions as F

from wirespark.operators import classify, traffic
from wirespark.sources import pcap
from wirespark.plans import build
from wirespark.streaming import packets as live

SCHEMA = "packet_id long, ts_nano long, length long, ip_proto int, flow_id string"


@pytest.fixture
def source(spark, tmp_path):
    rows = [(i, 1_700_000_000_000_000_000 + i * 700_000_000, 60 + i % 50, [6, 17][i % 2], f"f{i % 3}") for i in range(300)]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in")
    return spark.read.parquet(f"{tmp_path}/in"), spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in")


def drained(spark, frame, name, mode="append"):
    q = frame.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(60)
    return spark.table(name)


def test_timeline(spark, source):
    batch, stream = source
    got = drained(spark, live.timeline(stream), "timeline", "complete")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, traffic.timeline(batch, 5).collect()))


def test_flow_gate(spark, source):
    batch, stream = source
    want = classify.scored_samples(batch.select("*", *(F.lit(0).alias(c) for c in ("src_ip", "dst_ip", "src_port", "dst_port", "protocol"))))
    got = drained(spark, live.flow_gate(stream), "gate")
    assert sorted(map(tuple, got.select("flow_id", "packet_id", "packets", "bytes").collect())) == sorted(map(tuple, want.select("flow_id", "packet_id", "packets", "bytes").collect()))


def test_sessions_and_duplicates(spark, source):
    batch, stream = source
    assert drained(spark, live.sessions(stream, "1 hour"), "sessions", "complete").agg(F.sum("packets")).first()[0] == 300
    assert drained(spark, live.deduplicated(stream.union(stream)), "dedup").count() == 300


def test_captures_round_trip_with_filters(spark, tmp_path):
    pcap.register(spark)
    frames = [(10**18 + i, bytearray(build.ipv4_frame("10.0.0.1", f"8.8.8.{i % 4}", 1000 + i, [80, 53][i % 2], [6, 17][i % 2], b"x" * i))) for i in range(50)]
    spark.createDataFrame(frames, "ts_nano long, frame binary").repartition(3).write.format("pcap").mode("append").save(f"{tmp_path}/c")
    back = spark.read.format("pcap").load(f"{tmp_path}/c")
    assert back.count() == 50 and back.filter("dst_port = 53 and ts_nano >= 1000000000000000010").count() == sum(i % 2 for i in range(10, 50))
    for test in ("length >= 60", "dst_port = 53", "ts_nano > 0 and src_port < 20000", "length > 10 and dst_port in (53, 80)", "length > 100000"):
        assert back.filter(test).select("ts_nano").count() == sum(1 for _ in back.select("*", (F.expr(test) & (F.rand() >= 0)).alias("holds")).filter("holds").collect()), test
    reader = pcap.PcapReader(f"{tmp_path}/c", ["ts_nano"])
    assert len(reader.partitions()) == 3
    with pytest.raises(ValueError):
        list(pcap.frames(__import__("io").BytesIO(b"nothing like it, really....").read))
