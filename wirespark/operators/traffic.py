"""Projections and aggregates over packets.

Packets have packet_id, ts_nano, length, src_ip, dst_ip, src_port, dst_port, ip_proto, protocol. Aggregates are plain
groupBy/agg, so Spark combines before the shuffle; nothing here holds a group in one place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wirespark.dims import PORT_APPS, PROTOCOLS, mapped

NANO = 1_000_000_000


def protocol_name(number: Column | str = "ip_proto") -> Column:
    number = F.col(number) if isinstance(number, str) else number
    return mapped(number.cast("int"), PROTOCOLS, F.concat(F.lit("Proto-"), number.cast("string")))


def protocol_group(number: Column | str = "ip_proto") -> Column:
    """TCP, UDP, ICMP (with ICMPv6), all else Other."""
    number = F.col(number) if isinstance(number, str) else number
    return F.when(number == 6, "TCP").when(number == 17, "UDP").when(number.isin(1, 58), "ICMP").otherwise("Other")


def app_protocol(src="src_port", dst="dst_port", proto="ip_proto") -> Column:
    """Tag by either port; a later rule outranks an earlier one, so they are tried from the last."""
    either = lambda p: (F.col(src) == p) | (F.col(dst) == p)
    return F.when(either(443) & (F.col(proto) == 17), "QUIC").when(either(443) & (F.col(proto) == 6), "TLS").when(either(80) & (F.col(proto) == 6), "HTTP").when(either(53), "DNS")


def flow_id() -> Column:
    return F.concat("src_ip", F.lit(":"), F.col("src_port"), F.lit("-"), "dst_ip", F.lit(":"), F.col("dst_port"), F.lit("-"), "protocol")


def stream_key(client_ip="src_ip", client_port="src_port", server_ip="dst_ip", server_port="dst_port") -> Column:
    return F.concat(F.col(client_ip), F.lit(":"), F.col(client_port), F.lit("-"), F.col(server_ip), F.lit(":"), F.col(server_port))


def quic_info(packet_type: Column, version: Column, short: Column) -> Column:
    return F.when(short, "QUIC 1-RTT").otherwise(F.format_string("QUIC Type:%d v%d", packet_type, version))


def ip_to_int(ip: Column | str) -> Column:
    """IPv4 text as a number; null for anything else."""
    ip = F.col(ip) if isinstance(ip, str) else ip
    parts = F.split(ip, r"\.")
    value = sum((F.try_element_at(parts, F.lit(k + 1)).try_cast("long") * 256 ** (3 - k) for k in range(4)), F.lit(0))
    return F.when(F.regexp_like(ip, F.lit(r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$")), value)


def is_local(ip: Column | str, networks: list[tuple[str, int]] = ()) -> Column:
    """Private, loopback, or in one of the networks (address, prefix length); IPv6 by its text prefix."""
    ip = F.col(ip) if isinstance(ip, str) else ip
    n = ip_to_int(ip)
    number = lambda a: sum(int(x) << (24 - 8 * k) for k, x in enumerate(a.split(".")))
    ranges = [("10.0.0.0", 8), ("172.16.0.0", 12), ("192.168.0.0", 16), ("127.0.0.0", 8), *networks]
    inside = [n.between(number(a), number(a) + (1 << (32 - bits)) - 1) for a, bits in ranges]
    v4 = inside[0]
    for more in inside[1:]:
        v4 = v4 | more
    lower = F.lower(ip)
    v6 = (lower == "::1") | lower.startswith("fc") | lower.startswith("fd")
    return F.coalesce(F.when(F.instr(ip, ":") > 0, v6).otherwise(v4), F.lit(False))


def with_direction(packets: DataFrame, networks: list[tuple[str, int]] = ()) -> DataFrame:
    src, dst = is_local("src_ip", networks), is_local("dst_ip", networks)
    return packets.withColumn("direction", F.when(src & ~dst, "outbound").when(dst & ~src, "inbound").otherwise("unknown"))


def endpoints(packets: DataFrame) -> DataFrame:
    """Two rows a packet, (ip, role), from one scan."""
    ends = F.array(F.struct(F.col("src_ip").alias("ip"), F.lit("src").alias("role")), F.struct(F.col("dst_ip").alias("ip"), F.lit("dst").alias("role")))
    return packets.select("packet_id", "ts_nano", "length", F.explode(ends).alias("e")).select("packet_id", "ts_nano", "length", "e.ip", "e.role")


def hosts(packets: DataFrame) -> DataFrame:
    """Per address: times seen, packets sent, bytes each way."""
    sent = F.col("role") == "src"
    return endpoints(packets).groupBy("ip").agg(
        F.min("ts_nano").alias("first_seen"), F.max("ts_nano").alias("last_seen"), F.count_if(sent).alias("packet_count"),
        F.sum(F.when(sent, F.col("length")).otherwise(0)).alias("bytes_out"), F.sum(F.when(~sent, F.col("length")).otherwise(0)).alias("bytes_in"),
    )


def ip_stats(packets: DataFrame) -> DataFrame:
    """Per address, both ends counted: packets, bytes."""
    return endpoints(packets).groupBy("ip").agg(F.count("*").alias("packets"), F.sum("length").alias("bytes"))


def port_stats(packets: DataFrame) -> DataFrame:
    """Well-known destination ports: packets, and the protocol seen first."""
    known = packets.filter((F.col("dst_port") > 0) & (F.col("dst_port") < 1024))
    return known.groupBy(F.col("dst_port").alias("port")).agg(F.count("*").alias("packets"), F.min_by("protocol", "packet_id").alias("protocol"))


def protocol_counts(packets: DataFrame, icmp6: bool = False) -> DataFrame:
    p = F.col("ip_proto")
    icmp = p.isin(1, 58) if icmp6 else p == 1
    return packets.agg(F.count_if(p == 6).alias("tcp"), F.count_if(p == 17).alias("udp"), F.count_if(icmp).alias("icmp"), F.count_if(~(icmp | p.isin(6, 17))).alias("other"))


def protocol_distribution(packets: DataFrame) -> DataFrame:
    return packets.groupBy("protocol").agg(F.count("*").alias("packets"))


def bytes_by_direction(packets: DataFrame) -> DataFrame:
    by = lambda d: F.coalesce(F.sum(F.when(F.col("direction") == d, F.col("length"))), F.lit(0))
    return packets.agg(by("inbound").alias("inbound"), by("outbound").alias("outbound"))


def flows(packets: DataFrame, end: str = "last") -> DataFrame:
    """Directional flows. end: time of the packet that came last ("last"), or the latest time ("max")."""
    when = F.max_by("ts_nano", "packet_id") if end == "last" else F.max("ts_nano")
    return packets.groupBy("flow_id", "src_ip", "dst_ip", "src_port", "dst_port", "ip_proto", "protocol").agg(
        F.count("*").alias("packets"), F.sum("length").alias("bytes"), F.min_by("ts_nano", "packet_id").alias("start_nano"), when.alias("end_nano")
    )


def packet_with_flow(packets: DataFrame) -> DataFrame:
    """Packets beside the totals of their flow. A join on flow_id: flows are pre-aggregated, and AQE splits hot ones."""
    total = packets.groupBy("flow_id").agg(F.count("*").alias("flow_packets"), F.sum("length").alias("flow_bytes"))
    return packets.select("packet_id", "flow_id", "length").join(total, "flow_id")


def flow_stats(flow_table: DataFrame) -> DataFrame:
    return flow_table.agg(F.count("*").alias("total"), F.count("*").alias("active"), F.lit(0).cast("long").alias("completed"))


def capture_stats(packets: DataFrame) -> DataFrame:
    """Packets, bytes, span, and rates over the span."""
    span = (F.max("ts_nano") - F.min("ts_nano")) / F.lit(float(NANO))
    got = packets.agg(F.count("*").alias("packets"), F.sum("length").alias("bytes"), F.min("ts_nano").alias("first_nano"), F.max("ts_nano").alias("last_nano"), span.alias("seconds"))
    return got.withColumn("packets_per_second", F.try_divide(F.col("packets").cast("double"), "seconds")).withColumn("bytes_per_second", F.try_divide(F.col("bytes").cast("double"), "seconds"))


def rates(packets: DataFrame, seconds: int = 1) -> DataFrame:
    """Packets and bytes per tick that has any."""
    tick = F.floor(F.col("ts_nano") / F.lit(NANO * seconds)).cast("long")
    got = packets.groupBy(tick.alias("tick")).agg(F.count("*").alias("n"), F.sum("length").alias("b"))
    return got.select("tick", (F.col("n") / F.lit(float(seconds))).alias("packets_per_second"), (F.col("b") / F.lit(float(seconds))).alias("bytes_per_second"))


def timeline(packets: DataFrame, seconds: int = 5) -> DataFrame:
    """Tumbling buckets: packets, bytes, tcp, udp."""
    bucket = (F.floor(F.col("ts_nano") / F.lit(NANO * seconds)) * seconds).cast("long")
    p = F.col("ip_proto")
    return packets.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("packets"), F.sum("length").alias("bytes"), F.count_if(p == 6).alias("tcp"), F.count_if(p == 17).alias("udp"))


def dashboard(packets: DataFrame) -> DataFrame:
    """One row: totals, distinct flows, addresses and protocols. Distinct counts run in one pass; nothing is cached."""
    total = packets.agg(
        F.count("*").alias("total_packets"), F.sum("length").alias("total_bytes"), F.countDistinct("flow_id").alias("flows"), F.countDistinct("protocol").alias("protocols"),
        F.count_if(F.col("ip_proto") == 6).alias("tcp"), F.count_if(F.col("ip_proto") == 17).alias("udp"), F.count_if(F.col("ip_proto") == 1).alias("icmp"),
    )
    return total


# ---- top k, pages, percentages


def top_talkers(packets: DataFrame, k: int = 10) -> DataFrame:
    return ip_stats(packets).orderBy(F.desc("bytes"), "ip").limit(k)


def top_talkers_with_share(packets: DataFrame, k: int = 5) -> DataFrame:
    """The k top talkers with bytes relative to the first. The window runs over k rows."""
    top = top_talkers(packets, k)
    return top.withColumn("bar", F.col("bytes") / F.max("bytes").over(Window.partitionBy(F.lit(0))))


def top_ports(packets: DataFrame, k: int = 10) -> DataFrame:
    return port_stats(packets).orderBy(F.desc("packets"), "port").limit(k)


def top_protocols(packets: DataFrame, k: int = 8) -> DataFrame:
    """The k most frequent protocols with their share of what is shown. The window runs over k rows."""
    top = protocol_distribution(packets).orderBy(F.desc("packets"), "protocol").limit(k)
    return top.withColumn("percent", F.col("packets") * 100.0 / F.sum("packets").over(Window.partitionBy(F.lit(0))))


def page(rows: DataFrame, offset: int, limit: int, by: str = "packet_id") -> DataFrame:
    return rows.orderBy(by).offset(offset).limit(limit)


def newest(rows: DataFrame, k: int, by: str = "packet_id") -> DataFrame:
    return rows.orderBy(F.desc(by)).limit(k)


# ---- graph


def nodes(packets: DataFrame, networks: list[tuple[str, int]] = ()) -> DataFrame:
    return ip_stats(packets).withColumn("type", F.when(is_local("ip", networks), "internal").otherwise("external"))


def links(packets: DataFrame) -> DataFrame:
    """One for each directional flow."""
    return flows(packets).select(F.col("src_ip").alias("source"), F.col("dst_ip").alias("target"), "flow_id", "protocol", "packets", "bytes")


def degrees(packets: DataFrame) -> DataFrame:
    """Distinct peers of each address."""
    pairs = packets.select(F.explode(F.array(F.struct(F.col("src_ip").alias("ip"), F.col("dst_ip").alias("peer")), F.struct(F.col("dst_ip").alias("ip"), F.col("src_ip").alias("peer")))).alias("p"))
    return pairs.select("p.*").distinct().groupBy("ip").agg(F.count("*").alias("connections"))


def app_of_port(port: str = "dst_port") -> Column:
    return mapped(F.col(port).cast("int"), PORT_APPS)
