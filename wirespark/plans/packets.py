"""The packet view of the driver's events table, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wirespark.operators.traffic import flow_id, with_direction

#: Expressions that both engines read alike, by column.
_COLUMNS = {
    "k": "CAST(regexp_extract(props, '([0-9]+)', 1) AS INT)",
    "length": "CAST(floor(value * 10) AS BIGINT) + 64",
    "src_ip": "concat('192.168.1.', CAST(user_id % 254 + 1 AS {text}))",
    "dst_ip": "concat(CASE WHEN {k} % 5 = 4 THEN '10.0.0.' ELSE '203.0.113.' END, CAST({k} % 5 + 1 AS {text}))",
    "src_port": "CAST(40000 + user_id AS INT)",
    "dst_port": "CASE {k} % 5 WHEN 0 THEN 80 WHEN 1 THEN 443 WHEN 2 THEN 53 WHEN 3 THEN 445 ELSE 4444 END",
    "ip_proto": "CASE WHEN event_id % 97 = 0 THEN 1 WHEN {k} % 5 = 2 THEN 17 ELSE 6 END",
}


def _expressions(text: str) -> dict[str, str]:
    return {name: e.format(k=_COLUMNS["k"], text=text) for name, e in _COLUMNS.items()}


def packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """packet_id, ts_nano, k, length, addresses, ports, ip_proto, protocol, direction, flow_id."""
    e = _expressions("STRING")
    raw = spark.read.parquet(f"{sf_dir}/events.parquet").select(
        F.col("event_id").alias("packet_id"), (F.unix_micros(F.col("ts").cast("timestamp")) * 1000).alias("ts_nano"), *(F.expr(x).alias(n) for n, x in e.items())
    )
    raw = raw.withColumn("protocol", F.expr("CASE ip_proto WHEN 1 THEN 'ICMP' WHEN 17 THEN 'UDP' ELSE 'TCP' END"))
    return with_direction(raw).withColumn("flow_id", flow_id())


_LOCAL = "(({c} LIKE '192.168.%') OR ({c} LIKE '10.%') OR ({c} LIKE '127.%'))"
SQL_LOCAL = {c: _LOCAL.format(c=c) for c in ("src_ip", "dst_ip", "ip")}
#: A WITH clause, to be followed by more tables or the query.
SQL_PACKETS = (
    "WITH p0 AS (SELECT event_id AS packet_id, epoch_us(ts) * 1000 AS ts_nano, "
    + ", ".join(f"{x} AS {n}" for n, x in _expressions("VARCHAR").items())
    + " FROM events), packets AS (SELECT *, CASE ip_proto WHEN 1 THEN 'ICMP' WHEN 17 THEN 'UDP' ELSE 'TCP' END AS protocol, "
    f"CASE WHEN {SQL_LOCAL['src_ip']} AND NOT {SQL_LOCAL['dst_ip']} THEN 'outbound' WHEN {SQL_LOCAL['dst_ip']} AND NOT {SQL_LOCAL['src_ip']} THEN 'inbound' ELSE 'unknown' END AS direction, "
    "concat(src_ip, ':', src_port, '-', dst_ip, ':', dst_port, '-', CASE ip_proto WHEN 1 THEN 'ICMP' WHEN 17 THEN 'UDP' ELSE 'TCP' END) AS flow_id FROM p0)"
)
