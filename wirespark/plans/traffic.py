"""Queries over the packet view: projections, filters, aggregates, top k, graph, windows, classification."""

from __future__ import annotations

from pyspark.sql import functions as F

from wirespark.dims import APP_CATEGORY, BAD_PORTS, PORT_APPS, PROTOCOLS, sql_case
from wirespark.functions import formatting
from wirespark.operators import classify, filters, series, traffic
from wirespark.plans.packets import SQL_LOCAL, SQL_PACKETS, packets
from wirespark.plans.registry import query

P = SQL_PACKETS
R = 6  # decimals to which doubles are compared


def r(column, name=None):
    c = F.round(F.col(column) if isinstance(column, str) else column, R)
    return c.alias(name or column)


IPSTATS = ", e AS (SELECT src_ip AS ip, length, packet_id FROM packets UNION ALL SELECT dst_ip, length, packet_id FROM packets), ipstats AS (SELECT ip, count(*) AS packets, CAST(sum(length) AS BIGINT) AS bytes FROM e GROUP BY ip)"
FLOWS = (
    ", flows AS (SELECT flow_id, src_ip, dst_ip, src_port, dst_port, ip_proto, protocol, count(*) AS packets, CAST(sum(length) AS BIGINT) AS bytes, "
    "arg_min(ts_nano, packet_id) AS start_nano, arg_max(ts_nano, packet_id) AS end_nano FROM packets GROUP BY ALL)"
)


# ---- projections


@query("prj_decode", f"{P} SELECT packet_id, src_ip, dst_ip, src_port, dst_port, ip_proto, length FROM packets")
def _(spark, d):
    return packets(spark, d).select("packet_id", "src_ip", "dst_ip", "src_port", "dst_port", "ip_proto", "length")


@query("prj_protoname", f"{P} SELECT packet_id, {sql_case('CAST(packet_id % 60 AS INT)', PROTOCOLS, other=chr(39) + 'Proto-' + chr(39) + ' || (packet_id % 60)')} AS name FROM packets")
def _(spark, d):
    return packets(spark, d).select("packet_id", traffic.protocol_name((F.col("packet_id") % 60).cast("int")).alias("name"))


@query("prj_protoname2", f"{P} SELECT packet_id, CASE WHEN packet_id % 60 = 6 THEN 'TCP' WHEN packet_id % 60 = 17 THEN 'UDP' WHEN packet_id % 60 IN (1, 58) THEN 'ICMP' ELSE 'Other' END AS name FROM packets")
def _(spark, d):
    return packets(spark, d).select("packet_id", traffic.protocol_group(F.col("packet_id") % 60).alias("name"))


@query("prj_appproto", f"""{P} SELECT packet_id, CASE WHEN 443 IN (src_port, dst_port) AND ip_proto = 17 THEN 'QUIC' WHEN 443 IN (src_port, dst_port) AND ip_proto = 6 THEN 'TLS'
    WHEN 80 IN (src_port, dst_port) AND ip_proto = 6 THEN 'HTTP' WHEN 53 IN (src_port, dst_port) THEN 'DNS' END AS app FROM packets""")
def _(spark, d):
    return packets(spark, d).select("packet_id", traffic.app_protocol().alias("app"))


@query("prj_quicinfo", f"{P} SELECT packet_id, CASE WHEN k % 3 = 0 THEN 'QUIC 1-RTT' ELSE 'QUIC Type:' || (k % 4) || ' v' || k END AS info FROM packets")
def _(spark, d):
    k = F.col("k")
    return packets(spark, d).select("packet_id", traffic.quic_info(k % 4, k, k % 3 == 0).alias("info"))


@query("prj_flowid", f"{P} SELECT packet_id, flow_id FROM packets")
def _(spark, d):
    return packets(spark, d).select("packet_id", "flow_id")


@query("prj_streamkey", f"{P} SELECT packet_id, concat(src_ip, ':', src_port, '-', dst_ip, ':', dst_port) AS stream FROM packets")
def _(spark, d):
    return packets(spark, d).select("packet_id", traffic.stream_key().alias("stream"))


@query("prj_direction", f"{P} SELECT packet_id, direction FROM packets")
def _(spark, d):
    return packets(spark, d).select("packet_id", "direction")


@query("prd_local", f"{P}, ips AS (SELECT src_ip AS ip FROM packets UNION SELECT dst_ip FROM packets) SELECT ip, {SQL_LOCAL['ip']} AS local FROM ips")
def _(spark, d):
    return traffic.endpoints(packets(spark, d)).select("ip").distinct().select("ip", traffic.is_local("ip").alias("local"))


@query("prj_packetdto", f"{P} SELECT packet_id AS id, ts_nano, src_ip, dst_ip, protocol, length, direction FROM packets")
def _(spark, d):
    return packets(spark, d).select(F.col("packet_id").alias("id"), "ts_nano", "src_ip", "dst_ip", "protocol", "length", "direction")


@query("prj_flowdto", f"{P}{FLOWS} SELECT flow_id AS id, src_ip, dst_ip, protocol, packets, bytes, {sql_case('dst_port', PORT_APPS)} AS app FROM flows")
def _(spark, d):
    return traffic.flows(packets(spark, d)).select(F.col("flow_id").alias("id"), "src_ip", "dst_ip", "protocol", "packets", "bytes", traffic.app_of_port().alias("app"))


# ---- filters

_BPF = {
    "flt_bpf_tcp": ("tcp", "ip_proto = 6"), "flt_bpf_udp": ("udp", "ip_proto = 17"), "flt_bpf_icmp": ("icmp", "ip_proto = 1"),
    "flt_bpf_port": ("port 53", "53 IN (src_port, dst_port)"), "flt_bpf_host": ("host 203.0.113.2", "'203.0.113.2' IN (src_ip, dst_ip)"),
    "flt_bpf_pcap": ("tcp and (port 80 or dst port 443) and not host 192.168.1.9", "ip_proto = 6 AND (80 IN (src_port, dst_port) OR dst_port = 443) AND NOT ('192.168.1.9' IN (src_ip, dst_ip))"),
}
for _name, (_expression, _sql) in _BPF.items():
    query(_name, f"{P} SELECT packet_id, src_ip, dst_ip FROM packets WHERE {_sql}")(lambda spark, d, e=_expression: packets(spark, d).filter(filters.bpf(e)).select("packet_id", "src_ip", "dst_ip"))


@query("flt_5tuple", f"{P} SELECT packet_id FROM packets WHERE dst_ip = '203.0.113.1' AND dst_port = 80 AND ip_proto = 6")
def _(spark, d):
    return packets(spark, d).filter(filters.five_tuple(dst_ip="203.0.113.1", dst_port=80, protocol=6)).select("packet_id")


@query("flt_ui_packets", f"""{P} SELECT packet_id FROM packets WHERE (contains(src_ip, 'udp') OR contains(dst_ip, 'udp') OR contains(lower(protocol), 'udp')) AND protocol IN ('UDP', 'TCP')
    AND contains(dst_ip, '203') AND 53 IN (src_port, dst_port) AND ts_nano >= 1704067200000000000 AND ts_nano <= 1893456000000000000""")
def _(spark, d):
    return filters.ui_packets(packets(spark, d), search="UDP", protocols=("UDP", "TCP"), dst_ip="203", port=53, since=1704067200000000000, until=1893456000000000000).select("packet_id")


@query("flt_ui_flows", f"{P}{FLOWS} SELECT flow_id, bytes FROM flows WHERE (contains(src_ip, '192.168.1.1') OR contains(dst_ip, '192.168.1.1')) AND protocol = 'TCP' AND bytes BETWEEN 2000 AND 20000")
def _(spark, d):
    return filters.ui_flows(traffic.flows(packets(spark, d)), search="192.168.1.1", protocols=("TCP",), least_bytes=2000, most_bytes=20000).select("flow_id", "bytes")


THREATS = f"""{P}{FLOWS}, threats AS (SELECT *, dst_port = 445 OR (dst_port = 53 AND bytes > 10000) OR {sql_case('dst_port', BAD_PORTS)} IS NOT NULL AS is_threat,
    CASE WHEN dst_port = 445 THEN 'lateral_movement' WHEN dst_port = 53 AND bytes > 10000 THEN 'exfiltration' WHEN {sql_case('dst_port', BAD_PORTS)} IS NOT NULL THEN 'suspicious_port' ELSE '' END AS threat_type,
    CASE WHEN dst_port = 445 OR (dst_port = 53 AND bytes > 10000) THEN 'high' WHEN {sql_case('dst_port', BAD_PORTS)} IS NOT NULL THEN 'medium' ELSE '' END AS severity,
    CASE WHEN dst_port = 445 OR (dst_port = 53 AND bytes > 10000) THEN 0.7::DOUBLE WHEN {sql_case('dst_port', BAD_PORTS)} IS NOT NULL THEN 0.6::DOUBLE ELSE 0.0::DOUBLE END AS confidence,
    array_to_string(list_filter([CASE WHEN {sql_case('dst_port', BAD_PORTS)} IS NOT NULL THEN concat('port_', dst_port, '_', {sql_case('dst_port', BAD_PORTS)}) END,
        CASE WHEN dst_port = 53 AND bytes > 10000 THEN 'dns_tunneling' END, CASE WHEN dst_port = 445 THEN 'admin_share_access' END], lambda x: x IS NOT NULL), ',') AS indicators FROM flows)"""


@query("cls_threat", f"{THREATS} SELECT flow_id, is_threat, threat_type, severity, confidence, indicators FROM threats")
def _(spark, d):
    return classify.threats(traffic.flows(packets(spark, d))).select("flow_id", "is_threat", "threat_type", "severity", "confidence", F.array_join("indicators", ",").alias("indicators"))


@query("cls_alerts_gui", f"{THREATS} SELECT concat('threat-', flow_id) AS alert_id, 'critical' AS severity, severity AS rule_severity, threat_type AS title, confidence AS score FROM threats WHERE is_threat")
def _(spark, d):
    return classify.alerts_of(classify.threats(traffic.flows(packets(spark, d)))).select("alert_id", "severity", "rule_severity", "title", "score")


@query("flt_ui_alerts", f"{THREATS} SELECT concat('threat-', flow_id) AS alert_id FROM threats WHERE is_threat AND contains(threat_type, 'lateral')")
def _(spark, d):
    alerts = classify.alerts_of(classify.threats(traffic.flows(packets(spark, d))))
    return filters.ui_alerts(alerts, search="Lateral", severities=("critical", "high")).select("alert_id")


@query("flt_severity_store", f"{THREATS} SELECT flow_id FROM threats WHERE severity = 'medium'")
def _(spark, d):
    return classify.threats(traffic.flows(packets(spark, d))).filter("severity = 'medium'").select("flow_id")


@query("flt_ui_search2", f"{P} SELECT packet_id FROM packets WHERE contains(src_ip, '1.77') OR contains(dst_ip, '1.77') OR contains(lower(protocol), '1.77')")
def _(spark, d):
    return filters.ui_second_search(packets(spark, d), "1.77").select("packet_id")


@query("flt_flow_ml", f"{P}, r AS (SELECT packet_id, flow_id, count(*) OVER (PARTITION BY flow_id ORDER BY packet_id) AS packets FROM packets) SELECT packet_id, flow_id, packets FROM r WHERE packets > 10")
def _(spark, d):
    return classify.scored_samples(packets(spark, d)).select("packet_id", "flow_id", "packets")


@query("flt_category", f"{P}{FLOWS} SELECT flow_id, {sql_case(sql_case('dst_port', PORT_APPS), APP_CATEGORY, chr(39) + 'unknown' + chr(39))} AS category FROM flows WHERE {sql_case(sql_case('dst_port', PORT_APPS), APP_CATEGORY, chr(39) + 'unknown' + chr(39))} IN ('web', 'unknown')")
def _(spark, d):
    f = traffic.flows(packets(spark, d)).withColumn("category", classify.category_of(traffic.app_of_port()))
    return f.filter(F.col("category").isin("web", "unknown")).select("flow_id", "category")


# ---- joins by small tables


@query("jn_port_app", f"{P}{FLOWS} SELECT flow_id, {sql_case('dst_port', PORT_APPS)} AS application, CASE WHEN {sql_case('dst_port', PORT_APPS)} IS NOT NULL THEN 0.7::DOUBLE END AS confidence FROM flows")
def _(spark, d):
    return traffic.flows(packets(spark, d)).withColumn("c", classify.by_port()).select("flow_id", "c.application", "c.confidence")


@query("jn_app_cat", f"{P}{FLOWS} SELECT flow_id, {sql_case(sql_case('dst_port', PORT_APPS), APP_CATEGORY, chr(39) + 'unknown' + chr(39))} AS category FROM flows")
def _(spark, d):
    return traffic.flows(packets(spark, d)).select("flow_id", classify.category_of(traffic.app_of_port()).alias("category"))


@query("jn_badport", f"{P}{FLOWS} SELECT flow_id, {sql_case('dst_port', BAD_PORTS)} AS label FROM flows WHERE {sql_case('dst_port', BAD_PORTS)} IS NOT NULL")
def _(spark, d):
    from wirespark.dims import mapped

    return traffic.flows(packets(spark, d)).select("flow_id", mapped(F.col("dst_port").cast("int"), BAD_PORTS).alias("label")).filter("label is not null")


@query("jn_packet_flow", f"{P}, t AS (SELECT flow_id, count(*) AS flow_packets, CAST(sum(length) AS BIGINT) AS flow_bytes FROM packets GROUP BY flow_id) SELECT packet_id, flow_id, length, flow_packets, flow_bytes FROM packets JOIN t USING (flow_id)")
def _(spark, d):
    return traffic.packet_with_flow(packets(spark, d)).select("packet_id", "flow_id", "length", "flow_packets", "flow_bytes")


@query("jn_topology", f"{P}{IPSTATS}{FLOWS} SELECT f.src_ip AS source, f.dst_ip AS target, a.bytes AS source_bytes, b.bytes AS target_bytes, f.bytes FROM flows f JOIN ipstats a ON a.ip = f.src_ip JOIN ipstats b ON b.ip = f.dst_ip")
def _(spark, d):
    p = packets(spark, d)
    n = traffic.ip_stats(p)
    a, b = n.select(F.col("ip").alias("source"), F.col("bytes").alias("source_bytes")), n.select(F.col("ip").alias("target"), F.col("bytes").alias("target_bytes"))
    return traffic.links(p).select("source", "target", "bytes").join(a, "source").join(b, "target")


@query("jn_ioc", f"{P} SELECT packet_id, dst_ip FROM packets WHERE dst_ip IN (SELECT DISTINCT dst_ip FROM packets WHERE dst_port = 4444)")
def _(spark, d):
    p = packets(spark, d)
    return p.join(p.filter("dst_port = 4444").select("dst_ip").distinct(), "dst_ip", "left_semi").select("packet_id", "dst_ip")


# ---- aggregates


@query("agg_hosts", f"""{P}, e AS (SELECT src_ip AS ip, 1 AS s, ts_nano, length FROM packets UNION ALL SELECT dst_ip, 0, ts_nano, length FROM packets)
    SELECT ip, min(ts_nano) AS first_seen, max(ts_nano) AS last_seen, CAST(sum(s) AS BIGINT) AS packet_count, CAST(sum(s * length) AS BIGINT) AS bytes_out, CAST(sum((1 - s) * length) AS BIGINT) AS bytes_in FROM e GROUP BY ip""")
def _(spark, d):
    return traffic.hosts(packets(spark, d))


@query("agg_ipstats", f"{P}{IPSTATS} SELECT ip, packets, bytes FROM ipstats")
def _(spark, d):
    return traffic.ip_stats(packets(spark, d))


PORTS = ", ports AS (SELECT dst_port AS port, count(*) AS packets, arg_min(protocol, packet_id) AS protocol FROM packets WHERE dst_port > 0 AND dst_port < 1024 GROUP BY dst_port)"


@query("agg_ports", f"{P}{PORTS} SELECT port, packets, protocol FROM ports")
def _(spark, d):
    return traffic.port_stats(packets(spark, d))


_COUNTS = "count(*) FILTER (ip_proto = 6) AS tcp, count(*) FILTER (ip_proto = 17) AS udp, count(*) FILTER ({icmp}) AS icmp, count(*) FILTER (NOT ({icmp} OR ip_proto IN (6, 17))) AS other"


@query("agg_proto_counts", f"{P} SELECT {_COUNTS.format(icmp='ip_proto = 1')} FROM packets")
def _(spark, d):
    return traffic.protocol_counts(packets(spark, d))


@query("agg_proto_counts2", f"{P} SELECT {_COUNTS.format(icmp='ip_proto IN (1, 58)')} FROM packets")
def _(spark, d):
    return traffic.protocol_counts(packets(spark, d), icmp6=True)


@query("agg_proto_dist", f"{P} SELECT protocol, count(*) AS packets FROM packets GROUP BY protocol")
def _(spark, d):
    return traffic.protocol_distribution(packets(spark, d))


@query("agg_bytes_dir", f"{P} SELECT CAST(coalesce(sum(length) FILTER (direction = 'inbound'), 0) AS BIGINT) AS inbound, CAST(coalesce(sum(length) FILTER (direction = 'outbound'), 0) AS BIGINT) AS outbound FROM packets")
def _(spark, d):
    return traffic.bytes_by_direction(packets(spark, d))


@query("agg_flows", f"{P}{FLOWS} SELECT * FROM flows")
def _(spark, d):
    return traffic.flows(packets(spark, d))


@query("agg_stats", f"""{P} SELECT count(*) AS total_packets, CAST(sum(length) AS BIGINT) AS total_bytes, count(DISTINCT flow_id) AS flows, count(DISTINCT protocol) AS protocols,
    count(*) FILTER (ip_proto = 6) AS tcp, count(*) FILTER (ip_proto = 17) AS udp, count(*) FILTER (ip_proto = 1) AS icmp FROM packets""")
def _(spark, d):
    return traffic.dashboard(packets(spark, d))


@query("agg_flowstats", f"{P}{FLOWS} SELECT count(*) AS total, count(*) AS active, 0::BIGINT AS completed FROM flows")
def _(spark, d):
    return traffic.flow_stats(traffic.flows(packets(spark, d)))


@query("agg_rates", f"{P} SELECT CAST(floor(ts_nano / 1000000000::DOUBLE) AS BIGINT) AS tick, CAST(count(*) AS DOUBLE) AS packets_per_second, CAST(sum(length) AS DOUBLE) AS bytes_per_second FROM packets GROUP BY 1")
def _(spark, d):
    return traffic.rates(packets(spark, d))


@query("src_stats", f"""{P}, s AS (SELECT count(*) AS packets, CAST(sum(length) AS BIGINT) AS bytes, (max(ts_nano) - min(ts_nano)) / 1e9 AS seconds FROM packets)
    SELECT packets, bytes, round(seconds, 6) AS seconds, round(packets / seconds, 6) AS packets_per_second, round(bytes / seconds, 6) AS bytes_per_second FROM s""")
def _(spark, d):
    return traffic.capture_stats(packets(spark, d)).select("packets", "bytes", r("seconds"), r("packets_per_second"), r("bytes_per_second"))


@query("agg_counter", f"{P} SELECT protocol, direction, count(*) AS packets_total, CAST(sum(length) AS BIGINT) AS bytes_total FROM packets GROUP BY ALL")
def _(spark, d):
    return packets(spark, d).groupBy("protocol", "direction").agg(F.count("*").alias("packets_total"), F.sum("length").alias("bytes_total"))


@query("agg_gauge", f"{P} SELECT protocol, arg_max(length, packet_id) AS value FROM packets GROUP BY protocol")
def _(spark, d):
    return packets(spark, d).groupBy("protocol").agg(F.max_by("length", "packet_id").alias("value"))


_LE = [100.0, 250.0, 500.0, 1000.0, 2500.0]


@query("agg_histogram", f"""{P}, b AS (SELECT unnest([{', '.join(map(str, _LE))}]) AS le) SELECT protocol, CAST(b.le AS VARCHAR) AS le, count(*) FILTER (length <= b.le) AS count, CAST(sum(length) AS BIGINT) AS sum, count(*) AS total FROM packets, b GROUP BY protocol, b.le
    UNION ALL SELECT protocol, '+Inf', count(*), CAST(sum(length) AS BIGINT), count(*) FROM packets GROUP BY protocol""")
def _(spark, d):
    return series.histogram(packets(spark, d), "length", _LE, ["protocol"])


@query("agg_percentile", f"{P} SELECT protocol, round(quantile_cont(CAST(length AS DOUBLE), 0.5), 6) AS p50, round(quantile_cont(CAST(length AS DOUBLE), 0.95), 6) AS p95, round(quantile_cont(CAST(length AS DOUBLE), 0.99), 6) AS p99 FROM packets GROUP BY protocol")
def _(spark, d):
    return series.percentiles(packets(spark, d), "length", [0.5, 0.95, 0.99], ["protocol"]).select("protocol", r("p50"), r("p95"), r("p99"))


@query("agg_float_stats", f"{P} SELECT protocol, min(length)::DOUBLE AS least, max(length)::DOUBLE AS most, round(avg(length), 6) AS mean, round(stddev_pop(length), 6) AS std FROM packets GROUP BY protocol")
def _(spark, d):
    n = F.col("length").cast("double")
    return packets(spark, d).groupBy("protocol").agg(F.min(n).alias("least"), F.max(n).alias("most"), r(F.avg(n), "mean"), r(F.stddev_pop(n), "std"))


@query("agg_feature_stats", f"""{P} SELECT 'length' AS feature, count(length) AS n, round(avg(length), 6) AS mean, round(var_samp(length), 4) AS variance, round(stddev_samp(length), 6) AS std, min(length) AS least, max(length) AS most FROM packets
    UNION ALL SELECT 'k', count(k), round(avg(k), 6), round(var_samp(k), 4), round(stddev_samp(k), 6), min(k), max(k) FROM packets""")
def _(spark, d):
    p = packets(spark, d).select(F.col("length"), F.col("k").cast("long").alias("k"))
    return series.feature_stats(p, ["length", "k"]).select("feature", "n", r("mean"), F.round("variance", 4).alias("variance"), r("std"), "least", "most")


@query("agg_norm_fit", f"{P} SELECT round(avg(length), 6) AS mean, round(stddev_pop(length), 6) AS std, min(length)::DOUBLE AS least, max(length)::DOUBLE AS most FROM packets")
def _(spark, d):
    x = F.col("length").cast("double")
    return packets(spark, d).agg(r(F.avg(x), "mean"), r(F.stddev_pop(x), "std"), F.min(x).alias("least"), F.max(x).alias("most"))


@query("agg_var_select", f"""{P}, v AS (SELECT 'length' AS feature, var_pop(length) AS variance FROM packets UNION ALL SELECT 'k', var_pop(k) FROM packets UNION ALL SELECT 'dst_port', var_pop(dst_port) FROM packets UNION ALL SELECT 'ip_proto', var_pop(ip_proto) FROM packets),
    s AS (SELECT *, row_number() OVER (ORDER BY variance DESC, feature) AS rank FROM v) SELECT feature, round(variance, 2) AS variance, CAST(rank AS INTEGER) AS rank, variance > 100 AND rank <= 3 AS selected FROM s""")
def _(spark, d):
    return series.variance_ranking(packets(spark, d), ["length", "k", "dst_port", "ip_proto"], 100.0, 3).select("feature", F.round("variance", 2).alias("variance"), "rank", "selected")


@query("agg_proto_pct", f"{P}, t AS (SELECT protocol, count(*) AS packets FROM packets GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 8) SELECT protocol, packets, round(packets * 100.0::DOUBLE / sum(packets) OVER (), 6) AS percent FROM t")
def _(spark, d):
    return traffic.top_protocols(packets(spark, d)).select("protocol", "packets", r("percent"))


@query("agg_droprate", f"{P} SELECT protocol, round(count(*) FILTER (k = 0) * 100.0::DOUBLE / count(*), 2) AS rate FROM packets GROUP BY protocol")
def _(spark, d):
    return packets(spark, d).groupBy("protocol").agg(formatting.drop_rate(F.count_if(F.col("k") == 0), F.count("*")).alias("rate"))


@query("agg_cache_rate", f"{P} SELECT user, round(hits * 100.0::DOUBLE / n, 6) AS rate FROM (SELECT src_ip AS user, count(*) FILTER (k >= 50) AS hits, count(*) AS n FROM packets GROUP BY 1)")
def _(spark, d):
    return packets(spark, d).groupBy(F.col("src_ip").alias("user")).agg(r(F.try_divide(F.count_if(F.col("k") >= 50) * 100.0, F.count("*").cast("double")), "rate"))


@query("agg_pipeline_stats", f"{THREATS} SELECT count(*) AS flows, count(*) FILTER (is_threat) AS threats FROM threats")
def _(spark, d):
    return classify.threats(traffic.flows(packets(spark, d))).agg(F.count("*").alias("flows"), F.count_if("is_threat").alias("threats"))


@query("agg_latency", f"""{P}, s AS (SELECT protocol, list_sort(list(length)) AS v FROM packets GROUP BY 1) SELECT protocol, v[1] AS least, v[-1] AS most,
    v[least(CAST(floor(len(v) * 0.5) AS BIGINT) + 1, len(v))] AS p50, v[least(CAST(floor(len(v) * 0.99) AS BIGINT) + 1, len(v))] AS p99 FROM s""")
def _(spark, d):
    p = packets(spark, d)
    n = F.count("*").over
    from pyspark.sql import Window

    w = Window.partitionBy("protocol")
    ranked = p.select("protocol", "length", F.row_number().over(w.orderBy("length")).alias("i"), n(w).alias("n"))
    at = lambda q: F.max(F.when(F.col("i") == F.least(F.floor(F.col("n") * q) + 1, F.col("n")), F.col("length")))
    return ranked.groupBy("protocol").agg(F.min("length").alias("least"), F.max("length").alias("most"), at(0.5).alias("p50"), at(0.99).alias("p99"))


# ---- top k, pages, retention


@query("top_talkers", f"{P}{IPSTATS} SELECT ip, packets, bytes FROM ipstats ORDER BY bytes DESC, ip LIMIT 10")
def _(spark, d):
    return traffic.top_talkers(packets(spark, d), 10)


@query("top_talkers5", f"{P}{IPSTATS}, t AS (SELECT * FROM ipstats ORDER BY bytes DESC, ip LIMIT 5) SELECT ip, packets, bytes, round(bytes / CAST(max(bytes) OVER () AS DOUBLE), 6) AS bar FROM t")
def _(spark, d):
    return traffic.top_talkers_with_share(packets(spark, d), 5).select("ip", "packets", "bytes", r("bar"))


@query("top_ports", f"{P}{PORTS} SELECT port, packets, protocol FROM ports ORDER BY packets DESC, port LIMIT 10")
def _(spark, d):
    return traffic.top_ports(packets(spark, d), 10)


@query("top_protocols", f"{P} SELECT protocol, count(*) AS packets FROM packets GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 8")
def _(spark, d):
    return traffic.top_protocols(packets(spark, d)).select("protocol", "packets")


@query("top_recent_alerts", f"{THREATS} SELECT flow_id, end_nano FROM threats WHERE is_threat ORDER BY end_nano DESC, flow_id LIMIT 5")
def _(spark, d):
    t = classify.threats(traffic.flows(packets(spark, d))).filter("is_threat")
    return t.orderBy(F.desc("end_nano"), "flow_id").limit(5).select("flow_id", "end_nano")


@query("pg_packets", f"{P} SELECT packet_id, length FROM packets ORDER BY packet_id LIMIT 50 OFFSET 200")
def _(spark, d):
    return traffic.page(packets(spark, d), 200, 50).select("packet_id", "length")


@query("pg_ui_caps", f"{P}{FLOWS} SELECT flow_id, bytes FROM flows ORDER BY flow_id LIMIT 500")
def _(spark, d):
    return traffic.page(traffic.flows(packets(spark, d)), 0, 500, "flow_id").select("flow_id", "bytes")


@query("lim_ring", f"{P} SELECT packet_id FROM packets ORDER BY packet_id DESC LIMIT 100000")
def _(spark, d):
    return traffic.newest(packets(spark, d), 100_000).select("packet_id")


@query("win_topk_alert", f"{THREATS} SELECT flow_id FROM threats WHERE is_threat ORDER BY end_nano DESC, flow_id LIMIT 100")
def _(spark, d):
    return classify.threats(traffic.flows(packets(spark, d))).filter("is_threat").orderBy(F.desc("end_nano"), "flow_id").limit(100).select("flow_id")


@query("snk_emit_throttled", "WITH e AS (SELECT event_type, event_id, CAST(floor(epoch_us(ts) / 3600000000.0::DOUBLE) AS BIGINT) AS tick FROM events) SELECT event_type, tick, min(event_id) AS packet_id, count(*) AS of FROM e GROUP BY ALL")
def _(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet").select("event_type", F.col("event_id").alias("packet_id"), (F.unix_micros(F.col("ts").cast("timestamp")) * 1000).alias("ts_nano"))
    return filters.throttle(e, 3600 * 10**9)


# ---- graph


@query("gr_nodes", f"{P}{IPSTATS} SELECT ip, packets, bytes, CASE WHEN {SQL_LOCAL['ip']} THEN 'internal' ELSE 'external' END AS type FROM ipstats")
def _(spark, d):
    return traffic.nodes(packets(spark, d))


@query("gr_nodes_alt", f"{P}{IPSTATS}, t AS (SELECT * FROM ipstats ORDER BY bytes DESC, ip LIMIT 20) SELECT ip, packets, bytes FROM t")
def _(spark, d):
    return traffic.top_talkers(packets(spark, d), 20)


@query("gr_links", f"{P}{FLOWS} SELECT src_ip AS source, dst_ip AS target, flow_id, protocol, packets, bytes FROM flows")
def _(spark, d):
    return traffic.links(packets(spark, d))


@query("gr_degree", f"{P}, e AS (SELECT src_ip AS ip, dst_ip AS peer FROM packets UNION SELECT dst_ip, src_ip FROM packets) SELECT ip, count(*) AS connections FROM e GROUP BY ip")
def _(spark, d):
    return traffic.degrees(packets(spark, d))


# ---- windows


@query("win_running_flow", f"{P} SELECT packet_id, flow_id, count(*) OVER w AS packets, CAST(sum(length) OVER w AS BIGINT) AS bytes, first(ts_nano) OVER w AS start_nano FROM packets WINDOW w AS (PARTITION BY flow_id ORDER BY packet_id)")
def _(spark, d):
    return classify.running_flow(packets(spark, d)).select("packet_id", "flow_id", "packets", "bytes", "start_nano")


_Z = """, z AS (SELECT packet_id, protocol, length, k, count(*) OVER w AS n, stddev_samp(length) OVER w AS sl, avg(length) OVER w AS al, stddev_samp(k) OVER w AS sk, avg(k) OVER w AS ak FROM packets WINDOW w AS ({part} ORDER BY packet_id)),
    s AS (SELECT *, CASE WHEN coalesce(sl, 0) > 1e-9 THEN (length - al) / sl ELSE 0 END AS zl, CASE WHEN coalesce(sk, 0) > 1e-9 THEN (k - ak) / sk ELSE 0 END AS zk FROM z),
    f AS (SELECT *, sqrt((zl * zl + zk * zk) / 2) AS score FROM s)"""


@query("win_zscore", f"{P}{_Z.format(part='PARTITION BY protocol')} SELECT packet_id, n, round(score, 5) AS score FROM f")
def _(spark, d):
    return series.zscores(packets(spark, d), ["length", "k"], ["packet_id"], ["protocol"]).select("packet_id", "n", F.round("score", 5).alias("score"))


@query("win_zscore_global", f"{P}{_Z.format(part='')} SELECT packet_id, n >= 100 AND score > 3 AS is_anomaly FROM f")
def _(spark, d):
    return series.zscores(packets(spark, d), ["length", "k"], ["packet_id"]).select("packet_id", "is_anomaly")


@query("win_zrank", f"{P}{_Z.format(part='PARTITION BY protocol')} SELECT packet_id, CASE WHEN abs(zk) > abs(zl) OR (abs(zk) = abs(zl)) THEN 'k' ELSE 'length' END AS first FROM f")
def _(spark, d):
    z = series.zscores(packets(spark, d), ["length", "k"], ["packet_id"], ["protocol"])
    return z.select("packet_id", series.contributions(z, ["length", "k"])[0]["feature"].alias("first"))


@query("win_iqr", f"""{P}, q AS (SELECT packet_id, length, quantile_cont(CAST(length AS DOUBLE), 0.25) OVER w AS a, quantile_cont(CAST(length AS DOUBLE), 0.75) OVER w AS b FROM packets WINDOW w AS (PARTITION BY src_ip ORDER BY packet_id ROWS 999 PRECEDING))
    SELECT packet_id, CASE WHEN length < a - 1.5 * (b - a) OR length > b + 1.5 * (b - a) THEN 1 ELSE 0 END AS outliers FROM q""")
def _(spark, d):
    return series.quartile_fence(packets(spark, d), ["length"], ["packet_id"], ["src_ip"]).select("packet_id", "outliers")


@query("win_mad", f"""{P}, m AS (SELECT packet_id, length, list(CAST(length AS DOUBLE)) OVER w AS v, median(CAST(length AS DOUBLE)) OVER w AS m FROM packets WINDOW w AS (PARTITION BY src_ip ORDER BY packet_id ROWS 999 PRECEDING)),
    x AS (SELECT *, list_median(list_transform(v, lambda x: abs(x - m))) AS d FROM m) SELECT packet_id, round(abs(CASE WHEN d > 0 THEN 0.6745::DOUBLE * (length - m) / d ELSE 0 END) + 1e-9::DOUBLE, 5) AS score FROM x""")
def _(spark, d):
    return series.median_deviation(packets(spark, d), ["length"], ["packet_id"], ["src_ip"]).select("packet_id", F.round(F.col("score") + 1e-9, 5).alias("score"))


@query("win_iat", f"{P} SELECT packet_id, ts_nano - lag(ts_nano) OVER (PARTITION BY flow_id ORDER BY packet_id) AS iat_nano FROM packets")
def _(spark, d):
    return series.inter_arrival(packets(spark, d)).select("packet_id", "iat_nano")


@query("win_ema", f"""{P}, l AS (SELECT src_ip, list(CAST(length AS DOUBLE) ORDER BY packet_id) AS v FROM packets GROUP BY 1) SELECT src_ip, round(list_reduce(v, lambda a, x: a + 0.1::DOUBLE * (x - a)), 6) AS ema FROM l""")
def _(spark, d):
    return series.last_average(packets(spark, d), "length", ["packet_id"], ["src_ip"]).select("src_ip", r("ema"))


@query("win_ewma")
def _(spark, d):
    return series.moving_average(packets(spark, d).select("src_ip", "packet_id", "length"), "length", ["packet_id"], ["src_ip"]).select("packet_id", r("ema"), r("em_var"), "is_anomaly")


@query("win_seasonal", f"""{P}, s AS (SELECT *, row_number() OVER (PARTITION BY src_ip ORDER BY packet_id) AS n, count(length) OVER a AS c, sum(length) OVER a AS t FROM packets WINDOW a AS (PARTITION BY src_ip ORDER BY packet_id ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)),
    d AS (SELECT packet_id, src_ip, length, (n - 1) % 7 AS phase, CASE WHEN c = 7 THEN t / 7.0::DOUBLE END AS trend FROM s), e AS (SELECT *, avg(length - trend) OVER (PARTITION BY src_ip, phase) AS season FROM d)
    SELECT packet_id, round(trend, 5) AS trend, round(season, 5) AS season, round(length - trend - season, 5) AS residual FROM e""")
def _(spark, d):
    s = series.seasonal(packets(spark, d).withColumn("length", F.col("length").cast("double")), "length", "packet_id", 7, ["src_ip"])
    return s.select("packet_id", *(F.round(c, 5).alias(c) for c in ("trend", "season", "residual")))


@query("agg_window_features", f"""{P}, b AS (SELECT min(ts_nano) AS lo, max(ts_nano) AS hi FROM packets), w AS (SELECT unnest(range(lo, hi, 43200000000000)) AS window_start FROM b)
    SELECT window_start, count(*) AS packets, CAST(sum(length) AS BIGINT) AS bytes, min(length)::DOUBLE AS min_len, max(length)::DOUBLE AS max_len, round(avg(length), 6) AS mean_len, round(stddev_pop(length), 6) AS std_len,
    count(*) FILTER (protocol = 'TCP') AS tcp, count(*) FILTER (protocol = 'UDP') AS udp FROM packets JOIN w ON ts_nano >= window_start AND ts_nano < window_start + 86400000000000 GROUP BY window_start""")
def _(spark, d):
    w = series.window_features(series.sliding_windows(packets(spark, d), 86400 * 10**9, 43200 * 10**9))
    return w.select("window_start", "packets", "bytes", "min_len", "max_len", r("mean_len"), r("std_len"), "tcp", "udp")


@query("st_sliding", f"""{P}, b AS (SELECT min(ts_nano) AS lo, max(ts_nano) AS hi FROM packets), w AS (SELECT unnest(range(lo, hi, 3600000000000)) AS window_start FROM b)
    SELECT window_start, count(*) AS packets FROM packets JOIN w ON ts_nano >= window_start AND ts_nano < window_start + 7200000000000 GROUP BY 1""")
def _(spark, d):
    return series.sliding_windows(packets(spark, d), 7200 * 10**9, 3600 * 10**9).groupBy("window_start").agg(F.count("*").alias("packets"))


@query("st_tumbling", f"{P} SELECT CAST(floor(ts_nano / 5e9) AS BIGINT) * 5 AS bucket, count(*) AS packets, CAST(sum(length) AS BIGINT) AS bytes, count(*) FILTER (ip_proto = 6) AS tcp, count(*) FILTER (ip_proto = 17) AS udp FROM packets GROUP BY 1")
def _(spark, d):
    return traffic.timeline(packets(spark, d), 5)


@query("st_session", f"""{P}, g AS (SELECT *, CASE WHEN coalesce(ts_nano - lag(ts_nano) OVER (PARTITION BY flow_id ORDER BY ts_nano, packet_id) > 3600000000000, TRUE) THEN 1 ELSE 0 END AS new FROM packets),
    s AS (SELECT *, sum(new) OVER (PARTITION BY flow_id ORDER BY ts_nano, packet_id) AS session FROM g) SELECT flow_id, CAST(session AS BIGINT) AS session, min(ts_nano) AS start_nano, max(ts_nano) AS end_nano, count(*) AS packets, CAST(sum(length) AS BIGINT) AS bytes FROM s GROUP BY 1, 2""")
def _(spark, d):
    return series.sessions(packets(spark, d), 3600 * 10**9)


@query("st_count_window", f"{P} SELECT packet_id, CAST(sum(length) OVER (PARTITION BY src_ip ORDER BY packet_id ROWS 999 PRECEDING) AS BIGINT) AS bytes FROM packets")
def _(spark, d):
    from pyspark.sql import Window

    return packets(spark, d).select("packet_id", F.sum("length").over(Window.partitionBy("src_ip").orderBy("packet_id").rowsBetween(-999, 0)).alias("bytes"))


# ---- classification


@query("cls_port", f"{P}{FLOWS} SELECT flow_id, {sql_case('dst_port', PORT_APPS)} AS application, 0.7::DOUBLE AS confidence FROM flows WHERE {sql_case('dst_port', PORT_APPS)} IS NOT NULL")
def _(spark, d):
    return traffic.flows(packets(spark, d)).withColumn("c", classify.by_port()).filter("c is not null").select("flow_id", "c.application", "c.confidence")


_HEUR = "CASE WHEN protocol = 'TCP' AND src_port > 1024 AND dst_port > 1024 THEN '{a}' WHEN protocol = 'UDP' AND dst_port BETWEEN 16384 AND 32767 THEN '{b}' WHEN protocol = 'UDP' AND dst_port IN (3074, 3478) THEN '{c}' ELSE '{d}' END"


@query("cls_heur", f"{P}{FLOWS} SELECT flow_id, {_HEUR.format(a='unknown_tcp', b='rtp', c='gaming', d='unknown')} AS application, {_HEUR.format(a='unknown', b='voip', c='gaming', d='unknown')} AS category FROM flows")
def _(spark, d):
    return traffic.flows(packets(spark, d)).withColumn("c", classify.by_heuristics()).select("flow_id", "c.application", "c.category")


@query("cls_traffic", f"{P}{FLOWS} SELECT flow_id, coalesce({sql_case('dst_port', PORT_APPS)}, {_HEUR.format(a='unknown_tcp', b='rtp', c='gaming', d='unknown')}) AS application, CASE WHEN {sql_case('dst_port', PORT_APPS)} IS NOT NULL THEN 'port' ELSE 'heuristic' END AS method FROM flows")
def _(spark, d):
    return classify.classified(traffic.flows(packets(spark, d))).select("flow_id", "application", "method")


@query("cls_dpi", """SELECT doc_id, CASE WHEN starts_with(p, 'GET ') THEN 'http_get' WHEN starts_with(p, 'HTTP/') THEN 'http_response' WHEN starts_with(p, 'SSH-') THEN 'ssh' WHEN starts_with(p, 'EHLO ') THEN 'smtp_ehlo' WHEN starts_with(p, '220 ') THEN 'smtp_220' WHEN starts_with(p, '*') THEN 'redis_cmd' END AS application
    FROM (SELECT doc_id, concat(CASE doc_id % 7 WHEN 0 THEN 'GET ' WHEN 1 THEN 'HTTP/' WHEN 2 THEN 'SSH-' WHEN 3 THEN 'EHLO ' WHEN 4 THEN '220 ' WHEN 5 THEN '*' ELSE 'zz' END, md5(text)) AS p FROM documents)""")
def _(spark, d):
    head = F.expr("CASE doc_id % 7 WHEN 0 THEN 'GET ' WHEN 1 THEN 'HTTP/' WHEN 2 THEN 'SSH-' WHEN 3 THEN 'EHLO ' WHEN 4 THEN '220 ' WHEN 5 THEN '*' ELSE 'zz' END")
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", F.concat(head, F.md5(F.encode("text", "utf-8"))).cast("binary").alias("payload"))
    return docs.withColumn("c", classify.by_payload()).select("doc_id", "c.application")


@query("cls_severity", f"{P} SELECT packet_id, CASE WHEN k / 10.0 > 5 THEN 'critical' WHEN k / 10.0 > 4 THEN 'high' WHEN k / 10.0 > 3 THEN 'medium' ELSE 'low' END AS severity FROM packets")
def _(spark, d):
    return packets(spark, d).select("packet_id", classify.score_severity(F.col("k") / 10.0).alias("severity"))


@query("cls_traffic_py", f"""{P}{FLOWS}, e AS (SELECT *, (bytes % 90) / 10.0::DOUBLE AS payload_entropy FROM flows), c AS (SELECT *, {sql_case('dst_port', classify.PORT_APPS_2)} AS a FROM e)
    SELECT flow_id, CASE WHEN a IS NOT NULL THEN a WHEN protocol = 'TCP' AND payload_entropy > 7.5 THEN 'encrypted' WHEN protocol = 'TCP' AND payload_entropy < 4 THEN 'text_protocol' ELSE 'unknown' END AS application,
    CASE WHEN a IS NOT NULL THEN {sql_case('a', classify.APP_CATEGORY_2, chr(39) + 'unknown' + chr(39))} ELSE 'unknown' END AS category FROM c""")
def _(spark, d):
    f = traffic.flows(packets(spark, d)).withColumn("payload_entropy", (F.col("bytes") % 90) / 10.0)
    return classify.classified_2(f).select("flow_id", "application", "category")


SAMPLES = f"{P}, r AS (SELECT *, count(*) OVER w AS packets, sum(length) OVER w AS bytes, first(ts_nano) OVER w AS start_nano FROM packets WINDOW w AS (PARTITION BY flow_id ORDER BY packet_id))"


@query("cls_flow_features", f"""{SAMPLES}, f AS (SELECT packet_id, packets, bytes, protocol, src_port, dst_port, CAST(greatest(ts_nano - start_nano, 0) / 1e9 AS FLOAT) AS duration FROM r WHERE packets > 10)
    SELECT packet_id, round(duration::DOUBLE, 2) AS duration, packets::DOUBLE AS total_packets, bytes::DOUBLE AS total_bytes, (protocol = 'TCP')::INT::DOUBLE AS is_tcp, (protocol = 'UDP')::INT::DOUBLE AS is_udp, round(CAST(src_port / 65535.0 AS FLOAT)::DOUBLE, 6) AS src_port_norm, (dst_port < 1024)::INT::DOUBLE AS is_well_known_port FROM f""")
def _(spark, d):
    f = classify.flow_features(classify.scored_samples(packets(spark, d)))
    return f.select("packet_id", F.round(F.col("duration"), 2).alias("duration"), "total_packets", "total_bytes", "is_tcp", "is_udp", r("src_port_norm"), "is_well_known_port")


@query("cls_vector")
def _(spark, d):
    f = classify.flow_features(classify.scored_samples(packets(spark, d)))
    return f.select("packet_id", classify.flow_vector(f).alias("vector"))


@query("cls_pipeline")
def _(spark, d):
    f = classify.flow_features(classify.scored_samples(packets(spark, d)))
    scored = series.zscores(f, classify.FLOW_FEATURES, ["packet_id"], ["protocol"])
    return classify.threats(classify.classified(scored.select("packet_id", "flow_id", "src_ip", "dst_ip", "src_port", "dst_port", "protocol", "bytes", F.round("score", 4).alias("z"), "is_anomaly"))).select(
        "packet_id", "flow_id", "z", "is_anomaly", "application", "category", "is_threat", "threat_type"
    )


# ---- texts of numbers


@query("fn_format_bytes", f"{P} SELECT packet_id, CASE WHEN n >= 1073741824 THEN printf('%.2f GB', round(n / 1073741824.0::DOUBLE, 2)) WHEN n >= 1048576 THEN printf('%.2f MB', round(n / 1048576.0::DOUBLE, 2)) WHEN n >= 1024 THEN printf('%.2f KB', round(n / 1024.0::DOUBLE, 2)) ELSE concat(n, ' B') END AS text FROM (SELECT packet_id, length * length * (k + 1) AS n FROM packets)")
def _(spark, d):
    return packets(spark, d).select("packet_id", formatting.format_bytes(F.col("length") * F.col("length") * (F.col("k") + 1)).alias("text"))


@query("fn_format_duration", f"{P} SELECT packet_id, CASE WHEN n < 1000 THEN concat(n, 'ms') WHEN n < 60000 THEN printf('%.1fs', round(n / 1000.0::DOUBLE, 1)) ELSE printf('%.1fm', round(n / 60000.0::DOUBLE, 1)) END AS text FROM (SELECT packet_id, length * (k + 1) AS n FROM packets)")
def _(spark, d):
    return packets(spark, d).select("packet_id", formatting.format_duration(F.col("length") * (F.col("k") + 1)).alias("text"))


@query("fn_format_uptime", f"{P} SELECT packet_id, printf('%02d:%02d:%02d', n // 3600, n % 3600 // 60, n % 60) AS text FROM (SELECT packet_id, length * (k + 1) AS n FROM packets)")
def _(spark, d):
    return packets(spark, d).select("packet_id", formatting.format_uptime(F.col("length") * (F.col("k") + 1)).alias("text"))


@query("fn_ip2int", f"{P} SELECT DISTINCT src_ip, CAST(split_part(src_ip, '.', 1) AS BIGINT) * 16777216 + CAST(split_part(src_ip, '.', 2) AS BIGINT) * 65536 + CAST(split_part(src_ip, '.', 3) AS BIGINT) * 256 + CAST(split_part(src_ip, '.', 4) AS BIGINT) AS number FROM packets")
def _(spark, d):
    return packets(spark, d).select("src_ip").distinct().select("src_ip", traffic.ip_to_int("src_ip").alias("number"))
