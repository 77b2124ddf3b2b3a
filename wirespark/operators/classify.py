"""Traffic and threat classification of flows, as expressions over columns: no joins, so no shuffles and no broadcasts."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wirespark.dims import APP_CATEGORY, BAD_PORTS, PAYLOAD_SIGNATURES, PORT_APPS, SNI_KEYWORDS, THREAT_PATTERNS, mapped


def category_of(app: Column) -> Column:
    return mapped(app, APP_CATEGORY, "unknown")


def _result(app, category, confidence, method) -> Column:
    lit = lambda x: F.lit(x) if not isinstance(x, Column) else x
    return F.struct(lit(app).alias("application"), lit(category).alias("category"), lit(confidence).alias("confidence"), lit(method).alias("method"))


def by_port(port: str = "dst_port") -> Column:
    """struct or null."""
    app = mapped(F.col(port).cast("int"), PORT_APPS)
    return F.when(app.isNotNull(), _result(app, category_of(app), 0.7, "port"))


def by_payload(payload: str = "payload") -> Column:
    """The first signature in order that the payload (binary) has; struct or null."""
    text = F.hex(F.col(payload))
    out = F.lit(None)
    for name, category, offset, pattern, least in reversed(PAYLOAD_SIGNATURES):
        at = F.substring(text, 2 * offset + 1, 2 * len(pattern))
        out = F.when((F.octet_length(payload) >= least) & (at == pattern.hex().upper()), _result(name, category, 0.9, "dpi")).otherwise(out)
    return out


def by_heuristics(server_name: str | None = None, encrypted: Column | None = None) -> Column:
    """From src_port, dst_port, protocol; server_name and encrypted (a TLS fingerprint is known) where there are such."""
    p, s, d = F.col("protocol"), F.col("src_port"), F.col("dst_port")
    out = (
        F.when((p == "TCP") & (s > 1024) & (d > 1024), _result("unknown_tcp", "unknown", 0.3, "heuristic"))
        .when((p == "UDP") & d.between(16384, 32767), _result("rtp", "voip", 0.5, "heuristic"))
        .when((p == "UDP") & d.isin(3074, 3478), _result("gaming", "gaming", 0.6, "heuristic")).otherwise(_result("unknown", "unknown", 0.1, "heuristic"))
    )
    if encrypted is None:
        return out
    named = _result("tls", "web", 0.6, "heuristic")
    if server_name:
        for category, words in reversed(SNI_KEYWORDS):
            for word in reversed(words):
                named = F.when(F.contains(F.lower(server_name), F.lit(word)), _result(word, category, 0.85, "heuristic")).otherwise(named)
    return F.when(encrypted, named).otherwise(out)


def classified(flows: DataFrame, payload: str | None = None, server_name: str | None = None, encrypted: Column | None = None) -> DataFrame:
    """Port, then payload, then heuristics."""
    tries = [by_port(), *([by_payload(payload)] if payload else []), by_heuristics(server_name, encrypted)]
    return flows.withColumn("c", F.coalesce(*tries)).select("*", "c.application", "c.category", "c.confidence", "c.method").drop("c")


#: The ports of the second classifier, and its categories.
PORT_APPS_2 = {80: "http", 443: "https", 22: "ssh", 21: "ftp", 25: "smtp", 53: "dns", 110: "pop3", 143: "imap", 3306: "mysql", 5432: "postgres", 6379: "redis", 27017: "mongodb", 8080: "http_proxy", 8443: "https_alt"}
APP_CATEGORY_2 = {
    "http": "web", "https": "web", "ftp": "file_transfer", "smtp": "email", "imap": "email", "pop3": "email",
    "mysql": "database", "postgres": "database", "mongodb": "database", "redis": "database",
}


def classified_2(flows: DataFrame, payload_entropy: str = "payload_entropy") -> DataFrame:
    """Ports with 0.9, then entropy of a TCP payload, then UDP ports."""
    app = mapped(F.col("dst_port").cast("int"), PORT_APPS_2)
    p, d, e = F.col("protocol"), F.col("dst_port"), F.col(payload_entropy)
    c = (
        F.when(app.isNotNull(), _result(app, mapped(app, APP_CATEGORY_2, "unknown"), 0.9, "port"))
        .when((p == "TCP") & (e > 7.5), _result("encrypted", "unknown", 0.7, "entropy")).when((p == "TCP") & (e < 4.0), _result("text_protocol", "unknown", 0.6, "entropy"))
        .when((p == "UDP") & d.isin(67, 68), _result("dhcp", "network", 0.95, "port")).when((p == "UDP") & (d == 123), _result("ntp", "network", 0.95, "port"))
        .when((p == "UDP") & d.between(16384, 32767), _result("rtp", "voip", 0.7, "port")).otherwise(_result("unknown", "unknown", 0.3, "none"))
    )
    return flows.withColumn("c", c).select("*", "c.application", "c.category", "c.confidence").drop("c")


class Indicator(NamedTuple):
    """A sign of remote control: a condition on a flow's columns."""

    name: str
    kind: str
    condition: Column
    description: str
    severity: str = "high"
    confidence: float = 0.7


def built_in() -> list[Indicator]:
    d = F.col("dst_port")
    return [
        Indicator("dns_tunneling", "exfiltration", (d == 53) & (F.col("bytes") > 10_000), "Potential DNS tunneling detected"),
        Indicator("admin_share_access", "lateral_movement", d == 445, "Admin share access detected"),
    ]


def threats(flows: DataFrame, more: list[Indicator] = ()) -> DataFrame:
    """Flows with is_threat, threat_type, severity, confidence, indicators, description; later rules outrank earlier ones, indicators gather.

    more: indicators of one's own, after the built-in ones.
    """
    d = F.col("dst_port")
    label = mapped(d.cast("int"), BAD_PORTS)
    bad, rules = label.isNotNull(), [x._replace(condition=F.coalesce(x.condition, F.lit(False))) for x in (*built_in(), *more)]
    text = F.concat(F.lit("Connection to known suspicious port "), d.cast("string"), F.lit(" ("), label, F.lit(")"))
    found = F.array_compact(F.array(F.when(bad, F.concat(F.lit("port_"), d.cast("string"), F.lit("_"), label)), *(F.when(x.condition, x.name) for x in rules)))
    any_, kind, severity, confidence, description = bad, F.when(bad, "suspicious_port").otherwise(""), F.when(bad, "medium").otherwise(""), F.when(bad, 0.6).otherwise(0.0), F.when(bad, text).otherwise("")
    for x in rules:
        any_ = any_ | x.condition
        pick = lambda value, before, x=x: F.when(x.condition, F.lit(value)).otherwise(before)
        kind, severity, confidence, description = pick(x.kind, kind), pick(x.severity, severity), pick(x.confidence, confidence), pick(x.description, description)
    return flows.select(
        "*", any_.alias("is_threat"), kind.alias("threat_type"), severity.alias("severity"), confidence.alias("confidence"), found.alias("indicators"), description.alias("description")
    )


def top_predictions(probabilities: str, n: int = 3) -> Column:
    """Places of the n largest, the first of equal ones first."""
    ranked = F.array_sort(F.transform(probabilities, lambda v, i: F.struct((-v).alias("p"), i.alias("i"))))
    return F.transform(F.slice(ranked, 1, n), lambda r: r["i"])


def payload_threats(payload: str = "payload") -> Column:
    """Names of the patterns that a payload holds; off in the cascade unless one adds it."""
    return F.array_compact(F.array(*(F.when(F.contains(F.col(payload), F.lit(pattern)), name) for name, _, _, pattern in THREAT_PATTERNS)))


def score_severity(score: Column) -> Column:
    return F.when(score > 5, "critical").when(score > 4, "high").when(score > 3, "medium").otherwise("low")


def running_flow(packets: DataFrame) -> DataFrame:
    """The state of its flow as of each packet. One sort by flow; a flow's rows are streamed, not gathered."""
    w = Window.partitionBy("flow_id").orderBy("packet_id").rowsBetween(Window.unboundedPreceding, 0)
    return packets.select(
        "packet_id", "flow_id", "src_ip", "dst_ip", "src_port", "dst_port", "protocol", "ts_nano", F.count("*").over(w).alias("packets"), F.sum("length").over(w).alias("bytes"), F.first("ts_nano").over(w).alias("start_nano")
    )


def scored_samples(packets: DataFrame, least: int = 10) -> DataFrame:
    """Samples that go to scoring: flows from their packet number least + 1 on."""
    return running_flow(packets).filter(F.col("packets") > least)


FLOW_FEATURES = ["duration", "total_packets", "total_bytes", "packets_per_sec", "bytes_per_sec", "is_tcp", "is_udp", "is_https", "src_port_norm", "dst_port_norm", "is_well_known_port", "is_ephemeral_port"]
#: The 38 places of the flow vector; those without a name above stay 0 in compatible mode.
FLOW_VECTOR = (
    "duration total_packets total_bytes packets_per_sec bytes_per_sec fwd_packets bwd_packets fwd_bytes bwd_bytes fwd_bwd_ratio "
    "min_packet_len max_packet_len mean_packet_len std_packet_len min_iat max_iat mean_iat std_iat syn_count ack_count fin_count rst_count "
    "psh_count urg_count payload_entropy payload_mean payload_std is_tcp is_udp is_http is_https is_dns is_smb is_quic src_port_norm dst_port_norm is_well_known_port is_ephemeral_port"
).split()


def flow_features(samples: DataFrame, end: str = "ts_nano", start: str = "start_nano", server_name: str | None = None) -> DataFrame:
    """The features of a flow sample that can be other than 0, in 32-bit arithmetic widened to doubles."""
    f = lambda c: c.cast("float")
    seconds = f(F.greatest(F.col(end) - F.col(start), F.lit(0)) / F.lit(1e9))
    per = lambda c: F.when(seconds > 0, f(f(F.col(c)) / seconds)).otherwise(f(F.lit(0)))
    flag = lambda c: F.when(c, 1.0).otherwise(0.0)
    named = F.coalesce(F.col(server_name) != "", F.lit(False)) if server_name else F.lit(False)
    norm = lambda c: f(f(F.col(c)) / f(F.lit(65535.0)))
    values = [
        seconds, f(F.col("packets")), f(F.col("bytes")), per("packets"), per("bytes"), flag(F.col("protocol") == "TCP"), flag(F.col("protocol") == "UDP"), flag(named),
        norm("src_port"), norm("dst_port"), flag(F.col("dst_port") < 1024), flag(F.col("src_port") >= 49152),
    ]
    return samples.select("*", *(v.cast("double").alias(n) for n, v in zip(FLOW_FEATURES, values)))


def flow_vector(features: DataFrame) -> Column:
    return F.array(*(F.col(n) if n in features.columns else F.lit(0.0) for n in FLOW_VECTOR))


def alerts_of(threat_rows: DataFrame, anomalies: DataFrame | None = None) -> DataFrame:
    """Alerts of threats (always critical, the rule's own severity beside it) and of anomalies (high)."""
    a = threat_rows.filter("is_threat").select(
        F.concat(F.lit("threat-"), "flow_id").alias("alert_id"), F.lit("threat").alias("source"), F.lit("critical").alias("severity"), F.col("severity").alias("rule_severity"),
        F.col("threat_type").alias("title"), "description", "src_ip", "dst_ip", F.col("confidence").alias("score"),
    )
    if anomalies is None:
        return a
    b = anomalies.select(
        F.concat(F.lit("anomaly-"), "flow_id", F.lit("-"), "packet_id").alias("alert_id"), F.lit("anomaly").alias("source"), F.lit("high").alias("severity"), score_severity(F.col("score")).alias("rule_severity"),
        F.lit("anomaly").alias("title"), F.lit("Unusual flow").alias("description"), "src_ip", "dst_ip", F.col("score"),
    )
    return a.unionByName(b)
