import pytest
from pyspark.sql import functions as F

from wirespark.functions import content, domain, formatting, pii
from wirespark.functions.fingerprint import is_grease, tls_version
from wirespark.operators import anomaly, classify, filters, series, streams, traffic
from wirespark.plans import build


def values(spark, rows, column, kind="string"):
    frame = spark.createDataFrame([(i, x) if not isinstance(x, tuple) else (i, *x) for i, x in enumerate(rows)], f"i int, {kind if ' ' in kind else 'x ' + kind}")
    return [r.v for r in frame.select("i", column.alias("v")).orderBy("i").collect()]


def test_shares_and_pipes(spark):
    yes = ["\\\\server\\ADMIN$", "C$", "d$", "IPC$", "PRINT$", "admin$", "Q$"]
    assert values(spark, yes + ["share", "documents", ""], content.is_admin_share("x")) == [True] * 7 + [False] * 3
    files = [("PSEXESVC.exe", "x"), ("paexec", "x"), ("REMCOM", "x"), ("notepad.exe", "ADMIN$")]
    assert values(spark, files, content.is_remote_exec("x", "y"), "x string, y string") == [True, True, True, False]
    assert values(spark, ["svcctl", "srvsvc", "samr", "lsarpc"], content.is_service_pipe("x")) == [True, True, False, False]
    assert values(spark, ["wkssvc", "winreg", "ntsvcs", "atsvc", "eventlog", "samr"], content.is_wmi_pipe("x")) == [True] * 5 + [False]
    ups = [("a.exe", "ADMIN$"), ("a.ps1", "C$"), ("a.dll", "C$"), ("a.bat", "C$"), ("a.txt", "ADMIN$"), ("a.exe", "share")]
    assert values(spark, ups, content.is_suspicious_upload("x", "y"), "x string, y string") == [True] * 4 + [False] * 2
    names = ["../../../etc/passwd", "C:\\Windows\\System32\\cmd.exe", 'file<>:"|?*.txt', ".hidden", "a" * 120, ".."]
    assert values(spark, names, content.sanitized(F.col("x"))) == ["passwd", "cmd.exe", "file_______.txt", "hidden", "a" * 100, ""]


def test_magic_and_content(spark):
    data = [bytes.fromhex(x) for x in ("255044462d", "504b0304", "89504e470d", "ffd8ffe0", "4749463839", "4d5a9000")] + [b"plain text", bytes([0, 1, 2, 3]), b"abc"]
    want = ["application/pdf", "application/zip", "image/png", "image/jpeg", "image/gif", "application/x-msdownload", "text/plain", "application/octet-stream", "application/octet-stream"]
    assert values(spark, data, content.magic_mime(F.col("x")), "binary") == want
    rows = [("MZ\x90", "a"), ("x", "run.ps1"), ("x", "run.bat"), ("powershell -enc", "a"), ("plain", "a.txt")]
    got = values(spark, rows, content.suspicious_content(F.col("x"), F.col("y")), "x string, y string")
    assert got == ["Executable file", "PowerShell script", "Batch script", "Suspicious content: powershell", None]


def test_lateral_score(spark):
    ops = spark.createDataFrame([(1, 1, "f.txt", "ADMIN$"), (1, 2, "PSEXESVC.exe", "x"), (2, 1, "notes", "docs")], "session int, n int, file string, share string")
    got = content.lateral_scores(content.lateral_events(ops, "file", "share"), ["session"], ["n", "kind"]).orderBy("n").collect()
    assert [(r.kind, r.score, r.alert) for r in got] == [("ADMIN_SHARE_ACCESS", 2, False), ("PSEXEC", 5, True)]


def test_names(spark):
    rows = ["mail.google.com", "aGVsbG8gd29ybGQgdGhpcyBpcyBhIHRlc3Q0.t.example.com", "google.com", "xyz", ""]
    t = values(spark, rows, domain.tunnelling("x"))
    assert [r.is_tunnelling for r in t] == [False, True, False, False, False]
    assert round(values(spark, ["google.com"], domain.entropy("x"))[0], 4) == 2.6464
    assert values(spark, ["xkqjzwvbnmghptrs.com", "google.com"], domain.generated("x")["is_dga"]) == [True, False]
    assert values(spark, ["mail.google.com"], domain.analysed("x", compat=True)["is_tunnelling"]) == [True]
    assert values(spark, ["é", "日本"], domain.entropy("x"))[0] > 0


def test_pii(spark):
    text = "mail a@gmail.com or 123-45-6789, card 4111111111111111 and 4111111111111112, key api_key=abcdefghij0123456789xyz"
    got = {(r.type, r.value): r.confidence for r in pii.matches(spark.createDataFrame([(1, text)], "i int, t string"), "t", ["email", "ssn", "credit_card", "api_key"]).collect()}
    assert got[("email", "a@gmail.com")] == 0.95 and got[("ssn", "123-45-6789")] == 0.9 and got[("credit_card", "4111111111111111")] == 0.95
    assert ("credit_card", "4111111111111112") not in got
    assert pii.redact("a@b.org", "label") == "[EMAIL]" and pii.redact("x a@b.org", "mask") == "x a*****g" and pii.redact("a@b.org!", "remove") == "!"
    assert pii.redact("none") == "none"


def test_filters_refuse_what_they_cannot_read(spark):
    for bad in ("", "port", "port x", "host a.b", "tcp and", "(tcp", "net 10", "tcp udp", "port 70000", "host 1.2.3.400"):
        with pytest.raises(ValueError):
            filters.bpf(bad)
    rows = spark.createDataFrame([("1.1.1.1", "2.2.2.2", 1, 80, 6), ("::1", "::2", 1, 80, 6)], "src_ip string, dst_ip string, src_port int, dst_port int, ip_proto int")
    assert rows.filter(filters.bpf("tcp port 80")).count() == 1 and rows.filter(filters.bpf("port 80")).count() == 2 and rows.filter(filters.bpf("not (udp or icmp)")).count() == 2


def test_local_addresses(spark):
    rows = ["10.1.2.3", "172.16.0.1", "172.32.0.1", "192.168.9.9", "127.0.0.1", "8.8.8.8", "::1", "fd00::1", "2001:db8::1", None, "x"]
    assert values(spark, rows, traffic.is_local("x")) == [True, True, False, True, True, False, True, True, False, False, False]


def test_texts(spark):
    assert values(spark, [0, 1023, 1536, 5 << 30], formatting.format_bytes(F.col("x")), "long") == ["0 B", "1023 B", "1.50 KB", "5.00 GB"]
    assert values(spark, [0x0A0A, 0x1A1A, 0x0035, 0x1301], is_grease(F.col("x")), "int") == [True, True, False, False]
    assert values(spark, [0x0300, 0x0304, 0x0305], tls_version(F.col("x")), "int") == ["SSL 3.0", "TLS 1.3", "Unknown (0x0305)"]


def test_sums_are_kept(spark):
    rows = [(i, i * 10, 60 + i % 7, f"10.0.0.{i % 5}", f"8.8.8.{i % 3}", 1000 + i % 4, [80, 53, 4444][i % 3], [6, 17, 6][i % 3], ["TCP", "UDP", "TCP"][i % 3]) for i in range(200)]
    p = spark.createDataFrame(rows, "packet_id long, ts_nano long, length long, src_ip string, dst_ip string, src_port int, dst_port int, ip_proto int, protocol string").withColumn("flow_id", traffic.flow_id())
    total = sum(r[2] for r in rows)
    assert traffic.flows(p).agg(F.sum("bytes")).first()[0] == total and traffic.ip_stats(p).agg(F.sum("bytes")).first()[0] == 2 * total
    assert sorted(map(tuple, traffic.flows(p.repartition(7)).collect())) == sorted(map(tuple, traffic.flows(p.coalesce(1)).collect()))
    t = {r.dst_port: r.threat_type for r in classify.threats(traffic.flows(p)).collect()}
    assert t == {80: "", 53: "", 4444: "suspicious_port"}


def test_moving_average_and_windows(spark):
    rows = [("a", i, 10.0 + i % 2) for i in range(100)] + [("a", 100, 1000.0)]
    got = series.moving_average(spark.createDataFrame(rows, "k string, i int, v double"), "v", ["i"], ["k"]).orderBy("i").collect()
    assert got[-1].is_anomaly and not any(r.is_anomaly for r in got[20:-1])
    p = spark.createDataFrame([(i, i * 10) for i in range(20)], "packet_id long, ts_nano long")
    w = {r.window_start: r["count"] for r in series.sliding_windows(p, 40, 20).groupBy("window_start").count().collect()}
    assert w == {s: sum(s <= t < s + 40 for t in range(0, 200, 10)) for s in range(0, 190, 20)}
    assert series.sliding_windows(p.limit(0), 40, 20).count() == 0


def test_forest_and_lof_find_the_outlier():
    import numpy as np

    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(size=(300, 3)), [[9.0, 9.0, 9.0]]])
    forest, lof = anomaly.IsolationForest(x), anomaly.LocalOutlierFactor(x)
    assert forest.score(x).argmax() == 300 and forest.score(x)[300] > forest.threshold and lof.score(x)[300] == lof.score(x).max()
    assert np.allclose(anomaly.IsolationForest(x).score(x), forest.score(x))
    with pytest.raises(ValueError):
        anomaly.LocalOutlierFactor(x[:20], 20)


def test_reassembly_orders_overlaps_wraps_and_gaps():
    whole = bytes(range(200))
    parts = [(4294967200 + i & 0xFFFFFFFF, whole[i : i + 30]) for i in range(0, 200, 20)]
    assert streams.ordered(parts[::-1], 4294967200) == (whole, 0)
    assert streams.ordered([(0, b"ab"), (10, b"cd")], 0) == (b"abcd", 1)
    assert streams.ordered([], None) == (b"", 0)


def test_http_request_over_three_segments(spark):
    text = b"GET /index HTTP/1.1\r\nHost: h\r\n\r\nmore"
    cuts = [(1000, text[:10]), (1020, text[20:]), (1010, text[10:20]), (1010, text[10:20])]
    rows = [("192.168.1.1", "192.168.1.2", 12345, 80, 6, s, 24, bytearray(d), 10 * k) for k, (s, d) in enumerate(cuts)]
    frame = spark.createDataFrame(rows, "src_ip string, dst_ip string, src_port int, dst_port int, ip_proto int, seq long, tcp_flags int, payload binary, ts_nano long")
    got = streams.reassembled(frame).first()
    assert bytes(got.client_data) == text and got.stream == "192.168.1.1:12345-192.168.1.2:80" and got.gaps == 0
    assert (got.client_dropped, got.server_dropped) == (0, 0)
    short = streams.reassembled(frame, most=12).first()
    assert bytes(short.client_data) == text[:12] and (short.client_dropped, short.server_dropped) == (len(text) - 12, 0)
    assert streams.stream_stats(streams.reassembled(frame, most=12)).first().client_bytes == len(text)


def test_carving():
    png = bytes.fromhex("89504e470d0a1a0a") + bytes(120) + bytes.fromhex("49454e44ae426082")
    data = b"junk" * 30 + png + b"<html>" + b"%PDF-1.4" + bytes(200) + b"%%EOF" + b"tail"
    found = {f["extension"]: f for f in streams.carve(data)}
    assert (found[".png"]["start"], found[".png"]["size"]) == (120, len(png)) and found[".pdf"]["category"] == "document"
    assert streams.carve(b"MZ" + bytes(200))[0]["threat"] and {f["extension"] for f in streams.carve(b"PK\3\4" + bytes(200))} == {".docx", ".zip"}
    assert len(streams.carve(b"PK\3\4" + bytes(200), best_only=True)) == 1 and streams.carve(b"\xff\xd8\xff") == []


def test_as_of_takes_the_latest_state(spark):
    e = spark.createDataFrame([("a", 5, 1), ("a", 15, 2), ("b", 9, 3)], "k string, ts_nano long, e int")
    s = spark.createDataFrame([("a", 5, "x"), ("a", 10, "y"), ("b", 10, "z")], "k string, ts_nano long, state string")
    assert {r.e: r.state for r in streams.as_of(e, s, ["k"], "state").collect()} == {1: "x", 2: "y", 3: None}


def test_later_writes_count_and_gaps_are_zeros(spark):
    c = spark.createDataFrame([("f", 0, bytearray(b"old"), 1), ("f", 0, bytearray(b"new"), 2), ("f", 5, bytearray(b"x"), 3)], "k string, offset long, data binary, seq int")
    assert bytes(streams.written_files(c, ["k"]).first().data) == b"new\0\0x"


def test_build_round_trip():
    from wirespark.functions.parsers import packet

    assert packet.decode(build.ipv4_frame("1.1.1.1", "2.2.2.2", 5, 6, 1))["ip_proto"] == 1
