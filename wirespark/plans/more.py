"""Queries for the smaller operators: batches, limits, unions, helpers of parsers, and batch forms of stateful ones."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from wirespark.dims import BAD_PORTS, sql_case
from wirespark.functions import content, encoding, pii, sql
from wirespark.functions.parsers import array_of, column, dns, hpack, http, smb, tls
from wirespark.operators import anomaly, classify, filters, streams, traffic
from wirespark.plans import build
from wirespark.plans.network import _chunks, _credentials, _dicts, _points, _segments, events
from wirespark.plans.packets import SQL_PACKETS, packets
from wirespark.plans.registry import query
from wirespark.plans.text import NAMES, docs, names, shares
from wirespark.plans.traffic import FLOWS
from wirespark.sources import sinks
from wirespark.sources.files import scratch

P = SQL_PACKETS


def pages(spark, d):
    return spark.read.parquet(f"{d}/pages.parquet")


# ---- batches


@query("src_batchacc", f"{P} SELECT protocol, (row_number() OVER (PARTITION BY protocol ORDER BY packet_id) - 1) // 100 AS batch, packet_id FROM packets")
def _(spark, d):
    n = F.row_number().over(Window.partitionBy("protocol").orderBy("packet_id"))
    return packets(spark, d).select("protocol", F.floor((n - 1) / 100).alias("batch"), "packet_id")


@query("src_workerpool", f"{P} SELECT packet_id % 8 AS worker, count(*) AS packets FROM packets GROUP BY 1")
def _(spark, d):
    return packets(spark, d).groupBy((F.col("packet_id") % 8).alias("worker")).agg(F.count("*").alias("packets"))


_BATCHES = f"{P}, b AS (SELECT protocol, (row_number() OVER (PARTITION BY protocol ORDER BY packet_id) - 1) // 100 AS batch FROM packets), n AS (SELECT protocol, batch, count(*) AS n FROM b GROUP BY ALL)"


@query("agg_batch_stats", f"{_BATCHES} SELECT protocol, count(*) AS batches, round(avg(n), 6) AS mean_size FROM n GROUP BY protocol")
def _(spark, d):
    n = F.row_number().over(Window.partitionBy("protocol").orderBy("packet_id"))
    b = packets(spark, d).select("protocol", F.floor((n - 1) / 100).alias("batch")).groupBy("protocol", "batch").agg(F.count("*").alias("n"))
    return b.groupBy("protocol").agg(F.count("*").alias("batches"), F.round(F.avg("n"), 6).alias("mean_size"))


@query("snk_batcher", f"{_BATCHES} SELECT protocol, batch, n FROM n")
def _(spark, d):
    n = F.row_number().over(Window.partitionBy("protocol").orderBy("packet_id"))
    return packets(spark, d).select("protocol", F.floor((n - 1) / 100).alias("batch")).groupBy("protocol", "batch").agg(F.count("*").alias("n"))


@query("snk_events", f"{P} SELECT packet_id, CASE WHEN dst_port = 53 AND k % 2 = 0 THEN 'dns:response' WHEN dst_port = 53 THEN 'dns:query' ELSE 'packet' END AS event FROM packets")
def _(spark, d):
    answers = F.when(F.col("k") % 2 == 0, F.array(F.lit("a"))).otherwise(F.array().cast("array<string>"))
    kind = F.when(F.col("dst_port") == 53, F.when(F.size(answers) > 0, "dns:response").otherwise("dns:query")).otherwise("packet")
    return packets(spark, d).select("packet_id", kind.alias("event"))


# ---- limits, sorts, unions


@query("lim_carve", """WITH n AS (SELECT doc_id, source, strlen(text) AS size, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents),
    t AS (SELECT doc_id, row_number() OVER w AS k, sum(size) OVER w AS total FROM n WHERE n <= 100 WINDOW w AS (ORDER BY doc_id)) SELECT doc_id FROM t WHERE k <= 10000 AND total <= 10737418240""")
def _(spark, d):
    """100 files a stream, 10,000 in all, 10 GiB."""
    n = docs(spark, d).select("doc_id", "source", F.octet_length("text").alias("size")).withColumn("n", F.row_number().over(Window.partitionBy("source").orderBy("doc_id"))).filter("n <= 100")
    w = Window.orderBy("doc_id").rowsBetween(Window.unboundedPreceding, 0)
    return n.orderBy("doc_id").limit(10_000).withColumn("total", F.sum("size").over(w)).filter("total <= 10737418240").select("doc_id")


@query("sort_versions", "SELECT 'forest' AS model, 1 AS version UNION ALL SELECT 'forest', 2 UNION ALL SELECT 'lof', 1")
def _(spark, d):
    path = scratch(spark, "models")
    for name, version in (("forest", 1), ("forest", 2), ("lof", 1)):
        sinks.save_model(spark.range(4), path, name, version)
    return sinks.model_versions(spark, path).select("model", "version")


@query("sort_cipher", "SELECT event_id, array_to_string(list_sort([4865 + event_id % 3, 49195, 156, event_id % 100]), '-') AS ciphers FROM events")
def _(spark, d):
    n = F.col("event_id")
    values = F.array(4865 + n % 3, F.lit(49195).cast("long"), F.lit(156).cast("long"), n % 100)
    return events(spark, d).select("event_id", F.array_join(F.transform(F.array_sort(values), lambda x: x.cast("string")), "-").alias("ciphers"))


@query("set_union_files", "SELECT page_id, '.html' AS kind FROM pages UNION ALL SELECT page_id, '.html' FROM pages WHERE starts_with(html, '<!DOCTYPE') AND strlen(html) >= 100")
def _(spark, d):
    p = pages(spark, d).select("page_id", F.encode("html", "utf-8").alias("b"))
    whole = p.select("page_id", F.lit(".html").alias("kind"))
    return whole.unionByName(streams.carved(p, "b").filter("extension = '.html' and start = 0").select("page_id", F.col("extension").alias("kind")))


@query("set_union_bundle", f"{P} SELECT 'flow' AS kind, count(DISTINCT flow_id) AS n FROM packets UNION ALL SELECT 'host', (SELECT count(*) FROM (SELECT src_ip FROM packets UNION SELECT dst_ip FROM packets)) UNION ALL SELECT 'investigation', 1")
def _(spark, d):
    p = packets(spark, d)
    return sinks.bundle("case 1", sinks.flow_objects(traffic.flows(p)), sinks.host_objects(traffic.hosts(p))).groupBy("kind").agg(F.count("*").alias("n"))


# ---- digests and numbers


@query("fn_merkle_proof", "SELECT doc_id, TRUE AS holds FROM documents")
def _(spark, d):
    def check(data):
        levels = encoding.merkle_levels(data, 512)
        k = len(levels[0]) // 2
        return encoding.proof_holds(levels[0][k], encoding.merkle_proof(levels, k), levels[-1][0])

    return docs(spark, d).select("doc_id", column(check, "boolean")(F.encode("text", "utf-8")).alias("holds"))


@query("fn_merkle_verify", "SELECT doc_id, doc_id % 2 = 0 AS whole FROM documents")
def _(spark, d):
    x = docs(spark, d).select("doc_id", F.encode("text", "utf-8").alias("b"))
    x = x.select("doc_id", encoding.merkle_root(F.col("b"), 1024).alias("root"), encoding.merkle_root(F.when(F.col("doc_id") % 2 == 0, F.col("b")).otherwise(F.concat("b", F.lit(b"x"))), 1024).alias("now"))
    return x.select("doc_id", (F.col("root") == F.col("now")).alias("whole"))


@query("fn_consttime_eq", "SELECT doc_id, md5(text) = md5(lower(text)) AS same FROM documents")
def _(spark, d):
    return docs(spark, d).select("doc_id", (F.md5(F.encode("text", "utf-8")) == F.md5(F.encode(F.lower("text"), "utf-8"))).alias("same"))


@query("fn_varint", "SELECT event_id, event_id % 60 AS number FROM events")
def _(spark, d):
    e = events(spark, d).select("event_id", build.made(lambda n: bytes([0x40, n % 60]) if n % 2 else bytes([n % 60]), "event_id").alias("b"))
    return e.select("event_id", column(lambda b: hpack.varint(b, 0)[0], "long")("b").alias("number"))


@query("fn_hpack_int", "SELECT event_id, event_id % 5000 AS number FROM events")
def _(spark, d):
    def coded(n):
        n = int(n) % 5000
        if n < 31:
            return bytes([n])
        out, n = bytearray([31]), n - 31
        while n >= 128:
            out.append(n % 128 + 128)
            n //= 128
        return bytes(out) + bytes([n])

    e = events(spark, d).select("event_id", build.made(coded, "event_id").alias("b"))
    return e.select("event_id", column(lambda b: hpack.integer(b, 0, 5)[0], "long")("b").alias("number"))


@query("fn_hkdf")
def _(spark, d):
    from wirespark.functions.parsers.quic import initial_secrets

    e = events(spark, d).select("event_id", build.made(lambda n: f"{n:08d}".encode(), "event_id").alias("dcid"))
    return e.select("event_id", column(lambda b: initial_secrets(b)[0].hex(), "string")("dcid").alias("client_key"))


# ---- classification


@query("top3_pred", "SELECT vec_id, array_to_string(list_transform(list_sort(list_transform(range(1, len(embedding) + 1), lambda i: {'p': -CAST(embedding[i] AS DOUBLE), 'i': i})), lambda x: x.i - 1)[1:3], ',') AS labels FROM embeddings")
def _(spark, d):
    p = spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("p"))
    return p.select("vec_id", F.array_join(F.transform(classify.top_predictions("p"), lambda i: i.cast("string")), ",").alias("labels"))


@query("cls_anom_py", "WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings), s AS (SELECT *, list_avg(e) AS m FROM v), t AS (SELECT *, sqrt(list_sum(list_transform(e, lambda x: (x - m) * (x - m))) / len(e)) AS s FROM s) SELECT vec_id, list_max(list_transform(e, lambda x: abs((x - m) / s))) > 3 AS is_anomaly FROM t")
def _(spark, d):
    v = spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", encoding.standardized(F.transform("embedding", lambda x: x.cast("double"))).alias("z"))
    return v.select("vec_id", (F.array_max(F.transform("z", F.abs)) > 3).alias("is_anomaly"))


@query("cls_ml")
def _(spark, d):
    """Without a model the forest stands in: probabilities of ordinary and odd."""
    p, dims = _points(spark, d)
    s = anomaly.scored(p, dims, anomaly.IsolationForest(anomaly.sampled(p, dims, 2000, "vec_id")), "odd")
    return s.select("vec_id", F.when(F.col("odd") >= 0.5, "odd").otherwise("ordinary").alias("label"), F.round(F.greatest("odd", 1 - F.col("odd")), 6).alias("confidence"))


@query("cls_threat_patterns", "SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'metasploit_shell' WHEN 1 THEN 'powershell_encoded' ELSE '' END AS found FROM documents")
def _(spark, d):
    t = docs(spark, d).select("doc_id", F.expr("CASE doc_id % 3 WHEN 0 THEN 'run /bin/sh now' WHEN 1 THEN 'powershell -enc x' ELSE 'plain' END").cast("binary").alias("payload"))
    return t.select("doc_id", F.array_join(classify.payload_threats(), ",").alias("found"))


# ---- parsers' parts


@query("prs_dns_name", f"{NAMES} SELECT page_id, CASE WHEN ends_with(name, '.') THEN name[:-2] ELSE name END AS name FROM names")
def _(spark, d):
    n = names(spark, d).select("page_id", build.made(lambda x: build.dns_query(x), "name").alias("m"))
    return n.select("page_id", column(lambda b: dns.name_at(b, 12)[0], "string")("m").alias("name"))


@query("prs_dns_rr", f"{NAMES} SELECT page_id, page_id * 7 % 86400 AS ttl, concat('10.', page_id % 256, '.1.', page_id % 200) AS data FROM names")
def _(spark, d):
    made = build.made(lambda x, n: build.dns_answer(x, f"10.{n % 256}.1.{n % 200}", int(n) * 7 % 86400), "name", "page_id")
    n = names(spark, d).withColumn("r", F.explode(dns.parsed(made)))
    return n.select("page_id", F.col("r.answers")[0]["ttl"].alias("ttl"), F.col("r.answers")[0]["data"].alias("data"))


def _(spark, d):
    n = names(spark, d).withColumn("r", F.explode(dns.parsed(build.made(lambda x: build.dns_answer(x, "1.2.3.4"), "name"))))
    return n.select("page_id", F.col("r.answers")[0]["ttl"].alias("ttl"))


@query("prs_http_gzip", "SELECT page_id, md5(html) AS digest FROM pages")
def _(spark, d):
    import gzip

    p = pages(spark, d).select("page_id", build.made(lambda t: gzip.compress((t or "").encode()), "html").alias("z"))
    return p.select("page_id", F.md5(column(http.gunzipped, "binary")("z")).alias("digest"))


@query("prs_http_file", "SELECT page_id, concat('f', page_id, '.pdf') AS name FROM pages")
def _(spark, d):
    p = pages(spark, d).select("page_id", F.concat(F.lit("/dir/f"), F.col("page_id").cast("string"), F.lit(".pdf?x=1")).alias("path"))
    return p.select("page_id", column(lambda x: http.file_name(x, {}), "string")("path").alias("name"))


@query("prd_h2_preface", "SELECT event_id, event_id % 3 = 0 AS preface FROM events")
def _(spark, d):
    heads = [hpack.PREFACE + b"x", hpack.PREFACE[:-1], b"GET / HTTP/1.1"]
    e = events(spark, d).select("event_id", build.made(lambda n: heads[n % 3], "event_id").alias("m"))
    return e.select("event_id", column(hpack.is_h2, "boolean")("m").alias("preface"))


def _(spark, d):
    e = events(spark, d).select("event_id", F.when(F.col("event_id") % 2 == 0, F.lit(hpack.PREFACE + b"x")).otherwise(F.lit(b"GET / HTTP/1.1")).alias("m"))
    return e.select("event_id", F.startswith("m", F.lit(hpack.PREFACE)).alias("preface"))


@query("prs_tls_sh", "SELECT event_id, CAST(769 + event_id % 3 AS INT) AS version, CAST(4865 + event_id % 5 AS INT) AS cipher, CASE WHEN event_id % 2 = 0 THEN 772 END AS chosen, CASE WHEN event_id % 7 = 0 THEN 'h2' END AS alpn FROM events")
def _(spark, d):
    def message(n):
        extensions = (b"\0\x2b\0\x02\x03\x04" if n % 2 == 0 else b"") + (b"\0\x10\0\x05\0\x03\x02h2" if n % 7 == 0 else b"")
        body = bytes([3, 1 + n % 3]) + bytes(32) + bytes([n % 4]) + bytes(n % 4) + (4865 + int(n) % 5).to_bytes(2, "big") + b"\0" + len(extensions).to_bytes(2, "big") + extensions
        return b"\x02" + len(body).to_bytes(3, "big") + body

    e = events(spark, d).select("event_id", build.made(message, "event_id").alias("m")).withColumn("h", tls.server_hellos("m"))
    return e.select("event_id", "h.version", F.col("h.ciphers")[0].alias("cipher"), F.get("h.supported_versions", F.lit(0)).alias("chosen"), F.get("h.alpn", F.lit(0)).alias("alpn"))


def _(spark, d):
    body = b"\x03\x03" + bytes(32) + b"\0" + b"\x13\x01" + b"\0" + b"\0\x06" + b"\0\x2b\0\x02\x03\x04"
    e = events(spark, d).select("event_id", F.lit(b"\x02" + len(body).to_bytes(3, "big") + body).alias("m")).withColumn("h", tls.server_hellos("m"))
    return e.select("event_id", "h.version", F.col("h.ciphers")[0].alias("cipher"))


@query("prs_ntlm", "SELECT event_id, concat('u', user_id) AS user, 'CORP' AS domain FROM events")
def _(spark, d):
    import struct

    def blob(n):
        u, c = f"u{n}".encode("utf-16-le"), "CORP".encode("utf-16-le")
        return b"NTLMSSP\0" + struct.pack("<I", 3) + bytes(16) + struct.pack("<HHI", len(c), len(c), 64) + struct.pack("<HHI", len(u), len(u), 64 + len(c)) + bytes(20) + c + u

    e = events(spark, d).select("event_id", build.made(blob, "user_id").alias("m"))
    return e.withColumn("n", column(smb.ntlm, "domain string, user string")("m")).select("event_id", "n.user", "n.domain")


@query("prs_smb3_enc", "SELECT user_id AS session_id, count(*) AS messages FROM events GROUP BY 1")
def _(spark, d):
    import struct

    e = events(spark, d).select(build.made(lambda u: b"\xfdSMB" + bytes(32) + struct.pack("<IHHQ", 100, 0, 1, int(u)), "user_id").alias("m"))
    s = e.withColumn("e", column(smb.encrypted, "session_id decimal(20,0), size int, flags int")("m"))
    return s.groupBy(F.col("e.session_id").cast("long").alias("session_id")).agg(F.count("*").alias("messages"))


@query("prd_smb2", "SELECT event_id, event_id % 5 IN (0, 2) AS smb2, event_id % 5 IN (1, 3) AS smb3 FROM events")
def _(spark, d):
    heads = [b"\xfeSMB", b"\xfdSMB", b"\0\0\0\x04\xfeSMB", b"\0\0\0\x04\xfdSMB", b"\xffSMB"]  # with the session service's 4 bytes or without; SMB1
    e = events(spark, d).select("event_id", build.made(lambda n: heads[n % 5], "event_id").alias("m"))
    return e.select("event_id", column(smb.is_smb2, "boolean")("m").alias("smb2"), column(smb.is_encrypted, "boolean")("m").alias("smb3"))


@query("fn_smb_names", """SELECT event_id, CASE event_id % 7 WHEN 0 THEN 'SMB 2.0.2' WHEN 1 THEN 'SMB 2.1' WHEN 2 THEN 'SMB 3.0' WHEN 3 THEN 'SMB 3.0.2' WHEN 4 THEN 'SMB 3.1.1' ELSE printf('Unknown (0x%04X)', event_id % 7 + 43000) END AS dialect,
    CASE event_id % 6 WHEN 1 THEN 'AES-128-CCM' WHEN 2 THEN 'AES-128-GCM' WHEN 3 THEN 'AES-256-CCM' WHEN 4 THEN 'AES-256-GCM' ELSE printf('Unknown (0x%04X)', event_id % 6) END AS cipher FROM events""")
def _(spark, d):
    codes = F.array(*(F.lit(x) for x in (0x0202, 0x0210, 0x0300, 0x0302, 0x0311)))
    n = F.col("event_id")
    dialect = F.when(n % 7 < 5, F.get(codes, (n % 7).cast("int"))).otherwise(n % 7 + 43000)
    return events(spark, d).select("event_id", smb.dialect_name(dialect).alias("dialect"), smb.cipher_name(n % 6).alias("cipher"))


def _(spark, d):
    e = events(spark, d).select("event_id", F.when(F.col("event_id") % 2 == 0, F.unhex(F.lit("fe534d42"))).otherwise(F.unhex(F.lit("fd534d42"))).alias("m"))
    return e.select("event_id", F.startswith("m", F.unhex(F.lit("fe534d42"))).alias("smb2"), F.startswith("m", F.unhex(F.lit("fd534d42"))).alias("smb3"))


# ---- files and shares


@query("win_tcp_order", "SELECT page_id, md5(html) AS digest FROM pages WHERE strlen(html) > 0")
def _(spark, d):
    first = _segments(spark, d).withColumn("ts_nano", F.when((F.col("seq") == 4294967000), F.lit(-10000000)).otherwise(F.col("ts_nano")))
    return streams.reassembled(first).select((F.col("client_port") - 10000).cast("long").alias("page_id"), F.md5("server_data").alias("digest"))


@query("jn_file_stream", "SELECT page_id, concat('10.0.0.', page_id % 250) AS src_ip, sha256(html) AS sha256 FROM pages WHERE starts_with(html, '<!DOCTYPE') AND strlen(html) >= 100")
def _(spark, d):
    p = pages(spark, d).select("page_id", F.concat(F.lit("10.0.0."), (F.col("page_id") % 250).cast("string")).alias("src_ip"), F.encode("html", "utf-8").alias("b"))
    return streams.carved(p, "b").filter("extension = '.html' and start = 0").select("page_id", "src_ip", "sha256")


def _carved(spark, d):
    return streams.carved(pages(spark, d).select("page_id", F.encode("html", "utf-8").alias("b")), "b").filter("extension = '.html' and start = 0")


_C = " FROM pages WHERE starts_with(html, '<!DOCTYPE') AND strlen(html) >= 100"


@query("crv_record", f"SELECT page_id, 'text/html' AS mime, 'document' AS category, sha256(html) AS sha256, md5(html) AS md5{_C}")
def _(spark, d):
    return _carved(spark, d).select("page_id", "mime", "category", "sha256", "md5")


@query("crv_filename", f"SELECT page_id, concat('carved_0_', left(sha256(html), 16), '.html') AS file_name{_C}")
def _(spark, d):
    return _carved(spark, d).select("page_id", "file_name")


@query("crv_reader", f"SELECT page_id, strlen(html) AS size{_C}")
def _(spark, d):
    return _carved(spark, d).select("page_id", "size")


@query("snk_carved", f"SELECT page_id, 0 AS stored_bytes, strlen(html) AS size{_C}")
def _(spark, d):
    return _carved(spark, d).select("page_id", F.lit(0).alias("stored_bytes"), "size")


_MAGIC = " ".join(f"WHEN starts_with(hex(encode(html)), '{magic}') THEN '{mime}'" for mime, magic in content.MAGIC)


@query("crv_mime", f"""SELECT page_id, CASE WHEN strlen(html) < 4 THEN 'application/octet-stream' {_MAGIC}
    WHEN regexp_full_match(left(hex(encode(html)), 1024), '((09|0A|0B|0C|0D|[2-6][0-9A-F]|7[0-9A-E]|[89AB][0-9A-F]))+') THEN 'text/plain' ELSE 'application/octet-stream' END AS mime FROM pages""")
def _(spark, d):
    return pages(spark, d).select("page_id", content.magic_mime(F.encode("html", "utf-8")).alias("mime"))


@query("crv_addsig", """SELECT page_id, '.own' AS extension, strlen(left(html, strpos(html, '<article') - 1)) AS start, strlen(split_part(substr(html, strpos(html, '<article')), '</article>', 1)) + 10 AS size
    FROM pages WHERE contains(html, '<article') AND contains(substr(html, strpos(html, '<article')), '</article>') AND strlen(split_part(substr(html, strpos(html, '<article')), '</article>', 1)) + 10 >= 100
    AND strpos(substr(html, strpos(html, '<article') + 1), '<article') = 0""")
def _(spark, d):
    """Files cut out by a signature of one's own."""
    own = [(".own", "application/x-own", b"<article".hex(), b"</article>".hex(), 1, "other", False)]
    p = pages(spark, d).filter(F.length("html") - F.length(F.replace("html", F.lit("<article"), F.lit("<articl"))) == 1)
    p = p.filter(F.contains(F.substring_index("html", "<article", -1), F.lit("</article>")))
    return streams.carved(p.select("page_id", F.encode("html", "utf-8").alias("b")), "b", signatures=own).select("page_id", "extension", "start", "size")


@query("prj_filedto", f"SELECT page_id AS flow_id, concat('carved_0_', left(sha256(html), 16), '.html') AS name, strlen(html) AS size, 'text/html' AS mime_type, md5(html) AS md5, sha256(html) AS sha1, sha256(html) AS sha256, page_id * 1000 AS ts_nano{_C}")
def _(spark, d):
    files = _carved(spark, d).withColumns({"flow_id": F.col("page_id"), "ts_nano": F.col("page_id") * 1000})
    return streams.file_rows(files).select("flow_id", "name", "size", "mime_type", "md5", "sha1", "sha256", "ts_nano")


def _(spark, d):
    own = (".own", "application/x-own", "6f776e", "", 1, "other", False)
    return content.signatures(spark, [own]).filter("extension = '.own'").select("extension", "mime", "line")


@query("snk_smbfile", "SELECT doc_id, concat(doc_id, '_', left(sha256(text), 8), '_f.txt') AS name FROM documents")
def _(spark, d):
    w = streams.written_files(_chunks(spark, d), ["doc_id"])
    return w.select("doc_id", F.concat(F.col("doc_id").cast("string"), F.lit("_"), F.left("sha256", F.lit(8)), F.lit("_"), content.sanitized(F.lit("dir/f.txt"))).alias("name"))


@query("smb_extract_ops", "SELECT doc_id, strlen(text) AS size FROM documents")
def _(spark, d):
    return streams.written_files(_chunks(spark, d), ["doc_id"]).select("doc_id", "size")


@query("smb_list", "SELECT doc_id, strlen(text) AS size, sha256(text) AS sha256, epoch_ns(TIMESTAMP '2024-01-01') + doc_id * 3600000000000 AS ts_nano FROM documents")
def _(spark, d):
    return _dated_files(spark, d).select("doc_id", "size", "sha256", "ts_nano")


@query("smb_cleanup", "SELECT doc_id, doc_id < max(doc_id) OVER () - 24 AS removed FROM documents")
def _(spark, d):
    """Files older than a day, as of the newest one."""
    f = _dated_files(spark, d)
    now = f.agg(F.max("ts_nano")).first()[0]
    return streams.with_expired(f, now, 24 * 3600 * 10**9).select("doc_id", F.col("expired").alias("removed"))


def _dated_files(spark, d):
    stamp = F.lit(1704067200 * 10**9) + F.col("doc_id") * F.lit(3600 * 10**9)
    return streams.written_files(_chunks(spark, d), ["doc_id"]).withColumn("ts_nano", stamp)


@query("fn_tsa_batch", "SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN NULL ELSE sha256(text) END AS digest, doc_id % 5 <> 0 AS stamped, CASE WHEN doc_id % 5 <> 0 THEN 1700000000000000000 + doc_id END AS ts_nano FROM documents")
def _(spark, d):
    evidence = docs(spark, d).select("doc_id", F.when(F.col("doc_id") % 5 != 0, F.encode("text", "utf-8")).alias("data"), (F.lit(1700000000000000000) + F.col("doc_id")).alias("now"))
    return encoding.batch_stamps(evidence, "data", "now").select("doc_id", "digest", "stamped", "ts_nano")


@query("cls_c2", f"{P}{FLOWS} SELECT flow_id, dst_port = 445 OR dst_port = 53 AND bytes > 10000 OR {sql_case('dst_port', BAD_PORTS)} IS NOT NULL OR bytes < 300 * packets AS is_threat, bytes < 300 * packets AS beacon FROM flows")
def _(spark, d):
    """Indicators of one's own beside the built-in ones."""
    own = classify.Indicator("small_packets", "beacon", F.col("bytes") < 300 * F.col("packets"), "Small packets")
    t = classify.threats(traffic.flows(packets(spark, d)), [own])
    return t.select("flow_id", "is_threat", F.array_contains("indicators", "small_packets").alias("beacon"))


@query("sql_functions", "SELECT event_id, concat('/e', event_id) AS path, CASE event_id % 2 WHEN 0 THEN 'GET' ELSE 'POST' END AS method, 0.0::DOUBLE AS entropy FROM events")
def _(spark, d):
    """Parsers called from SQL."""
    sql.register(spark)
    e = events(spark, d).select("event_id", build.made(lambda n: f"{('GET', 'POST')[n % 2]} /e{n} HTTP/1.1\r\n\r\n".encode(), "event_id").alias("m"))
    return spark.sql("SELECT event_id, http_request(m).path AS path, http_request(m).method AS method, byte_entropy(CAST('aaaa' AS BINARY)) AS entropy FROM {e}", e=e)


def _(spark, d):
    return streams.written_files(_chunks(spark, d), ["doc_id"]).filter("doc_id >= 100").select("doc_id")


@query("smb_lateral_share", "SELECT event_id FROM events WHERE event_id % 8 IN (0, 1, 3, 4, 6)")
def _(spark, d):
    return shares(spark, d).filter(content.is_admin_share("share")).select("event_id")


@query("agg_smb_tree", "SELECT user_id AS session, event_id % 7 AS tree, count(*) AS operations, count(*) FILTER (event_id % 2 = 0) AS reads FROM events GROUP BY ALL")
def _(spark, d):
    e = events(spark, d).select(F.col("user_id").alias("session"), (F.col("event_id") % 7).alias("tree"), "event_id")
    return e.groupBy("session", "tree").agg(F.count("*").alias("operations"), F.count_if(F.col("event_id") % 2 == 0).alias("reads"))


# ---- personal data elsewhere


@query("pii_scan_dns", "SELECT page_id, 'email' AS type FROM pages")
def _(spark, d):
    n = pages(spark, d).select("page_id", F.concat(F.lit("user"), F.col("page_id").cast("string"), F.lit("@example.org")).alias("name"))
    return pii.matches(n, "name", ["email"]).select("page_id", "type")


@query("pii_evidence", "SELECT count(*) AS n, 0::BIGINT AS shown FROM events")
def _(spark, d):
    c = _credentials(spark, d).withColumn("username", pii.redacted_text(F.concat("username", F.lit("@example.org"))))
    return sinks.credential_objects(c).agg(F.count("*").alias("n"), F.count_if(F.contains("json", F.lit("@example.org"))).alias("shown"))


# ---- batch forms of what streams keep


@query("st_throttle", f"{P} SELECT protocol, CAST(floor(ts_nano / 6e10) AS BIGINT) AS tick, min(packet_id) AS packet_id, count(*) AS of FROM packets GROUP BY 1, 2")
def _(spark, d):
    return filters.throttle(packets(spark, d), 60 * 10**9, "protocol")


@query("st_dedup", f"{P} SELECT src_ip, dst_ip, count(*) AS n FROM (SELECT DISTINCT src_ip, dst_ip, dst_port FROM packets) GROUP BY ALL")
def _(spark, d):
    return packets(spark, d).dropDuplicates(["src_ip", "dst_ip", "dst_port"]).groupBy("src_ip", "dst_ip").agg(F.count("*").alias("n"))


@query("st_stateful", f"{P} SELECT flow_id, count(*) AS packets, CAST(sum(length) AS BIGINT) AS bytes, max(packet_id) AS last_packet FROM packets GROUP BY flow_id")
def _(spark, d):
    return packets(spark, d).groupBy("flow_id").agg(F.count("*").alias("packets"), F.sum("length").alias("bytes"), F.max("packet_id").alias("last_packet"))


@query("st_ttl_cache", """WITH s AS (SELECT user_id, epoch_us(ts) * 1000 AS t, max(event_type) AS v FROM events WHERE event_id % 5 = 0 GROUP BY 1, 2)
    SELECT count(*) AS queries, count(*) FILTER (s.t + 3600000000000 >= e.t) AS hits FROM (SELECT *, epoch_us(ts) * 1000 AS t FROM events) e ASOF LEFT JOIN s ON e.user_id = s.user_id AND e.t >= s.t""")
def _(spark, d):
    e = events(spark, d)
    a = e.filter("event_id % 5 = 0").groupBy("user_id", "ts_nano").agg(F.max("event_type").alias("data")).select(F.col("user_id").alias("name"), F.lit("A").alias("type"), "data", "ts_nano", F.lit(3600).cast("long").alias("ttl"))
    q = streams.cache_lookup(e.select("event_id", F.col("user_id").alias("name"), F.lit("A").alias("type"), "ts_nano"), a)
    return q.agg(F.count("*").alias("queries"), F.count("data").alias("hits"))


@query("st_batcher", f"{_BATCHES} SELECT count(*) AS batches, CAST(sum(n) AS BIGINT) AS packets FROM n")
def _(spark, d):
    n = F.row_number().over(Window.partitionBy("protocol").orderBy("packet_id"))
    b = packets(spark, d).select("protocol", F.floor((n - 1) / 100).alias("batch")).groupBy("protocol", "batch").agg(F.count("*").alias("n"))
    return b.agg(F.count("*").alias("batches"), F.sum("n").alias("packets"))
