"""TCP streams, carving, and the joins of requests with answers."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wirespark.dims import CARVING, DANGEROUS_MIMES, SCRIPT_MARKERS

SYN, ACK, FIN, RST = 2, 16, 1, 4


def connection_key() -> Column:
    """The same for both directions."""
    a, b = F.concat("src_ip", F.lit(":"), "src_port"), F.concat("dst_ip", F.lit(":"), "dst_port")
    return F.concat_ws("-", F.least(a, b), F.greatest(a, b))


def ordered(segments: list[tuple[int, bytes]], start: int | None) -> tuple[bytes, int]:
    """Bytes in order from (sequence number, data): overlaps keep what came first in sequence, numbers wrap, gaps are closed and counted."""
    if not segments:
        return b"", 0
    base = segments[0][0] if start is None else start
    placed = sorted(((((seq - base) + (1 << 31)) % (1 << 32)) - (1 << 31), k, data) for k, (seq, data) in enumerate(segments) if data)
    out, at, gaps = [], min([0, *(p for p, _, _ in placed)]) if start is None else 0, 0
    for place, _, data in placed:
        if place + len(data) <= at:
            continue
        if place > at:
            gaps += 1
            at = place
        out.append(data[at - place :])
        at = place + len(data)
    return b"".join(out), gaps


def reassembled(packets: DataFrame, most: int = 64 << 20) -> DataFrame:
    """Streams of TCP packets (src_ip, dst_ip, src_port, dst_port, seq, tcp_flags, payload, ts_nano): both sides' bytes in order.

    The client sends the first SYN; without one, the side with the higher port is the client. A connection is one group;
    its bytes are bounded by `most` for each side, as a stream beyond that is not parsed; client_dropped and server_dropped
    count the bytes beyond.
    """
    tcp = packets.filter("ip_proto = 6").withColumn("connection", connection_key()).select("connection", "src_ip", "dst_ip", "src_port", "dst_port", "seq", "tcp_flags", "payload", "ts_nano")
    schema = "client_ip string, client_port int, server_ip string, server_port int, stream string, client_data binary, server_data binary, client_dropped long, server_dropped long, packets long, gaps long, first_nano long, last_nano long, state string"

    def run(key, pdf):
        pdf = pdf.sort_values("ts_nano", kind="stable")
        opening = pdf[(pdf.tcp_flags.to_numpy() & (SYN | ACK)) == SYN]
        first = opening.iloc[0] if len(opening) else pdf.iloc[0]
        client = (first.src_ip, int(first.src_port)) if len(opening) or first.src_port >= first.dst_port else (first.dst_ip, int(first.dst_port))
        server = (first.dst_ip, int(first.dst_port)) if client == (first.src_ip, int(first.src_port)) else (first.src_ip, int(first.src_port))
        sides, dropped, gaps = [], [], 0
        for ip, port in (client, server):
            own = pdf[(pdf.src_ip == ip) & (pdf.src_port == port)]
            begin = [int(s) + 1 for s, f in zip(own.seq, own.tcp_flags) if f & SYN]
            data, n = ordered([(int(s) + (1 if f & SYN else 0), bytes(p)) for s, f, p in zip(own.seq, own.tcp_flags, own.payload) if p is not None and len(p)], begin[0] if begin else None)
            sides.append(data[:most])
            dropped.append(max(0, len(data) - most))
            gaps += n
        flags = 0
        for f in pdf.tcp_flags:
            flags |= int(f)
        state = "reset" if flags & RST else "closed" if flags & FIN else "established" if len(opening) else "partial"
        return pd.DataFrame([[*client, *server, f"{client[0]}:{client[1]}-{server[0]}:{server[1]}", *sides, *dropped, len(pdf), gaps, int(pdf.ts_nano.min()), int(pdf.ts_nano.max()), state]], columns=[x.split()[0] for x in schema.split(", ")])

    return tcp.groupBy("connection").applyInPandas(run, schema)


def stream_stats(streams: DataFrame) -> DataFrame:
    return streams.agg(
        F.count("*").alias("streams"), F.count_if(F.col("state").isin("closed", "reset")).alias("closed"), F.sum(F.octet_length("client_data") + F.col("client_dropped")).alias("client_bytes"),
        F.sum(F.octet_length("server_data") + F.col("server_dropped")).alias("server_bytes"), F.sum("packets").alias("packets"), F.sum("gaps").alias("gaps"),
    )


# ---- carving

LEAST_FILE, MOST_FILE, MOST_A_STREAM = 100, 100 << 20, 100


def carve(data: bytes, best_only: bool = False, signatures=CARVING, most: int = MOST_A_STREAM) -> list[dict]:
    """Every place where a signature's header stands: to its first footer, or as far as it may go. best_only: one for each place.

    In the order of their places; the first `most` (the application's limit for a stream).
    """
    out, taken = [], set()
    for extension, mime, head, foot, mib, category, dangerous in signatures:
        header, footer = bytes.fromhex(head), bytes.fromhex(foot)
        at = data.find(header)
        while at >= 0:
            reach = min(len(data), at + min(mib << 20, MOST_FILE))
            end = reach
            if footer:
                found = data.find(footer, at + len(header), reach)
                end = found + len(footer) if found >= 0 else reach
            body = data[at:end]
            if len(body) >= LEAST_FILE and not (best_only and at in taken):
                taken.add(at)
                text = body[:1024].decode("latin-1")
                sha = hashlib.sha256(body).hexdigest()
                out.append({
                    "extension": extension, "mime": mime, "category": category, "start": at, "size": len(body), "sha256": sha, "md5": hashlib.md5(body).hexdigest(), "dangerous": dangerous,
                    "threat": mime in DANGEROUS_MIMES or any(m in text for m in SCRIPT_MARKERS), "file_name": f"carved_{at}_{sha[:16]}{extension}",
                })
            at = data.find(header, at + 1)
    return sorted(out, key=lambda x: x["start"])[:most]


def carved(rows: DataFrame, data: str, best_only: bool = False, signatures=CARVING, most: int = MOST_A_STREAM) -> DataFrame:
    """rows without data, one for each file found in it (metadata only). signatures: rows like those of dims.CARVING, perhaps one's own."""
    from wirespark.functions.parsers import array_of, column
    from wirespark.schemas import CARVED_FILE

    find = column(lambda b: carve(b, best_only, signatures, most), array_of(CARVED_FILE))
    return rows.withColumn("f", F.explode(find(data))).drop(data).select("*", "f.*").drop("f")


def file_rows(files: DataFrame) -> DataFrame:
    """Carved files as the interface lists them (its sha1 is the SHA-256). files: what carved() gives, with flow_id and ts_nano."""
    return files.select(
        F.concat_ws("-", "flow_id", "start").alias("id"), F.col("file_name").alias("name"), "size", F.col("mime").alias("mime_type"), "md5", F.col("sha256").alias("sha1"), "sha256", "ts_nano", "flow_id"
    )


def with_expired(files: DataFrame, now_nano: int, most_age_nano: int, time: str = "ts_nano") -> DataFrame:
    """files with `expired`: older than the age, which a clean-up removes."""
    return files.withColumn("expired", F.col(time) < F.lit(now_nano - most_age_nano))


def carver_stats(files: DataFrame) -> DataFrame:
    return files.groupBy("category").agg(F.count("*").alias("files"), F.sum("size").alias("bytes"), F.count_if("threat").alias("threats"))


# ---- requests with answers


def http_pairs(requests: DataFrame, responses: DataFrame, connection: str = "connection", order: str = "ts_nano") -> DataFrame:
    """The n-th response of a connection answers its n-th request. Both sides are numbered by the same partitioning, so the join needs no other shuffle."""
    w = Window.partitionBy(connection).orderBy(order)
    a = requests.withColumn("n", F.row_number().over(w))
    b = responses.withColumn("n", F.row_number().over(w)).withColumnsRenamed({c: f"response_{c}" for c in responses.columns if c != connection})
    return a.join(b, [connection, "n"])


def by_message(requests: DataFrame, responses: DataFrame, keys: list[str] = ("connection", "session_id", "message_id")) -> DataFrame:
    """SMB answers by connection, session and message."""
    return requests.join(responses.withColumnsRenamed({c: f"response_{c}" for c in responses.columns if c not in keys}), list(keys))


def as_of(events: DataFrame, states: DataFrame, keys: list[str], value: str, order: str = "ts_nano") -> DataFrame:
    """Events with the latest state at or before them, by one union and one window: no range join."""
    mark = events.withColumn("_v", F.lit(None).cast(states.schema[value].dataType)).withColumn("_e", F.struct(*events.columns))
    other = states.select(*keys, order, F.col(value).alias("_v")).withColumn("_e", F.lit(None).cast(mark.schema["_e"].dataType))
    both = mark.select(*keys, order, "_v", "_e").unionByName(other)
    w = Window.partitionBy(*keys).orderBy(F.col(order), F.col("_e").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn(value, F.last("_v", ignorenulls=True).over(w)).filter("_e is not null").select("_e.*", value)


def quic_connections(packets: DataFrame, initials: DataFrame) -> DataFrame:
    """Packets with their connection: by either id that an initial packet named. Two equi joins by union, no OR."""
    ids = initials.select(F.col("dcid").alias("id"), "connection").unionByName(initials.select(F.col("scid").alias("id"), "connection")).filter("id <> ''").groupBy("id").agg(F.min("connection").alias("connection"))
    return packets.join(ids, packets["dcid"] == ids["id"], "left").drop("id")


def reverse_lookup(rows: DataFrame, answers: DataFrame, ip: str = "ip", time: str = "ts_nano") -> DataFrame:
    """rows with the name that last resolved to their address and had not expired. answers: name, data, ts_nano, ttl."""
    a = answers.select(F.col("data").alias(ip), F.struct("name", (F.col("ts_nano") + F.col("ttl") * 10**9).alias("until")).alias("answer"), F.col("ts_nano").alias(time))
    out = as_of(rows, a, [ip], "answer", time)
    return out.withColumn("hostname", F.when(F.col("answer.until") >= F.col(time), F.col("answer.name"))).drop("answer")


def cache_lookup(queries: DataFrame, answers: DataFrame) -> DataFrame:
    """queries (name, type, ts_nano) with the answer cached for them."""
    a = answers.select("name", "type", F.struct("data", (F.col("ts_nano") + F.col("ttl") * 10**9).alias("until")).alias("answer"), "ts_nano")
    out = as_of(queries, a, ["name", "type"], "answer")
    return out.withColumn("data", F.when(F.col("answer.until") >= F.col("ts_nano"), F.col("answer.data"))).drop("answer")


def written_files(chunks: DataFrame, key: list[str]) -> DataFrame:
    """Files from written chunks (key, offset, data, seq): the last write to an offset counts, gaps are zeros."""
    latest = chunks.groupBy(*key, "offset").agg(F.max_by("data", "seq").alias("data"))
    schema = ", ".join(f"{k} {dict(chunks.dtypes)[k]}" for k in key) + ", size long, sha256 string, data binary"

    def run(group_key, pdf):
        out = bytearray()
        for offset, data in sorted(zip(pdf.offset, pdf.data), key=lambda x: x[0]):
            end = int(offset) + len(data)
            if end > len(out):
                out.extend(bytes(end - len(out)))
            out[int(offset) : end] = bytes(data)
        return pd.DataFrame([[*group_key, len(out), hashlib.sha256(out).hexdigest(), bytes(out)]], columns=[*key, "size", "sha256", "data"])

    return latest.groupBy(*key).applyInPandas(run, schema)


def hash_chain(rows: DataFrame, chain: list[str], order: str, data: str) -> DataFrame:
    """Links of each chain, in order: index, data_hash, chain_hash."""
    from wirespark.functions.encoding import blake3_many, chain_hash

    schema = ", ".join(f"{k} {dict(rows.dtypes)[k]}" for k in [*chain, order]) + ", index long, data_hash string, chain_hash string"

    def run(key, pdf):
        pdf, before, out = pdf.sort_values(order, kind="stable"), bytes(32), []
        for n, (at, own) in enumerate(zip(pdf[order], blake3_many([bytes(x) for x in pdf[data]]))):
            before = chain_hash(n, own, before, int(at))
            out.append([*key, at, n, own.hex(), before.hex()])
        return pd.DataFrame(out, columns=[*chain, order, "index", "data_hash", "chain_hash"])

    return rows.select(*chain, order, data).groupBy(*chain).applyInPandas(run, schema)
