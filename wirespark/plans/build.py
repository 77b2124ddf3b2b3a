"""Bytes of messages, for queries and tests that need payloads which the driver's tables don't have."""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def ipv4_frame(src: str, dst: str, sport: int, dport: int, proto: int, payload: bytes = b"", flags: int = 24, seq: int = 1, ack: int = 1) -> bytes:
    if proto == 6:
        body = struct.pack(">HHIIBBHHH", sport, dport, seq & 0xFFFFFFFF, ack, 80, flags, 8192, 0, 0) + payload
    elif proto == 17:
        body = struct.pack(">HHHH", sport, dport, 8 + len(payload), 0) + payload
    else:
        body = struct.pack(">BBHHH", 8, 0, 0, 1, 1) + payload
    ip = struct.pack(">BBHHHBBH", 69, 0, 20 + len(body), 0, 0, 64, proto, 0) + bytes(map(int, src.split("."))) + bytes(map(int, dst.split(".")))
    return bytes(12) + b"\x08\x00" + ip + body


def dns_query(name: str, kind: int = 1, ident: int = 1234) -> bytes:
    labels = b"".join(bytes([len(x)]) + x.encode("latin-1", "replace") for x in name.rstrip(".").split("."))
    return struct.pack(">HHHHHH", ident, 0x0100, 1, 0, 0, 0) + labels + b"\0" + struct.pack(">HH", kind, 1)


def dns_answer(name: str, ip: str, ttl: int = 300, ident: int = 1234) -> bytes:
    q = dns_query(name, 1, ident)
    return q[:2] + struct.pack(">HHHHH", 0x8180, 1, 1, 0, 0) + q[12:] + b"\xc0\x0c" + struct.pack(">HHIH", 1, 1, ttl, 4) + bytes(map(int, ip.split(".")))


def client_hello(name: str, ciphers=(0x1301, 0x1302, 0x1303, 0xC02C, 0xC02B), versions=(0x0304, 0x0303), alpn=("h2",), groups=(29, 23), grease: int | None = None) -> bytes:
    two = lambda xs: b"".join(struct.pack(">H", x) for x in xs)
    ext = lambda k, b: struct.pack(">HH", k, len(b)) + b
    c = two(([grease] if grease else []) + list(ciphers))
    host = name.encode()
    e = ext(0, struct.pack(">HBH", len(host) + 3, 0, len(host)) + host) if name else b""
    e += ext(10, struct.pack(">H", 2 * len(groups)) + two(groups)) + ext(11, b"\x01\x00") + ext(13, struct.pack(">H", 4) + two((0x0403, 0x0804)))
    names = b"".join(bytes([len(x)]) + x.encode() for x in alpn)
    e += ext(16, struct.pack(">H", len(names)) + names) + ext(43, bytes([2 * len(versions)]) + two(versions))
    body = struct.pack(">H", 0x0303) + bytes(32) + b"\0" + struct.pack(">H", len(c)) + c + b"\x01\x00" + struct.pack(">H", len(e)) + e
    return b"\x01" + struct.pack(">I", len(body))[1:] + body


def quic_initial(dcid: bytes, scid: bytes, version: int = 1) -> bytes:
    return b"\xc0" + struct.pack(">I", version) + bytes([len(dcid)]) + dcid + bytes([len(scid)]) + scid + b"\0" + b"\x10" + bytes(16)


def smb_header(command: int, message_id: int, session_id: int = 1, tree_id: int = 1, answer: bool = False) -> bytes:
    return b"\xfeSMB" + struct.pack("<HHIHHIIQIIQ", 64, 0, 0, command, 1, int(answer), 0, message_id, 0, tree_id, session_id) + bytes(16)


def smb_tree_connect(path: str, message_id: int, session_id: int = 1) -> bytes:
    text = path.encode("utf-16-le")
    return smb_header(3, message_id, session_id, 0) + struct.pack("<HHHH", 9, 0, 72, len(text)) + text


def smb_create(path: str, message_id: int, session_id: int = 1, tree_id: int = 1) -> bytes:
    text = path.encode("utf-16-le")
    return smb_header(5, message_id, session_id, tree_id) + bytes(44) + struct.pack("<HH", 120, len(text)) + bytes(8) + text


def smb_write(file_id: bytes, offset: int, data: bytes, message_id: int, session_id: int = 1, tree_id: int = 1) -> bytes:
    return smb_header(9, message_id, session_id, tree_id) + struct.pack("<HHIQ", 49, 112, len(data), offset) + file_id.ljust(16, b"\0") + bytes(16) + data


def made(function, *columns: Column | str) -> Column:
    """Bytes made from columns, by Arrow batches."""

    @F.pandas_udf("binary")
    def run(*series: pd.Series) -> pd.Series:
        return pd.Series([function(*row) for row in zip(*series)], dtype=object)

    return run(*columns)
