"""QUIC headers (RFC 9000, 9369), from UDP payloads."""

from __future__ import annotations

import struct

from pyspark.sql import Column
from pyspark.sql import functions as F

from wirespark.dims import mapped
from wirespark.functions.parsers import column
from wirespark.functions.parsers.hpack import Malformed, varint
from wirespark.schemas import QUIC_HEADER

MOST_ID, MOST_TOKEN, MOST_LENGTH, MOST_VERSIONS = 20, 8192, 65535, 64
TYPES = ["Initial", "0-RTT", "Handshake", "Retry"]
#: Versions by number.
VERSIONS = {0x00000001: "QUIC v1", 0x6B3343CF: "QUIC v2", 0xFF00001D: "QUIC draft-29", 0x00000000: "Version Negotiation"}


def header(data: bytes) -> dict | None:
    if not data:
        return None
    if not data[0] & 0x80:
        return {"form": "short", "packet_type": "1-RTT", "dcid": data[1:9].hex()} if data[0] & 0x40 and len(data) >= 9 else None
    if len(data) < 7:
        return None
    version = struct.unpack(">I", data[1:5])[0]
    n = data[5]
    at = 6 + n
    if n > MOST_ID or at >= len(data):
        return None
    m = data[at]
    if m > MOST_ID or at + 1 + m > len(data):
        return None
    out = {"form": "long", "version": version, "dcid": data[6 : 6 + n].hex(), "scid": data[at + 1 : at + 1 + m].hex()}
    at += 1 + m
    if version == 0:
        count = (len(data) - at) // 4
        return None if count > MOST_VERSIONS else out | {"packet_type": "Version Negotiation", "supported": list(struct.unpack(f">{count}I", data[at : at + 4 * count]))}
    kind = data[0] >> 4 & 3
    kind = (kind - 1) % 4 if version == 0x6B3343CF else kind
    out["packet_type"] = TYPES[kind]
    try:
        if kind == 0:
            token, at = varint(data, at)
            if token > MOST_TOKEN or at + token > len(data):
                return None
            out["token_length"], at = token, at + token
        if kind != 3:
            size, at = varint(data, at)
            if size > MOST_LENGTH:
                return None
            out["length"] = size
    except Malformed:
        return None
    return out


def is_quic(payload: Column) -> Column:
    """The fixed bit, and for a long header room for a version."""
    first = F.conv(F.hex(F.substring(payload, 1, 1)), 16, 10).cast("int")
    return F.coalesce((first.bitwiseAND(0x40) != 0) & ((first.bitwiseAND(0x80) == 0) | (F.octet_length(payload) >= 7)), F.lit(False))


def version_name(version: Column) -> Column:
    return mapped(version.cast("long"), VERSIONS, F.concat(F.lit("Unknown (0x"), F.lower(F.lpad(F.hex(version.cast("long")), 8, "0")), F.lit(")")))


#: Salts of the first keys by version.
SALTS = {0x00000001: "38762cf7f55934b34d179ae6a4c80cadccbb7f0a", 0x6B3343CF: "0dede3def700a6db819381be6e269dcbf9bd2ed9"}


def expand_label(secret: bytes, label: str, size: int) -> bytes:
    """HKDF-Expand-Label of TLS 1.3 with an empty context (RFC 8446, 7.1; RFC 5869)."""
    import hashlib
    import hmac

    name = b"tls13 " + label.encode()
    info, out, last, k = struct.pack(">H", size) + bytes([len(name)]) + name + b"\0", b"", b"", 1
    while len(out) < size:
        last = hmac.new(secret, last + info + bytes([k]), hashlib.sha256).digest()
        out, k = out + last, k + 1
    return out[:size]


def initial_secrets(dcid: bytes, version: int = 1) -> tuple[bytes, bytes, bytes]:
    """Client key, iv and header-protection key of the first packets (RFC 9001, 5.2)."""
    import hashlib
    import hmac

    secret = hmac.new(bytes.fromhex(SALTS[version]), dcid, hashlib.sha256).digest()
    client = expand_label(secret, "client in", 32)
    head = "quicv2" if version == 0x6B3343CF else "quic"
    return expand_label(client, f"{head} key", 16), expand_label(client, f"{head} iv", 12), expand_label(client, f"{head} hp", 16)


headers = column(header, QUIC_HEADER)
