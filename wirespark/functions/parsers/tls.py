"""TLS hellos (RFC 8446, 6066, 7301)."""

from __future__ import annotations

import struct

from wirespark.functions.parsers import column
from wirespark.schemas import TLS_HELLO


def _numbers(data: bytes) -> list[int]:
    return [struct.unpack(">H", data[i : i + 2])[0] for i in range(0, len(data) - 1, 2)]


def handshake_of(data: bytes) -> bytes:
    """The handshake message of a record, or the data themselves."""
    return data[5:] if len(data) > 5 and data[0] == 22 and data[1] == 3 else data


def _extensions(data: bytes) -> list[tuple[int, bytes]]:
    out, at = [], 0
    while at + 4 <= len(data):
        kind, n = struct.unpack(">HH", data[at : at + 4])
        if at + 4 + n > len(data):
            break
        out.append((kind, data[at + 4 : at + 4 + n]))
        at += 4 + n
    return out


def _server_name(body: bytes) -> str | None:
    at = 2
    while at + 3 <= len(body):
        kind, n = body[at], struct.unpack(">H", body[at + 1 : at + 3])[0]
        if kind == 0:
            return body[at + 3 : at + 3 + n].decode("latin-1")
        at += 3 + n
    return None


def _protocols(body: bytes) -> list[str]:
    out, at = [], 2
    while at < len(body):
        out.append(body[at + 1 : at + 1 + body[at]].decode("latin-1"))
        at += 1 + body[at]
    return out


def client_hello(data: bytes) -> dict | None:
    data = handshake_of(data)
    if len(data) < 39 or data[0] != 1:
        return None
    out: dict = {"version": struct.unpack(">H", data[4:6])[0]}
    at = 38
    at += 1 + data[at]
    if at + 2 > len(data):
        return None
    n = struct.unpack(">H", data[at : at + 2])[0]
    out["ciphers"] = _numbers(data[at + 2 : at + 2 + n])
    at += 2 + n
    if at >= len(data):
        return out | {"extensions": [], "groups": [], "point_formats": [], "signature_algorithms": [], "alpn": [], "supported_versions": []}
    at += 1 + data[at]
    found = _extensions(data[at + 2 :])
    by = {kind: body for kind, body in reversed(found)}
    return out | {
        "extensions": [k for k, _ in found], "server_name": _server_name(by[0]) if 0 in by else None, "groups": _numbers(by.get(10, b"")[2:]), "point_formats": list(by.get(11, b"")[1:]),
        "signature_algorithms": _numbers(by.get(13, b"")[2:]), "alpn": _protocols(by[16]) if 16 in by else [], "supported_versions": _numbers(by.get(43, b"")[1:]),
    }


def server_hello(data: bytes) -> dict | None:
    data = handshake_of(data)
    if len(data) < 39 or data[0] != 2:
        return None
    at = 39 + data[38]
    if at + 3 > len(data):
        return None
    found = _extensions(data[at + 5 :]) if at + 5 <= len(data) else []
    by = dict(found)
    return {
        "version": struct.unpack(">H", data[4:6])[0], "ciphers": _numbers(data[at : at + 2]), "extensions": [k for k, _ in found], "groups": [], "point_formats": [], "signature_algorithms": [],
        "server_name": None, "alpn": _protocols(by[16]) if 16 in by else [], "supported_versions": _numbers(by.get(43, b"")),
    }


client_hellos, server_hellos = column(client_hello, TLS_HELLO), column(server_hello, TLS_HELLO)
