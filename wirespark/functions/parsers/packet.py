"""Ethernet, IPv4, IPv6, TCP and UDP headers."""

from __future__ import annotations

import ipaddress
import struct

from wirespark.functions.parsers import column
from wirespark.schemas import DECODED

IPV6_EXTENSIONS = {0, 43, 60}


def decode(frame: bytes, link_type: int = 1) -> dict | None:
    """Fields of a frame; what a layer doesn't have stays absent. Link types: 1 Ethernet, 101 raw IP."""
    at, kind = 0, None
    if link_type == 1:
        if len(frame) < 14:
            return None
        kind, at = struct.unpack(">H", frame[12:14])[0], 14
        while kind in (0x8100, 0x88A8) and len(frame) >= at + 4:
            kind, at = struct.unpack(">H", frame[at + 2 : at + 4])[0], at + 4
    elif frame:
        kind = 0x0800 if frame[0] >> 4 == 4 else 0x86DD
    out = {"ethertype": kind}
    if kind == 0x0800 and len(frame) >= at + 20:
        size = (frame[at] & 15) * 4
        if size < 20:
            return out
        total = struct.unpack(">H", frame[at + 2 : at + 4])[0]
        end = min(len(frame), at + total) if total >= size else len(frame)
        out |= {"ip_version": 4, "ttl": frame[at + 8], "ip_proto": frame[at + 9], "src_ip": ".".join(map(str, frame[at + 12 : at + 16])), "dst_ip": ".".join(map(str, frame[at + 16 : at + 20]))}
        fragment = struct.unpack(">H", frame[at + 6 : at + 8])[0] & 0x1FFF
        return out if fragment else out | transport(out["ip_proto"], frame[at + size : end])
    if kind == 0x86DD and len(frame) >= at + 40:
        proto, end = frame[at + 6], min(len(frame), at + 40 + struct.unpack(">H", frame[at + 4 : at + 6])[0])
        out |= {"ip_version": 6, "ttl": frame[at + 7], "src_ip": str(ipaddress.IPv6Address(frame[at + 8 : at + 24])), "dst_ip": str(ipaddress.IPv6Address(frame[at + 24 : at + 40]))}
        at += 40
        while proto in IPV6_EXTENSIONS and at + 8 <= end:
            proto, at = frame[at], at + 8 + 8 * frame[at + 1]
        return out | {"ip_proto": proto} | transport(proto, frame[at:end])
    return out


def transport(proto: int, data: bytes) -> dict:
    if proto == 6 and len(data) >= 20:
        src, dst, seq, ack, words, flags, window = struct.unpack(">HHIIBBH", data[:16])
        return {"src_port": src, "dst_port": dst, "seq": seq, "ack": ack, "tcp_flags": flags & 63, "window": window, "payload": data[max(20, (words >> 4) * 4) :]}
    if proto == 17 and len(data) >= 8:
        src, dst, size = struct.unpack(">HHH", data[:6])
        return {"src_port": src, "dst_port": dst, "payload": data[8 : size if size >= 8 else len(data)]}
    return {"payload": data}


decoded = column(decode, DECODED)
