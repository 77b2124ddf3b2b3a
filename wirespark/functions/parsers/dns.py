"""DNS messages (RFC 1035): names with guarded compression, questions, answers."""

from __future__ import annotations

import ipaddress
import struct

from wirespark.dims import DNS_RCODES, DNS_TYPES
from wirespark.functions.parsers import array_of, column
from wirespark.schemas import DNS_RECORD

MOST_RECORDS, MOST_LABEL, MOST_NAME, MOST_JUMPS = 256, 63, 255, 10


class Malformed(ValueError):
    pass


def type_name(n: int) -> str:
    return DNS_TYPES.get(n, f"TYPE{n}")


def rcode_name(n: int) -> str:
    return DNS_RCODES.get(n, f"RCODE{n}")


def name_at(data: bytes, at: int) -> tuple[str, int]:
    """A name and where it ends. A pointer must go backwards, past the header, and chains of pointers are short."""
    labels, size, end, jumps = [], 0, None, 0
    while True:
        if at >= len(data):
            raise Malformed("name runs out")
        n = data[at]
        if n & 0xC0 == 0xC0:
            if at + 1 >= len(data):
                raise Malformed("pointer runs out")
            to, jumps = (n & 0x3F) << 8 | data[at + 1], jumps + 1
            end = at + 2 if end is None else end
            if to < 12 or to >= at or jumps > MOST_JUMPS:
                raise Malformed("bad pointer")
            at = to
            continue
        if n & 0xC0:
            raise Malformed("bad label")
        if n == 0:
            return ".".join(labels), at + 1 if end is None else end
        size += n + 1
        if n > MOST_LABEL or size > MOST_NAME or at + 1 + n > len(data):
            raise Malformed("label too long")
        labels.append(data[at + 1 : at + 1 + n].decode("latin-1"))
        at += 1 + n


def _value(data: bytes, kind: int, at: int, size: int) -> str:
    raw = data[at : at + size]
    if kind == 1 and size == 4:
        return ".".join(map(str, raw))
    if kind == 28 and size == 16:
        return str(ipaddress.IPv6Address(raw))
    if kind in (2, 5, 12):
        return name_at(data, at)[0]
    if kind == 15 and size > 2:
        return f"{struct.unpack('>H', raw[:2])[0]} {name_at(data, at + 2)[0]}"
    if kind == 6:
        first, then = name_at(data, at)
        return f"{first} {name_at(data, then)[0]}"
    if kind == 16:
        out, k = [], 0
        while k < size:
            out.append(raw[k + 1 : k + 1 + raw[k]].decode("latin-1"))
            k += 1 + raw[k]
        return "".join(out)
    return raw.hex()


def message(data: bytes) -> dict | None:
    """Header, questions and answers; an answer that can't be read ends the answers."""
    if len(data) < 12:
        return None
    ident, flags, qn, an = struct.unpack(">HHHH", data[:8])
    if max(qn, an) > MOST_RECORDS:
        return None
    at, questions, answers = 12, [], []
    try:
        for _ in range(qn):
            name, at = name_at(data, at)
            questions.append((name, struct.unpack(">H", data[at : at + 2])[0]))
            at += 4
    except (Malformed, struct.error):
        return None
    try:
        for _ in range(an):
            name, at = name_at(data, at)
            kind, _, ttl, size = struct.unpack(">HHIH", data[at : at + 10])
            at += 10
            if at + size > len(data):
                break
            answers.append({"name": name, "type": type_name(kind), "ttl": ttl, "data": _value(data, kind, at, size)})
            at += size
    except (Malformed, struct.error, IndexError):
        pass
    return {"transaction_id": ident, "is_response": bool(flags & 0x8000), "rcode": rcode_name(flags & 15), "questions": questions, "answers": answers}


def records(data: bytes, chase_cname: bool = False) -> list[dict]:
    """A row for each question, with the answers to its name (case doesn't matter); ttl is that of the first answer of any name."""
    m = message(data)
    out = []
    for name, kind in m["questions"] if m else []:
        names = {name.lower()}
        mine = []
        for a in m["answers"]:
            if a["name"].lower() in names:
                mine.append(a)
                if chase_cname and a["type"] == "CNAME":
                    names.add(a["data"].lower())
        out.append({
            "transaction_id": m["transaction_id"], "is_response": m["is_response"], "query_name": name, "query_type": type_name(kind), "rcode": m["rcode"], "answers": mine,
            "ttl": m["answers"][0]["ttl"] if m["answers"] else None,
        })
    return out


parsed = column(records, array_of(DNS_RECORD))
