"""SMB2 and SMB3 messages (MS-SMB2), NTLM names (MS-NLMP)."""

from __future__ import annotations

import struct
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from wirespark.dims import mapped
from wirespark.functions.parsers import column
from wirespark.schemas import SMB_HEADER

#: Commands, dialects, ciphers.
COMMANDS = dict(enumerate("NEGOTIATE SESSION_SETUP LOGOFF TREE_CONNECT TREE_DISCONNECT CREATE CLOSE FLUSH READ WRITE LOCK IOCTL CANCEL ECHO QUERY_DIRECTORY CHANGE_NOTIFY QUERY_INFO SET_INFO OPLOCK_BREAK".split()))
DIALECTS = {0x0202: "SMB 2.0.2", 0x0210: "SMB 2.1", 0x0300: "SMB 3.0", 0x0302: "SMB 3.0.2", 0x0311: "SMB 3.1.1", 0x02FF: "SMB 2.???"}
CIPHERS = {1: "AES-128-CCM", 2: "AES-128-GCM", 3: "AES-256-CCM", 4: "AES-256-GCM"}
MOST_ENCRYPTED = 16 << 20


def command_name(n: int) -> str:
    return COMMANDS.get(n, f"UNKNOWN({n})")


def _named(code: Column, names: dict[int, str]) -> Column:
    return mapped(code.cast("int"), names, F.concat(F.lit("Unknown (0x"), F.lpad(F.hex(code.cast("long")), 4, "0"), F.lit(")")))


def dialect_name(code: Column) -> Column:
    return _named(code, {k: v for k, v in DIALECTS.items() if k != 0x02FF})


def cipher_name(code: Column) -> Column:
    return _named(code, CIPHERS)


def unframed(data: bytes) -> bytes:
    """Without the 4 bytes of the session service."""
    return data[4:] if len(data) > 4 and data[0] == 0 and data[4:5] in (b"\xfe", b"\xfd", b"\xff") else data


def is_smb2(data: bytes) -> bool:
    return unframed(data).startswith(b"\xfeSMB")


def is_encrypted(data: bytes) -> bool:
    return unframed(data).startswith(b"\xfdSMB")


def header(data: bytes) -> dict | None:
    m = unframed(data)
    if len(m) < 64 or not m.startswith(b"\xfeSMB"):
        return None
    status, command, _, flags = struct.unpack("<IHHI", m[8:20])
    message_id, = struct.unpack("<Q", m[24:32])
    tree_id = None if flags & 2 else struct.unpack("<I", m[36:40])[0]
    session_id, = struct.unpack("<Q", m[40:48])
    return {"command": command, "status": status, "flags": flags, "message_id": Decimal(message_id), "tree_id": tree_id, "session_id": Decimal(session_id), "is_response": bool(flags & 1), "body": m[64:]}


def encrypted(data: bytes) -> dict | None:
    m = unframed(data)
    if len(m) < 52 or not m.startswith(b"\xfdSMB"):
        return None
    size, _, flags, session_id = struct.unpack("<IHHQ", m[36:52])
    return {"session_id": Decimal(session_id), "size": size, "flags": flags} if size <= MOST_ENCRYPTED else None


def _part(m: bytes, offset: int, size: int) -> bytes:
    """Offsets count from the header."""
    return m[offset : offset + size] if offset + size <= len(m) else b""


def operation(data: bytes) -> dict | None:
    """What a message asks or answers: command, and path, file_id, offset, data, dialects, user and domain where it has them."""
    h, m = header(data), unframed(data)
    if h is None:
        return None
    body, command, answer = h["body"], h["command"], h["is_response"]
    out = {"command": command_name(command), "is_response": answer, "message_id": h["message_id"], "session_id": h["session_id"], "tree_id": h["tree_id"], "status": h["status"]}
    try:
        if command == 0:
            out["dialects"] = [struct.unpack("<H", body[4:6])[0]] if answer else list(struct.unpack(f"<{struct.unpack('<H', body[2:4])[0]}H", body[36 : 36 + 2 * struct.unpack("<H", body[2:4])[0]]))
        elif command == 1:
            at, size = struct.unpack("<HH", body[4:8] if answer else body[12:16])
            out |= ntlm(_part(m, at, size)) or {}
        elif command == 3 and not answer:
            at, size = struct.unpack("<HH", body[4:8])
            out["path"] = _part(m, at, size).decode("utf-16-le", "replace")
        elif command == 5:
            if answer:
                out["file_id"] = body[64:80].hex()
            else:
                at, size = struct.unpack("<HH", body[44:48])
                out["path"] = _part(m, at, size).decode("utf-16-le", "replace")
        elif command == 6 and not answer:
            out["file_id"] = body[8:24].hex()
        elif command == 8:
            if answer:
                size, = struct.unpack("<I", body[4:8])
                out["data"] = _part(m, body[2], size)
            else:
                size, offset = struct.unpack("<IQ", body[4:16])
                out |= {"file_id": body[16:32].hex(), "offset": offset, "length": size}
        elif command == 9 and not answer:
            at, size, offset = struct.unpack("<HIQ", body[2:16])
            out |= {"file_id": body[16:32].hex(), "offset": offset, "length": size, "data": _part(m, at, size)}
        elif command == 11 and not answer:
            out["control"] = struct.unpack("<I", body[4:8])[0]
    except (struct.error, IndexError):
        pass
    return out


def ntlm(blob: bytes) -> dict | None:
    """User and domain of an authenticate message."""
    at = blob.find(b"NTLMSSP\0")
    m = blob[at:] if at >= 0 else b""
    if len(m) < 44 or struct.unpack("<I", m[8:12])[0] != 3:
        return None

    def text(place: int) -> str:
        size, _, offset = struct.unpack("<HHI", m[place : place + 8])
        return m[offset : offset + size].decode("utf-16-le", "replace")

    return {"domain": text(28), "user": text(36)}


headers = column(header, SMB_HEADER)
