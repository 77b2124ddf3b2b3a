"""HTTP/1.x messages, bodies, credentials and files (RFC 9112, 7617, 7616)."""

from __future__ import annotations

import base64
import re
import zlib

from wirespark.dims import EXTENSIONS
from wirespark.functions.parsers import column
from wirespark.schemas import CREDENTIAL, HTTP_REQUEST, HTTP_RESPONSE

METHODS = ["GET", "POST", "PUT", "DELETE", "HEAD", "OPTIONS", "PATCH", "CONNECT", "TRACE"]
MOST_REQUEST, MOST_RESPONSE, MOST_INFLATED, MOST_RATIO = 10 << 20, 100 << 20, 10 << 20, 100


def is_request(data: bytes) -> bool:
    return any(data.startswith(m.encode() + b" ") for m in METHODS)


def is_response(data: bytes) -> bool:
    return data.startswith(b"HTTP/")


def _head(data: bytes) -> tuple[list[str], dict[str, str], bytes] | None:
    end = re.search(rb"\r?\n\r?\n", data)
    if not end:
        return None
    lines = re.split(r"\r?\n", data[: end.start()].decode("latin-1"))
    headers: dict[str, str] = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon or not name.strip():
            return None
        key = name.strip().lower()
        headers[key] = f"{headers[key]}, {value.strip()}" if key in headers else value.strip()
    return lines[0].split(" ", 2), headers, data[end.end() :]


def content_length(headers: dict[str, str]) -> int:
    value = headers.get("content-length", "")
    return int(value) if value.isdigit() else -1


def dechunked(body: bytes) -> bytes:
    out, at = [], 0
    while (end := body.find(b"\r\n", at)) >= 0:
        size = body[at:end].split(b";")[0].strip()
        if not re.fullmatch(rb"[0-9a-fA-F]{1,8}", size):
            break
        n = int(size, 16)
        if n == 0:
            break
        out.append(body[end + 2 : end + 2 + n])
        at = end + 2 + n + 2
    return b"".join(out)


def gunzipped(body: bytes) -> bytes | None:
    """None beyond the size or ratio that is safe, or if it isn't gzip."""
    inflate = zlib.decompressobj(31)
    try:
        out = inflate.decompress(body, MOST_INFLATED + 1)
    except zlib.error:
        return None
    return None if len(out) > MOST_INFLATED or len(out) > MOST_RATIO * max(1, len(body)) else out


def _body(headers: dict[str, str], rest: bytes, most: int) -> bytes:
    n = content_length(headers)
    if "chunked" in headers.get("transfer-encoding", "").lower():
        rest = dechunked(rest)
    elif n >= 0:
        rest = rest[:n]
    rest = rest[:most]
    if headers.get("content-encoding", "").lower() == "gzip":
        inflated = gunzipped(rest)
        return rest if inflated is None else inflated
    return rest


def request(data: bytes) -> dict | None:
    head = _head(data) if is_request(data) else None
    if head is None or len(head[0]) != 3 or not head[0][2].startswith("HTTP/"):
        return None
    (method, path, version), headers, rest = head
    n = content_length(headers)
    body = _body(headers, rest, MOST_REQUEST) if n > 0 or "transfer-encoding" in headers else b""
    return {"method": method, "path": path, "version": version, "headers": headers, "host": headers.get("host"), "user_agent": headers.get("user-agent"), "body": body}


def response(data: bytes) -> dict | None:
    head = _head(data) if is_response(data) else None
    if head is None or len(head[0]) < 2 or not head[0][1].isdigit():
        return None
    first, headers, rest = head
    return {"version": first[0], "status": int(first[1]), "reason": first[2] if len(first) > 2 else "", "headers": headers, "body": _body(headers, rest, MOST_RESPONSE)}


def credential(authorization: str) -> dict | None:
    """Basic: name and password; Digest: name; Bearer: the first 50 characters."""
    scheme, _, value = authorization.partition(" ")
    kind = scheme.lower()
    if kind == "basic":
        try:
            name, colon, secret = base64.b64decode(value.strip(), validate=True).decode("utf-8", "replace").partition(":")
        except ValueError:
            return None
        return {"scheme": "basic", "username": name, "secret": secret} if colon else None
    if kind == "digest":
        name = re.search(r'username="([^"]*)"', value)
        return {"scheme": "digest", "username": name[1], "secret": None} if name else None
    if kind == "bearer":
        return {"scheme": "bearer", "username": None, "secret": value[:50] + "..." if len(value) > 50 else value}
    return None


def file_name(path: str, headers: dict[str, str]) -> str:
    """From Content-Disposition, else the end of the path, else made from the type."""
    given = re.search(r'filename\*?="?(?:UTF-8\'\')?([^";]+)', headers.get("content-disposition", ""))
    if given:
        return given[1].strip()
    tail = path.split("?")[0].rsplit("/", 1)[-1]
    if "." in tail:
        return tail
    return "file" + EXTENSIONS.get(headers.get("content-type", "").split(";")[0].lower(), ".bin")


requests, responses, credentials = column(request, HTTP_REQUEST), column(response, HTTP_RESPONSE), column(credential, CREDENTIAL)
