"""TLS fingerprints from parsed hello fields: built-in functions over arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Version numbers.
VERSIONS = {0x0300: "SSL 3.0", 0x0301: "TLS 1.0", 0x0302: "TLS 1.1", 0x0303: "TLS 1.2", 0x0304: "TLS 1.3"}


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def is_grease(v: Column) -> Column:
    return v.bitwiseAND(0x0F0F) == 0x0A0A


def without_grease(v) -> Column:
    return F.filter(_c(v), lambda x: ~is_grease(x))


def tls_version(v: Column) -> Column:
    from wirespark.dims import mapped

    return mapped(v.cast("int"), VERSIONS, F.concat(F.lit("Unknown (0x"), F.lower(F.lpad(F.hex(v), 4, "0")), F.lit(")")))


def _dashed(v: Column) -> Column:
    return F.array_join(F.transform(v, lambda x: x.cast("string")), "-")


def ja3(version, ciphers, extensions, groups, points) -> Column:
    """The string; md5 of it is the hash."""
    return F.concat_ws(",", _c(version).cast("string"), *(_dashed(without_grease(x)) for x in (ciphers, extensions, groups)), _dashed(_c(points)))


def ja3s(version: Column, cipher: Column, extensions: Column) -> Column:
    return F.concat_ws(",", version.cast("string"), cipher.cast("string"), _dashed(extensions))


def _short(values: Column) -> Column:
    text = F.array_join(F.transform(F.array_sort(values), lambda x: F.lower(F.lpad(F.hex(x.cast("long")), 4, "0"))), ",")
    return F.left(F.sha2(text.cast("binary"), 256), F.lit(12))


def ja4(version, ciphers, extensions, server_name: Column, alpn: Column, supported: Column | None = None, quic: bool = False) -> Column:
    """supported: values of the supported_versions extension, whose highest is the version; without them the record's own is shown.

    The quic form shows one letter of the protocol, and no sign for a missing server name.
    """
    c, e, v = without_grease(ciphers), without_grease(extensions), _c(version)
    if supported is not None:
        v = F.coalesce(F.array_max(without_grease(supported)).cast("long"), v.cast("long"))
    shown = F.when(v == 0x0304, "13").when(v == 0x0303, "12").when(v == 0x0302, "11").when(v == 0x0301, "10").otherwise("00")
    name = F.when(server_name.isNotNull() & (server_name != ""), "d").otherwise("" if quic else "i")
    count = lambda a: F.lpad(F.least(F.size(a), F.lit(99)).cast("string"), 2, "0")
    first = F.coalesce(F.get(alpn, F.lit(0)), F.lit("00" if not quic else "0"))
    protocol = F.left(first, F.lit(1)) if quic else F.concat(F.left(first, F.lit(1)), F.right(first, F.lit(1)))
    hashed = F.filter(e, lambda x: ~x.isin(0, 16))
    return F.concat(F.lit("q" if quic else "t"), shown, name, count(c), count(e), protocol, F.lit("_"), _short(c), F.lit("_"), _short(hashed))
