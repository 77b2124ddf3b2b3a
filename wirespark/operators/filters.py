"""Filters. All are plain predicates, so those on stored columns reach the scan."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def is_ipv4(column: str = "src_ip") -> Column:
    return ~F.contains(F.col(column), F.lit(":"))


def bpf(expression: str) -> Column:
    """tcp, udp, icmp, [src|dst] port N, [src|dst] host A, combined by and, or, not and parentheses; anything else is refused."""
    tokens = re.findall(r"\(|\)|[^\s()]+", expression.lower().replace("&&", " and ").replace("||", " or ").replace("!", " not "))
    at = 0

    def peek() -> str | None:
        return tokens[at] if at < len(tokens) else None

    def take() -> str:
        nonlocal at
        if at >= len(tokens):
            raise ValueError(f"filter ends early: {expression!r}")
        at += 1
        return tokens[at - 1]

    def either() -> Column:
        left = both()
        while peek() == "or":
            take()
            left = left | both()
        return left

    def both() -> Column:
        left = one()
        while peek() == "and":
            take()
            left = left & one()
        return left

    def one() -> Column:
        word = take()
        if word == "not":
            return ~one()
        if word == "(":
            inner = either()
            if take() != ")":
                raise ValueError(f"missing ) in {expression!r}")
            return inner
        if word in ("tcp", "udp", "icmp"):
            proto = (F.col("ip_proto") == {"tcp": 6, "udp": 17, "icmp": 1}[word]) & is_ipv4()
            return proto & one() if peek() in ("port", "src", "dst") else proto
        sides = ["src", "dst"] if word not in ("src", "dst") else [word]
        word = word if len(sides) == 2 else take()
        if word == "port":
            number = take()
            if not number.isdigit() or int(number) > 65535:
                raise ValueError(f"not a port: {number!r}")
            tests = [F.col(f"{s}_port") == int(number) for s in sides]
        elif word == "host":
            address = take()
            if not re.fullmatch(r"(\d{1,3}\.){3}\d{1,3}", address) or any(int(x) > 255 for x in address.split(".")):
                raise ValueError(f"not an IPv4 address: {address!r}")
            tests = [F.col(f"{s}_ip") == address for s in sides]
        else:
            raise ValueError(f"cannot filter by {word!r}")
        return tests[0] | tests[1] if len(tests) == 2 else tests[0]

    out = either()
    if peek() is not None:
        raise ValueError(f"cannot read {peek()!r} in {expression!r}")
    return out


def five_tuple(src_ip=None, dst_ip=None, src_port=0, dst_port=0, protocol=0) -> Column:
    """A conjunction in which what is empty or 0 matches all."""
    out = F.lit(True)
    for name, value in (("src_ip", src_ip), ("dst_ip", dst_ip), ("src_port", src_port), ("dst_port", dst_port), ("ip_proto", protocol)):
        if value:
            out = out & (F.col(name) == value)
    return out


def ui_packets(packets: DataFrame, search="", protocols=(), src_ip="", dst_ip="", port=None, since=None, until=None) -> DataFrame:
    """Search in either address or the lower-case protocol; both ends of the time range are in."""
    out = packets
    if search:
        s = search.lower()
        out = out.filter(F.col("src_ip").contains(s) | F.col("dst_ip").contains(s) | F.lower("protocol").contains(s))
    if protocols:
        out = out.filter(F.col("protocol").isin(*protocols))
    if src_ip:
        out = out.filter(F.col("src_ip").contains(src_ip))
    if dst_ip:
        out = out.filter(F.col("dst_ip").contains(dst_ip))
    if port is not None:
        out = out.filter((F.col("src_port") == port) | (F.col("dst_port") == port))
    if since is not None:
        out = out.filter(F.col("ts_nano") >= since)
    return out if until is None else out.filter(F.col("ts_nano") <= until)


def ui_flows(flows: DataFrame, search="", protocols=(), least_bytes=None, most_bytes=None) -> DataFrame:
    out = flows
    if search:
        s = search.lower()
        hit = F.col("src_ip").contains(s) | F.col("dst_ip").contains(s) | F.lower("protocol").contains(s)
        for more in ("server_name", "http_host"):
            if more in flows.columns:
                hit = hit | F.coalesce(F.lower(more).contains(s), F.lit(False))
        out = out.filter(hit)
    if protocols:
        out = out.filter(F.col("protocol").isin(*protocols))
    if least_bytes is not None:
        out = out.filter(F.col("bytes") >= least_bytes)
    return out if most_bytes is None else out.filter(F.col("bytes") <= most_bytes)


def ui_alerts(alerts: DataFrame, search="", severities=()) -> DataFrame:
    out = alerts.filter(F.col("severity").isin(*severities)) if severities else alerts
    s = search.lower()
    return out.filter(F.lower("title").contains(s) | F.lower("description").contains(s)) if s else out


def ui_second_search(packets: DataFrame, text: str) -> DataFrame:
    """Addresses as typed, protocol without case."""
    return packets.filter(F.col("src_ip").contains(text) | F.col("dst_ip").contains(text) | F.lower("protocol").contains(text.lower()))


def throttle(events: DataFrame, nanos: int = 100_000_000, per: str = "event_type") -> DataFrame:
    """The first event of each type and tick."""
    tick = F.floor(F.col("ts_nano") / F.lit(nanos)).cast("long")
    first = events.groupBy(F.col(per), tick.alias("tick")).agg(F.min("packet_id").alias("packet_id"), F.count("*").alias("of"))
    return first
