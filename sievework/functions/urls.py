"""URLs as Columns: normal form, class of host, redaction for messages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normal_url(url: Column) -> Column:
    """Trimmed, with a scheme, without closing slashes; null if blank."""
    flat = F.regexp_replace(F.trim(F.coalesce(url, F.lit(""))), "/+$", "")
    return F.when(flat == "", F.lit(None)).when(flat.rlike("^[a-zA-Z][a-zA-Z0-9+.-]*://"), flat).otherwise(F.concat(F.lit("http://"), flat))


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_replace(F.try_parse_url(url, F.lit("HOST")), r"^\[|\]$", ""))


def address(host: Column) -> Column:
    """An IPv4 address as a number; null for names."""
    parts = F.split(host, r"\.")
    valid = host.rlike(r"^[0-9]{1,3}(?:\.[0-9]{1,3}){3}$") & F.forall(parts, lambda p: p.try_cast("int") < 256)
    number = F.aggregate(F.transform(parts, lambda p: p.try_cast("bigint")), F.lit(0).cast("bigint"), lambda s, x: s * 256 + x)
    return F.when(valid, number)


def within(value: Column, base: str, bits: int) -> Column:
    start = 0
    for part in base.split("."):
        start = start * 256 + int(part)
    return value.between(start, start + (1 << (32 - bits)) - 1)


def host_class(url: Column) -> Column:
    """loopback, private, link_local, mdns, public_ip, dns, or none without a host."""
    host = host_of(url)
    ip = address(host)
    private = within(ip, "10.0.0.0", 8) | within(ip, "172.16.0.0", 12) | within(ip, "192.168.0.0", 16)
    return (
        F.when(host.isNull() | (host == ""), "none")
        .when((host == "localhost") | (host == "::1") | within(ip, "127.0.0.0", 8), "loopback")
        .when(private, "private")
        .when(within(ip, "169.254.0.0", 16) | host.startswith("fe80:"), "link_local")
        .when(ip.isNotNull(), "public_ip")
        .when(host.endswith(".local"), "mdns")
        .otherwise("dns")
    )


def safe_message(text: Column, most: int = 300) -> Column:
    """An error text for a log: addresses and bearer tokens masked, cut."""
    masked = F.regexp_replace(F.regexp_replace(text, r"https?://[^ \t\n\"')]+", "[url]"), r"(?i)(bearer) +[A-Za-z0-9._~+/=-]+", "$1 [token]")
    return F.when(F.length(masked) > most, F.concat(F.substring(masked, 1, most - 1), F.lit("…"))).otherwise(masked)


def event_data(line: Column) -> Column:
    """The payload of a server-sent event line; null for other lines and for the end mark."""
    data = F.trim(F.regexp_replace(line, "^data:", ""))
    return F.when(line.startswith("data:") & (data != "[DONE]"), data)
