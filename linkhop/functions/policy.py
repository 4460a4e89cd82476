"""Which ports, host names and addresses links may lead to."""

from __future__ import annotations

import ipaddress

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

#: Ports that browsers refuse.
BAD_PORTS = [
    0, 1, 7, 9, 11, 13, 15, 17, 19, 20, 21, 22, 23, 25, 37, 42, 43, 53, 69, 77, 79, 87, 95, 101, 102,
    103, 104, 109, 110, 111, 113, 115, 117, 119, 123, 135, 137, 139, 143, 161, 179, 389, 427, 465,
    512, 513, 514, 515, 526, 530, 531, 532, 540, 548, 554, 556, 563, 587, 601, 636, 989, 990, 993,
    995, 1719, 1720, 1723, 2049, 3659, 4045, 4190, 5060, 5061, 6000, 6566, 6665, 6666, 6667, 6668,
    6669, 6679, 6697, 10080,
]
#: Names that only mean something inside a private network.
INTERNAL_SUFFIXES = ["localhost", "local", "internal", "home.arpa", "localdomain", "lan", "home", "corp", "intranet"]
#: IPv4 blocks that aren't on the public internet.
PRIVATE_IPV4 = [
    "0.0.0.0/8", "10.0.0.0/8", "100.64.0.0/10", "127.0.0.0/8", "168.63.129.16/32", "169.254.0.0/16",
    "172.16.0.0/12", "192.0.0.0/24", "192.0.2.0/24", "192.88.99.0/24", "192.168.0.0/16", "198.18.0.0/15",
    "198.51.100.0/24", "203.0.113.0/24", "224.0.0.0/4", "240.0.0.0/4",
]
#: Of IPv6 only this block is public, less the special blocks in it.
GLOBAL_IPV6 = "2000::/3"
SPECIAL_IPV6 = ["2001::/23", "2001:db8::/32", "2002::/16", "3fff::/20"]

_BYTE = "(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
IPV4 = rf"^{_BYTE}(\.{_BYTE}){{3}}$"


def bad_port(port: Column) -> Column:
    return F.coalesce(port.isin(BAD_PORTS), F.lit(False))


def bad_port_error(port: Column) -> Column:
    return F.when(bad_port(port), F.concat(F.lit("Port "), port.cast("string"), F.lit(" is not allowed")))


def internal_host(host: Column, suffixes: list[str] | None = None) -> Column:
    """Without its trailing dots, a name without a dot, or one of the suffixes or below it."""
    name = F.lower(F.rtrim(host, F.lit(".")))
    ends = "|".join(s.replace(".", r"\.") for s in suffixes or INTERNAL_SUFFIXES)
    return ~name.contains(".") | name.rlike(rf"(^|\.)({ends})$")


def ip_literal(host: Column) -> Column:
    """struct(address, family): the host without brackets, and 4, 6 or null for a name."""
    bare = F.regexp_replace(host, r"^\[(.*)\]$", "$1")
    family = F.when(bare.rlike(IPV4), 4).when(host.startswith("[") | bare.contains(":"), 6)
    return F.struct(bare.alias("address"), family.alias("family"))


def ipv4_to_long(ip: Column) -> Column:
    """The number of a dotted quad; null for other texts."""
    part = lambda i: F.split(ip, r"\.")[i].cast("long")
    return F.when(ip.rlike(IPV4), part(0) * 16777216 + part(1) * 65536 + part(2) * 256 + part(3))


def ipv4_bounds(cidr: str) -> tuple[int, int]:
    net = ipaddress.ip_network(cidr)
    return int(net.network_address), int(net.broadcast_address)


def ranges_ipv4(spark: SparkSession, blocks: list[str] | None = None) -> DataFrame:
    """(cidr, lo, hi) of a handful of blocks."""
    return spark.createDataFrame([(b, *ipv4_bounds(b)) for b in blocks or PRIVATE_IPV4], "cidr string, lo long, hi long")


def _bound(value: Column, use) -> Column:
    """use(value) with the value computed once, however often `use` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def is_public_ipv4(ip: Column, blocks: list[str] | None = None) -> Column:
    def outside(n: Column) -> Column:
        private = F.lit(False)
        for b in blocks or PRIVATE_IPV4:
            private = private | n.between(*ipv4_bounds(b))
        return ~private

    return F.coalesce(_bound(ipv4_to_long(ip), outside), F.lit(False))


@F.pandas_udf(T.StringType())
def ipv6_hex(ips: pd.Series) -> pd.Series:
    """32 hex digits, ordered like the addresses; null for what isn't IPv6 or has a zone."""

    def one(ip: str | None) -> str | None:
        try:
            return None if ip is None or "%" in ip else f"{int(ipaddress.IPv6Address(ip)):032x}"
        except ValueError:
            return None

    return ips.map(one)


def _hex_bounds(cidr: str) -> tuple[str, str]:
    net = ipaddress.ip_network(cidr)
    return f"{int(net.network_address):032x}", f"{int(net.broadcast_address):032x}"


def is_public_ipv6_hex(digits: Column) -> Column:
    """Of the 32 hex digits of an address; they belong in a column of their own, as a helper makes them."""
    inside = digits.between(*_hex_bounds(GLOBAL_IPV6))
    for block in SPECIAL_IPV6:
        inside = inside & ~digits.between(*_hex_bounds(block))
    return F.coalesce(inside, F.lit(False))


def is_public(ip: Column) -> Column:
    """Whether an address is on the public internet; other texts aren't."""
    return F.when(ip.rlike(IPV4), is_public_ipv4(ip)).when(ip.contains(":"), is_public_ipv6_hex(ipv6_hex(ip))).otherwise(False)
