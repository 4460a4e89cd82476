"""Joins of hosts and addresses with DNS answers and address blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from linkhop.functions.policy import IPV4, internal_host, ip_literal, ipv4_to_long, ipv6_hex, is_public_ipv4, is_public_ipv6_hex
from linkhop.sources.tables import BROADCAST_ROWS, broadcast_if_small, written


def _bits(address: Column, digits: Column) -> Column:
    """struct(family, hi, lo): the 128 bits of an address as two longs, those of IPv4 first of all; digits are the hex ones of IPv6.  Null for other texts."""
    n = ipv4_to_long(address)
    half = lambda at: F.conv(F.substring(digits, at, 16), 16, -10).cast("long")
    return F.when(n.isNotNull(), F.struct(F.lit(4).alias("family"), F.shiftleft(n, 32).alias("hi"), F.lit(0).cast("long").alias("lo"))).when(
        digits.isNotNull(), F.struct(F.lit(6).alias("family"), half(1).alias("hi"), half(17).alias("lo"))
    )


def _masked(hi: Column, lo: Column, prefix: int) -> tuple[Column, Column]:
    """The first `prefix` of 128 bits, the others 0."""
    cut = lambda x, n: x if n >= 64 else F.shiftleft(F.shiftright(x, 64 - n), 64 - n) if n > 0 else F.lit(0).cast("long")
    return cut(hi, prefix), cut(lo, prefix - 64)


def _with_bits(addresses: DataFrame, ip_col: str, six: bool = True) -> DataFrame:
    """addresses with _bits; only distinct IPv6 texts go through a helper, and without six none: theirs are null."""
    ip = F.col(ip_col)
    if not six:
        return addresses.withColumn("_bits", _bits(ip, F.lit(None).cast("string")))
    found = addresses.where(ip.contains(":")).select(ip.alias("_six")).distinct()
    if found.isEmpty():
        return addresses.withColumn("_bits", _bits(ip, F.lit(None).cast("string")))
    read = written(found.withColumn("_hex", ipv6_hex("_six")), "ipv6")
    return addresses.join(broadcast_if_small(read), F.when(ip.contains(":"), ip) == F.col("_six"), "left").withColumn("_bits", _bits(ip, F.col("_hex"))).drop("_six", "_hex")


def block_index(blocks: DataFrame) -> DataFrame:
    """(family, prefix, hi, lo, cidr) of blocks (cidr), IPv4 and IPv6, each once; bits behind the prefix don't count."""
    prefix = F.substring_index("cidr", "/", -1).cast("int")
    own = _with_bits(blocks.select("cidr", F.substring_index("cidr", "/", 1).alias("_at"), prefix.alias("prefix")), "_at")
    return written(own.groupBy("_bits.family", "prefix", "_bits.hi", "_bits.lo").agg(F.min("cidr").alias("cidr")).where("family is not null and prefix is not null"), "blocks")


def placed(addresses: DataFrame, blocks: DataFrame, ip_col: str = "ip") -> DataFrame:
    """addresses with family (4, 6 or null) and cidr, the smallest block (cidr) that holds each, null for none.

    Blocks of one prefix length are a table whose key is the masked address, so each length
    is one equi-join, of which there are at most 33 and 129; blocks may overlap, and there
    may be any number of them: those of a length are broadcast where they are few.
    """
    return _placed(addresses, block_index(blocks), ip_col, True)


def _placed(addresses: DataFrame, index: DataFrame, ip_col: str, families: bool) -> DataFrame:
    """placed() by a block index.  Without families, IPv6 texts are only read where there are IPv6 blocks; else their family is null."""
    lengths = [tuple(r) for r in index.groupBy("family", "prefix").count().collect()]  # at most 162 rows
    rows, names = _with_bits(addresses, ip_col, families or any(f == 6 for f, _, _ in lengths)), []
    for i, (family, prefix, n) in enumerate(sorted(lengths, key=lambda x: -x[1])):
        hi, lo = _masked(F.col("hi"), F.col("lo"), prefix)
        part = index.where((F.col("family") == family) & (F.col("prefix") == prefix)).groupBy(hi.alias("_hi"), lo.alias("_lo")).agg(F.min("cidr").alias(f"_cidr{i}"))
        own = F.col("_bits.family") == family
        hi, lo = (F.when(own, x) for x in _masked(F.col("_bits.hi"), F.col("_bits.lo"), prefix))
        rows = rows.join(F.broadcast(part) if n <= BROADCAST_ROWS else part, (hi == F.col("_hi")) & (lo == F.col("_lo")), "left").drop("_hi", "_lo")
        names.append(f"_cidr{i}")
    found = F.coalesce(*names) if names else F.lit(None).cast("string")
    return rows.select(*addresses.columns, F.col("_bits.family").alias("family"), found.alias("cidr"))


def range_of(addresses: DataFrame, ranges: DataFrame, ip_col: str = "ip") -> DataFrame:
    """addresses with cidr, the smallest of the blocks (cidr, ...) that holds each (null: none)."""
    return _placed(addresses, block_index(ranges), ip_col, False).drop("family")


def in_ranges(addresses: DataFrame, ranges: DataFrame, ip_col: str = "ip", how: str = "left_semi") -> DataFrame:
    """Rows whose address lies in a block (left_semi) or in none (left_anti); texts that aren't addresses lie in none."""
    found = range_of(addresses, ranges, ip_col)
    return found.where("cidr is not null" if how == "left_semi" else "cidr is null").drop("cidr")


def check_dns(hosts: DataFrame, dns: DataFrame | None, host_col: str = "host", suffixes: list[str] | None = None, blocks: DataFrame | None = None) -> DataFrame:
    """(host, status, error) for the distinct hosts; status is null where a host may be visited.

    An IP literal is judged by itself; a name is refused if internal, has no address, or has
    any address that isn't public.  dns: (host, addresses), or a row an address (host, ip);
    without it only literals and internal names are refused.  IPv4 is judged by columns, and
    only the distinct IPv6 texts by a helper.  suffixes replace the policy's own; blocks, a
    table (cidr) of IPv4 and IPv6 blocks of any number, are then all that isn't public.
    """
    distinct = hosts.select(hosts[host_col].alias("host")).where("host is not null").distinct()
    if dns is None:
        joined = distinct.select("host", F.lit(1).alias("known"), F.lit(True).alias("public"))
    else:
        listed = dns.select("host", F.explode_outer("addresses").alias("ip")) if "addresses" in dns.columns else dns.select("host", "ip")
        verdicts = _judged(listed, blocks).groupBy("host").agg(F.count("ip").alias("known"), F.bool_and("public").alias("public"))
        joined = distinct.join(verdicts, "host", "left")
    literal = ip_literal(F.col("host"))
    alone = _judged(joined.where(literal["family"].isNotNull()).select("host", literal["address"].alias("ip")), blocks)
    joined = joined.join(broadcast_if_small(written(alone.select("host", F.col("public").alias("own")), "literals")), "host", "left")
    own = F.coalesce("own", F.lit(False))
    status = (
        F.when(literal["family"].isNotNull(), F.when(~own, "BLOCKED"))
        .when(internal_host(F.col("host"), suffixes), "BLOCKED")
        .when(F.coalesce("known", F.lit(0)) == 0, "ERROR")
        .when(~F.col("public"), "BLOCKED")
    )
    error = (
        F.when(literal["family"].isNotNull(), F.concat(literal["address"], F.lit(" is a private or reserved address")))
        .when(internal_host(F.col("host"), suffixes), F.concat("host", F.lit(" is a local or internal host name")))
        .when(F.coalesce("known", F.lit(0)) == 0, F.lit("Request failed (ENOTFOUND)"))
        .otherwise(F.concat("host", F.lit(" resolves to a private or reserved address")))
    )
    return joined.select("host", status.alias("status"), F.when(status.isNotNull(), error).alias("error"))


def _judged(addresses: DataFrame, blocks: DataFrame | None) -> DataFrame:
    """(host, ip, public) of (host, ip): public is false for what is no address; by the policy's own blocks unless others are given."""
    if blocks is not None:
        return placed(addresses, blocks).select("host", "ip", (F.col("family").isNotNull() & F.col("cidr").isNull()).alias("public"))
    quad = F.col("ip").rlike(IPV4)
    v4 = addresses.where(F.col("ip").isNull() | quad | ~F.col("ip").contains(":")).select("host", "ip", is_public_ipv4(F.coalesce("ip", F.lit(""))).alias("public"))
    v6 = addresses.where(~quad & F.col("ip").contains(":"))
    judged = v6.select("ip").distinct().withColumn("hex", ipv6_hex("ip")).select("ip", is_public_ipv6_hex(F.col("hex")).alias("public"))
    return v4.unionByName(v6.join(judged, "ip").select("host", "ip", "public"))
