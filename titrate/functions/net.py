"""IP address literals as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import clip, let

IPV4 = r"\A[0-9]{1,3}(?:\.[0-9]{1,3}){3}\z"


def ipv4_number(address: Column) -> Column:
    """Dotted quad as a LONG; NULL when it is not one or an octet exceeds 255."""

    def number(octets: Column) -> Column:
        at = lambda i: F.get(octets, F.lit(i))
        value = at(0).cast("long") * 16777216 + at(1) * 65536 + at(2) * 256 + at(3)
        return F.when(F.array_max(octets) <= 255, value)

    octets = F.transform(F.split(address, r"\."), lambda o: o.try_cast("int"))
    return F.when(address.rlike(IPV4), let(octets, number))


def ipv4_text(number: Column) -> Column:
    parts = [F.pmod(F.shiftright(number, s), F.lit(256)).cast("string") for s in (24, 16, 8, 0)]
    return F.concat_ws(".", *parts)


def _ipv6_groups(address: Column) -> Column:
    """Eight integer groups of an IPv6 literal, or NULL."""
    tail4 = F.regexp_extract(address, r":([0-9]+\.[0-9]+\.[0-9]+\.[0-9]+)\z", 1)
    embedded = ipv4_number(tail4)
    hex_tail = F.concat(
        F.lower(F.hex(F.shiftright(embedded, 16))), F.lit(":"), F.lower(F.hex(F.pmod(embedded, F.lit(65536))))
    )
    text = F.when(tail4 == "", address).otherwise(
        F.concat(F.substring(address, F.lit(1), F.length(address) - F.length(tail4)), hex_tail)
    )
    halves = F.split(text, "::")
    left = F.filter(F.split(F.get(halves, F.lit(0)), ":"), lambda g: g != "")
    right = F.filter(F.split(F.coalesce(F.get(halves, F.lit(1)), F.lit("")), ":"), lambda g: g != "")
    gap = F.lit(8) - F.size(left) - F.size(right)
    compressed = F.size(halves) == 2
    fill = F.when(compressed & (gap >= 1), gap).otherwise(F.lit(0))
    groups = F.concat(left, F.array_repeat(F.lit("0"), fill), right)
    lone_colon = text.rlike(r"\A:(?!:)|(?<!:):\z|:::|::.*::")
    ok = (
        (F.size(groups) == 8)
        & (F.size(halves) <= 2)
        & ~lone_colon
        & F.forall(groups, lambda g: g.rlike(r"\A[0-9a-fA-F]{1,4}\z"))
    )
    return F.when(ok, F.transform(groups, lambda g: F.conv(g, 16, 10).cast("int")))


def canonical_ip(value: Column) -> Column:
    """One spelling per address; leading zeros read as decimal; host names give NULL."""
    return let(clip(value), _canonical_ip)


def _canonical_ip(address: Column) -> Column:
    v4 = let(ipv4_number(address), lambda n: F.when(n.isNotNull(), ipv4_text(n)))
    is_v6 = address.contains(":") & address.rlike(r"\A[0-9a-fA-F:.]+\z")
    return F.coalesce(v4, F.when(is_v6, let(_ipv6_groups(address), _ipv6_text)))


def _ipv6_text(groups: Column) -> Column:
    mapped = (
        F.forall(F.slice(groups, 1, 5), lambda g: g == 0) & (F.get(groups, F.lit(5)) == 65535)
    )
    mapped_v4 = F.get(groups, F.lit(6)).cast("long") * 65536 + F.get(groups, F.lit(7))
    v6 = F.array_join(F.transform(groups, lambda g: F.lower(F.hex(g))), ":")
    return F.when(mapped, ipv4_text(mapped_v4)).otherwise(v6)


def address_bits(address: Column) -> Column:
    """The 32 or 128 bits of an address in its canonical spelling (see ``canonical_ip``) as a text of 0 and 1."""
    return let(address, _address_bits)


def _address_bits(address: Column) -> Column:
    v4 = let(ipv4_number(address), lambda n: F.when(n.isNotNull(), F.lpad(F.bin(n), 32, "0")))
    v6 = let(_ipv6_groups(address), lambda groups: F.when(
        groups.isNotNull(), F.array_join(F.transform(groups, lambda g: F.lpad(F.bin(g.cast("long")), 16, "0")), "")))
    return F.coalesce(v4, v6)


def cidr_range(entry: Column) -> Column:
    """(family, low, high, bits) of an IPv4 or IPv6 address or CIDR range, bounds as texts of 0 and 1; NULL for an entry that is neither."""

    def of_pieces(p: Column) -> Column:
        declared = F.when(F.size(p) > 1, clip(F.get(p, F.lit(1))).try_cast("int"))
        return F.struct(address_bits(canonical_ip(F.get(p, F.lit(0)))).alias("base"), declared.alias("declared"), (F.size(p) == 1).alias("single"))

    def bounds(b: Column) -> Column:
        width = F.length(b["base"])
        bits = F.when(b["single"], width).otherwise(b["declared"])
        prefix = F.substring(b["base"], F.lit(1), bits)
        return F.when(
            b["base"].isNotNull() & bits.between(0, width),
            F.struct(F.when(width == 32, 4).otherwise(6).alias("family"), F.rpad(prefix, width, F.lit("0")).alias("low"),
                     F.rpad(prefix, width, F.lit("1")).alias("high"), bits.alias("bits")),
        )

    return let(let(F.split(clip(entry), "/", 2), of_pieces), bounds)
