"""IPv4 and IPv6 text as Column expressions, so that addresses never leave the JVM."""

from __future__ import annotations

import ipaddress
from collections.abc import Callable

from pyspark.sql import Column, functions as F

OCTET = r"(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
IPV4 = rf"^{OCTET}\.{OCTET}\.{OCTET}\.{OCTET}$"

# Blocks counted as internal, and the narrower blocks inside them that are not.
INTERNAL_V4 = [
    "0.0.0.0/8", "10.0.0.0/8", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.0.0.0/24",
    "192.168.0.0/16", "198.18.0.0/15", "240.0.0.0/4",
]
EXTERNAL_V4 = ["192.0.0.9/32", "192.0.0.10/32"]
INTERNAL_V6 = [
    "::1/128", "::/128", "64:ff9b:1::/48", "100::/64", "2001::/23", "2001:db8::/32",
    "2002::/16", "fc00::/7", "fe80::/10",
]
EXTERNAL_V6 = [
    "2001:1::1/128", "2001:1::2/128", "2001:3::/32", "2001:4:112::/48", "2001:20::/28", "2001:30::/28",
]
MAPPED_V4 = "::ffff:0:0/96"


def ipv4_number(ip: Column) -> Column:
    """Dotted IPv4 text as a number; null when it is not one."""
    parts = F.split(ip, r"\.")
    total = F.lit(0).cast("bigint")
    for i in range(4):
        total = total + F.get(parts, F.lit(i)).try_cast("bigint") * 256 ** (3 - i)
    return F.when(ip.rlike(IPV4), total)


def _hex_pair(number: Column) -> Column:
    high, low = F.floor(number / 65536), number % 65536
    return F.concat(F.lower(F.hex(high)), F.lit(":"), F.lower(F.hex(low)))


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use(value)` with `value` computed once, however often `use` mentions it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


EMPTY = "array<string>"


def ipv6_groups(ip: Column) -> Column:
    """The eight 16-bit groups of IPv6 text without its zone; null when it is not one."""

    def dotted_tail(plain: Column) -> Column:
        # an IPv4 tail becomes two groups
        tail = F.regexp_extract(plain, r"([0-9.]*\.[0-9.]*)$", 1)
        return bind(tail, lambda t: F.when(t == "", plain).otherwise(
            F.concat(F.substr(plain, F.lit(1), F.length(plain) - F.length(t)), bind(ipv4_number(t), _hex_pair))))

    def groups(half: Column) -> Column:
        return F.when(half == "", F.array().cast(EMPTY)).otherwise(F.split(half, ":"))

    def joined(halves: Column) -> Column:
        left = groups(F.get(halves, F.lit(0)))
        right = groups(F.get(halves, F.lit(1)))
        return F.when(F.size(halves) == 1, left).when(F.size(halves) == 2, bind(
            F.struct(left.alias("l"), right.alias("r")),
            lambda h: F.when(F.size(h["l"]) + F.size(h["r"]) <= 7, F.concat(
                h["l"], F.array_repeat(F.lit("0"), 8 - F.size(h["l"]) - F.size(h["r"])), h["r"]))))

    def numbers(full: Column) -> Column:
        ok = (F.size(full) == 8) & F.forall(full, lambda g: g.rlike("^[0-9a-fA-F]{1,4}$"))
        return F.when(ok, F.transform(full, lambda g: F.conv(g, 16, 10).cast("int")))

    plain = F.regexp_replace(ip, r"%[^%]+$", "")
    parsed = bind(F.split(bind(plain, dotted_tail), "::"), lambda h: bind(joined(h), numbers))
    return F.when(ip.contains(":") & ~plain.contains("%"), parsed)


def ipv6_text(groups: Column) -> Column:
    """Canonical text: lower-case hex with the first longest run of zero groups as `::`."""

    def run_at(i: Column) -> Column:
        # length of the zero run starting at group i
        return bind(F.slice(groups, i + 1, 8 - i), lambda rest: F.coalesce(
            F.array_min(F.transform(rest, lambda g, j: F.when(g != 0, j))), F.size(rest)))

    def shortened(runs: Column) -> Column:
        return bind(F.struct(F.array_max(runs).alias("len"),
                             (F.array_position(runs, F.array_max(runs)).cast("int") - 1).alias("at")), cut)

    def cut(best: Column) -> Column:
        after = best["at"] + best["len"]
        hexes = F.transform(groups, lambda g: F.lower(F.hex(g)))
        return F.when(best["len"] < 2, F.array_join(hexes, ":")).otherwise(F.concat(
            F.array_join(F.slice(hexes, F.lit(1), best["at"]), ":"), F.lit("::"),
            F.array_join(F.slice(hexes, after + 1, 8 - after), ":")))

    return bind(F.transform(F.sequence(F.lit(0), F.lit(7)), run_at), shortened)


def canonical_ip(raw: Column) -> Column:
    """Valid address in canonical text, else null. Empty text and "-" count as missing."""
    ip = F.btrim(raw, F.lit(" \t\n\r\x0b\x0c"))
    zone = F.regexp_extract(ip, r"(%[^%]+)$", 1)
    six = bind(ipv6_groups(ip), lambda g: F.when(g.isNotNull(), F.concat(ipv6_text(g), zone)))
    return F.when(ip.rlike(IPV4), ip).when(ip.contains(":"), six)


def _in_v4(number: Column, nets: list[str]) -> Column:
    out = F.lit(False)
    for text in nets:
        net = ipaddress.ip_network(text)
        out = out | number.between(int(net.network_address), int(net.broadcast_address))
    return out


def _in_v6(groups: Column, nets: list[str]) -> Column:
    out = F.lit(False)
    for text in nets:
        net = ipaddress.ip_network(text)
        value, bits = int(net.network_address), net.prefixlen
        inside = F.lit(True)
        for i in range(8):
            width = min(16, max(0, bits - 16 * i))
            if width:
                want = (value >> (112 - 16 * i)) & 0xFFFF
                size = 1 << (16 - width)
                inside = inside & F.get(groups, F.lit(i)).between(want, want + size - 1)
        out = out | inside
    return out


def is_internal(ip: Column) -> Column:
    """Private, loopback or link-local; null when `ip` is no address."""
    documentation = ["192.0.2.0/24", "198.51.100.0/24", "203.0.113.0/24"]

    def four(number: Column) -> Column:
        return _in_v4(number, INTERNAL_V4) & ~_in_v4(number, EXTERNAL_V4)

    def six(groups: Column) -> Column:
        inner = F.get(groups, F.lit(6)).cast("bigint") * 65536 + F.get(groups, F.lit(7))
        mapped = bind(inner, lambda n: four(n) | _in_v4(n, documentation))
        own = _in_v6(groups, INTERNAL_V6) & ~_in_v6(groups, EXTERNAL_V6)
        return F.when(groups.isNotNull(), F.when(_in_v6(groups, [MAPPED_V4]), mapped).otherwise(own))

    return F.when(ip.rlike(IPV4), four(ipv4_number(ip))).when(ip.contains(":"), bind(ipv6_groups(ip), six))
