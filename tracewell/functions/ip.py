"""IP special-use classification: ordered range tables, native for columns of both families, and in Python for single addresses."""

from __future__ import annotations

import ipaddress

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracewell.functions.binding import let

#: Special-use IPv4 ranges. The first range in this order that holds an address names it.
IPV4_RANGES = [
    ("0.0.0.0", 8, "current-network"),
    ("10.0.0.0", 8, "private"),
    ("100.64.0.0", 10, "shared-address-space"),
    ("127.0.0.0", 8, "loopback"),
    ("169.254.0.0", 16, "link-local"),
    ("172.16.0.0", 12, "private"),
    ("192.0.0.0", 24, "special-purpose"),
    ("192.0.2.0", 24, "documentation"),
    ("192.31.196.0", 24, "special-purpose"),
    ("192.52.193.0", 24, "special-purpose"),
    ("192.88.99.0", 24, "deprecated-relay"),
    ("192.168.0.0", 16, "private"),
    ("192.175.48.0", 24, "special-purpose"),
    ("198.18.0.0", 15, "benchmark"),
    ("198.51.100.0", 24, "documentation"),
    ("203.0.113.0", 24, "documentation"),
    ("224.0.0.0", 4, "multicast"),
    ("240.0.0.0", 4, "reserved"),
]
#: Special-use IPv6 ranges, in the same sense.
IPV6_RANGES = [
    ("::", 96, "ipv4-compatible"),
    ("::ffff:0:0", 96, "ipv4-mapped"),
    ("64:ff9b::", 96, "translation"),
    ("64:ff9b:1::", 48, "translation-local"),
    ("100::", 64, "discard-only"),
    ("2001::", 23, "special-purpose"),
    ("2001:db8::", 32, "documentation"),
    ("2002::", 16, "deprecated-6to4"),
    ("2620:4f:8000::", 48, "special-purpose"),
    ("3fff::", 20, "documentation"),
    ("5f00::", 16, "segment-routing"),
    ("fc00::", 7, "unique-local"),
    ("fe80::", 10, "link-local"),
    ("fec0::", 10, "deprecated-site-local"),
    ("ff00::", 8, "multicast"),
]
#: A strict dotted quad: four decimals without leading zeros.
DOTTED = r"^(0|[1-9]\d{0,2})\.(0|[1-9]\d{0,2})\.(0|[1-9]\d{0,2})\.(0|[1-9]\d{0,2})$"
PUBLIC = "global"


def ipv4_number(address: Column) -> Column:
    """The address as a number; null unless it is a strict dotted quad."""

    def number(quad: Column) -> Column:
        value = F.aggregate(quad, F.lit(0).cast("long"), lambda n, q: n * 256 + q)
        return F.when(F.forall(quad, lambda q: q <= 255), value)

    return F.when(address.rlike(DOTTED), let(F.transform(F.split(address, r"\."), lambda q: q.try_cast("int")), number))


def ipv6_key(address: Column) -> Column:
    """The address as 32 hex digits; null unless it is an IPv6 address (a dotted quad may end it, a zone may not follow)."""
    empty = F.array().cast("array<string>")
    groups = lambda sides, k: F.when(F.coalesce(F.get(sides, F.lit(k)), F.lit("")) == "", empty).otherwise(F.split(F.get(sides, F.lit(k)), ":", -1))

    def spelled_out(text: Column) -> Column:
        """The dotted quad at the end as two groups."""
        low = ipv4_number(F.regexp_extract(text, r":(\d+\.\d+\.\d+\.\d+)$", 1))
        words = let(low, lambda n: F.concat(F.lower(F.hex(F.shiftright(n, 16))), F.lit(":"), F.lower(F.hex(n.bitwiseAND(0xFFFF)))))
        return F.when(text.rlike(r":\d+\.\d+\.\d+\.\d+$"), F.concat(F.regexp_replace(text, r"\d+\.\d+\.\d+\.\d+$", ""), words)).otherwise(text)

    def whole(sides: Column) -> Column:
        absent = 8 - F.size(groups(sides, 0)) - F.size(groups(sides, 1))
        fits = F.when(F.size(sides) == 1, absent == 0).otherwise((F.size(sides) == 2) & (absent >= 1))
        return F.when(fits, F.concat(groups(sides, 0), F.array_repeat(F.lit("0"), F.greatest(absent, F.lit(0))), groups(sides, 1)))

    valid = lambda found: F.when(F.forall(found, lambda g: g.rlike("^[0-9a-f]{1,4}$")), F.array_join(F.transform(found, lambda g: F.lpad(g, 4, "0")), ""))
    return F.when(address.contains(":"), let(let(F.split(spelled_out(F.lower(address)), "::", -1), whole), valid))


def ipv6_reason(key: Column) -> Column:
    """The first range that holds the address of a key, as one CASE over the fixed table."""
    out = F
    for start, bits, reason in IPV6_RANGES:
        low = int(ipaddress.IPv6Address(start))
        out = out.when(key.between(f"{low:032x}", f"{low + (1 << (128 - bits)) - 1:032x}"), reason)
    return F.when(key.isNotNull(), out.otherwise(PUBLIC))


def ipv6_text(key: Column) -> Column:
    """The shortest form of the address of a key: the longest run of two or more zero groups, the first of equals, is left out."""

    def shortest(text: Column) -> Column:
        out = F
        for n in range(8, 1, -1):
            run = rf"(?:^|:)0(?::0){{{n - 1}}}(?::|$)"
            out = out.when(text.rlike(run), F.regexp_replace(text, rf"^(.*?){run}(.*)$", "$1::$2"))
        return out.otherwise(text)

    return let(F.array_join(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda k: F.regexp_replace(F.substring(key, k * 4 + 1, F.lit(4)), "^0{1,3}", "")), ":"), shortest)


def ipv4_reason(number: Column) -> Column:
    """The first range that holds the number, as one CASE over the fixed table: no join at all."""
    out = F
    for start, bits, reason in IPV4_RANGES:
        low = int(ipaddress.IPv4Address(start))
        out = out.when(number.between(low, low + (1 << (32 - bits)) - 1), reason)
    return F.when(number.isNotNull(), out.otherwise(PUBLIC))


def parse_ipv6(text: str) -> int | None:
    if "%" in text or ":" not in text:
        return None
    try:
        return int(ipaddress.IPv6Address(text))
    except ValueError:
        return None


def parse_ipv4(text: str) -> int | None:
    parts = text.split(".")
    if len(parts) != 4 or not all(p.isascii() and p.isdigit() and (p == "0" or p[0] != "0") and int(p) < 256 for p in parts):
        return None
    return int.from_bytes(bytes(map(int, parts)), "big")


def classify(address: str | None) -> tuple[int, bool, str] | None:
    """(family, public, reason) of an address; None if it is not one."""
    if address is None:
        return None
    address = address[1:-1] if address[:1] == "[" and address[-1:] == "]" else address
    for family, value, table, width in ((4, parse_ipv4(address), IPV4_RANGES, 32), (6, parse_ipv6(address), IPV6_RANGES, 128)):
        if value is not None:
            for start, bits, reason in table:
                if value >> (width - bits) == int(ipaddress.ip_address(start)) >> (width - bits):
                    return family, False, reason
            return family, True, PUBLIC
    return None


def format_ipv6(value: int) -> str:
    return ipaddress.IPv6Address(value).compressed
