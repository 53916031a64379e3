"""Addresses of IPv4 and IPv6 as strings of 128 bits, so that a network is a prefix."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

V4 = r"^(\d{1,3})\.(\d{1,3})\.(\d{1,3})\.(\d{1,3})$"


def _hex(ip: Column) -> Column:
    """32 hexadecimal digits; IPv4 as mapped into IPv6 (::ffff:0:0/96); null for what is no address."""
    octets = [F.regexp_extract(ip, V4, k).try_cast("int") for k in (1, 2, 3, 4)]
    v4 = F.when(F.greatest(*octets) <= 255, F.concat(F.lit("0" * 20 + "ffff"), *[F.lower(F.lpad(F.hex(o), 2, "0")) for o in octets]))
    low = F.lower(ip)
    short = F.contains(low, F.lit("::"))
    groups = lambda part: F.when(part == "", F.array().cast("array<string>")).otherwise(F.split(part, ":"))
    head, tail = groups(F.split_part(low, F.lit("::"), F.lit(1))), F.when(short, groups(F.split_part(low, F.lit("::"), F.lit(2)))).otherwise(F.array().cast("array<string>"))
    gap = F.greatest(8 - F.size(head) - F.size(tail), F.lit(0))
    eight = F.when(short, F.concat(head, F.array_repeat(F.lit("0"), gap), tail)).otherwise(head)
    good = (F.size(eight) == 8) & F.forall(eight, lambda g: g.rlike("^[0-9a-f]{1,4}$")) & (~short | (gap > 0)) & ~low.rlike(":::|::.*::")
    v6 = F.when(good, F.array_join(F.transform(eight, lambda g: F.lpad(g, 4, "0")), ""))
    return F.when(ip.rlike(V4), v4).when(F.contains(ip, F.lit(":")), v6)


def bits(ip: Column) -> Column:
    """128 characters 0 and 1; null for what is no address."""
    h = _hex(ip)
    half = lambda k: F.lpad(F.conv(F.substring(h, k, 16), 16, 2), 64, "0")
    return F.concat(half(1), half(17))


def prefix(network: Column) -> Column:
    """The bits of a network in CIDR notation, as many as its length says (96 more for IPv4); null for what is none."""
    ip = F.split_part(network, F.lit("/"), F.lit(1))
    n = F.split_part(network, F.lit("/"), F.lit(2)).try_cast("int")
    n = F.when(ip.rlike(V4), F.when(n.between(0, 32), n + 96)).otherwise(F.when(n.between(0, 128), n))
    return F.when(n == 0, "").otherwise(F.substring(bits(ip), F.lit(1), n))
