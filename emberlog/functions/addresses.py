"""IPv6 addresses natively: shape, full spelling, and class by the special-purpose registry."""

from __future__ import annotations

import ipaddress
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# -- fixed values: blocks of the special-purpose and reserved registries and their class; the longest prefix decides -------
REGISTRY = {
    "loopback": ("::1/128",),
    "private": ("::/128", "::ffff:0:0/96", "64:ff9b:1::/48", "100::/64", "2001::/23", "2001:db8::/32", "2002::/16", "fc00::/7", "fe80::/10"),
    "public": ("2001:1::1/128", "2001:1::2/128", "2001:3::/32", "2001:4:112::/48", "2001:20::/28", "2001:30::/28"),
    "reserved": ("::/8", "100::/8", "200::/7", "400::/6", "800::/5", "1000::/4", "4000::/3", "6000::/3", "8000::/3", "a000::/3", "c000::/3", "e000::/4", "f000::/5", "f800::/6", "fe00::/9", "ff00::/8"),
}
# ------------------------------------------------------------------------------------------------------------------------
DOTTED = r"(?:^|:)((?:\d{1,3}\.){3}\d{1,3})$"
MAPPED = "0" * 20 + "ffff"


def _intervals() -> list[tuple[str, str]]:
    """(first address as 32 hex digits, class) of the stretches of equal class, in order."""
    blocks = [(n.prefixlen, int(n.network_address), int(n.broadcast_address), kind) for kind, nets in REGISTRY.items() for n in map(ipaddress.ip_network, nets)]
    out: list[tuple[str, str]] = []
    for at in sorted({0, *(b[1] for b in blocks), *(b[2] + 1 for b in blocks if b[2] + 1 < 1 << 128)}):
        kind = max(((length, k) for length, first, last, k in blocks if first <= at <= last), default=(0, "public"))[1]
        if not out or out[-1][1] != kind:
            out.append((f"{at:032x}", kind))
    return out


INTERVALS = _intervals()


def _tail(ip: Column) -> Column:
    """An embedded dotted IPv4 part as two groups of hex digits."""
    dotted = F.regexp_extract(ip, DOTTED, 1)
    parts = F.split(dotted, r"\.")
    pair = lambda i: F.lpad(F.lower(F.hex(F.get(parts, F.lit(i)).try_cast("long") * 256 + F.get(parts, F.lit(i + 1)).try_cast("long"))), 4, "0")
    return F.when(dotted != "", F.concat(F.regexp_replace(ip, r"(?:\d{1,3}\.){3}\d{1,3}$", ""), pair(0), F.lit(":"), pair(2))).otherwise(ip)


def full_ipv6(ip: Column) -> Column:
    """The 32 hex digits of an IPv6 address in any spelling (without a zone), null where it is none."""
    low = F.lower(_tail(ip))
    octets = F.split(F.regexp_extract(ip, DOTTED, 1), r"\.")
    dotted_fits = ~F.contains(ip, F.lit(".")) | F.coalesce(ip.rlike(DOTTED) & F.forall(octets, lambda o: (o.try_cast("int") <= 255) & ~o.rlike("^0.")), F.lit(False))
    groups = lambda c: F.filter(F.split(c, ":"), lambda g: g != "")
    short = F.contains(low, F.lit("::"))
    left, right = groups(F.substring_index(low, "::", 1)), F.when(short, groups(F.substring_index(low, "::", -1))).otherwise(F.array().cast("array<string>"))
    used = F.size(left) + F.size(right)
    fits = dotted_fits & low.rlike("^[0-9a-f:]{2,39}$") & ~low.rlike("[0-9a-f]{5}|:::|::.*::|^:[^:]|[^:]:$") & F.when(short, used <= 7).otherwise(used == 8)
    filled = F.concat(left, F.array_repeat(F.lit("0"), 8 - used), right)
    return F.when(fits, F.array_join(F.transform(filled, lambda g: F.lpad(g, 4, "0")), ""))


def mapped_ipv4(full: Column) -> Column:
    """The IPv4 number inside an IPv4-mapped address of 32 hex digits, else null."""
    return F.when(full.startswith(MAPPED), F.conv(F.right(full, F.lit(8)), 16, 10).cast("long"))


def class_of(full: Column) -> Column:
    """Class of 32 hex digits: the last stretch that begins at or before them."""
    later_first = [(full >= F.lit(start), F.lit(kind)) for start, kind in reversed(INTERVALS)]
    return reduce(lambda acc, c: acc.when(*c), later_first[1:], F.when(*later_first[0]))
