"""IPv6 classes against the standard library, at every border of the registries."""

import ipaddress
import random

from pyspark.sql import functions as F

from emberlog.functions import addresses, scalars


def plain_class(text):
    try:
        a = ipaddress.ip_address(text)
    except ValueError:
        return None
    if a.is_loopback:
        return "loopback"
    if a.is_private:
        return "private"
    return "reserved" if a.is_reserved or a.is_multicast or a.is_link_local else "public"


def borders():
    rng = random.Random(2)
    for nets in addresses.REGISTRY.values():
        for n in map(ipaddress.ip_network, nets):
            first, last = int(n.network_address), int(n.broadcast_address)
            yield from (x for x in (first - 1, first, first + 1, rng.randint(first, last), last - 1, last, last + 1) if 0 <= x < 1 << 128)
    yield from (rng.getrandbits(128) for _ in range(200))
    yield from (0xFFFF00000000 + x for x in (0x7F000001, 0x0A000001, 0x08080808, 0xC0000201, 0xE0000001, 0xFFFFFFFF))


ODD = ["1.2.3.4", "127.0.0.1", "::ffff:10.0.0.1", "::ffff:8.8.8.8", "64:ff9b::1.2.3.4", "::1.2.3.4", "::", "1::", "::1:", ":1::", "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7:8:9", "1:2:3:4:5:6:7", "1::2::3", ":::", "12345::", "g::", "1:2:3:4:5:6:7::", "::2:3:4:5:6:7:8", "1:2:3:4:5:6:7:8::", "::ffff:1.2.3.256", "::ffff:1.2.3", "::ffff:01.2.3.4", "1.2.3.4::", "FE80::A", "not-an-ip", "", ":", "1:2:3:4:5:6:1.2.3.4", "1:2:3:4:5:6:7:1.2.3.4"]


def test_classes_are_those_of_the_registries(spark):
    texts = [s for x in borders() for a in [ipaddress.IPv6Address(x)] for s in (str(a), a.exploded, str(a).upper())] + ODD
    rows = spark.createDataFrame([(t,) for t in [*texts, None]], "ip string").select("ip", scalars.ip_class(F.col("ip")).alias("kind"), addresses.full_ipv6(F.col("ip")).alias("full")).collect()
    wrong = [(r["ip"], r["kind"], plain_class(r["ip"])) for r in rows if r["ip"] is not None and r["kind"] != plain_class(r["ip"])]
    assert wrong == []
    for r in rows:
        if r["full"] is not None:
            assert int(r["full"], 16) == int(ipaddress.IPv6Address(r["ip"]))
    assert rows[-1]["kind"] is None
