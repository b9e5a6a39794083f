"""Scalar functions as Column builders: cleaning, names, addresses, endpoints, durations, levels, hashes."""

from __future__ import annotations

import hashlib
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from .addresses import class_of, full_ipv6, mapped_ipv4

# -- fixed values: spellings that mean a level, severity ranks, methods, environments, agent families ------------------
LEVELS = ("TRACE", "DEBUG", "INFO", "NOTICE", "WARNING", "ERROR", "CRITICAL", "ALERT", "EMERGENCY", "UNKNOWN")
LEVEL_RANK = {"TRACE": 5, "DEBUG": 10, "INFO": 20, "NOTICE": 25, "WARNING": 30, "ERROR": 40, "CRITICAL": 50, "ALERT": 60, "EMERGENCY": 70, "UNKNOWN": 0}
LEVEL_SPELLINGS = {
    "WARN": "WARNING", "WARNINGS": "WARNING", "ERR": "ERROR", "ERRORS": "ERROR", "FATAL": "CRITICAL", "CRIT": "CRITICAL",
    "SEVERE": "CRITICAL", "EMERG": "EMERGENCY", "PANIC": "EMERGENCY", "VERBOSE": "DEBUG", "FINE": "DEBUG", "FINEST": "TRACE",
    "INFORMATION": "INFO", "INFORMATIONAL": "INFO", "NOTIFY": "NOTICE",
    "0": "EMERGENCY", "1": "ALERT", "2": "CRITICAL", "3": "ERROR", "4": "WARNING", "5": "NOTICE", "6": "INFO", "7": "DEBUG",
}
METHODS = ("GET", "HEAD", "POST", "PUT", "PATCH", "DELETE", "OPTIONS", "TRACE", "CONNECT", "OTHER")
ENVIRONMENTS = {
    "prod": "production", "production": "production", "live": "production", "stg": "staging", "stage": "staging", "staging": "staging",
    "uat": "staging", "dev": "development", "develop": "development", "development": "development", "local": "development", "test": "test", "qa": "test",
}
AGENTS = (
    ("edg", "Edge"), ("opr", "Opera"), ("chrome", "Chrome"), ("firefox", "Firefox"), ("safari", "Safari"), ("msie", "IE"), ("trident", "IE"),
    ("curl", "curl"), ("wget", "wget"), ("python-requests", "python-requests"), ("httpie", "HTTPie"), ("postman", "Postman"),
    ("go-http-client", "Go"), ("java", "Java"), ("okhttp", "OkHttp"), ("bot", "Bot"), ("crawler", "Bot"), ("spider", "Bot"),
)
ABSENT = ("-", "--", "n/a", "na", "none", "null", "nil", "undefined", "unknown", "?", "(null)", "")
UNITS_MS = {"ns": 1e-6, "us": 1e-3, "µs": 1e-3, "ms": 1.0, "s": 1000.0, "sec": 1000.0, "secs": 1000.0, "second": 1000.0, "seconds": 1000.0, "m": 60000.0, "min": 60000.0}
NAME_ENDINGS_MS = {"_ms": 1.0, "_millis": 1.0, "_milliseconds": 1.0, "_us": 0.001, "_micros": 0.001, "_ns": 1e-6, "_nanos": 1e-6, "_s": 1000.0, "_sec": 1000.0, "_secs": 1000.0, "_seconds": 1000.0}
SECONDS_NAMES = ("request_time", "upstream_time", "upstream_response_time")
SEVERITY_CUTS = ((90, "critical"), (70, "high"), (45, "medium"), (20, "low"))
# ----------------------------------------------------------------------------------------------------------------------


def lookup(table: dict[str, str], key: Column) -> Column:
    """Value of a small literal map; null where the key is missing."""
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])[key]


def first_match(cases: list[tuple[Column, Column]], otherwise: Column | None = None) -> Column:
    """One ordered conditional expression."""
    out = reduce(lambda acc, c: acc.when(*c), cases[1:], F.when(*cases[0]))
    return out if otherwise is None else out.otherwise(otherwise)


def empty_to_null(c: Column) -> Column:
    return F.when(F.length(c) > 0, c)


def level(raw: Column) -> Column:
    text = F.upper(F.trim(raw.cast("string")))
    return F.coalesce(F.when(text.isin(*LEVELS), text), lookup(LEVEL_SPELLINGS, text), F.lit("UNKNOWN"))


def level_rank(lvl: Column) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for p in LEVEL_RANK.items() for x in p])[lvl], F.lit(0))


def http_method(raw: Column) -> Column:
    text = F.upper(F.trim(raw))
    return F.when(F.length(text) > 0, F.when(text.isin(*METHODS), text).otherwise("OTHER"))


def severity(score: Column) -> Column:
    return first_match([(score >= cut, F.lit(name)) for cut, name in SEVERITY_CUTS], F.lit("info"))


def status_class(status: Column) -> Column:
    """``4xx`` by whole hundreds (no rounding)."""
    return F.concat(F.floor(status / 100).cast("string"), F.lit("xx"))


def scrub(raw: Column, limit: int | None = None) -> Column:
    """Escapes, control characters and odd spaces go; most texts hold none and are only trimmed."""
    t = F.regexp_replace(raw, r"\x1b\[[0-9;?]{0,32}[ -/]{0,8}[@-~]", "")
    t = F.regexp_replace(t, r"[\r\n\x0b\f\u0085\u2028\u2029]+", " ")
    t = F.regexp_replace(t, r"[\x00-\x08\x0e-\x1f\x7f]", "")
    t = F.regexp_replace(t, r"[ \t\u00a0\u1680\u2000-\u200b\u202f\u205f\u3000\ufeff]+", " ")
    t = F.trim(F.when(raw.rlike(r"^[!-~]*(?: [!-~]+)*$"), raw).otherwise(t))
    return F.left(t, F.lit(limit)) if limit else t


def present(text: Column) -> Column:
    """Markers of absence become null."""
    return F.when(~F.lower(text).isin(*ABSENT), text)


def clean_text(raw: Column, limit: int | None = None) -> Column:
    """Escapes, control characters and odd spaces go; markers of absence become null."""
    return present(scrub(raw, limit))


def compose(raw: Column) -> Column:
    """NFC, which Spark has no builtin for: an Arrow UDF that only non-ASCII values reach."""
    @pandas_udf("string")
    def nfc(s: pd.Series) -> pd.Series:
        return s.str.normalize("NFC")

    return F.when(raw.rlike(r"[^\x00-\x7f]"), nfc(F.when(raw.rlike(r"[^\x00-\x7f]"), raw))).otherwise(raw)


def repair_encoding(raw: Column) -> Column:
    """One round of UTF-8 read as Latin-1 is undone where that is loss-free and gives valid UTF-8."""
    suspect = raw.rlike("[Ãâ�Â]") & raw.rlike("Ã|â€|Â|�") & ~raw.rlike(r"[^\x{0}-\x{ff}]")
    narrow = F.encode(F.when(suspect, raw), "ISO-8859-1")
    wide = F.try_validate_utf8(narrow.cast("string"))
    return F.coalesce(F.when(suspect, wide), raw)


def service_name(raw: Column) -> Column:
    slug = F.regexp_replace(F.lower(F.trim(raw)), "[^a-z0-9]+", "-")
    return empty_to_null(F.left(F.regexp_replace(slug, "^-+|-+$", ""), F.lit(255)))


def host_name(raw: Column) -> Column:
    t = F.regexp_replace(F.lower(F.trim(raw)), r"\.+$", "")
    one_colon = (F.length(t) - F.length(F.replace(t, F.lit(":"), F.lit("")))) == 1
    return empty_to_null(F.left(F.when(one_colon & ~t.startswith("["), F.substring_index(t, ":", 1)).otherwise(t), F.lit(255)))


def environment(*hints: Column) -> Column:
    """First known token of the first hint that has one."""
    found = [F.filter(F.transform(F.split(F.lower(h), "[^a-z0-9]+"), lambda w: lookup(ENVIRONMENTS, w)), lambda e: e.isNotNull()) for h in hints]
    return F.coalesce(*[F.try_element_at(f, F.lit(1)) for f in found], F.lit("unknown"))


def endpoint_template(path: Column, most: int = 24) -> Column:
    """Segments that look like identifiers become typed placeholders."""
    p = F.when(path.startswith("/"), path).otherwise(F.concat(F.lit("/"), path))

    def segment(s: Column) -> Column:
        return first_match(
            [
                (F.length(s) == 0, s),
                (s.rlike(r"(?i)^v\d{1,3}$"), F.lower(s)),
                (s.rlike(r"(?i)^[0-9a-f]{8}-(?:[0-9a-f]{4}-){3}[0-9a-f]{12}$"), F.lit("{uuid}")),
                (s.rlike(r"^\d{1,19}$"), F.lit("{id}")),
                (s.rlike(r"(?i)^[0-9a-f]{16,64}$"), F.lit("{hash}")),
                (s.rlike(r"^[^@/]{1,64}@[^@/]{1,255}$"), F.lit("{email}")),
                (s.rlike(r"^(?=.*\d)[A-Za-z0-9_\-]{12,64}$"), F.lit("{token}")),
            ],
            F.left(F.lower(s), F.lit(64)),
        )

    joined = F.array_join(F.transform(F.slice(F.split(p, "/"), 1, most + 1), segment), "/")
    return F.when(F.length(path) > 0, F.coalesce(empty_to_null(F.regexp_replace(joined, "/+$", "")), F.lit("/")))


def agent_family(agent: Column) -> Column:
    low = F.lower(agent)
    return F.when(F.length(agent) > 0, first_match([(F.contains(low, F.lit(k)), F.lit(v)) for k, v in AGENTS], F.lit("Other")))


_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
IPV4 = rf"^{_OCTET}(?:\.{_OCTET}){{3}}$"
#: loopback, private and reserved ranges as (network, prefix length, class), first hit wins (fixed values: address registry)
RANGES = (
    ("127.0.0.0", 8, "loopback"), ("192.0.0.9", 32, "public"), ("192.0.0.10", 32, "public"), ("0.0.0.0", 8, "private"), ("10.0.0.0", 8, "private"), ("169.254.0.0", 16, "private"),
    ("172.16.0.0", 12, "private"), ("192.0.0.0", 24, "private"), ("192.0.0.170", 31, "private"), ("192.0.2.0", 24, "private"), ("192.168.0.0", 16, "private"),
    ("198.18.0.0", 15, "private"), ("198.51.100.0", 24, "private"), ("203.0.113.0", 24, "private"), ("240.0.0.0", 4, "private"), ("224.0.0.0", 4, "reserved"),
)


def ip_number(ip: Column) -> Column:
    parts = F.split(ip, r"\.")
    return reduce(lambda a, b: a * 256 + b, [parts[i].cast("long") for i in range(4)])


def ip_class(ip: Column) -> Column:
    """loopback, private, reserved or public by the special-purpose registries. IPv4-mapped addresses are loopback or private where their
    IPv4 part is, else reserved, as their block is."""

    def four(number: Column) -> Column:
        return first_match([(F.shiftright(number, 32 - bits) == sum(int(x) << (24 - 8 * i) for i, x in enumerate(net.split("."))) >> (32 - bits), F.lit(name)) for net, bits, name in RANGES], F.lit("public"))

    def six(full: Column) -> Column:
        mapped = mapped_ipv4(full)
        return F.when(mapped.isNotNull(), F.when(four(mapped).isin("loopback", "private"), four(mapped)).otherwise("reserved")).when(full.isNotNull(), class_of(full))

    # the full spelling is bound once by the lambda: repeating it at every comparison would blow the plan up
    return F.when(ip.rlike(IPV4), four(ip_number(ip))).when(F.contains(ip, F.lit(":")), F.get(F.transform(F.array(full_ipv6(ip)), six), F.lit(0)))


def ipv6_like(ip: Column) -> Column:
    return full_ipv6(ip).isNotNull()


def valid_ip(raw: Column) -> Column:
    """The first address of a forwarded chain, or null where it is none."""
    first = F.trim(F.substring_index(raw, ",", 1))
    return F.when(first.rlike(IPV4) | ipv6_like(first), F.lower(first))


def to_int(raw: Column) -> Column:
    return F.when(~F.lower(raw).isin("true", "false"), raw).try_cast("double").try_cast("bigint")


def duration_ms(raw: Column, name: str | None = None) -> Column:
    """Unit in the value, else unit in the field's name, else a guess by size."""
    shape = r"^\s*([0-9]{1,15}(?:\.[0-9]{1,9})?)\s*([A-Za-zµ]{0,7})\s*$"
    number = F.regexp_extract(raw, shape, 1).try_cast("double")
    unit = F.lower(F.regexp_extract(raw, shape, 2))
    by_unit = F.create_map(*[F.lit(x) for p in UNITS_MS.items() for x in p])[unit]
    low = (name or "").lower()
    times = 1000.0 if low in SECONDS_NAMES else next((v for k, v in NAME_ENDINGS_MS.items() if low.endswith(k)), None)
    plain = number * F.lit(times) if times is not None else F.when((number > 0) & (number < 10) & (number != F.floor(number)), number * 1000.0).otherwise(number)
    return F.when(F.length(unit) > 0, number * by_unit).otherwise(plain)


NONE = "\u0000none"


def fingerprint(*parts: Column) -> Column:
    """128 bits of SHA-256 over the parts, nulls marked, as lowercase hex."""
    marked = [F.coalesce(p.cast("string"), F.lit(NONE)) for p in parts]
    return F.left(F.sha2(F.concat_ws("\u001f", *marked), 256), F.lit(32))


def fingerprint_fields(names: list[str]) -> Column:
    """A fingerprint with the column names folded in; null only where every column is null."""
    parts = [x for n in names for x in (F.lit(n), F.col(n))]
    return F.when(F.coalesce(*[F.col(n).cast("string") for n in names]).isNotNull(), fingerprint(*parts))


def blake2b_id(*parts: Column) -> Column:
    """The same parts under BLAKE2b-128 (an Arrow UDF), for ids that must agree with other writers."""
    @pandas_udf("string")
    def digest(s: pd.Series) -> pd.Series:
        return s.map(lambda v: hashlib.blake2b(v.encode(), digest_size=16).hexdigest())

    return digest(F.concat_ws("\u001f", *[F.coalesce(p.cast("string"), F.lit(NONE)) for p in parts]))
