"""Seeded synthetic logs as an expression over ``spark.range``: any size, the same rows for the same seed.

Daily traffic curve, one error, one latency and one traffic incident, an attacking address, 1 % malformed lines, 2 % repeats,
0.3 % times that can't be read, and credentials in messages: at ``credentials`` evenly spaced rows, and by chance elsewhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SERVICES = ("api-gateway", "auth", "payment", "search", "catalog", "orders", "notifications", "billing", "frontend")
PATHS = ("/api/v1/users/{n}", "/api/v1/orders/{n}", "/api/v1/search", "/login", "/health", "/api/v2/items/{n}/reviews")

#: made-up secrets that must never reach a store
CREDENTIALS = ("password=Wint3r-storm", "api_key=demo-0123456789", "Authorization: Bearer demo.bearer-value_42", "reported by demo.person@example.org")
BAD_TIMES = ("yesterday", "2024-13-45T99:00:00Z", "0000-00-00")
BURST = (0.5, 0.01)  # where the traffic incident begins, and how long it lasts, as shares of the span


def _pick(values: tuple, u: Column) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), F.floor(u * len(values)).cast("int"))


def records(spark: SparkSession, count: int, *, seed: int = 1337, start: str = "2024-01-01 00:00:00", hours: float = 24.0, duplicates: float = 0.02, burst: float = 0.05, credentials: int = 0, leaks: float = 0.001) -> DataFrame:
    """Structured events; ``id`` of a repeat is that of the row before. ``burst`` is the share of rows in the traffic incident,
    ``secret`` the credential that a row's message leaks, or null."""
    unit = lambda k: (F.pmod(F.xxhash64("id", F.lit(seed), F.lit(k)), F.lit(1 << 30)) / float(1 << 30))
    rows = spark.range(count).withColumn("n", F.col("id"))
    rows = rows.withColumn("id", F.when((unit("dup") < duplicates) & (F.col("id") > 0), F.col("id") - 1).otherwise(F.col("id")))
    # time runs faster where the daily curve is low: rows are dense around midday
    x = F.col("id") / float(max(count, 1))
    t = x - 0.6 * F.sin(2 * 3.141592653589793 * x) / (2 * 3.141592653589793)
    t = F.when(unit("burst") < burst, BURST[0] + BURST[1] * unit("where")).otherwise(t)
    every = max(count // credentials, 1) if credentials else 0
    due = (F.col("id") % every == 0) & (F.col("id") < every * credentials) if every else F.lit(False)
    secret = F.when(due, F.get(F.array(*map(F.lit, CREDENTIALS)), (F.floor(F.col("id") / max(every, 1)) % len(CREDENTIALS)).cast("int"))).when(unit("leak") < leaks, _pick(CREDENTIALS, unit("which")))
    at = F.timestamp_micros((F.unix_micros(F.lit(start).cast("timestamp")) + t * hours * 3600e6).cast("long"))
    error_time, slow_time = t.between(0.55, 0.58), t.between(0.75, 0.78)
    attack = unit("attack") < F.when(t.between(0.3, 0.33), 0.15).otherwise(0.0)
    status = F.when(attack, F.when(unit("s") < 0.7, 401).otherwise(404)).when(unit("s") < F.when(error_time, 0.4).otherwise(0.01), 500).when(unit("s") < 0.05, 404).when(unit("s") < 0.08, 301).otherwise(200)
    return rows.select(
        "n", "id", at.alias("timestamp"), _pick(SERVICES, unit("svc")).alias("service"), F.concat(F.lit("host-"), F.floor(unit("host") * 12).cast("string")).alias("hostname"),
        F.when(attack, "198.51.100.9").otherwise(F.concat(F.lit("203.0.114."), F.floor(unit("ip") * 250 + 1).cast("string"))).alias("client_ip"),
        F.concat(F.lit("user"), F.floor(unit("user") * 500).cast("string")).alias("user_id"), _pick(("GET", "GET", "GET", "POST", "PUT", "DELETE"), unit("m")).alias("method"),
        F.when(attack, F.lit("/.env")).otherwise(F.replace(_pick(PATHS, unit("p")), F.lit("{n}"), F.floor(unit("n") * 10000).cast("string"))).alias("path"), status.alias("status"),
        F.round(F.exp(3.5 + 1.2 * (unit("l1") + unit("l2") + unit("l3") - 1.5)) * F.when(slow_time, 8.0).otherwise(1.0), 3).alias("duration_ms"), F.floor(unit("b") * 50000).alias("bytes"),
        F.when(attack, "sqlmap/1.7").otherwise(_pick(("Mozilla/5.0 Chrome/120.0", "Mozilla/5.0 Firefox/121.0", "curl/8.1"), unit("ua"))).alias("user_agent"), unit("bad").alias("_bad"), secret.alias("secret"), unit("late").alias("_late"), _pick(BAD_TIMES, unit("odd")).alias("_odd"),
    )


def lines(spark: SparkSession, count: int, fmt: str = "json", malformed: float = 0.01, bad_times: float = 0.003, **options) -> DataFrame:
    """Text lines (value): json, access or logfmt. Secrets go into the message (the user agent of an access line)."""
    r = records(spark, count, **options)
    r = r.withColumn("user_agent", F.concat_ws(" ", "user_agent", "secret") if fmt == "access" else F.col("user_agent"))
    timed = lambda pattern: F.when(F.col("_late") < bad_times, F.col("_odd")).otherwise(F.date_format("timestamp", pattern))
    iso = timed("yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    lvl = F.when(F.col("status") >= 500, "ERROR").when(F.col("status") >= 400, "WARNING").otherwise("INFO")
    message = F.concat_ws(" ", "method", "path", F.col("status").cast("string"), "secret")
    if fmt == "json":
        body = F.to_json(F.struct(iso.alias("timestamp"), lvl.alias("level"), "service", "hostname", message.alias("message"), "client_ip", "user_id", "method", "path", "status", "duration_ms", "bytes", "user_agent"))
    elif fmt == "access":
        body = F.format_string('%s - %s [%s] "%s %s HTTP/1.1" %d %d "-" "%s" %.3f', "client_ip", "user_id", timed("dd/MMM/yyyy:HH:mm:ss +0000"), "method", "path", "status", "bytes", "user_agent", F.col("duration_ms") / 1000)
    elif fmt == "logfmt":
        body = F.format_string('ts=%s level=%s service=%s msg="%s" status=%d duration=%.3fms', iso, lvl, "service", message, "status", "duration_ms")
    else:
        raise ValueError(f"unknown format {fmt!r}")
    return r.select("n", F.when(F.col("_bad") < malformed, F.concat(F.lit("{broken "), F.left(body, F.lit(20)))).otherwise(body).alias("value"))
