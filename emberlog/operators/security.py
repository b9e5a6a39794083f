"""Scored security detections. All of them are one grouped aggregate over one scan; scores and correlation are expressions."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import ip_class, lookup, severity
from .views import rounded

# -- fixed values: base risk of each finding, statuses of failed logins, watched paths and agents -----------------------
BASE = {"brute_force": 55.0, "credential_stuffing": 70.0, "endpoint_scanning": 45.0, "sensitive_endpoint_access": 60.0, "suspicious_user_agent": 35.0, "request_flood": 40.0, "secret_in_log": 65.0}
FAILED_LOGIN = (401, 403)
SENSITIVE_PATHS = ("/admin", "/login", "/api/keys", "/.env", "/.git", "/wp-admin", "/actuator", "/phpmyadmin")
SUSPICIOUS_AGENTS = ("sqlmap", "nikto", "nmap", "masscan", "havij", "acunetix", "dirbuster", "gobuster", "wpscan", "curl/7.", "python-requests")
PER_TYPE = 50
SAMPLES = 10
# ------------------------------------------------------------------------------------------------------------------------


def score(kind: Column, volume: Column, distinct: Column, public: Column, signals: Column) -> Column:
    """Base risk plus volume, breadth and correlation, less for internal sources; 0 to 100."""
    base = F.coalesce(lookup({k: str(v) for k, v in BASE.items()}, kind).cast("double"), F.lit(30.0))
    log = lambda c: F.log10(F.greatest(c, F.lit(1)).cast("double"))
    total = base + F.least(F.lit(32.0), 8.0 * log(volume)) + F.least(F.lit(10.0), 5.0 * log(distinct)) + F.least(F.lit(15.0), 7.5 * (signals - 1)) - F.when(public, 0.0).otherwise(12.0)
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(100.0), total)), 2)


def _seconds() -> Column:
    return (F.unix_micros(F.col("last_seen").cast("timestamp")) - F.unix_micros(F.col("first_seen").cast("timestamp"))) / 1000000.0


@dataclass(frozen=True)
class Detection:
    """Which rows count for whom, what is counted as breadth, and what a finding needs."""

    kind: str
    hit: Column
    item: str = "endpoint"
    subject: Column | None = None
    least: int = 1
    least_breadth: int = 0
    by_breadth: bool = False
    least_rate: float = 0.0


def findings(logs: DataFrame, *detections: Detection, limit: int = PER_TYPE, samples: int = SAMPLES) -> DataFrame:
    """All detections from one scan, the ``limit`` largest of each kind.

    A row counts once for each detection it hits. Rows are first counted by (type, subject, item), so a subject's
    breadth is a plain count and its evidence the first ``samples`` items in order: no set of all items is held.
    """
    subject = lambda d: F.col("ip_address") if d.subject is None else d.subject
    hits = [F.when(d.hit & subject(d).isNotNull(), F.struct(F.lit(d.kind).alias("type"), subject(d).alias("subject"), F.col(d.item).cast("string").alias("item"))) for d in detections]
    rows = logs.select("timestamp", "user_agent", F.explode(F.array(*hits)).alias("_h")).where("_h IS NOT NULL").select("timestamp", "user_agent", "_h.*")
    items = rows.groupBy("type", "subject", "item").agg(F.count("*").alias("_n"), F.min("timestamp").alias("first_seen"), F.max("timestamp").alias("last_seen"), F.min("user_agent").alias("user_agent"))
    first = F.row_number().over(Window.partitionBy("type", "subject").orderBy(F.asc_nulls_last("item"))) <= samples
    found = items.withColumn("_sample", F.when(first, F.col("item"))).groupBy("type", "subject").agg(
        F.sum("_n").alias("event_count"), F.count("item").alias("breadth"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"),
        F.min("user_agent").alias("user_agent"), F.array_sort(F.collect_list("_sample")).alias("samples"),
    )
    enough = reduce(lambda a, b: a | b, [(F.col("type") == d.kind) & (F.col("event_count") >= d.least) & (F.col("breadth") >= d.least_breadth) for d in detections])
    size = F.when(F.col("type").isin(*[d.kind for d in detections if d.by_breadth]), F.col("breadth")).otherwise(F.col("event_count"))
    top = F.row_number().over(Window.partitionBy("type").orderBy(F.desc(size), F.asc("subject")))
    kept = found.where(enough).withColumn("_r", top).where(F.col("_r") <= limit).drop("_r")
    rate = F.col("event_count") / F.greatest(_seconds(), F.lit(1.0))
    return reduce(DataFrame.where, [(F.col("type") != d.kind) | (rate >= d.least_rate) for d in detections if d.least_rate], kept)


def _any_like(column: str, patterns: Sequence[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.col(column).ilike(p) for p in patterns], F.lit(False))


def brute_force_of(threshold: int = 5) -> Detection:
    return Detection("brute_force", F.col("status_code").isin(*FAILED_LOGIN), least=threshold)


def credential_stuffing_of(threshold: int = 5) -> Detection:
    return Detection("credential_stuffing", F.col("user_id").isNotNull() & F.col("status_code").isin(*FAILED_LOGIN), "user_id", least_breadth=max(5, threshold), by_breadth=True)


def endpoint_scanning_of(threshold: int = 25) -> Detection:
    return Detection("endpoint_scanning", F.col("status_code") == 404, least=threshold, by_breadth=True)


def sensitive_endpoints_of(paths: Sequence[str] = SENSITIVE_PATHS) -> Detection:
    return Detection("sensitive_endpoint_access", _any_like("endpoint", [f"{p}%" for p in paths]))


def suspicious_agents_of(agents: Sequence[str] = SUSPICIOUS_AGENTS) -> Detection:
    return Detection("suspicious_user_agent", _any_like("user_agent", [f"%{a}%" for a in agents]))


def request_floods_of(threshold: int = 300, least_rate: float = 1.0) -> Detection:
    """The rate is tested on the busiest addresses, after their limit."""
    return Detection("request_flood", F.lit(True), least=threshold, least_rate=least_rate)


def secrets_in_logs_of() -> Detection:
    return Detection("secret_in_log", F.get_json_object("metadata", "$.masked") == "true", "logger", F.coalesce("service", F.lit("unknown")))


DETECTIONS = {
    "brute_force": brute_force_of, "credential_stuffing": credential_stuffing_of, "endpoint_scanning": endpoint_scanning_of, "sensitive_endpoints": sensitive_endpoints_of,
    "suspicious_agents": suspicious_agents_of, "request_floods": request_floods_of, "secrets_in_logs": secrets_in_logs_of,
}


def scored(found: DataFrame) -> DataFrame:
    """risk_score and severity of each finding; a subject that several detections name scores higher."""
    public = (F.col("type") != "secret_in_log") & ~F.coalesce(ip_class(F.col("subject")).isin("private", "loopback"), F.lit(False))
    signals = F.size(F.collect_set("type").over(Window.partitionBy("subject")))
    out = found.withColumn("signals", signals)
    out = out.withColumn("risk_score", score(F.col("type"), F.col("event_count"), F.greatest("breadth", F.lit(1)), public, F.col("signals")))
    return out.withColumn("severity", severity(F.col("risk_score")))


def analyze(logs: DataFrame, limit: int = 100) -> DataFrame:
    """All findings, highest risk first."""
    found = findings(logs, *[make() for make in DETECTIONS.values()])
    return scored(found).orderBy(F.desc("risk_score"), "subject", "type").limit(limit)


def by_severity(findings: DataFrame) -> DataFrame:
    return findings.groupBy("severity").agg(F.count("*").alias("n"))


__all__ = ["DETECTIONS", "analyze", "by_severity", "findings", "rounded", "scored"]
