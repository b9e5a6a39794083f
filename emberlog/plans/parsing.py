"""Queries that write the canonical rows as text lines of each format and parse them back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import parsers, stages
from ..operators.parsers import parse
from .catalog import add
from .eventlog import logs

STAMP = "strftime(timestamp, '%Y-%m-%d %H:%M:%S')"


def dash(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit("-"))


def iso() -> Column:
    return F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss'Z'")


#: a line of each format (built when called: columns need a session)
LINES = {
    "access": lambda: F.format_string('%s - %s [%s] "%s %s?q=1 HTTP/1.1" %s %s "-" "%s" %.3f', dash("ip_address"), dash("user_id"), F.date_format("timestamp", "dd/MMM/yyyy:HH:mm:ss +0000"), "http_method", F.coalesce("endpoint", F.lit("/")), dash("status_code"), dash("bytes_sent"), "user_agent", F.coalesce("response_time_ms", F.lit(0.0)) / 1000),
    "json": lambda: F.to_json(F.struct(iso().alias("@timestamp"), F.lower("level").alias("severity"), F.col("service").alias("app"), F.col("message").alias("msg"), F.struct(F.col("http_method").alias("method"), F.col("status_code").alias("status"), F.col("endpoint").alias("path")).alias("http"), F.col("response_time_ms").alias("duration_ms"), F.col("request_id").alias("requestId"), F.lit("x").alias("colour"))),
    "keyvalue": lambda: F.format_string('ts=%s level=%s service=%s msg="%s" status=%s duration=%s user=%s', iso(), "level", F.coalesce("service", F.lit("")), "message", F.coalesce(F.col("status_code").cast("string"), F.lit("")), F.concat(F.floor(F.coalesce("response_time_ms", F.lit(0.0))).cast("string"), F.lit("ms")), F.coalesce("user_id", F.lit(""))),
    "syslog": lambda: F.format_string("<%s>1 %s %s %s 17 ID1 - %s", F.when(F.col("level") == "ERROR", "11").when(F.col("level") == "NOTICE", "13").otherwise("14"), iso(), "hostname", F.coalesce("service", F.lit("none")), "message"),
    "nginx_error": lambda: F.format_string('%s [%s] 12#0: *%s %s, client: %s, server: %s, request: "%s %s?x=1 HTTP/1.1", host: "h"', F.date_format("timestamp", "yyyy/MM/dd HH:mm:ss"), F.lower("level"), "event_id", "message", F.coalesce("ip_address", F.lit("bad")), "hostname", "http_method", F.coalesce("endpoint", F.lit("/"))),
    "plaintext": lambda: F.format_string("%s [%s] [%s] %s status=%s latency=%s request_id=%s", F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss"), "level", F.coalesce("logger", F.lit("root")), "message", F.coalesce(F.col("status_code").cast("string"), F.lit("none")), F.concat(F.floor(F.coalesce("response_time_ms", F.lit(0.0))).cast("string"), F.lit("ms")), "request_id"),
}
CUSTOM = (r"^(?P<timestamp>[^|]+)\|(?P<level>\w+)\|(?P<svc>[^|]*)\|(?P<shard>\d+)\|(?P<message>.*)$", {"svc": "service"})


def lines(spark: SparkSession, sf: str, fmt: str) -> DataFrame:
    return logs(spark, sf).select(F.col("event_id").alias("id"), LINES[fmt]().alias("value"))


def parsed(fmt: str, *columns: str):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        e = parse(lines(spark, sf, fmt), fmt).where("event IS NOT NULL")
        picked = [F.date_format("event.timestamp", "yyyy-MM-dd HH:mm:ss").alias("ts") if c == "timestamp" else F.col(f"event.{c}").alias(c) for c in columns]
        return e.select(F.col("id").alias("event_id"), *picked)

    return run


LEVEL_BY_STATUS = "CASE WHEN status_code >= 500 THEN 'ERROR' WHEN status_code >= 400 THEN 'WARNING' ELSE 'INFO' END"
add("parse_access", parsed("access", "timestamp", "level", "ip_address", "user_id", "http_method", "endpoint", "status_code", "bytes_sent", "user_agent"),
    f"SELECT event_id, {STAMP} AS ts, {LEVEL_BY_STATUS} AS level, ip_address, user_id, http_method, coalesce(endpoint, '/') AS endpoint, status_code, bytes_sent, user_agent FROM logs")
add("parse_json", parsed("json", "timestamp", "level", "service", "message", "http_method", "status_code", "endpoint", "response_time_ms", "request_id"),
    f"SELECT event_id, {STAMP} AS ts, level, service, message, http_method, status_code, endpoint, response_time_ms, request_id FROM logs")
add("parse_keyvalue", parsed("keyvalue", "timestamp", "level", "service", "message", "status_code", "response_time_ms", "user_id"),
    f"SELECT event_id, {STAMP} AS ts, level, service, message, status_code, CAST(floor(coalesce(response_time_ms, 0)) AS DOUBLE) AS response_time_ms, user_id FROM logs")
add("parse_syslog", parsed("syslog", "timestamp", "level", "hostname", "service", "message"), f"SELECT event_id, {STAMP} AS ts, level, hostname, coalesce(service, 'none') AS service, message FROM logs")
add("parse_nginx_error", parsed("nginx_error", "timestamp", "level", "ip_address", "hostname", "http_method", "endpoint", "logger"), f"SELECT event_id, {STAMP} AS ts, level, ip_address, hostname, http_method, coalesce(endpoint, '/') AS endpoint, 'nginx' AS logger FROM logs")
add("parse_plaintext", parsed("plaintext", "timestamp", "level", "logger", "status_code", "response_time_ms", "request_id"),
    f"SELECT event_id, {STAMP} AS ts, level, coalesce(logger, 'root') AS logger, status_code, CAST(floor(coalesce(response_time_ms, 0)) AS DOUBLE) AS response_time_ms, request_id FROM logs")
add("parse_custom", lambda s, sf: parse(logs(s, sf).select(F.col("event_id").alias("id"), F.concat_ws("|", iso(), "level", F.coalesce("service", F.lit("")), F.lit("7"), "message").alias("value")), parsers.custom(*CUSTOM)).select(F.col("id").alias("event_id"), "event.level", "event.service", "event.message", F.col("event.metadata")["shard"].alias("shard")), "SELECT event_id, level, service, message, '7' AS shard FROM logs")


def mixed(spark: SparkSession, sf: str) -> DataFrame:
    """JSON lines with every 20th broken."""
    good = lines(spark, sf, "json")
    return good.select(F.when(F.col("id").cast("long") % 20 == 0, F.concat(F.lit("oops "), F.left("value", F.lit(30)))).otherwise(F.col("value")).alias("value"))


add("stage_ingest_good", lambda s, sf: stages.ingest(mixed(s, sf), "json", source="events")[0].groupBy("level", "service").agg(F.count("*").alias("n")), "SELECT level, service, count(*) AS n FROM logs WHERE CAST(event_id AS BIGINT) % 20 <> 0 GROUP BY ALL")
add("stage_dead_letters", lambda s, sf: stages.ingest(mixed(s, sf), "json", source="events")[1].groupBy("reason", "stage").agg(F.count("*").alias("n")), "SELECT 'unparseable' AS reason, 'parse' AS stage, count(*) AS n FROM logs WHERE CAST(event_id AS BIGINT) % 20 = 0")
