"""The test tables' ``events`` seen as canonical log rows: one SQL text that Spark and DuckDB both read."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

START, END = datetime(2024, 1, 1), datetime(2024, 1, 31)

COLUMNS = {
    "event_id": "CAST(event_id AS STRING)",
    "timestamp": "ts",
    "source": "'events'",
    "service": "CASE WHEN event_id % 17 = 0 THEN NULL ELSE concat('svc-', CAST(user_id % 8 AS STRING)) END",
    "hostname": "concat('host-', CAST(user_id % 12 AS STRING))",
    "environment": "CASE WHEN user_id % 3 = 0 THEN 'production' ELSE 'staging' END",
    "level": "CASE WHEN event_type = 'error' THEN 'ERROR' WHEN event_type = 'signup' THEN 'NOTICE' ELSE 'INFO' END",
    "logger": "CASE WHEN event_id % 5 = 0 THEN NULL ELSE concat('app.', event_type) END",
    "message": "concat('user ', CAST(user_id AS STRING), ' did ', event_type, CASE WHEN event_id % 50 = 0 THEN ' 100% of a_b' ELSE '' END)",
    "ip_address": "CASE WHEN event_id % 23 = 0 THEN NULL WHEN user_id % 4 = 0 THEN concat('10.0.0.', CAST(user_id % 20 AS STRING)) ELSE concat('8.8.', CAST(user_id % 3 AS STRING), '.', CAST(user_id % 11 AS STRING)) END",
    "user_id": "CASE WHEN event_id % 29 = 0 THEN NULL ELSE CAST(user_id AS STRING) END",
    "request_id": "concat('r', CAST(event_id AS STRING))",
    "http_method": "CASE WHEN event_id % 3 = 0 THEN 'POST' ELSE 'GET' END",
    "endpoint": "CASE WHEN event_id % 31 = 0 THEN NULL WHEN event_id % 37 = 0 THEN '/.env' WHEN event_id % 41 = 0 THEN '/Admin/users' ELSE concat('/api/v1/', event_type, '/', CAST(event_id % 20 AS STRING)) END",
    "status_code": "CAST(CASE WHEN event_id % 13 = 0 THEN NULL WHEN event_type = 'error' THEN CASE event_id % 4 WHEN 0 THEN 500 WHEN 1 THEN 503 WHEN 2 THEN 599 ELSE 451 END WHEN event_id % 7 = 0 THEN 404 WHEN event_id % 11 = 0 THEN 401 WHEN event_id % 19 = 0 THEN 403 WHEN event_id % 43 = 0 THEN 429 WHEN event_id % 6 = 0 THEN 301 ELSE 200 END AS SMALLINT)",
    "response_time_ms": "CASE WHEN event_id % 9 = 0 THEN NULL ELSE value END",
    "bytes_sent": "CASE WHEN event_id % 15 = 0 THEN NULL ELSE event_id * 37 % 5000 END",
    "user_agent": "CASE WHEN event_id % 53 = 0 THEN 'sqlmap/1.7' WHEN event_id % 2 = 0 THEN 'Mozilla/5.0 Chrome/120.0 Safari/537.36' ELSE 'curl/8.1' END",
    "referrer": "CAST(NULL AS STRING)",
    "metadata": "CASE WHEN event_id % 47 = 0 THEN '{\"masked\":\"true\"}' ELSE NULL END",
    "raw_message": "props",
    "parser": "'table'",
}
LOGS_SQL = "SELECT " + ", ".join(f"{expr} AS {name}" for name, expr in COLUMNS.items()) + " FROM events"


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return events.select(*[F.expr(expr).alias(name) for name, expr in COLUMNS.items()])
