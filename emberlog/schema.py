"""The one stored row shape. Declared once: inference per batch would break partitioned datasets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_S, _TS = T.StringType(), T.TimestampType()

EVENT = T.StructType(
    [
        T.StructField("event_id", _S, False),
        T.StructField("timestamp", _TS, False),
        T.StructField("ingested_at", _TS, False),
        *[T.StructField(n, _S) for n in ("source", "source_type", "service", "hostname", "environment", "level", "logger", "message", "ip_address", "user_id", "request_id", "http_method", "endpoint")],
        T.StructField("status_code", T.ShortType()),
        T.StructField("response_time_ms", T.DoubleType()),
        T.StructField("bytes_sent", T.LongType()),
        *[T.StructField(n, _S) for n in ("user_agent", "referrer", "metadata", "raw_message", "parser")],
    ]
)
#: longest stored value of each text column (fixed values)
LIMITS = {"event_id": 64, "source": 255, "service": 255, "hostname": 255, "logger": 255, "message": 65536, "user_id": 255, "request_id": 255, "endpoint": 2048, "user_agent": 1024, "referrer": 2048, "raw_message": 131072, "parser": 255}
PARTITIONS = ("year", "month", "day")
ERROR_LEVELS = ("ERROR", "CRITICAL", "ALERT", "EMERGENCY")


def is_error() -> Column:
    """Error level, or a 5xx status; never null."""
    return F.coalesce(F.col("level").isin(*ERROR_LEVELS), F.lit(False)) | F.coalesce(F.col("status_code") >= 500, F.lit(False))


def conform(df: DataFrame, *more: str) -> DataFrame:
    """df in the stored column order and types; missing columns are null. ``more`` columns follow as they are."""
    have = set(df.columns)
    return df.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in EVENT.fields], *more)
