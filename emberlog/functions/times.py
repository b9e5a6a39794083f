"""Timestamps: parsing, windows, partitions, ranges."""

from __future__ import annotations

from datetime import UTC, date, datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOWS = {"1m": 60, "5m": 300, "15m": 900, "1h": 3600, "6h": 21600, "1d": 86400}
EARLIEST, LATEST = "1990-01-01 00:00:00", "2100-01-01 00:00:00"
#: accepted shapes beside epoch numbers and ISO 8601, as (guard, pattern)
SHAPES = (
    (r"^\d{2}/[A-Za-z]{3}/\d{4}:\d{2}:\d{2}:\d{2} [+-]\d{4}$", "dd/MMM/yyyy:HH:mm:ss xx"),
    (r"^\d{2}/[A-Za-z]{3}/\d{4}:\d{2}:\d{2}:\d{2}$", "dd/MMM/yyyy:HH:mm:ss"),
    (r"^\d{4}/\d{1,2}/\d{1,2} \d{1,2}:\d{2}:\d{2}$", "yyyy/M/d H:mm:ss"),
    (r"^\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{2}:\d{2}$", "M/d/yyyy H:mm:ss"),
    (r"^\d{8}T\d{6}Z$", "yyyyMMdd'T'HHmmss'Z'"),
)


def parse_timestamp(raw: Column, default_year: int | None = None) -> Column:
    """Epoch s/ms/us/ns by digits, ISO, then SHAPES, then year-less syslog; outside 1990-2100 null."""
    text = F.regexp_replace(F.trim(raw.cast("string")), r"^\[(.*)\]$", "$1")
    whole = F.regexp_extract(text, r"^(\d{9,19})(?:\.\d{1,9})?$", 1)
    digits = F.length(whole)
    number = F.when(digits > 0, text.try_cast("decimal(38,9)"))
    micros = F.when(digits <= 10, number * 1000000).when(digits <= 13, number * 1000).when(digits <= 16, number).otherwise(number / 1000)
    epoch = F.timestamp_micros(micros.cast("bigint"))
    iso = F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}(?:$|[T ]\d{2}:\d{2})"), F.regexp_replace(F.regexp_replace(text, r",(\d{1,9})", ".$1"), r"([+-]\d{2})(\d{2})$", "$1:$2").try_cast("timestamp"))
    shaped = [F.when(text.rlike(guard), F.try_to_timestamp(text, F.lit(pattern))) for guard, pattern in SHAPES]
    year = F.lit(default_year).cast("string") if default_year else F.date_format(F.current_timestamp(), "yyyy")
    bsd = F.when(text.rlike(r"^[A-Za-z]{3}\s{1,2}\d{1,2} \d{2}:\d{2}:\d{2}$"), F.try_to_timestamp(F.concat(year, F.lit(" "), F.regexp_replace(text, r"\s+", " ")), F.lit("yyyy MMM d HH:mm:ss")))
    found = F.coalesce(epoch, iso, *shaped, bsd)
    return F.when(found.between(F.lit(EARLIEST).cast("timestamp"), F.lit(LATEST).cast("timestamp")), found)


def floor_to(ts: Column, window: str) -> Column:
    """Start of the window that holds ts."""
    return F.window(ts, f"{WINDOWS[window]} seconds").getField("start")


def to_iso(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def partition_columns(df: DataFrame, ts: str = "timestamp", hourly: bool = False) -> DataFrame:
    out = df.withColumn("year", F.date_format(ts, "yyyy")).withColumn("month", F.date_format(ts, "MM")).withColumn("day", F.date_format(ts, "dd"))
    return out.withColumn("hour", F.date_format(ts, "HH")) if hourly else out


def parse_range(start: str | datetime | None, end: str | datetime | None, span: timedelta = timedelta(days=1), now: datetime | None = None) -> tuple[datetime, datetime]:
    """Aware bounds, both inclusive; reversed ones are swapped; the default is the last ``span``."""

    def aware(v: str | datetime) -> datetime:
        v = datetime.fromisoformat(v) if isinstance(v, str) else v
        return v.replace(tzinfo=UTC) if v.tzinfo is None else v.astimezone(UTC)

    stop = aware(end) if end is not None else (now or datetime.now(UTC))
    begin = aware(start) if start is not None else stop - span
    return min(begin, stop), max(begin, stop)


def in_range(df: DataFrame, start: datetime | str | None, end: datetime | str | None, ts: str = "timestamp") -> DataFrame:
    """Rows of the inclusive range; on a partitioned dataset the day partitions outside it are not listed."""
    kind = dict(df.dtypes)[ts]

    def bound(v):
        v = datetime.fromisoformat(v) if isinstance(v, str) else v
        v = v.astimezone(UTC).replace(tzinfo=None) if v.tzinfo else v
        return v, F.lit(v.isoformat(sep=" ")).cast(kind)

    parts = {"year", "month", "day"} <= set(df.columns)
    for v, low in ((start, True), (end, False)):
        if v is None:
            continue
        moment, lit = bound(v)
        df = df.where(F.col(ts) >= lit if low else F.col(ts) <= lit)
        if parts:
            df = df.where(_day_key() >= _key(moment.date()) if low else _day_key() <= _key(moment.date()))
    return df


def _day_key() -> Column:
    return F.col("year").cast("int") * 10000 + F.col("month").cast("int") * 100 + F.col("day").cast("int")


def _key(day: date) -> int:
    return day.year * 10000 + day.month * 100 + day.day


def spine(spark, start: datetime | str, end: datetime | str, window: str, kind: str = "timestamp") -> DataFrame:
    """Every bucket start of the range, both ends' buckets included."""
    step = WINDOWS[window]
    a, b = (floor_seconds(v, step) for v in (start, end))
    times = F.expr(f"timestamp_seconds({a} + id * {step})")
    return spark.range((b - a) // step + 1).select(F.to_timestamp_ntz(F.date_format(times, "yyyy-MM-dd HH:mm:ss")).cast(kind).alias("bucket") if kind == "timestamp_ntz" else times.alias("bucket"))


def floor_seconds(v: datetime | str, step: int) -> int:
    v = datetime.fromisoformat(v) if isinstance(v, str) else v
    v = v.replace(tzinfo=UTC) if v.tzinfo is None else v
    s = int(v.timestamp())
    return s - s % step
