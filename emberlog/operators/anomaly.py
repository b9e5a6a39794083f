"""Statistical anomaly detection over bucketed series, as window functions.

A series is (metric, [dimension,] bucket, value); every detector works on all series at once,
partitioned by series, so nothing is ordered globally. The one recursive detector (ewma) follows
each series in one Arrow table (bounded by the number of buckets of the range), in linear time.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import lookup
from ..functions.times import spine
from .views import long_series, rounded, timeseries

DEFAULT_METRICS = ("errors", "server_errors", "latency_p95", "requests")
DROP_METRICS = ("requests", "bytes", "unique_users")
SEVERITIES = ("info", "low", "medium", "high", "critical")


@dataclass(frozen=True)
class Config:
    threshold: float = 3.0
    iqr_multiplier: float = 1.5
    window: int = 12
    min_history: int = 10
    alpha: float = 0.3
    least_observed: float = 3.0  # smaller values are no upward anomaly


def _keys(series: DataFrame) -> list[str]:
    return [c for c in ("metric", "dimension") if c in series.columns]


def _frames(series: DataFrame):
    w = Window.partitionBy(*_keys(series))
    return w, w.orderBy("bucket")


def moving_average(series: DataFrame, window: int) -> DataFrame:
    _, o = _frames(series)
    return series.withColumn("moving_average", F.avg("value").over(o.rowsBetween(-(window - 1), 0)))


def rolling_std(series: DataFrame, window: int) -> DataFrame:
    _, o = _frames(series)
    return series.withColumn("rolling_std", F.coalesce(F.stddev_samp("value").over(o.rowsBetween(-(window - 1), 0)), F.lit(0.0)))


def zscores(series: DataFrame) -> DataFrame:
    w, _ = _frames(series)
    sd = F.stddev_samp("value").over(w)
    return series.withColumn("zscore", F.when(sd > 0, (F.col("value") - F.avg("value").over(w)) / sd).otherwise(0.0))


def iqr_bounds(series: DataFrame, multiplier: float = 1.5) -> DataFrame:
    """lower, upper and median of each series; unbounded under four points."""
    keys = _keys(series)
    q = series.groupBy(*keys).agg(F.percentile("value", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"), F.count("*").alias("n"))
    spread = (F.col("q")[2] - F.col("q")[0]) * multiplier
    few = F.col("n") < 4
    return q.select(*keys, "n", F.col("q")[1].alias("median"), F.when(few, F.lit(float("-inf"))).otherwise(F.col("q")[0] - spread).alias("lower"), F.when(few, F.lit(float("inf"))).otherwise(F.col("q")[2] + spread).alias("upper"))


def _found(rows: DataFrame, detector: str, expected: Column, score: Column, hit: Column, config: Config) -> DataFrame:
    """Rows that hit, upward from ``least_observed`` on, downward for volume metrics only."""
    keys = [c for c in ("metric", "dimension") if c in rows.columns]
    up = F.col("value") > expected
    counts = (up & (F.col("value") >= config.least_observed)) | (~up & F.col("metric").isin(*DROP_METRICS))
    return rows.where(hit & counts).select(*keys, "bucket", "value", expected.alias("expected"), F.abs(score).alias("score"), F.lit(detector).alias("detector"))


def detect_zscore(series: DataFrame, config: Config = Config()) -> DataFrame:
    w, _ = _frames(series)
    rows = zscores(series).withColumn("_mean", F.avg("value").over(w)).withColumn("_n", F.count("*").over(w))
    return _found(rows, "zscore", F.col("_mean"), F.abs("zscore"), (F.col("_n") >= config.min_history) & (F.abs("zscore") >= config.threshold), config)


def detect_moving_average(series: DataFrame, config: Config = Config()) -> DataFrame:
    """Each point against the ``window`` points before it; a departure from a flat baseline scores threshold + 1."""
    w, o = _frames(series)
    past = o.rowsBetween(-config.window, -1)
    rows = series.withColumn("_mean", F.avg("value").over(past)).withColumn("_sd", F.coalesce(F.stddev_samp("value").over(past), F.lit(0.0))).withColumn("_i", F.row_number().over(o)).withColumn("_n", F.count("*").over(w))
    gap = F.abs(F.col("value") - F.col("_mean"))
    score = F.when(F.col("_sd") > 0, gap / F.col("_sd")).otherwise(F.when(gap > 0, F.lit(config.threshold + 1.0)).otherwise(0.0))
    return _found(rows, "moving_average", F.col("_mean"), score, (F.col("_n") >= config.min_history) & (F.col("_i") > config.window) & (score >= config.threshold), config)


def detect_iqr(series: DataFrame, config: Config = Config()) -> DataFrame:
    rows = series.join(iqr_bounds(series, config.iqr_multiplier), _keys(series))
    reach = F.col("upper") - F.col("median")
    score = F.abs(F.col("value") - F.col("median")) / F.greatest(reach, F.lit(1e-9)) * config.threshold
    outside = (F.col("value") > F.col("upper")) | (F.col("value") < F.col("lower"))
    return _found(rows, "iqr", F.col("median"), score, (F.col("n") >= max(config.min_history, 8)) & outside, config)


def detect_ewma(series: DataFrame, config: Config = Config()) -> DataFrame:
    """Exponentially weighted level and variance; each point is scored before it updates them."""
    a, flat_score, few = config.alpha, config.threshold + 1.0, config.min_history

    def follow(rows: pa.Table) -> pa.Table:
        rows = rows.slice(0, 0) if rows.num_rows < few else rows.sort_by("bucket")
        level, var, expected, scores = None, 0.0, [], []
        for v in rows["value"].to_pylist():
            expected.append(level)
            if v is None or level is None:
                scores.append(None)
                level = v if level is None else level
                continue
            gap = v - level
            scores.append(abs(gap) / math.sqrt(var) if var > 0 else flat_score if gap else 0.0)
            level, var = level + gap * a, (var + gap * gap * a) * (1 - a)
        return rows.append_column("expected", pa.array(expected, pa.float64())).append_column("score", pa.array(scores, pa.float64()))

    rows = series.withColumn("value", F.col("value").cast("double"))
    schema = T.StructType([*rows.schema.fields, T.StructField("expected", T.DoubleType()), T.StructField("score", T.DoubleType())])
    flat = rows.groupBy(*_keys(series)).applyInArrow(follow, schema)
    return _found(flat, "ewma", F.col("expected"), F.col("score"), F.col("score") >= config.threshold, config)


DETECTORS = {"zscore": detect_zscore, "moving_average": detect_moving_average, "iqr": detect_iqr, "ewma": detect_ewma}


def detect(series: DataFrame, names: Sequence[str] = ("moving_average", "iqr"), config: Config = Config()) -> DataFrame:
    return reduce(DataFrame.unionByName, [DETECTORS[n](series, config) for n in names])


UPWARD = {
    "errors": "error_spike", "error_rate": "error_spike", "server_errors": "server_error_surge", "client_errors": "unusual_pattern",
    "requests": "traffic_spike", "latency_avg": "latency_spike", "latency_p95": "latency_spike", "latency_p99": "latency_spike",
    "latency_max": "latency_spike", "bytes": "traffic_spike", "unique_ips": "unusual_pattern", "unique_users": "unusual_pattern",
}


def typed(found: DataFrame) -> DataFrame:
    """type by metric and direction; severity needs a strong score and a large ratio."""
    up = F.col("value") > F.col("expected")
    kind = F.when(~up, "traffic_drop").otherwise(F.coalesce(lookup(UPWARD, F.col("metric")), F.lit("unusual_pattern")))
    ratio = F.when(F.col("expected") > 0, F.col("value") / F.col("expected")).otherwise(F.when(F.col("value") > 0, 2.0).otherwise(1.0))
    s = F.col("score")
    severity = F.when((s >= 6) & (ratio >= 5), "critical").when((s >= 4.5) & (ratio >= 3), "high").when((s >= 3) & (ratio >= 1.75), "medium").when(s >= 2.5, "low").otherwise("info")
    return found.withColumn("type", kind).withColumn("severity", severity)


def rank_of(severity: Column) -> Column:
    return F.array_position(F.array(*[F.lit(s) for s in SEVERITIES]), severity)


def merged(found: DataFrame) -> DataFrame:
    """The strongest finding of each point; the detectors that agree are joined with ``+``."""
    keys = [*_keys(found), "bucket"]
    best = Window.partitionBy(*keys).orderBy(F.desc(rank_of(F.col("severity"))), F.desc("score"), F.asc("detector"))
    names = F.array_join(F.array_sort(F.collect_set("detector").over(Window.partitionBy(*keys))), "+")
    return found.withColumn("_names", names).withColumn("_r", F.row_number().over(best)).where("_r = 1").drop("_r", "detector").withColumnRenamed("_names", "detector")


def scan(logs: DataFrame, start, end, window: str = "5m", metrics: Sequence[str] = DEFAULT_METRICS, names: Sequence[str] = ("moving_average", "iqr"), config: Config = Config(), least: str = "low", limit: int = 200, exact: bool = False) -> DataFrame:
    """All metrics in one pass over the logs, then every detector on all series at once."""
    series = long_series(timeseries(logs, start, end, window, metrics, exact=exact), metrics)
    return _limited(merged(typed(detect(series, names, config))), least, limit)


def scan_by(logs: DataFrame, dimension: str, start, end, window: str = "5m", metric: str = "errors", names: Sequence[str] = ("moving_average", "iqr"), config: Config = Config(), most: int = 20, least: str = "medium", limit: int = 200, exact: bool = False) -> DataFrame:
    """One metric by the busiest values of a dimension: one query for all of them, gaps filled for each."""
    named = logs.where(F.col(dimension).isNotNull()).withColumn("dimension", F.col(dimension).cast("string"))
    busiest = named.groupBy("dimension").count().orderBy(F.desc("count"), "dimension").limit(most).select("dimension")
    got = timeseries(named, start, end, window, [metric], by="dimension", exact=exact)
    full = spine(logs.sparkSession, start, end, window, dict(logs.dtypes)["timestamp"]).crossJoin(F.broadcast(busiest))  # buckets x at most ``most`` values
    filled = full.join(got, ["bucket", "dimension"], "left").select("dimension", "bucket", F.coalesce(metric, F.lit(0.0)).alias(metric))
    series = long_series(filled, [metric], "dimension")
    return _limited(merged(typed(detect(series, names, config))), least, limit)


def _limited(found: DataFrame, least: str, limit: int) -> DataFrame:
    strong = found.where(rank_of(F.col("severity")) >= SEVERITIES.index(least) + 1)
    keys = [*_keys(found), "bucket"]
    out = strong.orderBy(F.desc(rank_of(F.col("severity"))), F.desc("score"), *keys).limit(limit)
    return out.withColumn("score", rounded(F.col("score"))).withColumn("expected", rounded(F.col("expected")))
