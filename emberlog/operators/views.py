"""Analytics views. Each view scans the logs once: its breakdowns share one pass by grouping sets.

Shares and rates are rounded to 6 places at the end only. Percentiles come from a mergeable sketch of bounded
size; ``exact=True`` holds every distinct value of a group and interpolates (see ``quantile``);
``disc_quantiles`` are exact without holding a group.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from decimal import Decimal
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import status_class
from ..functions.times import WINDOWS, floor_to, in_range, spine
from ..schema import is_error

DIGITS = 6
METRICS = ("requests", "errors", "error_rate", "server_errors", "client_errors", "latency_avg", "latency_p95", "latency_p99", "latency_max", "bytes", "unique_ips", "unique_users")


def scoped(logs: DataFrame, start=None, end=None, filters: Mapping[str, Any] | None = None) -> DataFrame:
    """The inclusive range and equality/membership filters; null values and empty lists don't filter."""
    logs = in_range(logs, start, end)
    for name, value in (filters or {}).items():
        if isinstance(value, (list, tuple, set)):
            if value:
                logs = logs.where(F.col(name).isin(*value))
        elif value is not None:
            logs = logs.where(F.col(name) == value)
    return logs


QUANTILES = (0.5, 0.95, 0.99)


def quantile(c: str, q: float, exact: bool = False) -> Column:
    """One of QUANTILES; a group keeps one sketch (or one table of its values) for all of them, as equal aggregates are one."""
    every = F.percentile(c, QUANTILES) if exact else F.percentile_approx(c, QUANTILES, 10000)
    return F.get(every, F.lit(QUANTILES.index(q))).cast("double")


def disc_quantiles(rows: DataFrame, by: str, c: str, quantiles: Mapping[str, float], accuracy: int = 10000) -> DataFrame:
    """A row for each value of ``by`` (few values: their cuts are broadcast): the exact value at place ceil(q n) of its sorted ones.

    A sketch only says where to cut: rows are counted between the cuts around every quantile, which tells the stretch that
    holds it and its place there, and of those stretches alone values are counted one by one. A bad sketch makes
    stretches longer, never a value wrong; no task holds a group. The rows are read three times.
    """
    near = sorted({min(max(q + d, 0.0), 1.0) for q in quantiles.values() for d in (-5 / accuracy, 5 / accuracy)})
    cuts = rows.groupBy(F.col(by).alias("_by")).agg(F.percentile_approx(c, near, accuracy).alias("_cuts"))
    some = rows.where(F.col(c).isNotNull()).select(by, F.col(c).alias("_value")).join(F.broadcast(cuts), F.col(by).eqNullSafe(F.col("_by")))
    some = some.select("_by", "_value", F.size(F.filter("_cuts", lambda x: x < F.col("_value"))).alias("_stretch"))
    group = Window.partitionBy("_by")
    n = F.col("_n")
    placed = some.groupBy("_by", "_stretch").agg(F.count("*").alias("_n")).withColumns({"_upto": F.sum("_n").over(group.orderBy("_stretch")), "_all": F.sum("_n").over(group)})
    places = [F.greatest(F.ceil(F.col("_all").cast("decimal(20,0)") * F.lit(Decimal(str(q)))).cast("long"), F.lit(1)) for q in quantiles.values()]
    wanted = placed.select("_by", "_stretch", n, "_upto", F.posexplode(F.array(*places)).alias("_which", "_place")).where("_place > _upto - _n AND _place <= _upto")
    wanted = wanted.select(F.col("_by").alias("_of"), F.col("_stretch").alias("_in"), "_which", (F.col("_place") - F.col("_upto") + n).alias("_place"))
    same = F.col("_by").eqNullSafe(F.col("_of")) & (F.col("_stretch") == F.col("_in"))
    values = some.join(F.broadcast(wanted.select("_of", "_in").distinct()), same, "left_semi").groupBy("_by", "_stretch", "_value").agg(F.count("*").alias("_n"))
    values = values.withColumn("_upto", F.sum("_n").over(Window.partitionBy("_by", "_stretch").orderBy("_value")))
    found = values.join(F.broadcast(wanted), same).where("_place > _upto - _n AND _place <= _upto")
    found = found.groupBy("_of").agg(*[F.max(F.when(F.col("_which") == k, F.col("_value"))).alias(name) for k, name in enumerate(quantiles)])
    return cuts.join(found, F.col("_by").eqNullSafe(F.col("_of")), "left").select(F.col("_by").alias(by), *quantiles)


def rounded(c: Column) -> Column:
    return F.round(c, DIGITS)


def share(part: Column, whole: Column) -> Column:
    """part / whole, 0 where the whole is 0."""
    return F.coalesce(F.when(whole > 0, part / whole), F.lit(0.0))


def latency_stats(exact: bool = False, ms: str = "response_time_ms") -> list[Column]:
    return [
        F.count(ms).alias("n"),
        rounded(F.coalesce(F.sum(ms), F.lit(0.0))).alias("total"),
        rounded(F.coalesce(F.avg(ms), F.lit(0.0))).alias("mean"),
        F.coalesce(F.min(ms), F.lit(0.0)).alias("least"),
        F.coalesce(F.max(ms), F.lit(0.0)).alias("most"),
        *[rounded(F.coalesce(quantile(ms, q, exact), F.lit(0.0))).alias(f"p{round(q * 100)}") for q in (0.5, 0.95, 0.99)],
        rounded(F.coalesce(F.stddev_samp(ms), F.lit(0.0))).alias("deviation"),
    ]


def overview(logs: DataFrame, exact: bool = False) -> DataFrame:
    """One row. Requests are rows with a status code."""
    errors = F.count_if(is_error())
    return logs.agg(
        F.count("*").alias("records"),
        F.count("status_code").alias("requests"),
        errors.alias("errors"),
        rounded(share(errors, F.count("*"))).alias("error_rate"),
        rounded(F.coalesce(F.avg("response_time_ms"), F.lit(0.0))).alias("latency_avg"),
        rounded(F.coalesce(quantile("response_time_ms", 0.95, exact), F.lit(0.0))).alias("latency_p95"),
        rounded(F.coalesce(quantile("response_time_ms", 0.99, exact), F.lit(0.0))).alias("latency_p99"),
        F.count_distinct("service").alias("services"),
    )


def by_dimension(logs: DataFrame, dimensions: Sequence[str], aggs: Sequence[Column]) -> DataFrame:
    """dimension, key and aggs for each value of each dimension, from one scan (null keys are left out)."""
    narrow = logs.select(*[F.col(d).cast("string").alias(f"_{d}") for d in dimensions], "*")
    grouped = narrow.groupingSets([[F.col(f"_{d}")] for d in dimensions], *[F.col(f"_{d}") for d in dimensions]).agg(*aggs, F.grouping_id().alias("_g"))
    n = len(dimensions)
    name = reduce(lambda acc, i: acc.when(F.col("_g") == (2**n - 1) - 2 ** (n - 1 - i), F.lit(dimensions[i])), range(1, n), F.when(F.col("_g") == (2**n - 1) - 2 ** (n - 1), F.lit(dimensions[0])))
    return grouped.select(name.alias("dimension"), F.coalesce(*[f"_{d}" for d in dimensions]).alias("key"), *[c for c in grouped.columns if c != "_g" and c not in {f"_{d}" for d in dimensions}]).where("key IS NOT NULL")


def top_counts(counts: DataFrame, top: int = 10, of_all: bool = False) -> DataFrame:
    """dimension, key, n -> the ``top`` largest of each dimension and their percentage of those rows (or of all)."""
    order = Window.partitionBy("dimension").orderBy(F.desc("n"), F.asc("key"))
    ranked = counts.withColumn("_r", F.row_number().over(order))
    if of_all:
        ranked = ranked.withColumn("_sum", F.sum("n").over(Window.partitionBy("dimension")))
    kept = ranked.where(F.col("_r") <= top)
    if not of_all:
        kept = kept.withColumn("_sum", F.sum("n").over(Window.partitionBy("dimension")))
    return kept.select("dimension", "key", "n", rounded(F.col("n") * 100.0 / F.col("_sum")).alias("percentage"))


def count_by(logs: DataFrame, dimensions: Sequence[str], top: int = 10, of_all: bool = False) -> DataFrame:
    return top_counts(by_dimension(logs, dimensions, [F.count("*").alias("n")]), top, of_all)


def errors(logs: DataFrame, top: int = 10) -> DataFrame:
    """Error counts by service, endpoint, host and level, and the total as dimension ``all``."""
    bad = logs.where(is_error())
    parts = count_by(bad, ["service", "endpoint", "hostname", "level"], top)
    total = logs.agg(F.count_if(is_error()).alias("n"), F.count("*").alias("_all")).select(F.lit("all").alias("dimension"), F.lit("errors").alias("key"), "n", rounded(share(F.col("n") * 100.0, F.col("_all"))).alias("percentage"))
    return parts.unionByName(total)


def status_codes(logs: DataFrame, top: int = 15) -> DataFrame:
    """Status classes, the most frequent codes, and success / client / server shares (dimension ``rate``)."""
    codes = logs.where("status_code IS NOT NULL").groupBy("status_code").agg(F.count("*").alias("n"))
    classes = codes.groupBy(status_class(F.col("status_code")).alias("key")).agg(F.sum("n").alias("n")).select(F.lit("class").alias("dimension"), "key", "n")
    single = codes.select(F.lit("code").alias("dimension"), F.col("status_code").cast("string").alias("key"), "n")
    hundreds = F.floor(F.col("status_code") / 100)
    kind = F.when(hundreds.isin(2, 3), "success").when(hundreds == 4, "client_error").when(hundreds == 5, "server_error").otherwise("other")
    rates = codes.groupBy(kind.alias("key")).agg(F.sum("n").alias("n")).select(F.lit("rate").alias("dimension"), "key", "n")
    return top_counts(classes.unionByName(rates), 1000).unionByName(top_counts(single, top))


def latency(logs: DataFrame, top: int = 10, exact: bool = False) -> DataFrame:
    """Latency statistics over all rows and of the busiest services and endpoints (rows without a latency don't count)."""
    timed = logs.where("response_time_ms IS NOT NULL").withColumn("everything", F.lit("all"))
    got = by_dimension(timed, ["everything", "service", "endpoint"], latency_stats(exact))
    order = Window.partitionBy("dimension").orderBy(F.desc("n"), F.asc("key"))
    return got.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= top).drop("_r")


def traffic(logs: DataFrame, start, end, top: int = 10) -> DataFrame:
    """Totals and rates over the range (dimension ``total``), and the top addresses, endpoints, agents and methods."""
    seconds = max(1.0, (end - start).total_seconds())
    total = logs.agg(F.count("*").alias("n"), F.coalesce(F.sum("bytes_sent"), F.lit(0)).alias("_b"))
    rows = F.array(
        F.struct(F.lit("requests").alias("key"), F.col("n").alias("n"), F.lit(0.0).alias("v")),
        F.struct(F.lit("bytes").alias("key"), F.col("_b").alias("n"), F.lit(0.0).alias("v")),
        *[F.struct(F.lit(name).alias("key"), F.col("n").alias("n"), rounded(F.col("n") * per / seconds).alias("v")) for name, per in (("per_minute", 60.0), ("per_hour", 3600.0), ("per_day", 86400.0))],
    )
    totals = total.select(F.explode(rows).alias("r")).select(F.lit("total").alias("dimension"), "r.key", "r.n", F.col("r.v").alias("percentage"))
    return totals.unionByName(count_by(logs, ["ip_address", "endpoint", "user_agent", "http_method"], top))


def services(logs: DataFrame, start, end, limit: int = 50, exact: bool = False) -> DataFrame:
    """Health of each service; busiest first."""
    seconds = max(1.0, (end - start).total_seconds())
    bad = F.count_if(is_error())
    got = logs.where("service IS NOT NULL").groupBy("service").agg(F.count("*").alias("requests"), bad.alias("errors"), *latency_stats(exact)[1:])
    rate = F.col("errors") / F.col("requests")
    return got.select(
        "service", "requests", "errors", rounded(rate).alias("failure_rate"), rounded(1 - rate).alias("availability"), rounded(F.col("requests") / seconds).alias("throughput"),
        *got.columns[3:], F.when(rate >= 0.10, "unhealthy").when(rate >= 0.02, "degraded").otherwise("healthy").alias("status"),
    ).orderBy(F.desc("requests"), F.asc("service")).limit(limit)


def metric_columns(metrics: Sequence[str], exact: bool = False) -> list[Column]:
    bad, server = is_error(), F.coalesce(F.col("status_code") >= 500, F.lit(False))
    client = F.coalesce(F.col("status_code").between(400, 499), F.lit(False))
    made = {
        "requests": lambda: F.count("*").cast("double"),
        "errors": lambda: F.count_if(bad).cast("double"),
        "error_rate": lambda: share(F.count_if(bad), F.count("*")),
        "server_errors": lambda: F.count_if(server).cast("double"),
        "client_errors": lambda: F.count_if(client).cast("double"),
        "latency_avg": lambda: F.avg("response_time_ms"),
        "latency_p95": lambda: quantile("response_time_ms", 0.95, exact),
        "latency_p99": lambda: quantile("response_time_ms", 0.99, exact),
        "latency_max": lambda: F.max("response_time_ms"),
        "bytes": lambda: F.sum("bytes_sent").cast("double"),
        "unique_ips": lambda: F.count_distinct("ip_address").cast("double"),
        "unique_users": lambda: F.count_distinct("user_id").cast("double"),
    }
    return [rounded(F.coalesce(made[m](), F.lit(0.0))).alias(m) for m in metrics]


def timeseries(logs: DataFrame, start, end, window: str = "5m", metrics: Sequence[str] = ("requests",), fill_gaps: bool = True, by: str | None = None, exact: bool = False) -> DataFrame:
    """bucket and one column for each metric, in one pass; gaps are 0. ``by`` adds a dimension (no gap filling beyond its own buckets)."""
    unknown = set(metrics) - set(METRICS)
    if unknown or window not in WINDOWS:
        raise ValueError(f"unknown metric {sorted(unknown)}" if unknown else f"unknown window {window!r}")
    keys = [floor_to(F.col("timestamp"), window).alias("bucket"), *([F.col(by)] if by else [])]
    got = logs.groupBy(*keys).agg(*metric_columns(metrics, exact))
    if not fill_gaps or by:
        return got
    full = spine(logs.sparkSession, start, end, window, dict(logs.dtypes)["timestamp"])
    return full.join(got, "bucket", "left").select("bucket", *[F.coalesce(m, F.lit(0.0)).alias(m) for m in metrics])


def long_series(series: DataFrame, metrics: Sequence[str], *keys: str) -> DataFrame:
    """One row for each bucket and metric: metric, bucket, value."""
    return series.unpivot([*keys, "bucket"], list(metrics), "metric", "value")


def distinct_values(logs: DataFrame, column: str, limit: int = 100, prefix: str | None = None) -> DataFrame:
    c = F.col(column).cast("string")
    rows = logs.select(c.alias("value")).where("value IS NOT NULL")
    if prefix:
        rows = rows.where(F.startswith(F.lower("value"), F.lit(prefix.lower())))
    return rows.distinct().orderBy("value").limit(limit)


def dataset_summary(logs: DataFrame) -> DataFrame:
    return logs.agg(F.count("*").alias("records"), F.min("timestamp").alias("first"), F.max("timestamp").alias("last"), F.count_distinct("service").alias("services"))


def describe(logs: DataFrame, column: str, *by: str, exact: bool = True) -> DataFrame:
    """Statistics of any numeric column (deviation 0 for a single value), with exact percentiles unless told otherwise."""
    rows = logs.where(F.col(column).isNotNull()).withColumn(column, F.col(column).cast("double"))
    return (rows.groupBy(*by) if by else rows).agg(*latency_stats(exact, column))


def run_stats(runs: DataFrame) -> DataFrame:
    """Totals over run records (status, records_written)."""
    return runs.agg(F.count("*").alias("runs"), F.count_if(F.col("status") == "failed").alias("failed_runs"), F.coalesce(F.sum("records_written"), F.lit(0)).cast("long").alias("records_written"))
