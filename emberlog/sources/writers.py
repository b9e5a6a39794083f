"""Sinks and upkeep of date-partitioned datasets."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.times import partition_columns
from ..schema import PARTITIONS
from .readers import NO_VALUE, STORED_TIME


NO_RUN = "none"


def _dealt(df: DataFrame, files_per_day: int | None) -> DataFrame:
    """Rows of a day go to a few tasks instead of a file of every task for every day.

    Without a number adaptive execution decides: a day with most rows is split by size, small days share a task.
    """
    if files_per_day is None:
        return df.hint("rebalance", *PARTITIONS)
    return df.repartition(*PARTITIONS, F.pmod(F.xxhash64("event_id"), F.lit(files_per_day)))


def write_events(df: DataFrame, root: str, *, format: str = "parquet", run: str | None = None, mode: str = "append", files_per_day: int | None = None, hourly: bool = False) -> None:
    """parquet (zstd), json or csv under year=/month=/day=/run=. With a ``run`` id a repeated run replaces its own files."""
    out = _dealt(partition_columns(df, hourly=hourly), files_per_day)
    keys = [*PARTITIONS, *(["hour"] if hourly else []), "run"]  # always there: one layout for all writes of a dataset
    out, mode = out.withColumn("run", F.lit(run or NO_RUN)), "overwrite" if run else mode
    writer = out.write.mode(mode).partitionBy(*keys).option("partitionOverwriteMode", "dynamic")
    if format == "parquet":
        writer.option("compression", "zstd").parquet(root)
    elif format == "json":
        writer.option("timestampFormat", STORED_TIME).json(root)
    elif format == "csv":
        writer.option("header", "true").option("timestampFormat", STORED_TIME).option("nullValue", NO_VALUE).option("escape", '"').csv(root)
    else:
        raise ValueError(f"unknown format {format!r}")


def write_dead_letters(df: DataFrame, root: str, mode: str = "append") -> None:
    df.withColumn("day", F.date_format("rejected_at", "yyyy-MM-dd")).write.mode(mode).partitionBy("day").json(root)


def rejection_counts(dead: DataFrame) -> DataFrame:
    return dead.groupBy("reason").agg(F.count("*").alias("n"))


def replayable(dead: DataFrame, reasons: tuple[str, ...] = ("storage_error", "transform_error", "unknown"), *more: str) -> DataFrame:
    """Lines worth another run, with ``more`` of their columns."""
    return dead.where(F.col("reason").isin(*reasons)).select(F.col("raw").alias("value"), *more)


def export(df: DataFrame, path: str, most: int | None = None) -> None:
    """NDJSON; an ordered limit only where ``most`` asks for one."""
    (df if most is None else df.orderBy(F.desc("timestamp"), F.desc("event_id")).limit(most)).write.mode("errorifexists").json(path)


def filesystem(spark: SparkSession, root: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def day_partitions(spark: SparkSession, root: str) -> dict[date, str]:
    """Day directories of a dataset, from its listing alone."""
    fs, path = filesystem(spark, root)
    found = fs.globStatus(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path, "year=*/month=*/day=*")) or []
    out = {}
    for status in found:
        p = status.getPath().toString()
        y, m, d = (int(part.split("=")[1]) for part in p.split("/")[-3:])
        out[date(y, m, d)] = p
    return out


def expire(spark: SparkSession, root: str, days: int, *, today: date, dry_run: bool = True) -> list[str]:
    """Day directories older than ``days``; deleted unless it is a dry run."""
    old = [p for d, p in sorted(day_partitions(spark, root).items()) if d < today - timedelta(days=days)]
    if not dry_run:
        fs, _ = filesystem(spark, root)
        for p in old:
            fs.delete(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p), True)
    return old


def compact(spark: SparkSession, root: str, day: date, target_mb: int = 128) -> int:
    """One day's files rewritten to about ``target_mb`` each, run by run (and hour by hour), so that a repeated run still replaces its own.

    Staged first, then swapped by two renames; between them readers miss the day. Returns the number of files.
    """
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path
    source = day_partitions(spark, root)[day]
    fs, _ = filesystem(spark, root)
    size = fs.getContentSummary(path(source)).getLength()
    n = max(1, -(-size // (target_mb << 20)))
    staged, old = f"{root}/_staged_{day:%Y%m%d}", f"{root}/_old_{day:%Y%m%d}"
    from pyspark.sql import types as T

    from ..schema import EVENT

    keys = [k for k, depth in (("hour", "hour=*"), ("run", "run=*")) if fs.globStatus(path(source, depth)) or fs.globStatus(path(source, f"*/{depth}"))]
    rows = spark.read.schema(T.StructType([*EVENT.fields, *[T.StructField(k, T.StringType()) for k in keys]])).parquet(source)
    dealt = rows.repartition(n, *keys, F.pmod(F.xxhash64("event_id"), F.lit(n))) if keys else rows.repartition(n)
    writer = dealt.write.mode("overwrite").option("compression", "zstd")
    (writer.partitionBy(*keys) if keys else writer).parquet(staged)
    files = sum(1 for f in spark.read.parquet(staged).inputFiles())
    fs.rename(path(source), path(old))
    fs.rename(path(staged), path(source))
    fs.delete(path(old), True)
    return files


def count_rows(spark: SparkSession, root: str) -> int:
    """From footers alone where aggregate pushdown is on."""
    return spark.read.parquet(root).count()
