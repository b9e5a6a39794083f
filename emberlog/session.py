"""Session defaults. A cluster's own settings win: only unset keys are filled in."""

from __future__ import annotations

from pyspark.sql import SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.sql.parquet.aggregatePushdown": "true",
    "spark.sql.parquet.compression.codec": "zstd",
    # call sites of columns in error messages cost three round trips a column: plans of wide rows take three times as long to build
    "spark.python.sql.dataFrameDebugging.enabled": "false",
    # the JVM never compiles a method of over 8,000 bytecodes: a stage of wide expressions would be interpreted for every row
    "spark.sql.codegen.hugeMethodLimit": "8000",
}


def build(name: str = "emberlog", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **{k.replace("__", "."): v for k, v in conf.items()}}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def prefer(spark: SparkSession, *keys: str) -> None:
    """Our defaults of these keys in a session that others built; what is set already stays."""
    for key in keys:
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, DEFAULTS[key])
