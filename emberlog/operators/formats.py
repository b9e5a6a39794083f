"""Formats by file: every file of a folder gets its own parser, from one grouped vote over a sample of its lines.

One native aggregate by file counts how many sampled lines fit each format; files are then read in groups of one format,
each file once. A file gives about SAMPLE bytes of lines to the vote, whatever its size, chosen by a
hash of line and place, so no order is assumed and nothing is collected but one row a file.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import readers
from .parsers import ACCESS, ENDINGS, NGINX_ERROR, PAIR, SYSLOG_3164, SYSLOG_5424, TRUST, parse

SAMPLE = 1 << 20
ENOUGH = 25  # lines that count in full
MOST_FILES = 100_000  # formats of more files are kept in a table
TABLES = (".csv", ".tsv")


def fits() -> dict[str, Column]:
    """Whether a line (value) has the shape of a format. Two pairs occur in prose too, so key=value lines need three."""
    v = F.col("value")
    bare = F.regexp_replace(F.trim(v), ",+$", "")
    return {
        "json": bare.startswith("{") & F.coalesce(F.size(F.from_json(bare, "map<string,string>")) > 0, F.lit(False)),
        "access": v.rlike(ACCESS),
        "nginx_error": v.rlike(NGINX_ERROR),
        "syslog": v.rlike(SYSLOG_3164) | v.rlike(SYSLOG_5424),
        "keyvalue": F.size(F.regexp_extract_all(v, F.lit(PAIR), F.lit(1))) >= 3,
        "plaintext": F.length(F.trim(v)) > 0,
    }


def votes(lines: DataFrame, *by: str, sampled: Column | None = None) -> DataFrame:
    """n and the hits of each format, for all lines or by groups; only ``sampled`` lines are looked at."""
    look = (F.length(F.trim("value")) > 0) & (F.lit(True) if sampled is None else sampled)
    return lines.groupBy(*by).agg(F.count_if(look).alias("n"), *[F.count_if(look & c).alias(k) for k, c in fits().items()])


def choose(vote: Mapping, filename: str = "") -> str:
    """The format with most points: share of lines that fit, weighed by trust, the lines themselves, and the file's ending."""
    n, name = max(vote["n"], 1), filename.lower().removesuffix(".gz")
    points = {}
    for k, trust in TRUST.items():
        share = vote[k] / n
        if share >= 0.5 or k == "plaintext":
            points[k] = share * trust + 4 * share * min(n, ENOUGH) + (15 if ENDINGS[k] and name.endswith(ENDINGS[k]) else 0)
    return min(points, key=lambda k: (-points[k], -TRUST[k], k))


def detect(lines: DataFrame, filename: str = "", sample: int = ENOUGH) -> str:
    """The parser for lines of one source, in one job over a small sample."""
    return choose(votes(lines.where(F.length(F.trim("value")) > 0).limit(sample)).first(), filename)


def file_votes(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """file, the votes of its sampled lines, and how its first line begins."""
    found = spark.read.option("recursiveFileLookup", "true").option("ignoreCorruptFiles", "true").option("ignoreMissingFiles", "true")
    if pattern:
        found = found.option("pathGlobFilter", pattern)
    place = F.monotonically_increasing_id()
    lines = found.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("_metadata.file_size").alias("size"), "value", place.alias("place"))
    first = F.min_by(F.when(F.length(F.trim("value")) > 0, F.left(F.trim("value"), F.lit(1))), F.when(F.length(F.trim("value")) > 0, F.struct("block", "place")))
    chosen = F.pmod(F.xxhash64("value", "place"), F.greatest("size", F.lit(1))) < SAMPLE
    look = (F.length(F.trim("value")) > 0) & chosen
    return lines.groupBy("file").agg(F.count_if(look).alias("n"), *[F.count_if(look & c).alias(k) for k, c in fits().items()], first.alias("first"))


def format_of(vote: Mapping) -> str:
    """csv and tsv by ending, json_array for a .json file that begins with a bracket, else the vote's choice."""
    name = vote["file"].rsplit("/", 1)[-1].lower().removesuffix(".gz")
    if name.endswith(TABLES):
        return name[-3:]
    if name.endswith(".json") and vote["first"] == "[":
        return "json_array"
    return choose(vote, name)


def formats(spark: SparkSession, path: str, pattern: str | None = None) -> dict[str, list[str]]:
    """Format -> its files. One row a file reaches the driver, which lists them for a scan anyway; over MOST_FILES is an error."""
    rows = file_votes(spark, path, pattern).limit(MOST_FILES + 1).collect()
    if len(rows) > MOST_FILES:
        raise ValueError(f"over {MOST_FILES} files: read the folder in parts, by pattern")
    out: dict[str, list[str]] = {}
    for r in sorted(rows, key=lambda r: r["file"]):
        out.setdefault(format_of(r), []).append(r["file"])
    return out


def read_events(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """Parsed lines (value, source, event) of a folder whose files have formats of their own; each file is parsed once.

    Files that one parser takes are one branch of the plan, whatever their reader.
    """
    lines_of: dict[str, list[DataFrame]] = {}
    for name, files in formats(spark, path, pattern).items():
        if name in ("csv", "tsv"):
            lines, parser = readers.csv(spark, files, "\t" if name == "tsv" else None), "json"
        elif name == "json_array":
            lines, parser = readers.json_array(spark, files), "json"
        else:
            lines, parser = readers.text(spark, files), name
        lines_of.setdefault(parser, []).append(lines.select("value", "source"))
    if not lines_of:
        return parse(spark.createDataFrame([], "value string, source string"))
    return reduce(DataFrame.unionByName, [parse(reduce(DataFrame.unionByName, lines), parser) for parser, lines in lines_of.items()])
