"""Sources as DataFrames. Text sources give value, source and line_number-free lines; order is never assumed."""

from __future__ import annotations

import ipaddress
import re
import socket
from collections.abc import Mapping, Sequence
from urllib.parse import parse_qsl, unquote, urlencode, urlsplit, urlunsplit

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import EVENT
from .ranges import key_ranges
from .spanning import Begins, Braces, Quoted, spanning

LONGEST_LINE = 1 << 20
STORED_TIME, NO_VALUE = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "\\N"  # how text stores spell times and missing values


def text(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Lines of plain or compressed files: value and source. Blank lines go, over-long ones are cut and flagged."""
    return _lines(spark.read.text(path))


def _lines(rows: DataFrame) -> DataFrame:
    rows = rows.withColumn("source", F.col("_metadata.file_name")).where(F.length(F.trim("value")) > 0)
    return rows.withColumn("too_long", F.length("value") > LONGEST_LINE).withColumn("value", F.left("value", F.lit(LONGEST_LINE)))


def directory(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """Every file below a directory; unreadable files are skipped."""
    found = spark.read.option("recursiveFileLookup", "true").option("ignoreCorruptFiles", "true").option("ignoreMissingFiles", "true")
    if pattern:
        found = found.option("pathGlobFilter", pattern)
    return _lines(found.text(path))


def sniff(header: str) -> str:
    """The delimiter that a header line uses most."""
    return max(",;\t|", key=lambda d: (header.count(d), -",;\t|".index(d)))


def csv(spark: SparkSession, path: str | list[str], delimiter: str | None = None) -> DataFrame:
    """Rows of a delimited file or folder as JSON lines (value), so that the record parser takes them.

    Each file's first line is its header. Quoted cells may hold delimiters and line breaks; cells beyond the header go to
    the list ``_extra``, empty ones too; short rows lack their last fields; blank rows go. A row of over a million
    characters is cut and flagged (too_long).
    """
    head = spark.read.option("lineSep", "\n").text(path).limit(1).first()
    sep = delimiter or sniff((head["value"] if head else "").lstrip("\ufeff"))
    rows = spanning(spark, path, Quoted(sep))
    return rows.where("block > 0 OR line > 0").select("value", "source", "too_long")


def json_array(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Objects of a JSON array (or a single object), one line each; other items are kept as they are and fail in the parser.

    The file is read in pieces that end at a closing brace, by several tasks; what a task holds is one object.
    """
    chunks = spanning(spark, path, Braces())
    items = F.from_json(F.concat(F.lit("["), F.col("value"), F.lit("]")), "array<string>")
    # a chunk that isn't JSON stays one line, which the parser rejects
    return chunks.select(F.explode(F.coalesce(items, F.array("value"))).alias("value"), "source")


def multiline(spark: SparkSession, path: str | list[str], begins: str, recursive: bool = False) -> DataFrame:
    """Records of several lines: each begins at a line that matches ``begins``; value holds all its lines."""
    return spanning(spark, path, Begins(begins), recursive=recursive).select("value", "source", "n_lines", "too_long")


_NAME = re.compile(r"^[A-Za-z_][A-Za-z0-9_$]{0,62}$")


def identifier(name: str) -> str:
    if not all(_NAME.match(p) for p in name.split(".")) or name.count(".") > 2:
        raise ValueError(f"not a plain identifier: {name!r}")
    return name


def database(spark: SparkSession, url: str, table: str, *, columns: Sequence[str] = (), timestamp_column: str | None = None, since: str | None = None, until: str | None = None, limit: int | None = None, fetch_size: int = 5000, slices: Sequence[str] | None = None, key: str | None = None, parallel: int = 8, options: Mapping[str, str] | None = None) -> DataFrame:
    """A relational table over JDBC: since <= ts < until, pushed down. ``slices`` are predicates read in parallel; with a
    whole-number ``key`` they are ``parallel`` ranges of about equal row counts, counted in the database first."""
    identifier(table)
    cols = [identifier(c) for c in columns]
    props = {"fetchsize": str(fetch_size), **(options or {})}
    if key and not slices:
        slices = key_ranges(spark, url, table, identifier(key), parallel, options)
    rows = spark.read.jdbc(url, table, predicates=list(slices), properties=props) if slices else spark.read.jdbc(url, table, properties=props)
    if timestamp_column:
        ts = F.col(identifier(timestamp_column))
        rows = rows.where(ts >= F.lit(since).cast("timestamp")) if since else rows
        rows = rows.where(ts < F.lit(until).cast("timestamp")) if until else rows
    rows = rows.select(*cols) if cols else rows
    if limit is not None:
        rows = (rows.orderBy(timestamp_column) if timestamp_column else rows).limit(limit)
    return rows


def records(rows: DataFrame, source: str = "database") -> DataFrame:
    """Structured rows as JSON lines for the record parser."""
    return rows.select(F.to_json(F.struct("*")).alias("value"), F.lit(source).alias("source"))


def redact_url(url: str) -> str:
    """No user info, and values of parameters that look secret hidden."""
    parts = urlsplit(url)
    host = parts.hostname or ""
    query = urlencode([(k, "***" if re.search(r"(?i)key|token|secret|pass|auth|sig", k) else v) for k, v in parse_qsl(parts.query, keep_blank_values=True)], safe="*")
    return urlunsplit((parts.scheme, host + (f":{parts.port}" if parts.port else ""), parts.path, query, ""))


def allowed_url(url: str, allow_private: bool = False) -> None:
    """Only http(s), and no address of an internal network unless allowed."""
    parts = urlsplit(url)
    if parts.scheme not in ("http", "https") or not parts.hostname:
        raise ValueError("only http and https URLs")
    if allow_private:
        return
    for info in socket.getaddrinfo(parts.hostname, parts.port or 443, proto=socket.IPPROTO_TCP):
        a = ipaddress.ip_address(info[4][0])
        if a.is_private or a.is_loopback or a.is_link_local or a.is_multicast or a.is_reserved or a.is_unspecified:
            raise ValueError("address of an internal network")


def dig(value, path: str):
    """Value at a dotted path of nested objects and lists, or None."""
    for part in [p for p in path.split(".") if p]:
        if isinstance(value, list):
            value = value[int(part)] if part.isdigit() and int(part) < len(value) else None
        else:
            value = value.get(part) if isinstance(value, dict) else None
    return value


def events(spark: SparkSession, root: str, start=None, end=None, format: str = "parquet") -> DataFrame:
    """A stored dataset (parquet, json or csv) with its declared schema; the range prunes day partitions.

    Times of JSON and CSV stores are read back to the microsecond; in CSV an empty text and a missing one are kept apart.
    """
    from pyspark.sql import types as T

    from ..functions.times import in_range

    schema = T.StructType([*EVENT.fields, *[T.StructField(n, T.StringType()) for n in ("year", "month", "day", "run")]])
    reader = spark.read.schema(schema).option("timestampFormat", STORED_TIME)
    if format == "csv":
        reader = reader.option("header", "true").option("multiLine", "true").option("nullValue", NO_VALUE).option("escape", '"')
    elif format not in ("parquet", "json"):
        raise ValueError(f"unknown format {format!r}")
    return in_range(reader.format(format).load(root), start, end)


def dead_letters(spark: SparkSession, root: str, since: str | None = None) -> DataFrame:
    rows = spark.read.schema("raw string, reason string, stage string, source string, rejected_at timestamp").option("mode", "PERMISSIVE").json(root)
    rows = rows.where("reason IS NOT NULL")  # broken lines have none
    return rows.where(F.col("rejected_at") >= F.lit(since).cast("timestamp")) if since else rows


#: database URLs of other tools and the JDBC scheme that reads them
JDBC_SCHEMES = {"postgres": "postgresql", "postgresql": "postgresql", "mysql": "mysql", "mariadb": "mariadb", "sqlite": "sqlite", "duckdb": "duckdb", "mssql": "sqlserver", "oracle": "oracle:thin"}


def jdbc_target(target: str) -> tuple[str, str, dict[str, str]] | None:
    """(JDBC URL, table, options) of ``scheme[+driver]://user:password@host/database#table``, or None. The password never stands in the URL."""
    parts = urlsplit(target)
    scheme = JDBC_SCHEMES.get(parts.scheme.split("+")[0])
    if scheme is None:
        return None
    if not parts.fragment:
        raise ValueError("name the table behind a #")
    options = {k: unquote(v) for k, v in (("user", parts.username), ("password", parts.password)) if v}
    query = f"?{parts.query}" if parts.query else ""
    if not parts.hostname:  # a file
        return f"jdbc:{scheme}:{parts.path[1:] if parts.path.startswith('//') else parts.path}{query}", parts.fragment, options
    host = parts.hostname + (f":{parts.port}" if parts.port else "")
    place = f"@//{host}{parts.path}" if scheme.startswith("oracle") else f"//{host};databaseName={parts.path[1:]}" if scheme == "sqlserver" else f"//{host}{parts.path}"
    return f"jdbc:{scheme}:{place}{query}", parts.fragment, options


def for_target(spark: SparkSession, target: str) -> DataFrame:
    """Lines of whatever a target names: URL, JDBC, directory or file by its ending."""
    if target.startswith(("http://", "https://")):
        from .rest import register

        register(spark)
        return spark.read.format("rest_records").option("url", target).load()
    if target.startswith("jdbc:"):
        url, _, table = target.partition("#")
        return records(database(spark, url, table))
    if found := jdbc_target(target):
        return records(database(spark, found[0], found[1], options=found[2]))
    bare = target.lower().removesuffix(".gz")
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(target)
    if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory():
        return directory(spark, target)
    if bare.endswith((".csv", ".tsv")):
        return csv(spark, target, "\t" if bare.endswith(".tsv") else None)
    if bare.endswith(".json"):
        first = text(spark, target).limit(1).first()
        if first and first["value"].lstrip().startswith("["):
            return json_array(spark, target)
    return text(spark, target)
