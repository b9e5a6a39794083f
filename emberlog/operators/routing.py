"""Routed ingest: one pass over the lines, every row written once by where it goes, published only if the run holds.

Each line ends as a good row, a dead letter or a duplicate (``route``). The pass counts lines and rejections
on its way (an observed metric); a listener reads the count whenever a task ends and cancels the job once the share
of rejections can't be right. Rows are staged as Parquet by route, then published by renames: dead letters first, good rows by day
under the run's own folder, so a repeated run replaces what it published before. A run that fails or
aborts publishes nothing.
"""

from __future__ import annotations

import atexit
import threading
import uuid
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from py4j.protocol import Py4JError, Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions import masking
from ..functions.times import partition_columns
from ..schema import PARTITIONS
from ..sources.writers import filesystem, write_dead_letters
from .parsers import parse
from .stages import Rejections, clean, enrich, normalise, stored, transform, validate, with_duplicates

LEAST_LINES = 1000  # a rate over fewer lines says nothing yet
_COUNTERS = "internal.metrics.collectMetricsAccumulator"  # how the engine names an observed metric's counter


def route(lines: DataFrame, parser: str | Callable[[DataFrame], DataFrame] = "plaintext", *, source: str = "unknown", source_type: str = "file", default_service: str | None = None, dedup: str = "event_id", count: Observation | None = None, **rules) -> DataFrame:
    """Every line with its stored columns and route ('good', 'dead', 'duplicate'), reason, stage and raw.

    ``lines`` that are parsed already (they have an ``event``) are taken as they are. ``rules`` go to ``validate``. Rows that
    validation rejects never make a good row a duplicate.
    """
    parsed = lines if "event" in lines.columns else parse(lines, parser, source=source, source_type=source_type)
    rest = [c for c in parsed.columns if c not in ("event", "source")]
    origin = F.coalesce("event.source", F.col("source") if "source" in parsed.columns else F.lit(source))
    fields = [origin.alias(n) if n == "source" else F.col("event")[n].alias(n) for n in parsed.schema["event"].dataType.names]
    flat = parsed.select(*fields, *rest, F.col("event").isNotNull().alias("_parsed"))  # a line that no parser took has only its source
    rows = validate(transform(flat, (clean, lambda d: normalise(d, default_service), enrich)), **rules)
    blank = F.length(F.trim(F.coalesce("value", F.lit("")))) == 0
    reason = F.when(~F.col("_parsed"), F.when(blank, "empty_line").otherwise("unparseable")).otherwise(F.col("reject_reason"))
    raw = F.when(F.col("_parsed"), F.col("raw_message")).otherwise(masking.mask_text(F.col("value")))
    rows = rows.withColumns({"reason": reason, "_raw": raw})
    if count is not None:
        rows = rows.observe(count, F.count(F.lit(1)).alias("lines"), F.count_if(F.col("reason").isNotNull()).alias("rejected"))
    rows = with_duplicates(rows, dedup, among=F.col("reason").isNull())
    twice = F.col("is_duplicate")
    way = F.when(F.col("reason").isNotNull(), "dead").when(twice, "duplicate").otherwise("good")
    stage = F.when(~F.col("_parsed"), "parse").when(F.col("reason").isNotNull(), "validate").when(twice, "deduplicate")
    out = rows.withColumns({"route": way, "stage": stage, "reason": F.when(twice, "duplicate").otherwise(F.col("reason")), "raw": F.when(way != "good", F.col("_raw"))})
    return stored(out, "route", "reason", "stage", "raw")


# -- counting while the job runs ------------------------------------------------------------------------------------------
@dataclass
class _Watch:
    """Looks at the counters of one job group; ``trip`` is called once when the share is over ``most``."""

    most: float
    least: int
    trip: Callable[[], None]
    stages: set = field(default_factory=set)
    lines: int = 0
    rejected: int = 0
    tripped: bool = False

    def see(self, lines: int, rejected: int) -> None:
        self.lines, self.rejected = max(self.lines, lines), max(self.rejected, rejected)
        if not self.tripped and hopeless(lines, rejected, self.most, self.least):
            self.tripped = True
            threading.Thread(target=self.trip, daemon=True).start()  # the listener's thread must not wait for a scheduler


def hopeless(lines: int, rejected: int, most: float, least: int) -> bool:
    return lines >= least and rejected > most * lines


class _Listener:
    """The session's one task listener; it hands counters to the watches of their job groups."""

    def __init__(self):
        self.watches: dict[str, _Watch] = {}

    def onJobStart(self, event) -> None:  # noqa: N802
        group = event.properties().getProperty("spark.jobGroup.id") if event.properties() else None
        if group in self.watches:
            ids = event.stageIds()
            self.watches[group].stages.update(ids.apply(i) for i in range(ids.size()))

    def onTaskEnd(self, event) -> None:  # noqa: N802
        if not self.watches:
            return
        stage = event.stageId()
        for watch in [w for w in self.watches.values() if stage in w.stages]:
            counters = event.taskInfo().accumulables()
            for i in range(counters.size()):
                info = counters.apply(i)
                if info.name().isDefined() and info.name().get() == _COUNTERS and info.value().isDefined():
                    row = info.value().get()
                    if row.numFields() == 2:
                        watch.see(row.getLong(0), row.getLong(1))

    def __getattr__(self, name: str):
        if name.startswith("on"):
            return lambda *_: None
        raise AttributeError(name)

    class Java:
        implements = ["org.apache.spark.scheduler.SparkListenerInterface"]


_LISTENERS: dict[str, _Listener] = {}
_LOCK = threading.Lock()


def _listener(spark: SparkSession) -> _Listener:
    from pyspark.java_gateway import ensure_callback_server_started

    sc = spark.sparkContext
    with _LOCK:
        found = _LISTENERS.get(sc.applicationId)
        if found is None:
            ensure_callback_server_started(sc._gateway)
            found = _LISTENERS[sc.applicationId] = _Listener()
            sc._jsc.sc().addSparkListener(found)
            atexit.register(sc.stop)  # while Python can still answer the listener's last events
        return found


def watched(spark: SparkSession, run: Callable[[], None], most: float, least: int) -> _Watch:
    """Runs a job and cancels it when over ``most`` of its observed lines (``least`` at least) are rejected."""
    sc, group = spark.sparkContext, f"ingest-{uuid.uuid4().hex}"
    listener = _listener(spark)
    watch = listener.watches[group] = _Watch(most, least, lambda: sc.cancelJobGroup(group))
    before = {k: sc.getLocalProperty(k) for k in ("spark.jobGroup.id", "spark.job.description", "spark.job.interruptOnCancel")}
    sc.setJobGroup(group, "ingest", interruptOnCancel=False)
    try:
        run()
    except (Py4JJavaError, PySparkException):
        if not watch.tripped:
            raise
    finally:
        for k, v in before.items():
            sc.setLocalProperty(k, v)
        listener.watches.pop(group, None)
    return watch


# -- a whole run ----------------------------------------------------------------------------------------------------------
def ingest_to(lines: DataFrame, root: str, dead: str, *, run: str, parser: str | Callable[[DataFrame], DataFrame] = "plaintext", most_rejected: float = 0.5, least_lines: int = LEAST_LINES, limit: int | None = None, keep_duplicates: bool = True, dry_run: bool = False, **options) -> Mapping[str, int]:
    """Lines to good rows below ``root`` (year/month/day/run) and dead letters below ``dead`` (run/day); counts by reason.

    Over ``most_rejected`` of at least ``least_lines`` lines rejected: the job is cancelled where it stands and
    ``Rejections`` is raised (fewer lines are judged at the end). ``limit`` takes so many lines. ``keep_duplicates`` sends
    duplicates to the dead letters. A dry run does everything but write, and counts.
    """
    spark = lines.sparkSession
    if limit is not None:
        lines = lines.limit(limit)
    count = Observation()
    rows = partition_columns(route(lines, parser, count=count, **options))
    fs, path = filesystem(spark, root)
    staged = f"{root.rstrip('/')}/_staged-{run}"
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path

    def write() -> None:
        if dry_run:
            rows.write.format("noop").mode("overwrite").save()
        else:  # a day with most rows is split, small ones share a task
            rows.hint("rebalance", "route", *PARTITIONS).write.mode("overwrite").partitionBy("route", *PARTITIONS).option("compression", "zstd").parquet(staged)

    try:
        watch = watched(spark, write, most_rejected, least_lines)
        seen = {"lines": watch.lines, "rejected": watch.rejected} if watch.tripped else dict(count.get)
        if watch.tripped or hopeless(seen["lines"], seen["rejected"], most_rejected, 1):
            raise Rejections(f"{seen['rejected']} of {seen['lines']} lines rejected; nothing was published")
        counts = {"lines": seen["lines"], "rejected": seen["rejected"]}
        if dry_run:
            return counts
        by = spark.read.schema("route string, reason string").parquet(staged).groupBy("route", "reason").agg(F.count("*").alias("n")).collect()
        counts |= {"good": 0, "duplicate": 0} | {r["reason"] or r["route"]: r["n"] for r in by}
        _publish(spark, fs, place, staged, root.rstrip("/"), dead.rstrip("/"), run, keep_duplicates)
        return counts
    finally:
        try:
            fs.delete(place(staged), True)
        except Py4JError:
            pass  # the session is gone


def _publish(spark: SparkSession, fs, place, staged: str, root: str, dead: str, run: str, keep_duplicates: bool) -> None:
    """Dead letters as JSON, then the run's day folders renamed into the dataset in place of its earlier ones."""
    wanted = ("dead", "duplicate") if keep_duplicates else ("dead",)
    letters = spark.read.schema("route string, raw string, reason string, stage string, source string, ingested_at timestamp").parquet(staged).where(F.col("route").isin(*wanted))
    write_dead_letters(letters.select("raw", "reason", "stage", "source", F.col("ingested_at").alias("rejected_at")), f"{dead}/run={run}", mode="overwrite")
    for old in fs.globStatus(place(f"{root}/year=*/month=*/day=*/run={run}")) or []:
        fs.delete(old.getPath(), True)
    for day in fs.globStatus(place(f"{staged}/route=good/year=*/month=*/day=*")) or []:
        target = "/".join(day.getPath().toString().split("/")[-3:])
        fs.mkdirs(place(f"{root}/{target}"))
        if not fs.rename(day.getPath(), place(f"{root}/{target}/run={run}")):
            raise OSError(f"could not publish {target} of run {run}")
