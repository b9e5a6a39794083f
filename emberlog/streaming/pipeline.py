"""Structured Streaming: the batch stages on a stream, checkpointed and idempotent.

Late rows: a watermark on event time (10 minutes by default) bounds the state of dedup.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..operators.routing import route
from ..schema import conform, is_error
from ..sources import tail
from ..sources.writers import filesystem, write_dead_letters, write_events

WATERMARK = "10 minutes"


def text_stream(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(files_per_trigger))
    return reader.text(path)


def tail_stream(spark: SparkSession, path: str, *, most_records: int | None = None, most_bytes: int = 64 << 20, position: str | None = None, **options: str) -> DataFrame:
    """Lines of a rotating log as they are written, so many a batch; ``position`` tells how far they are stored."""
    tail.register(spark)
    reader = spark.readStream.format("log_tail").options(**{"path": path, "most_bytes": str(most_bytes), "tasks": str(spark.sparkContext.defaultParallelism), **options})
    for name, value in (("most_records", most_records), ("position", position)):
        reader = reader if value is None else reader.option(name, str(value))
    return reader.load()


def kafka_stream(spark: SparkSession, servers: str, topic: str, *, per_trigger: int | None = None, start: str = "latest") -> DataFrame:
    reader = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).option("startingOffsets", start)
    if per_trigger:
        reader = reader.option("maxOffsetsPerTrigger", str(per_trigger))
    return reader.load().select(F.col("value").cast("string").alias("value"), F.col("topic").alias("source"))


def routed(lines: DataFrame, parser="json", watermark: str | None = WATERMARK) -> DataFrame:
    """Every line with its stored columns and route, as ``routing.route`` gives them; a bad line never fails the query.

    With a watermark each event id comes once within it, over batches and restarts. Dead letters have keys of their
    own and all stay. Without one (or on a batch) duplicates stay in.
    """
    rows = route(lines, parser, dedup="none", source_type="stream")
    if watermark is None or not lines.isStreaming:
        return rows
    key = F.when(F.col("route") == "good", F.col("event_id")).otherwise(F.concat(F.lit("-"), F.uuid()))
    return rows.withColumn("_key", key).withWatermark("timestamp", watermark).dropDuplicatesWithinWatermark(["_key"]).drop("_key")


def good(lines: DataFrame, parser="json", watermark: str = WATERMARK) -> DataFrame:
    """Valid rows of a stream, each event id once within the watermark."""
    return conform(routed(lines, parser, watermark).where("route = 'good'"))


def start(lines: DataFrame, root: str, dead: str, checkpoint: str, *, parser="json", watermark: str | None = WATERMARK, every: str = "10 seconds", available_now: bool = False, on_batch: Callable[[DataFrame, int], None] | None = None):
    """Good rows to date-partitioned Parquet and rejected lines to JSON, both from one pass over the batch.

    Event ids are remembered for the watermark with the checkpoint. A batch that runs again replaces its own files.
    """

    def flush(batch: DataFrame, number: int) -> None:
        batch.persist()
        try:
            ok = batch.where("route = 'good'")
            write_events(conform(ok), root, run=f"batch-{number}")
            letters = batch.where("route = 'dead'").select("raw", "reason", "stage", "source", F.col("ingested_at").alias("rejected_at"))
            write_dead_letters(letters, f"{dead}/batch={number}", mode="overwrite")
            if on_batch:
                on_batch(ok, number)
        finally:
            batch.unpersist()

    rows = routed(lines, parser, watermark)
    return _trigger(rows.writeStream.outputMode("append").foreachBatch(flush), checkpoint, every, available_now).start()


def _trigger(writer: DataStreamWriter, checkpoint: str, every: str, available_now: bool) -> DataStreamWriter:
    writer = writer.option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=every)


def live_window(rows: DataFrame, size: str = "5 minutes", slide: str = "10 seconds", watermark: str = WATERMARK) -> DataFrame:
    """Sliding figures of the last minutes: events, errors, rate, p95, last event."""
    bad = F.count_if(is_error())
    w = rows.withWatermark("timestamp", watermark).groupBy(F.window("timestamp", size, slide))
    return w.agg(F.count("*").alias("events"), bad.alias("errors"), F.round(bad / F.count("*"), 6).alias("error_rate"), F.percentile_approx("response_time_ms", 0.95, 10000).alias("p95_latency_ms"), F.max("timestamp").alias("newest")).select("window.start", "window.end", "events", "errors", "error_rate", "p95_latency_ms", "newest")


def live_services(rows: DataFrame, size: str = "5 minutes", slide: str = "10 seconds", watermark: str = WATERMARK) -> DataFrame:
    """Events of each service in the sliding window (readers take the ten largest)."""
    return rows.withWatermark("timestamp", watermark).groupBy(F.window("timestamp", size, slide), "service").agg(F.count("*").alias("events"))


class LiveWindow:
    """The newest events of a stream: not older than ``age`` seconds behind the newest one and ``most`` at most.

    Pass ``update`` as ``on_batch`` of ``start``. The window is a small table beside the checkpoint, one version a batch, found
    by an ordered limit over the batch and the last version: every task sends ``most`` rows at most, whatever the
    batch's size. A batch that runs again starts from the version before it. Age follows event time, not the clock;
    an event older than the window is ignored.
    """

    COLUMNS = "event_id string, timestamp timestamp, service string, failed boolean, response_time_ms double"

    def __init__(self, spark: SparkSession, root: str, age: int = 300, most: int = 10_000, services: int = 10):
        self.spark, self.root, self.age, self.most, self.services = spark, root.rstrip("/"), age, most, services

    def _versions(self) -> list[int]:
        fs, _ = filesystem(self.spark, self.root)
        found = fs.globStatus(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/batch=*/_SUCCESS"))
        return sorted(int(s.getPath().getParent().getName().split("=")[1]) for s in found or [])

    def _read(self, number: int) -> DataFrame:
        return self.spark.read.schema(self.COLUMNS).parquet(f"{self.root}/batch={number}")

    def update(self, batch: DataFrame, number: int) -> None:
        new = batch.select("event_id", F.col("timestamp").cast("timestamp").alias("timestamp"), "service", is_error().alias("failed"), "response_time_ms")
        before = [n for n in self._versions() if n < number]
        both = self._read(before[-1]).unionByName(new) if before else new
        newest = both.orderBy(F.desc("timestamp"), "event_id").limit(self.most)
        last = newest.agg(F.max("timestamp").alias("last"))
        kept = newest.join(F.broadcast(last), how="cross").where(F.col("timestamp") >= F.col("last") - F.make_interval(secs=F.lit(self.age))).drop("last")  # one row beside a bounded table
        kept.coalesce(1).write.mode("overwrite").parquet(f"{self.root}/batch={number}")
        fs, _ = filesystem(self.spark, self.root)
        for n in before[:-1]:  # the version before stays: this batch may run again
            fs.delete(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/batch={n}"), True)

    def table(self) -> DataFrame:
        """The window's events as they stand."""
        versions = self._versions()
        return self._read(versions[-1]) if versions else self.spark.createDataFrame([], self.COLUMNS)

    def figures(self) -> DataFrame:
        return window_figures(self.table(), self.age, self.services)


def window_figures(rows: DataFrame, seconds: int = 300, services: int = 10) -> DataFrame:
    """One row over a bounded window (service, failed, response_time_ms, timestamp): counts, rates, the exact p95
    (the value at place floor(0.95 n) of the sorted ones), and the largest services with their counts."""
    sorted_ms = F.array_sort(F.collect_list("response_time_ms"))
    at = F.floor(F.size("_ms") * F.lit(0.95)).cast("int")
    one = rows.agg(F.count("*").alias("events"), F.count_if("failed").alias("errors"), sorted_ms.alias("_ms"), F.min("timestamp").alias("oldest"), F.max("timestamp").alias("newest"))
    top = rows.where("service IS NOT NULL").groupBy("service").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "service").limit(services)
    names = top.agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("less"), "service"))), lambda s: F.struct(s["service"].alias("service"), (-s["less"]).alias("n"))).alias("services"))
    events = F.col("events")
    return one.join(names, how="cross").select(  # one row each
        events, "errors", F.when(events > 0, F.round(F.col("errors") / events, 6)).otherwise(0.0).alias("error_rate"), F.round(events / seconds, 3).alias("events_per_second"),
        F.round(F.coalesce(F.get("_ms", at), F.lit(0.0)), 3).alias("p95_latency_ms"), "services", "oldest", "newest",
    )


def snapshot(query) -> dict:
    """Counters of a running query."""
    p = query.lastProgress
    return {"id": str(query.id), "running": query.isActive, "batch": p["batchId"] if p else None, "rows": p["numInputRows"] if p else 0, "rows_per_second": p["processedRowsPerSecond"] if p else 0.0}
