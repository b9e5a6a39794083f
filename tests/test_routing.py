"""Routed ingest: one pass, early abort, publishing."""

import json
import os

import pytest
from pyspark.sql import functions as F

from emberlog.operators import routing, stages
from emberlog.schema import EVENT
from emberlog.sources import readers, writers

GOOD = '{"timestamp": "2024-01-0%dT00:00:%02dZ", "level": "info", "service": "Pay_API", "message": "m%d password=hunter2"}'


def text_file(tmp_path, lines):
    (tmp_path / "in.log").write_text("\n".join(lines) + "\n")
    return str(tmp_path / "in.log")


def run(spark, tmp_path, lines, name="r1", **options):
    source = text_file(tmp_path, lines)
    return routing.ingest_to(spark.read.text(source), str(tmp_path / "out"), str(tmp_path / "dead"), run=name, parser="json", **options)


def letters(spark, tmp_path):
    return {r["reason"]: r["n"] for r in writers.rejection_counts(readers.dead_letters(spark, str(tmp_path / "dead"))).collect()}


def test_every_line_goes_one_way(spark, tmp_path):
    lines = [GOOD % (1 + i % 3, i, i) for i in range(30)] + [GOOD % (1, 0, 0)] * 9 + ["{broken token=abc", '{"level": "info", "message": "no time"}']
    counts = run(spark, tmp_path, lines)
    assert counts == {"lines": 41, "rejected": 2, "good": 30, "duplicate": 9, "unparseable": 1, "missing_timestamp": 1}
    assert letters(spark, tmp_path) == {"duplicate": 9, "unparseable": 1, "missing_timestamp": 1}
    rows = readers.events(spark, str(tmp_path / "out"))
    assert rows.count() == 30 and set(EVENT.names) <= set(rows.columns)
    assert sorted(os.listdir(tmp_path / "out")) == ["year=2024"]
    stored = str(rows.collect()) + str(readers.dead_letters(spark, str(tmp_path / "dead")).collect())
    assert "hunter2" not in stored and "token=abc" not in stored
    assert {r["stage"] for r in readers.dead_letters(spark, str(tmp_path / "dead")).collect()} == {"parse", "validate", "deduplicate"}


def test_a_repeated_run_replaces_its_own_rows(spark, tmp_path):
    run(spark, tmp_path, [GOOD % (1, i, i) for i in range(10)], "other")
    run(spark, tmp_path, [GOOD % (1 + i % 2, i, i) for i in range(20)] + ["{x"])
    counts = run(spark, tmp_path, [GOOD % (2, i, i) for i in range(7)] + ["{x", "{y"])
    assert counts["good"] == 7
    by_run = {r["run"]: r["n"] for r in spark.read.parquet(str(tmp_path / "out")).groupBy("run").agg(F.count("*").alias("n")).collect()}
    assert by_run == {"other": 10, "r1": 7} and letters(spark, tmp_path) == {"unparseable": 2}


def test_hopeless_runs_stop_while_reading_and_publish_nothing(spark, tmp_path, monkeypatch):
    lines = [GOOD % (1, i, i) for i in range(30)] + ["{{{ broken"] * 12_000
    seen = []
    real = routing._Watch.see
    monkeypatch.setattr(routing._Watch, "see", lambda w, a, b: (seen.append((a, b)), real(w, a, b))[1])
    with pytest.raises(stages.Rejections, match="nothing was published"):
        run(spark, tmp_path, lines)
    assert seen and not os.path.exists(tmp_path / "dead") and not any(f for _, _, f in os.walk(tmp_path / "out"))


def test_the_job_is_cancelled_before_its_end(spark, tmp_path):
    done = spark.sparkContext.accumulator(0)

    def slow(batches):
        import time

        for b in batches:
            time.sleep(0.5)
            done.add(1)
            yield b

    lines = spark.range(4000, numPartitions=40).select(F.lit("{{{ broken").alias("value"))
    count = routing.Observation()
    rows = lines.mapInArrow(slow, "value string").withColumn("bad", F.col("value").startswith("{{{")).observe(count, F.count("*").alias("lines"), F.count_if("bad").alias("rejected"))
    watch = routing.watched(spark, lambda: rows.write.format("noop").mode("overwrite").save(), 0.5, 1000)
    assert watch.tripped and 1000 <= watch.lines < 4000 and done.value < 40


def test_small_runs_are_judged_at_the_end(spark, tmp_path):
    with pytest.raises(stages.Rejections):
        run(spark, tmp_path, ["{a", "{b", GOOD % (1, 1, 1)])
    assert run(spark, tmp_path, ["{a", "{b", GOOD % (1, 1, 1)], most_rejected=0.9)["good"] == 1


def test_dry_run_and_limit(spark, tmp_path):
    lines = [GOOD % (1, i, i) for i in range(30)] + ["{bad"] * 5
    assert run(spark, tmp_path, lines, dry_run=True) == {"lines": 35, "rejected": 5}
    assert not os.path.exists(tmp_path / "out")
    assert run(spark, tmp_path, lines, limit=10, keep_duplicates=False)["lines"] == 10


def test_one_scan_in_the_plan(spark, tmp_path):
    rows = routing.route(spark.read.text(text_file(tmp_path, [GOOD % (1, 1, 1)])), "json")
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("Relation [") == 1


def test_rejected_rows_do_not_shadow_good_ones(spark, tmp_path):
    late = json.dumps({"timestamp": "2024-01-01T00:00:00Z", "message": "same", "level": "info"})
    rows = routing.route(spark.createDataFrame([(late,), (late,), (late,)], "value string"), "json", extra=[("odd", F.col("event_id").isNull())]).groupBy("route").count().collect()
    assert {r["route"]: r["count"] for r in rows} == {"good": 1, "duplicate": 2}
