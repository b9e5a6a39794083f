"""Replay with its ledger, streams over restarts, the live window, and caps that say so."""

import http.server
import json
import threading
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from emberlog.operators import replay, search
from emberlog.sources import readers, rest, writers
from emberlog.streaming import pipeline as streaming

GOOD = '{"timestamp": "2024-01-01T00:00:%02dZ", "level": "info", "message": "m%d", "status": 200}'


def letters(spark, root, rows):
    df = spark.createDataFrame(rows, "raw string, reason string, source string").withColumns({"stage": F.lit("parse"), "rejected_at": F.current_timestamp()})
    writers.write_dead_letters(df, root + "/run=first")


def test_a_second_replay_writes_nothing(spark, tmp_path):
    dead, root, tries = (str(tmp_path / n) for n in ("dead", "out", "tries"))
    rows = [(GOOD % (i, i), "unknown", "a.log") for i in range(4)] + [(GOOD % (1, 1), "unknown", "a.log"), ("{bad token=abc", "storage_error", "a.log"), (GOOD % (9, 9), "unparseable", "a.log"), (None, "unknown", "a.log")]
    letters(spark, dead, rows)
    once = replay.replay(spark, dead, root, tries, run="one", parser="json")
    assert once == {"lines": 5, "rejected": 1, "good": 4, "duplicate": 0, "unparseable": 1}
    assert readers.events(spark, root).count() == 4
    assert {r["outcome"]: r["n"] for r in replay.ledger(spark, tries).groupBy("outcome").agg(F.count("*").alias("n")).collect()} == {"good": 4, "dead": 1}
    reasons = ("unknown", "storage_error", "unparseable")
    assert replay.replay(spark, dead, root, tries, run="two", parser="json")["lines"] == 0
    again = replay.replay(spark, dead, root, tries, run="one", parser="json")
    assert again == once and readers.events(spark, root).count() == 4
    later = replay.replay(spark, dead, root, tries, run="three", parser="json", version="2", reasons=reasons)
    assert later["lines"] == 2 and later["good"] == 1  # the failed one and the one that was not asked for before
    assert readers.events(spark, root).count() == 5


def test_letters_are_given_up_after_some_attempts(spark):
    one = spark.createDataFrame([("x", "unknown", "s")], "raw string, reason string, source string")
    letter = replay.eligible(one, spark.createDataFrame([], replay.LEDGER)).first()["letter"]
    past = spark.createDataFrame([(letter, str(k), "dead", None, str(k)) for k in range(3)], replay.LEDGER)
    assert replay.eligible(one, past, version="9").count() == 0
    assert replay.eligible(one, past, version="9", most_attempts=4).count() == 1


def test_stream_drops_duplicates_over_restarts_and_keeps_dead_letters(spark, tmp_path):
    inbox, root, dead, cp = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "dead"), str(tmp_path / "cp")
    inbox.mkdir()
    live = streaming.LiveWindow(spark, str(tmp_path / "live"), most=12)
    for n in range(2):
        (inbox / f"{n}.txt").write_text("\n".join([GOOD % (i, i) for i in range(10 + 5 * n)] + ["garbage", "garbage"]))
        streaming.start(streaming.text_stream(spark, str(inbox)), root, dead, cp, available_now=True, on_batch=live.update).awaitTermination()
    assert readers.events(spark, root).count() == 15
    assert readers.dead_letters(spark, dead).count() == 4
    figures = live.figures().first()
    assert (figures["events"], figures["errors"], figures["newest"]) == (12, 0, datetime(2024, 1, 1, 0, 0, 14))


def plain_figures(rows, seconds, most, services):
    newest = max(r[1] for r in rows)
    kept = sorted(rows, key=lambda r: (r[1], [-ord(c) for c in r[0]]))[-most:]
    kept = [r for r in kept if r[1] >= newest - timedelta(seconds=seconds)]
    ms = sorted(r[4] for r in kept if r[4] is not None)
    count = {}
    for r in kept:
        if r[2]:
            count[r[2]] = count.get(r[2], 0) + 1
    top = sorted(count.items(), key=lambda x: (-x[1], x[0]))[:services]
    errors = sum(r[3] == "ERROR" for r in kept)
    return len(kept), errors, round(errors / len(kept), 6), round(ms[int(len(ms) * 0.95)], 3) if ms else 0.0, top


@pytest.mark.parametrize("most", [10_000, 40])
def test_live_window_is_bounded_by_age_and_count(spark, tmp_path, most):
    start = datetime(2024, 1, 1)
    rows = [(f"{i:04d}", start + timedelta(seconds=(i * 37) % 900), f"s{i % 14}" if i % 9 else None, "ERROR" if i % 4 == 0 else "INFO", float(i % 50) if i % 7 else None, None) for i in range(600)]
    live = streaming.LiveWindow(spark, str(tmp_path / "w"), most=most)
    kind = "event_id string, timestamp timestamp, service string, level string, response_time_ms double, status_code short"
    for n in range(3):
        live.update(spark.createDataFrame(rows[n * 200 : n * 200 + 200], kind), n)
    live.update(spark.createDataFrame(rows[400:], kind), 2)  # the last batch runs again
    f = live.figures().first()
    got = (f["events"], f["errors"], f["error_rate"], f["p95_latency_ms"], [(s["service"], s["n"]) for s in f["services"]])
    if most == 10_000:
        assert got == plain_figures(rows, 300, most, 10)
    else:
        assert f["events"] == 40 and len(f["services"]) == 10
    assert sorted(live._versions()) == [1, 2]


def test_live_window_without_events(spark, tmp_path):
    assert streaming.LiveWindow(spark, str(tmp_path / "none")).figures().first()["events"] == 0


def test_value_lists_over_the_bound_are_refused():
    with pytest.raises(search.SearchError):
        search.compile_filters({"service": [f"s{i}" for i in range(51)]})


class _Pages(http.server.BaseHTTPRequestHandler):
    asked: list[str] = []

    def do_GET(self):  # noqa: N802
        self.asked.append(self.path)
        query = dict(p.split("=") for p in self.path.partition("?")[2].split("&") if p)
        if "page" in query:
            n = int(query["page"])
            body = [{"n": n}] if n <= 12 else []
        else:
            n = int(query.get("cursor", "0"))
            body = {"items": [{"n": n}], "next": n + 1 if n < 5 else None}
        data = json.dumps(body).encode()
        self.send_response(200)
        self.end_headers()
        self.wfile.write(data)

    def log_message(self, *_):
        pass


def test_rest_reads_all_pages_or_says_so(spark):
    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), _Pages)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        rest.register(spark)
        url = f"http://127.0.0.1:{server.server_port}/x"
        read = lambda **o: spark.read.format("rest_records").options(url=url, allow_private="true", **o).load()
        assert sorted(json.loads(r["value"])["n"] for r in read(page_param="page", page_tasks="3").collect()) == list(range(1, 13))
        assert len(_Pages.asked) == 15  # three empty pages end the three tasks
        assert read(page_param="page", max_pages="12").count() == 12
        assert read(records_path="items", next_path="next").count() == 6
        for short in ({"page_param": "page", "max_pages": "11"}, {"records_path": "items", "next_path": "next", "max_pages": "5"}):
            with pytest.raises(Exception, match="max_pages"):
                read(**short).collect()
    finally:
        server.shutdown()


def test_directories_flag_long_lines_like_files(spark, tmp_path):
    (tmp_path / "a.log").write_text("x" * (readers.LONGEST_LINE + 5) + "\nshort\n")
    both = [sorted((len(r["value"]), r["too_long"]) for r in f(spark, str(tmp_path)).collect()) for f in (readers.text, readers.directory)]
    assert both[0] == both[1] == [(5, False), (readers.LONGEST_LINE, True)]
