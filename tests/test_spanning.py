"""Records that span lines: the same rows whatever the split size."""

import csv as plain_csv
import io
import json
import random

import pytest

from emberlog.operators import parsers
from emberlog.sources import readers, spanning


@pytest.fixture(params=["64m", "97b"])
def split(request, spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", request.param)
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield request.param
    for k, v in old.items():
        spark.conf.set(k, v)


def events_text(n):
    return "".join(f"2024-01-01 00:00:{i % 60:02d} ERROR app{i} failed\n" + "".join(f"    at frame {k} of {i}\n" for k in range((i * 7) % 5)) for i in range(n))


def test_stack_traces_are_one_record(spark, tmp_path, split):
    (tmp_path / "a.log").write_text("stray first line\n" + events_text(30))
    (tmp_path / "b.log").write_text(events_text(3) + "2024-01-01 00:00:00 INFO long " + "x" * 400 + "\n" + "  more\n" * 60)
    got = readers.multiline(spark, str(tmp_path), r"^\d{4}-\d\d-\d\d ").collect()
    want = [("a.log", "stray first line", 1)]
    for name, n in (("a.log", 30), ("b.log", 3)):
        want += [(name, t.rstrip("\n"), t.count("\n")) for t in events_text(n).replace("\n2024", "\n\x002024").split("\x00")]
    want.append(("b.log", "2024-01-01 00:00:00 INFO long " + "x" * 400 + "\n  more" * 60, 61))
    assert sorted((r["source"], r["value"], r["n_lines"]) for r in got) == sorted(want)
    pattern = r"^(?P<timestamp>\S+ \S+) (?P<level>\w+) (?P<service>\S+) (?P<message>.*)$"
    event = parsers.parse(readers.multiline(spark, str(tmp_path / "a.log"), r"^\d{4}-"), parsers.custom(pattern, multiline=True)).where("event.service = 'app2'").first()["event"]
    assert event["message"] == "failed" + "".join(f"\n    at frame {k} of 2" for k in range(4)) and event["level"] == "ERROR"


def test_a_record_longer_than_the_bound_is_cut_and_flagged(spark, tmp_path, split):
    (tmp_path / "a.log").write_text("> one\n" + "y" * 50 + "\n" + "z" * 50 + "\n> two\n")
    rows = spanning.spanning(spark, str(tmp_path), spanning.Begins("^>"), longest=40).collect()
    assert sorted((r["value"], r["too_long"]) for r in rows) == [("> one\n" + "y" * 34, True), ("> two", False)]


def test_splits_of_several_files_in_one_task(spark, tmp_path):
    """The rests of larger files share a task: what ends a record there keeps its place before the rest's own records."""
    settings = {"spark.sql.files.maxPartitionBytes": "1000b", "spark.sql.files.openCostInBytes": "0", "spark.sql.files.minPartitionNum": "1"}
    old = {k: spark.conf.get(k, None) for k in settings}
    want = []
    for n in range(6):
        records = [f"> {n}.{i}" + "".join(f"\n  frame {k} of {n}.{i}" for k in range(3)) for i in range(24 + n)]
        (tmp_path / f"{n}.log").write_text("\n".join(records) + "\n")
        want += [(f"{n}.log", r, 4) for r in records]
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        lines = spark.read.text(str(tmp_path))
        assert lines.rdd.getNumPartitions() < 12  # two splits a file at least
        got = spanning.spanning(spark, str(tmp_path), spanning.Begins("^>")).collect()
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert sorted((r["source"], r["value"], r["n_lines"]) for r in got) == sorted(want)


def rows_of_csv(text, delimiter=","):
    rows = [r for r in plain_csv.reader(io.StringIO(text, newline=""), delimiter=delimiter)]
    names = [h.strip() for h in rows[0]]
    out = []
    for r in rows[1:]:
        if any(c.strip() for c in r):
            out.append(dict(zip(names, r, strict=False)) | ({"_extra": r[len(names) :]} if len(r) > len(names) else {}))
    return out


CSV = 'a,b\n1,2,,4\n1,"x\ny"\n\n5" pipe,6\n"7 ""q""",8\n,\n9\n"one, two",3\n"' + "long\n" * 80 + '",end\nlast,"a""\n""b"\n'


@pytest.mark.parametrize("ending", ["\n", "\r\n"])
def test_ragged_csv(spark, tmp_path, split, ending):
    text = CSV.replace("\n", ending)
    (tmp_path / "s.csv").write_bytes(text.encode())
    got = [json.loads(r["value"]) for r in readers.csv(spark, str(tmp_path / "s.csv")).collect()]
    key = lambda r: json.dumps(r)
    assert sorted(got, key=key) == sorted(rows_of_csv(text), key=key)
    assert {"a": "1", "b": "2", "_extra": ["", "4"]} in got


def test_each_csv_file_has_its_own_header(spark, tmp_path, split):
    (tmp_path / "a.csv").write_text("x,y\n1,2\n" + "3,4\n" * 40)
    (tmp_path / "b.csv").write_text('y,"z"\n5,6\n')
    got = [json.loads(r["value"]) for r in readers.csv(spark, str(tmp_path)).collect()]
    assert len(got) == 42 and {"y": "5", "z": "6"} in got and {"x": "1", "y": "2"} in got


def test_csv_plan_does_not_follow_the_data(spark, tmp_path):
    (tmp_path / "w.csv").write_text('a,b\n1,"' + "," * 3000 + '"\n')
    rows = readers.csv(spark, str(tmp_path / "w.csv"))
    assert len(rows.columns) == 3 and json.loads(rows.first()["value"]) == {"a": "1", "b": "," * 3000}
    (tmp_path / "empty.csv").write_text("")
    assert readers.csv(spark, str(tmp_path / "empty.csv")).collect() == []


def test_random_csv_like_the_csv_module(spark, tmp_path, split):
    rng = random.Random(4)
    pieces = ["a", "", '"', '""', "\n", ",", "x y", '"q,\n"', 'z"w']
    for n in range(3):
        text = "h1,h2,h3\n" + "".join(rng.choice(pieces) for _ in range(120)) + "\n"
        (tmp_path / f"{n}.csv").write_text(text)
        got = [json.loads(r["value"]) for r in readers.csv(spark, str(tmp_path / f"{n}.csv"), ",").collect()]
        assert sorted(map(json.dumps, got)) == sorted(map(json.dumps, rows_of_csv(text)))


ITEMS = [{"a": 1}, {"b": "}{][,\\\" \\u007d"}, {"c": {"d": [{"e": {}}, []]}}, 3, "text } with", None, {"f": "x" * 300}, [1, {"g": 2}], {"h": "}" * 90}, {}, {"z": "é\n}"}]


@pytest.mark.parametrize("indent", [None, 2])
@pytest.mark.parametrize("tail", ["", "\n"])
def test_json_arrays(spark, tmp_path, split, indent, tail):
    (tmp_path / "x.json").write_text(json.dumps(ITEMS, indent=indent) + tail)
    (tmp_path / "one.json").write_text(json.dumps(ITEMS[2], indent=indent) + tail)
    (tmp_path / "none.json").write_text("[]" + tail)
    got = {r["source"]: [] for r in [{"source": "none.json"}]}
    for r in readers.json_array(spark, str(tmp_path)).collect():
        got.setdefault(r["source"], []).append(r["value"])
    loaded = lambda v: None if v is None else json.loads(v) if v[0] in "{[3" else v
    key = lambda v: json.dumps(v)
    assert sorted(map(loaded, got["x.json"]), key=key) == sorted(ITEMS, key=key)
    assert list(map(loaded, got["one.json"])) == [ITEMS[2]] and got["none.json"] == []


def test_many_splits_go_by_shuffle(spark, tmp_path, split, monkeypatch):
    monkeypatch.setattr(spanning, "MOST_SPLITS", 0)
    (tmp_path / "s.csv").write_text(CSV)
    got = [json.loads(r["value"]) for r in readers.csv(spark, str(tmp_path / "s.csv")).collect()]
    assert sorted(map(json.dumps, got)) == sorted(map(json.dumps, rows_of_csv(CSV)))
