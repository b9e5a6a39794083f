"""Formats by file."""

import gzip
import json

from pyspark.sql import functions as F

from emberlog.operators import formats, routing
from emberlog.sources import readers
from tests.test_pipeline import SAMPLES


def folder(tmp_path):
    (tmp_path / "sub").mkdir()
    for name in ("access", "syslog", "keyvalue", "nginx_error", "plaintext"):
        (tmp_path / f"{name}.log").write_text(f"{SAMPLES[name]}\n\n" * 12)
    with gzip.open(tmp_path / "sub" / "j.jsonl.gz", "wt") as f:
        f.write("\n".join(json.dumps({"timestamp": f"2024-01-01T00:00:{i:02d}Z", "message": f"j{i}"}) for i in range(20)))
    (tmp_path / "array.json").write_text(json.dumps([{"timestamp": "2024-01-01T00:00:00Z", "message": f"a{i}"} for i in range(3)], indent=1))
    (tmp_path / "lines.json").write_text('{"message": "l0", "time": "2024-01-01T00:00:00Z"}\n')
    (tmp_path / "t.csv").write_text('timestamp,message\n2024-01-01T00:00:00Z,"c\nc"\n')
    (tmp_path / "t.tsv").write_text("timestamp\tmessage\n2024-01-01T00:00:00Z\tt, t\n")
    (tmp_path / "empty.log").write_text("")
    return str(tmp_path)


def test_every_file_gets_its_parser(spark, tmp_path):
    path = folder(tmp_path)
    found = {k: [f.rsplit("/", 1)[-1] for f in v] for k, v in formats.formats(spark, path).items()}
    assert found == {"access": ["access.log"], "syslog": ["syslog.log"], "keyvalue": ["keyvalue.log"], "nginx_error": ["nginx_error.log"], "plaintext": ["plaintext.log"], "json": ["lines.json", "j.jsonl.gz"], "json_array": ["array.json"], "csv": ["t.csv"], "tsv": ["t.tsv"]}
    rows = formats.read_events(spark, path).groupBy("source").agg(F.count("event").alias("n"), F.first("event.parser").alias("parser"), F.min("event.message").alias("message")).collect()
    got = {r["source"]: (r["n"], r["parser"]) for r in rows}
    assert got == {f"{k}.log": (12, k) for k in ("access", "syslog", "keyvalue", "nginx_error", "plaintext")} | {"j.jsonl.gz": (20, "json"), "array.json": (3, "json"), "lines.json": (1, "json"), "t.csv": (1, "json"), "t.tsv": (1, "json")}
    assert {r["source"]: r["message"] for r in rows}["t.csv"] == "c\nc"


def test_a_mixed_folder_is_ingested(spark, tmp_path):
    path = folder(tmp_path)
    for name in ("access", "syslog", "keyvalue", "nginx_error", "plaintext"):
        (tmp_path / f"{name}.log").unlink()
    counts = routing.ingest_to(formats.read_events(spark, path), str(tmp_path / "out"), str(tmp_path / "dead"), run="r")
    assert counts == {"lines": 26, "rejected": 0, "good": 26, "duplicate": 0}
    assert readers.events(spark, str(tmp_path / "out")).where("message = 't, t'").count() == 1


def test_large_files_give_a_sample(spark, tmp_path):
    (tmp_path / "big.log").write_text("".join(f"{SAMPLES['access']} {i}\n" for i in range(60_000)))
    vote = formats.file_votes(spark, str(tmp_path)).first()
    assert 3000 < vote["n"] < 30_000 and formats.format_of(vote) == "access"


def test_no_files(spark, tmp_path):
    (tmp_path / "e.log").write_text("")
    assert formats.read_events(spark, str(tmp_path)).collect() == []
