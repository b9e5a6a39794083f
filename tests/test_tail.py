"""The tailed log: admission by count, commit after flush, restarts; key ranges of a database table."""

import json
import random

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from emberlog.sources import readers, tail
from emberlog.sources.ranges import histogram, key_ranges
from emberlog.streaming import pipeline as streaming


def line(n):
    return json.dumps({"timestamp": f"2024-01-01T00:{n // 60 % 60:02d}:{n % 60:02d}Z", "level": "INFO", "service": "s", "message": f"m{n}", "request_id": f"r{n}"})


class Log:
    def __init__(self, tmp_path):
        self.dir, self.root, self.dead, self.cp, self.position = (str(tmp_path / n) for n in ("log", "events", "dead", "cp", "position"))
        (tmp_path / "log").mkdir()

    def write(self, name, text):
        with open(f"{self.dir}/{name}", "a") as f:
            f.write(text)

    def run(self, spark, on_batch=None, **options):
        rows = streaming.tail_stream(spark, self.dir, position=self.position, **options)
        q = streaming.start(rows, self.root, self.dead, self.cp, every="0 seconds", on_batch=on_batch)
        try:
            q.processAllAvailable()
        finally:
            q.stop()
        return q

    def messages(self, spark):
        return sorted(int(r["message"][1:]) for r in readers.events(spark, self.root).select("message").collect())


def test_killed_between_flush_and_commit(spark, tmp_path):
    log, sizes, fail = Log(tmp_path), [], [True]
    log.write("app.1", "".join(line(n) + "\n" for n in range(25)))
    log.write("app.2", "".join(line(n) + "\n" for n in range(25, 34)) + line(34))  # its last line ends with the file
    log.write("app.3", "".join(line(n) + "\n" for n in range(35, 40)) + line(40))  # this one isn't finished

    def dies(batch, number):
        n = batch.count()
        sizes.extend([n] if n else [])  # batches without rows only move the watermark
        if len(sizes) == 2 and fail.pop():
            raise RuntimeError("killed")

    with pytest.raises(StreamingQueryException):
        log.run(spark, dies, most_records=10)
    assert log.messages(spark) == list(range(20))  # flushed, but not committed
    log.run(spark, dies, most_records=10)
    assert log.messages(spark) == list(range(40))
    assert sizes == [10, 10, 10, 10, 10]  # the killed one twice
    log.write("app.3", "\n" + "".join(line(n) + "\n" for n in range(41, 44)))
    log.run(spark, dies, most_records=10)  # a restart with nothing left over
    log.run(spark, dies, most_records=10)
    assert log.messages(spark) == list(range(44)) and sizes[5:] == [4]
    place = json.load(open(log.position))
    assert set(place) == {"file", "at", "seen"} and place["file"] == "app.3"


def test_misuse_of_the_log_is_an_error(spark, tmp_path):
    log = Log(tmp_path)
    log.write("app.5", line(1) + "\n")
    log.write("app.4.gz", "a packed copy\n")
    log.run(spark)
    assert log.messages(spark) == [1]
    log.write("app.2", line(2) + "\n")
    with pytest.raises(StreamingQueryException, match="sorts before"):
        log.run(spark)
    (tmp_path / "log" / "app.2").unlink()
    (tmp_path / "log" / "app.5").write_text("x\n")
    with pytest.raises(StreamingQueryException, match="were read"):
        log.run(spark)


def reader(path, **options):
    return tail._Reader({"path": str(path), **{k: str(v) for k, v in options.items()}})


def drained(r):
    """All values, read batch by batch, and the number of batches."""
    at, found, batches = r.initialOffset(), [], 0
    while True:
        end = r.advance(at)
        if end == at:
            return found, batches
        for p in r.partitions(at, end):
            for b in r.read(p):
                found += b.column("value").to_pylist()
        at, batches = end, batches + 1


@pytest.mark.parametrize("seed", range(4))
def test_pieces_and_batches_give_every_line_once(tmp_path, seed):
    rnd, want = random.Random(seed), []
    for k in range(5):
        lines = ["".join(rnd.choice("aé x") for _ in range(rnd.choice((0, 1, 3, 40)))) for _ in range(rnd.randint(0, 30))]
        ending = rnd.choice(("\n", "\r\n"))
        (tmp_path / f"f{k}").write_text(ending.join(lines) + (ending if k == 4 or rnd.random() < 0.5 else ""), newline="")
        want += [x for x in lines if x.strip()]
    for piece in (1, 3, 7, 1000):
        for options in ({"most_records": 1}, {"most_records": 7}, {"most_bytes": 1}, {"most_bytes": 50}, {}):
            got, batches = drained(reader(tmp_path, piece=piece, **options))
            assert got == want, (piece, options)
            assert options or batches <= 1


def test_long_lines_are_cut_and_flagged(tmp_path, monkeypatch):
    monkeypatch.setattr(tail, "LONGEST_LINE", 10)
    monkeypatch.setattr(tail, "CHUNK", 16)
    (tmp_path / "a").write_text("x" * 500 + "\nshort\n" + "é" * 100 + "\n")
    r = reader(tmp_path, piece=64, most_bytes=20)
    assert drained(r)[0] == ["x" * 10, "short", "é" * 10]
    rows = [b.column("too_long").to_pylist() for p in r.partitions(r.initialOffset(), {"file": "a", "at": 708, "seen": 1}) for b in r.read(p)]
    assert sum(rows, []) == [True, False, True]


def test_an_empty_folder_waits(tmp_path):
    r = reader(tmp_path)
    assert r.latestOffset() == r.initialOffset() and r.partitions(r.initialOffset(), r.latestOffset()) == []
    with pytest.raises(ValueError):
        reader(tmp_path, most_bytes=0)


# -- database ranges -------------------------------------------------------------------------------------------------------
@pytest.fixture(scope="module")
def skewed(spark, tmp_path_factory):
    """A table in the database that Spark ships: most keys within a tiny part of a wide range, one hot key, some null."""
    spark._jvm.java.lang.System.setProperty("derby.stream.error.file", str(tmp_path_factory.mktemp("derby") / "derby.log"))
    url, options = "jdbc:derby:memory:ranges;create=true", {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    key = F.when(F.col("id") % 100 == 0, None).when(F.col("id") % 5 == 0, 777).when(F.col("id") == 1, -(10**15)).when(F.col("id") == 2, 10**17).otherwise(F.col("id") * 3)
    rows = spark.range(4000).select(key.alias("K"), F.col("id").alias("ID"))  # Spark quotes names as they are
    rows.coalesce(2).write.mode("overwrite").jdbc(url, "app.things", properties=options)
    return url, options


def test_ranges_are_balanced_and_whole(spark, skewed):
    url, options = skewed
    rows = readers.database(spark, url, "app.things", key="k", parallel=8, options=options)
    parts = [len(p) for p in rows.rdd.glom().collect()]
    assert len(parts) in (7, 8) and sum(parts) == 4000
    hot = 4000 // 5  # one key holds a fifth of the rows and can't be divided
    assert max(parts) <= hot + 1.5 * 4000 / 8 and sorted(parts)[-2] <= 1.5 * 4000 / 8
    assert sorted(r["ID"] for r in rows.collect()) == list(range(4000))


def test_ranges_of_odd_tables(spark, skewed):
    url, options = skewed
    spark.createDataFrame([(None, 1), (None, 2)], "K long, ID long").write.mode("overwrite").jdbc(url, "app.nokeys", properties=options)
    assert key_ranges(spark, url, "app.nokeys", "k", 4, options) == []
    assert readers.database(spark, url, "app.nokeys", key="k", parallel=4, options=options).count() == 2
    spark.createDataFrame([(5, 1), (5, 2)], "K long, ID long").write.mode("overwrite").jdbc(url, "app.onekey", properties=options)
    assert readers.database(spark, url, "app.onekey", key="k", parallel=4, options=options).count() == 2
    with pytest.raises(ValueError):
        readers.database(spark, url, "app.onekey", key="k; drop", options=options)


def test_histogram_rounds_are_few():
    """Heavy cells are divided until they hold half a share or one key."""
    import duckdb

    con, asked = duckdb.connect(), []
    con.execute("CREATE TABLE t AS SELECT CASE WHEN i % 3 = 0 THEN 9000000000000000000 WHEN i % 3 = 1 THEN i ELSE 0 END AS k FROM range(30000) r(i)")
    cells = histogram(lambda sql: asked.append(sql) or con.execute(sql.replace(" / ", " // ")).fetchall(), "t", "k", 10)
    assert sum(c[2] for c in cells) == 30000 and len(asked) <= 12
    assert all(c[2] <= 1500 or c[0] == c[1] for c in cells)
    assert all(a[1] < b[0] for a, b in zip(cells, cells[1:]))


def test_a_batch_of_few_pieces_is_cut_over_the_tasks(tmp_path):
    (tmp_path / "a.log").write_text("".join(f"{n:09d}\n" for n in range(50_000)))
    (tmp_path / "b.log").write_text("".join(f"{n:09d}\n" for n in range(50_000, 80_000)) + "x" * 100_001 + "\n")

    def pieces(**options):
        reader = tail._Reader({"path": str(tmp_path), "most_records": "90000", **options})
        return reader, reader.partitions(reader.initialOffset(), reader.latestOffset())

    assert len(pieces()[1]) == 2 and 8 <= len(pieces(tasks="8")[1]) <= 9 and len(pieces(tasks="1000")[1]) == 15  # 64 KiB at least
    assert len(pieces(tasks="2", piece="1000")[1]) == 901
    reader, parts = pieces(tasks="8")
    rows = [v for p in parts for batch in reader.read(p) for v in batch.column(0).to_pylist()]
    assert rows == [f"{n:09d}" for n in range(80_000)] + ["x" * 100_001]
