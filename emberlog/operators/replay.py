"""Replay of dead letters: eligible ones go through ingest again, and a ledger remembers every try.

A letter is known by a fingerprint of its raw line and source, so copies of a letter are one. It is tried again unless it was
taken before, was tried under this ``version`` of the parsing rules, or has been tried ``most_attempts`` times.
The ledger has one folder for each replay; a replay repeated with its own name replaces its rows and its ledger.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import masking
from ..functions.scalars import fingerprint
from ..sources.readers import dead_letters
from ..sources.writers import filesystem, replayable
from .routing import ingest_to

TRANSIENT = ("storage_error", "transform_error", "unknown")
LEDGER = "letter string, version string, outcome string, tried_at timestamp, run string"


def _letter(raw: str, source: str = "source"):
    """Of the masked line: that is how a letter that fails again comes back."""
    return fingerprint(masking.mask_text(F.col(raw)), F.coalesce(F.col(source), F.lit("")))


def ledger(spark: SparkSession, root: str) -> DataFrame:
    """Every try so far: letter, version, outcome ('good', 'duplicate' or 'dead'), tried_at, run."""
    fs, path = filesystem(spark, root)
    return spark.read.schema(LEDGER).parquet(root) if fs.exists(path) else spark.createDataFrame([], LEDGER)


def eligible(letters: DataFrame, past: DataFrame, *, reasons: Sequence[str] = TRANSIENT, version: str = "1", most_attempts: int = 3) -> DataFrame:
    """letter, value and source of the dead letters worth a try, each once."""
    seen = past.groupBy("letter").agg(F.count("*").alias("tries"), F.bool_or(F.col("outcome") != "dead").alias("taken"), F.bool_or(F.col("version") == version).alias("now"))
    settled = seen.where(F.col("taken") | F.col("now") | (F.col("tries") >= most_attempts))
    wanted = replayable(letters.where("raw IS NOT NULL AND raw <> ''"), tuple(reasons), "source").withColumn("letter", _letter("value"))
    return wanted.dropDuplicates(["letter"]).join(settled, "letter", "left_anti")


def replay(spark: SparkSession, dead: str, root: str, tries: str, *, run: str, reasons: Sequence[str] = TRANSIENT, version: str = "1", most_attempts: int = 3, **options) -> Mapping[str, int]:
    """Run eligible dead letters below ``dead`` through ingest into ``root``; the ledger is below ``tries``. Counts by reason.

    Letters that fail again return to ``dead`` under the replay's name. ``options`` go to ``ingest_to``.
    """
    past = ledger(spark, tries).where(F.col("run") != run)
    others = dead_letters(spark, dead).where(~F.coalesce(F.input_file_name().contains(f"/run={run}/"), F.lit(False)))
    todo = eligible(others, past, reasons=reasons, version=version, most_attempts=most_attempts).persist()
    try:
        if todo.isEmpty():
            return {"lines": 0, "rejected": 0, "good": 0, "duplicate": 0}
        counts = ingest_to(todo.select("value", "source"), root, dead, run=run, **{"most_rejected": 1.0, **options})
        again = spark.read.schema("raw string, reason string, source string").json(f"{dead.rstrip('/')}/run={run}")
        failed = again.where("raw IS NOT NULL").select(_letter("raw").alias("letter"), F.when(F.col("reason") == "duplicate", "duplicate").otherwise("dead").alias("outcome")).dropDuplicates(["letter"])
        outcome = todo.select("letter").join(failed, "letter", "left").select("letter", F.lit(version).alias("version"), F.coalesce("outcome", F.lit("good")).alias("outcome"), F.current_timestamp().alias("tried_at"))
        outcome.write.mode("overwrite").parquet(f"{tries.rstrip('/')}/run={run}")
        return counts
    finally:
        todo.unpersist()
