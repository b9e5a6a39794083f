"""Helpers that the corpus operators share: tables, scratch storage, Arrow maps, components.

Nothing here collects rows to the driver. Lineage is cut by writing Parquet into the folder
that the session names in ``spark.checkpoint.dir`` (set here only where it is unset, as in
tests), so results survive lost executors and are visible to every one of them.
"""

from __future__ import annotations

import atexit
import functools
import gc
import itertools
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

WORD_SPACE = b" \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


DOCUMENT = ("doc_id", "text", "lang", "source", "n_chars")


def keeps_columns(stage):
    """For a pipeline stage: columns beyond those of documents ride along in one struct, whatever their names are."""

    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        columns = docs.columns
        extra = [c for c in columns if c not in DOCUMENT]
        if not extra:
            return stage(spark, docs, sf_dir)
        packed = docs.select(*[c for c in columns if c in DOCUMENT], F.struct(*[F.col(f"`{c}`") for c in extra]).alias("_packed"))
        out = stage(spark, packed, sf_dir)
        return out.select(*[F.col(c) if c in DOCUMENT else F.col("_packed").getField(c).alias(c) for c in columns])

    return run


def scratch_root(spark: SparkSession) -> str:
    """The shared folder for cut lineage. A temporary one only on a local master; a cluster must name its own."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="corpus-scratch-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared scratch folder and read it back: a reliable end of its lineage.

    The folder is removed when the Python driver exits; ``drop`` removes it earlier.
    """
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/cut-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_path = path

    def clean() -> None:
        try:
            _delete(spark, path)
        except Exception:  # the session is gone: its owner clears the folder
            pass

    atexit.register(clean)
    return out


def drop(df: DataFrame) -> None:
    """Remove what ``cut`` wrote for df; nothing that still reads it may run afterwards."""
    if path := getattr(df, "_cut_path", None):
        _delete(df.sparkSession, path)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner delete the shuffle files of plans that nobody holds any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def arrow_map(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema: T.StructType) -> DataFrame:
    """mapInArrow with one function call for each record batch."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                yield from fn(batch)
                pa.default_memory_pool().release_unused()  # workers live on: what a batch took goes back

    return df.mapInArrow(run, schema)


def binary(column: pa.Array) -> pa.Array:
    """Text as UTF-8 bytes without a copy; null counts as empty."""
    if pa.types.is_string(column.type) or pa.types.is_large_string(column.type):
        column = column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary())
    return column.fill_null(b"") if column.null_count else column


def slices(column: pa.Array, most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``most`` bytes of text each (one row at least)."""
    import pyarrow.compute as pc

    sizes = pc.binary_length(column).to_numpy(zero_copy_only=False)
    start, held = 0, 0
    for i, n in enumerate(sizes):
        if held and held + n > most:
            yield start, i
            start, held = i, 0
        held += int(n)
    if start < len(sizes):
        yield start, len(sizes)


def smallest(df: DataFrame, most: int, *keys: str) -> DataFrame:
    """The ``most`` distinct keys with the smallest hashes (ties by the keys), one row each, as a bounded sample.

    Rows above a cutoff are left out before the ordered limit; else every task would send ``most`` rows to one. The
    cutoff is the least power of two under which there are ``most`` distinct hashes, all of them if there are fewer.
    """
    least = -(1 << 63)
    h = F.xxhash64(*keys)
    width = F.length(F.bin(h.bitwiseXOR(F.lit(least))))  # bits of the hash as a distance from the least long
    found = {r["width"]: r["n"] for r in df.select(h.alias("h")).distinct().groupBy(F.length(F.bin(F.col("h").bitwiseXOR(F.lit(least)))).alias("width")).agg(F.count("*").alias("n")).collect()}
    held = 0
    for w in sorted(found):
        held += found[w]
        if held >= most:
            df = df.where(width <= w)
            break
    return df.dropDuplicates(list(keys)).orderBy(F.xxhash64(*keys), *keys).limit(most)


def table_bytes(docs: DataFrame, column: str = "text") -> int:
    """Bytes of text in the table, by one native aggregate."""
    got = docs.agg(F.sum(F.octet_length(column)).alias("n")).first()
    return int(got["n"] or 0) if got else 0


def join_heavy(left: DataFrame, right: DataFrame, key: str, size: str, most: int = 1000) -> DataFrame:
    """left joined with right, which has one row for each key and in ``size`` (dropped) the number of left's rows with it.

    Keys that hold more than one in ``most`` of left's rows, fewer than ``most`` by counting, are joined by broadcast:
    none of them lands in one task. left is read twice, so it should be a written table.
    """
    total = right.agg(F.sum(size).alias("n")).first()["n"] or 0
    heavy, rest = (right.where(c).drop(size) for c in (F.col(size) * most > total, F.col(size) * most <= total))
    return left.join(F.broadcast(heavy), key).unionByName(left.join(F.broadcast(heavy.select(key)), key, "left_anti").join(rest, key))


def connected_components(edges: DataFrame, most_rounds: int | None = None) -> DataFrame:
    """(node, component) for every node of edges (u, v): component is the smallest node reachable.

    Alternating large-star and small-star rounds, each made of aggregates and equi-joins over
    distributed edges and written to the scratch folder, until the edges are stable; a bound of
    ``most_rounds`` that is hit before is an error. Nodes are longs; self links and null
    ends are ignored. An empty edge table gives an empty result.
    """
    spark = edges.sparkSession
    state = edges.where("u IS NOT NULL AND v IS NOT NULL AND u <> v").select(F.greatest("u", "v").alias("hi"), F.least("u", "v").alias("lo")).distinct()
    state = cut(state)
    mark = _mark(state)
    for done in itertools.count():
        if done == most_rounds:
            raise RuntimeError(f"components are not stable after {most_rounds} rounds")
        both = state.select(F.col("hi").alias("n"), F.col("lo").alias("b")).unionAll(state.select(F.col("lo").alias("n"), F.col("hi").alias("b")))
        least = both.groupBy("n").agg(F.min("b").alias("m")).select("n", F.least("n", "m").alias("m"))
        large = both.join(least, "n").where("b > n").select(F.col("b").alias("hi"), F.col("m").alias("lo")).distinct()
        low = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(low, "hi").where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo")).unionAll(low.select("hi", F.col("m").alias("lo"))).distinct()
        after = cut(small)
        drop(state)
        now = _mark(after)
        state = after
        if now == mark:
            break
        mark = now
    roots = state.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct()
    return state.select(F.col("hi").alias("node"), F.col("lo").alias("component")).unionAll(roots)


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)")).alias("h")).first()
    return (row["n"], row["h"])
