"""SimHash near-duplicates (5) with pigeonring filtering.

Fingerprints are cut into M consecutive segments on a ring. If two differ in at most
``bits`` places, some segment starts a chain whose first l segments differ in at most
l * bits / M places, for every l. The first two conditions (0 and at most 1 bits for 4 bits over
5 segments) are found by keys: rows are dealt by (start, first segment) and joined inside a
key on the second segment with one place masked; the longer chains prune the pairs that
this gives before the full Hamming check. Only spanning links of a run leave a task.

Defined results: words, shingles and the bit rule follow the contract in the module's
``fingerprints``; null or empty texts have fingerprint zero and link like any other; equal
fingerprints are one node, so exact copies never meet as pairs; null ids take part, and a
component's id is its smallest non-null id (null if it has none); repeated rows are returned
once each.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

BITS, SEGMENTS, SEED, SHINGLE = 4, 5, 42, 4


def _fingerprint(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    words = text.lower().split()  # bytes: A-Z only, and exactly the ASCII white space
    if not words:
        return 0
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), seed)
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_intdigest
    total = np.zeros(64, np.int64)
    n = len(words) - shingle + 1
    for at in range(0, n, 1 << 16):  # long texts in pieces: memory stays bounded
        to = min(n, at + (1 << 16))
        h = np.array([digest(line[a:b], seed) for a, b in zip(starts[at:to].tolist(), ends[at + shingle - 1 : to + shingle - 1].tolist(), strict=True)], np.uint64)
        bits = np.unpackbits(h.view(np.uint8)).reshape(-1, 64)
        total += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(total * 2 > n).view(np.uint64)[0])


def fingerprints(docs: DataFrame, into: str = "_fp", text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (default: all) with the 64-bit fingerprint of each whole text as a signed long."""
    keep = docs.columns if keep is None else keep
    docs = docs.select(*keep, F.col(text).alias("_fp_text"))
    schema = T.StructType([*docs.schema.fields[:-1], T.StructField(into, T.LongType(), False)])

    def run(batch: pa.RecordBatch):
        got = np.array([_fingerprint(t) for t in common.binary(batch.column(batch.num_columns - 1)).to_pylist()], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(got)], names=[*batch.schema.names[:-1], into])

    return common.arrow_map(docs, run, schema)


def _bounds(segments: int) -> list[tuple[int, int]]:
    """(first bit, width) of each segment of 64 bits."""
    edges = [round(i * 64 / segments) for i in range(segments + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def _segment(fp: np.ndarray, i: int, bounds) -> np.ndarray:
    shift, width = bounds[i % len(bounds)]
    return (fp >> np.uint64(shift)) & np.uint64((1 << width) - 1)


def _links(fp: np.ndarray, start: int, group: np.ndarray, bits: int, bounds) -> list[tuple[np.ndarray, np.ndarray]]:
    """Spanning links among rows of equal group whose chains from ``start`` fit and that differ in <= bits places."""
    m = len(bounds)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    allowed = [(l * bits) // m for l in range(1, m + 1)]

    def chain(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        x = a ^ b
        ok, total = np.ones(len(x), bool), np.zeros(len(x), np.int64)
        for l in range(m):
            total += np.bitwise_count(_segment(x, start + l, bounds))
            ok &= total <= allowed[l]
        return ok  # the last prefix is the whole ring: the full Hamming check

    second = _segment(fp, start + 1, bounds)
    width = bounds[(start + 1) % m][1]
    masks = [~np.uint64(1 << j) for j in range(width)] if allowed[1] else [~np.uint64(0)]
    for mask in masks:
        key = (group << np.uint64(20)) | (second & mask)
        order = np.argsort(key, kind="stable")
        ranked = key[order]
        run = np.flatnonzero(np.concatenate(([True], ranked[1:] != ranked[:-1])))
        size = np.diff(np.concatenate((run, [len(ranked)])))
        for far in range(1, min(16, int(size.max()))):  # short runs: all pairs at each distance, whole batch at once
            left = np.repeat(run, np.where(size <= 16, np.maximum(size - far, 0), 0))
            count = np.where(size <= 16, np.maximum(size - far, 0), 0)
            if not len(left):
                continue
            left = left + np.arange(len(left)) - np.repeat(np.cumsum(count) - count, count)
            a, b = order[left], order[left + far]
            ok = chain(fp[a], fp[b])
            if ok.any():
                found.append((a[ok], b[ok]))
        for at, n in zip(run[size > 16], size[size > 16], strict=True):  # long runs: breadth first over what is not reached yet
            rest = order[at : at + n]
            while len(rest):
                front, rest = rest[:1], rest[1:]
                while len(front) and len(rest):
                    node, front = front[0], front[1:]
                    ok = chain(np.full(len(rest), fp[node]), fp[rest])
                    if ok.any():
                        found.append((np.full(int(ok.sum()), node), rest[ok]))
                        front, rest = np.concatenate((front, rest[ok])), rest[~ok]
    return found


def candidate_links(distinct: DataFrame, bits: int = BITS, segments: int = SEGMENTS) -> DataFrame:
    """(u, v) spanning links between distinct fingerprints (column ``_fp``), through pigeonring chains."""
    bounds = _bounds(segments)
    starts = F.explode(F.array(*[F.struct(F.lit(i).alias("start"), F.shiftrightunsigned("_fp", s).bitwiseAND(F.lit((1 << w) - 1)).alias("head")) for i, (s, w) in enumerate(bounds)])).alias("k")
    rows = distinct.select("_fp", starts).select((F.col("k.head") * segments + F.col("k.start")).alias("key"), "_fp")
    rows = rows.repartition("key").sortWithinPartitions("key", "_fp")
    schema = T.StructType([T.StructField("u", T.LongType()), T.StructField("v", T.LongType())])

    def solve(key: np.ndarray, fp: np.ndarray) -> pa.RecordBatch | None:
        us, vs = [], []
        for start in range(segments):
            at = np.flatnonzero(key % segments == start)
            if len(at) < 2:
                continue
            f = fp[at].view(np.uint64)
            for a, b in _links(f, start, key[at].view(np.uint64) // np.uint64(segments), bits, bounds):
                us.append(f[a].view(np.int64))
                vs.append(f[b].view(np.int64))
        if us:
            pairs = np.unique(np.stack((np.concatenate(us), np.concatenate(vs)), 1), axis=0)
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["u", "v"])
        return None

    def run(batches):
        key, fp = np.zeros(0, np.int64), np.zeros(0, np.int64)
        held = 0
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:  # keys come sorted: all but the last key are complete
            parts.append((batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)))
            held += batch.num_rows
            if held < 200_000 or parts[0][0][0] == parts[-1][0][-1]:
                continue
            key, fp = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
            to = int(np.searchsorted(key, key[-1], side="left"))
            if to and (out := solve(key[:to], fp[:to])) is not None:
                yield out
            parts, held = [(key[to:], fp[to:])], len(key) - to
        if parts:
            key, fp = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
            if (out := solve(key, fp)) is not None:
                yield out

    return rows.mapInArrow(run, schema)


def components(rows: DataFrame, bits: int = BITS) -> DataFrame:
    """rows (doc_id, _fp) -> (_fp, _root, component_id, _rows) for every distinct fingerprint.

    _root is the least fingerprint of the component, _rows the number of rows with the fingerprint.
    """
    distinct = common.cut(rows.groupBy("_fp").agg(F.min("doc_id").alias("_least"), F.count("*").alias("_rows")))
    roots = common.connected_components(candidate_links(distinct.select("_fp"), bits))
    named = common.cut(distinct.join(roots.withColumnRenamed("node", "_fp"), "_fp", "left").select("_fp", "_least", "_rows", F.coalesce("component", "_fp").alias("_root")))
    least = common.cut(named.groupBy("_root").agg(F.min("_least").alias("component_id"), F.count("*").alias("_size")))
    return common.cut(common.join_heavy(named, least, "_root", "_size").select("_fp", "_root", "component_id", "_rows"))


def hexed(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    rows = common.cut(fingerprints(docs.select("doc_id", "text"), keep=["doc_id"]))
    return common.join_heavy(rows, components(rows), "_fp", "_rows").select("doc_id", hexed(F.col("_fp")).alias("fingerprint"), "component_id")


@common.keeps_columns
def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline: the row with the smallest doc_id of each group of near copies stays.

    Of several rows with that id in the group one stays (smallest row hash); null ids come after all
    others, so a group without any id keeps one row too.
    """
    cols = docs.columns
    named = docs.withColumn("_id", F.coalesce("doc_id", F.lit(-(1 << 63)))).withColumn("_row", F.xxhash64(*cols))
    rows = common.cut(fingerprints(named, keep=["doc_id", "_id", "_row"]))
    known = common.join_heavy(rows, components(rows.select("doc_id", "_fp")), "_fp", "_rows")
    lead = known.groupBy("_root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("_unnamed"), "_id", "_row")).alias("_lead"))
    return named.join(lead.select("_lead._id", "_lead._row"), ["_id", "_row"], "left_semi").dropDuplicates(["_id", "_row"]).select(*cols)
