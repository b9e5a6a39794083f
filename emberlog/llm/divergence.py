"""Source divergence audit (12): a systolic round-robin tournament of term distributions.

Groups are the (lang, source) pairs. Every lang keeps the terms that occur in enough of its documents; the
kept terms are numbered inside blocks (by hash), so that no task holds a whole vocabulary. A
group's vector of one block is a packed row: term numbers, counts and what turns counts into probabilities.

The groups of a lang are seated in at most SEATS teams. A team's rows of one block stay in one partition
(kept by Spark, rebuilt from the written table if an executor is lost). Rounds follow the circle method: in
each, a team meets one other team, compressed visitors travel to their host's partition, and a
meeting gives the divergence in both directions for that block. Blocks add up, since the
divergence is a sum over terms. Few rounds travel at a time (AT_ONCE), so the disk holds a few
copies of the vectors, however many teams there are.

Terms against their own lang are ranked by a heap of bounded size for each resident row; the heaps'
survivors of all blocks are ranked once more.

All arithmetic is exact: probabilities are integers of 10**-9, divided in steps that fit 64 bits.

Hot sources: counts are summed in the scan, then by (lang, source, term), so a source with a third
of all rows has as many rows as it has terms, spread by term. The result holds all pairs of groups of a
lang by contract; nothing else grows with the square.

Defined results: null text, lang and source count as ''; a lang without kept terms gives its pairs the
value 0; an empty table gives no rows; repeated rows count each; further columns are not read,
whatever their names; ties rank by item in UTF-8 order.
"""

from __future__ import annotations

import heapq
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

UNIT, LEAST_DOCUMENTS, TOP = 1_000_000_000, 10, 10
SEATS, AT_ONCE, LEAST_BLOCKS = 32, 4, 8
TEAM_ENTRIES = 1 << 20  # terms x groups of one team's block
HELD_TERMS = 1 << 18  # distinct (group, term) entries that a scan task holds before it passes them on
TERM = re.compile(rb"[a-z\x80-\xff]+")

COUNTS = T.StructType([T.StructField("lang", T.StringType(), False), T.StructField("source", T.StringType(), False), T.StructField("term", T.StringType(), False), T.StructField("n", T.LongType(), False), T.StructField("d", T.LongType(), False)])


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences), d (documents) of every group's terms."""

    def flush(held):
        for (lang, source), (n, d) in held.items():
            if n:
                terms = list(n)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(terms)), pa.array([source] * len(terms)), pa.array(terms, pa.binary()).cast(pa.string()), pa.array(list(n.values()), pa.int64()), pa.array([d[t] for t in terms], pa.int64())], names=COUNTS.names)
        held.clear()

    def run(batches):
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        size = 0
        for batch in batches:
            langs, sources, texts = (batch.column(i) for i in range(3))
            for lang, source, text in zip(langs.to_pylist(), sources.to_pylist(), common.binary(texts), strict=True):
                found = TERM.findall(text.as_py().lower())
                n, d = held.setdefault((lang, source), (Counter(), Counter()))
                before = len(n)
                n.update(found)
                d.update(set(found))
                size += len(n) - before
                if size > HELD_TERMS:
                    yield from flush(held)
                    size = 0
        yield from flush(held)

    part = docs.select(*_names(), F.col("text")).mapInArrow(run, COUNTS)
    return part.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("d").alias("d"))


def _names() -> list[Column]:
    return [F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source")]


def shares(count: np.ndarray, n: int, terms: int) -> np.ndarray:
    """1 + floor(UNIT * (count + 2) / (n + 2 * terms)), by long division in base 1000."""
    whole = n + 2 * terms
    top = count.astype(np.int64) + 2
    quotient, rest = top // whole, top % whole
    for _ in range(3):
        rest = rest * 1000
        quotient, rest = quotient * 1000 + rest // whole, rest % whole
    return quotient + 1


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


def opponent(team: Column, round_: Column, seats: int) -> Column:
    """Whom a team meets in a round 0 .. seats - 2 of the circle method (seats is even): the last seat is the pivot."""
    ring = seats - 1
    half = (seats // 2) % ring  # the inverse of two modulo the ring
    pivot = F.pmod(round_ * half, F.lit(ring))  # 2 * team = round
    other = F.pmod(round_ - team, F.lit(ring))
    return F.when(team == ring, pivot).when(team == pivot, F.lit(ring)).otherwise(other).cast("int")


VECTOR = ("seat", "groups", "n", "terms", "width", "packed")


def _pack(table: pa.Table) -> bytes:
    """Positions (ascending), counts and the lang's counts of one row's terms, zstd."""
    t = table.sort_by("pos")
    data = b"".join(np.ascontiguousarray(t.column(c).to_numpy(), kind).tobytes() for c, kind in (("pos", "<i4"), ("n", "<i8"), ("total", "<i8")))
    return pa.compress(data, codec="zstd", asbytes=True)


def _unpack(packed: bytes, entries: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    if not entries:
        return np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)
    data = pa.decompress(packed, decompressed_size=20 * entries, codec="zstd", asbytes=True)
    return np.frombuffer(data, "<i4", entries), np.frombuffer(data, "<i8", entries, 4 * entries), np.frombuffer(data, "<i8", entries, 12 * entries)


def _dense(row: dict) -> np.ndarray:
    """A row's probabilities over all terms of its block."""
    count = np.zeros(row["width"], np.int64)
    pos, n, _ = _unpack(row["packed"], row["entries"])
    count[pos] = n
    return shares(count, row["n"], row["terms"]) if row["width"] else count


MEETING = T.StructType([T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("item", T.StringType()), T.StructField("value", T.LongType())])


def _both(pairs: list[tuple[str, str, str, int]]) -> pa.Table:
    """Both directions of every meeting."""
    lang, a, b, value = (list(x) for x in zip(*pairs, strict=True)) if pairs else ([], [], [], [])
    return pa.table({"lang": pa.array(lang + lang, pa.string()), "source": pa.array(a + b, pa.string()), "item": pa.array(b + a, pa.string()), "value": pa.array(value + value, pa.int64())})


def _meet(left: pa.Table, right: pa.Table) -> pa.Table:
    """All residents of a seat against all visitors of a team."""
    home = [(r["source"], _dense(r)) for r in left.to_pylist()]
    out = []
    for r in right.to_pylist():
        q = _dense(r)
        out += [(r["lang"], name, r["source"], int(divergence(p, q).sum())) for name, p in home]
    return _both(out)


def _at_home(table: pa.Table) -> pa.Table:
    """The groups of one team among themselves."""
    home = [(r["source"], _dense(r)) for r in table.to_pylist()]
    lang = table.column("lang")[0].as_py()
    return _both([(lang, a, b, int(divergence(p, q).sum())) for i, (a, p) in enumerate(home) for b, q in home[:i]])


BEST = T.StructType([T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("block", T.IntegerType()), T.StructField("pos", T.IntegerType()), T.StructField("value", T.LongType())])


def _heaps(most: int):
    def run(batches):
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if not r["entries"]:
                    continue
                pos, n, total = _unpack(r["packed"], r["entries"])
                p, q = shares(n, r["n"], r["terms"]), shares(total, r["of_lang"], r["terms"])
                over = np.flatnonzero(p > q)
                value = divergence(p[over], q[over])
                best = heapq.nsmallest(most, zip((-value).tolist(), pos[over].tolist(), strict=True))
                out += [(r["lang"], r["source"], r["block"], at, -v) for v, at in best]
            yield pa.RecordBatch.from_pylist([dict(zip(BEST.names, o, strict=True)) for o in out], schema=pa.schema([("lang", pa.string()), ("source", pa.string()), ("block", pa.int32()), ("pos", pa.int32()), ("value", pa.int64())]))

    return run


def audit(docs: DataFrame, least: int = LEAST_DOCUMENTS, top: int = TOP, seats: int = SEATS) -> DataFrame:
    """lang, source, part ('pair' or 'term'), item, value, rank: every group against its peers, and its most divergent terms."""
    spark = docs.sparkSession
    counts = common.cut(term_counts(docs))
    groups = docs.select(*_names()).distinct()
    kept = common.cut(counts.groupBy("lang", "term").agg(F.sum("n").alias("total"), F.sum("d").alias("d")).where(F.col("d") >= least).drop("d"))
    per_lang = groups.groupBy("lang").agg(F.count("*").alias("groups")).join(kept.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("total").alias("of_lang")), "lang", "left").fillna(0, ["terms", "of_lang"])
    per_lang = common.cut(per_lang)
    size = per_lang.agg(F.max("groups").alias("groups"), F.max("terms").alias("terms")).first()
    most_groups, most_terms = size["groups"] or 0, size["terms"] or 0
    teams = max(2, min(seats, most_groups + most_groups % 2))
    blocks = max(LEAST_BLOCKS, -(-most_terms * -(-most_groups // teams) // TEAM_ENTRIES))

    # terms get their numbers inside (lang, block), in UTF-8 order
    numbered = kept.withColumn("block", F.pmod(F.xxhash64("term"), F.lit(blocks)).cast("int"))
    numbered = common.cut(numbered.withColumn("pos", (F.row_number().over(Window.partitionBy("lang", "block").orderBy("term")) - 1).cast("int")))
    width = numbered.groupBy("lang", "block").agg(F.count("*").cast("int").alias("width"))

    entries = counts.select("lang", "source", "term", "n").join(numbered, ["lang", "term"]).select("lang", "source", "block", "pos", "n", "total")
    shape = T.StructType([entries.schema["lang"], entries.schema["source"], T.StructField("block", T.IntegerType()), T.StructField("entries", T.IntegerType()), T.StructField("sum_n", T.LongType()), T.StructField("packed", T.BinaryType())])

    def pack(key: tuple, table: pa.Table) -> pa.Table:
        total = int(np.sum(table.column("n").to_numpy()))
        return pa.table({"lang": [key[0].as_py()], "source": [key[1].as_py()], "block": pa.array([key[2].as_py()], pa.int32()), "entries": pa.array([table.num_rows], pa.int32()), "sum_n": pa.array([total], pa.int64()), "packed": pa.array([_pack(table)], pa.binary())})

    packed = common.cut(entries.groupBy("lang", "source", "block").applyInArrow(pack, shape))
    per_group = packed.groupBy("lang", "source").agg(F.sum("sum_n").alias("n"))
    seated = groups.withColumn("seat", F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1)
    seated = seated.join(per_group, ["lang", "source"], "left").join(per_lang, "lang").select("lang", "source", (F.col("seat") % teams).cast("int").alias("team"), F.coalesce("n", F.lit(0)).alias("n"), "terms", "of_lang")
    # every group has a row in every block of its lang (block 0 where the lang keeps no term)
    places = per_lang.select("lang").join(width, "lang", "left").fillna(0, ["block", "width"])
    vectors = common.cut(seated.join(places, "lang").join(packed.drop("sum_n"), ["lang", "source", "block"], "left").fillna(0, ["entries"]))

    pairs = tournament(spark, vectors, teams, crowded=most_groups > teams)
    best = vectors.select("lang", "source", "block", "entries", "n", "terms", "of_lang", "packed").mapInArrow(_heaps(top), BEST)
    terms = best.join(numbered.select("lang", "block", "pos", F.col("term").alias("item")), ["lang", "block", "pos"]).select("lang", "source", "item", "value")
    ranked = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    terms = terms.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= top)
    pairs = pairs.withColumn("rank", F.row_number().over(ranked))
    columns = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.col("rank").cast("int").alias("rank"))
    return columns(pairs, "pair").unionByName(columns(terms, "term"))


def tournament(spark: SparkSession, vectors: DataFrame, teams: int, crowded: bool = False) -> DataFrame:
    """lang, source, item, value for every two groups of a lang, in both directions.

    ``crowded``: some team has more than one group, so teams play at home as well.
    """
    key = ["lang", "team", "block"]
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    residents = vectors.repartition(n, *key).persist()
    results = []
    if crowded:
        results.append(common.cut(residents.groupBy(*key).applyInArrow(_at_home, MEETING)))
    for first in range(0, teams - 1, AT_ONCE):
        rounds = F.explode(F.sequence(F.lit(first), F.lit(min(first + AT_ONCE, teams - 1) - 1)))
        met = vectors.withColumn("round", rounds).withColumn("host", opponent(F.col("team"), F.col("round"), teams))
        # the host of a meeting is the lower seat where their sum is even, else the higher: hosting is shared evenly
        guest = F.when((F.col("team") + F.col("host")) % 2 == 0, F.col("team") > F.col("host")).otherwise(F.col("team") < F.col("host"))
        visitors = met.where(guest).drop("team", "round").withColumnRenamed("host", "team").repartition(n, *key)
        results.append(common.cut(residents.groupBy(*key).cogroup(visitors.groupBy(*key)).applyInArrow(_meet, MEETING)))
        common.release(spark)
    residents.unpersist()
    out = results[0]
    for r in results[1:]:
        out = out.unionByName(r)
    return out.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(common.table(spark, sf_dir, "documents"))


ORACLE = """
WITH words AS (
  SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS row_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS found
  FROM documents),
one AS (SELECT lang, source, row_id, unnest(found) AS term FROM words),
kept AS (SELECT lang, term, count(*)::HUGEINT AS total FROM one GROUP BY ALL HAVING count(DISTINCT row_id) >= 10),
langs AS (SELECT lang, count(*)::HUGEINT AS v, sum(total)::HUGEINT AS of_lang FROM kept GROUP BY ALL),
grp AS (SELECT DISTINCT lang, source FROM words),
cnt AS (SELECT lang, source, term, count(*)::HUGEINT AS n FROM one SEMI JOIN kept USING (lang, term) GROUP BY ALL),
tot AS (SELECT lang, source, sum(n)::HUGEINT AS n_all FROM cnt GROUP BY ALL),
full_p AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000 * (coalesce(c.n, 0) + 2)) // (coalesce(t.n_all, 0) + 2 * l.v) AS p,
         1 + (1000000000 * (k.total + 2)) // (l.of_lang + 2 * l.v) AS q
  FROM grp g JOIN kept k USING (lang) JOIN langs l USING (lang)
  LEFT JOIN tot t ON t.lang = g.lang AND t.source = g.source
  LEFT JOIN cnt c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
pair_f AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
  FROM full_p a JOIN full_p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(f.value, 0) AS value
  FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN pair_f f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source),
terms AS (SELECT lang, source, term AS item, ((p - q) * (p - q)) // (p + q) AS value FROM full_p WHERE n > 0 AND p > q),
ranked AS (
  SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM pairs
  UNION ALL
  SELECT * FROM (SELECT lang, source, 'term' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM terms) WHERE rank <= 10)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INT AS rank FROM ranked
"""
