"""Best-fit packing (9) by the linear grouping scheme.

Texts become token pieces of at most ``room`` tokens. The driver sees only a histogram of piece
lengths (``room`` numbers at most). Large lengths are rounded up within groups of equal
cardinality, a configuration program over the few rounded sizes is solved by column generation,
its whole parts give patterns, actual pieces (longest first) take the patterns' places, and what
is left is put where it fits best. All of it works on run lengths: a plan is a list of
sequences of equal make-up, so its size depends on the number of lengths, not of documents.
Pieces find their place by their rank among pieces of equal length.

Defined results: null and empty texts give one piece, their end token; ties between pieces of
equal length are broken by id, piece and checksum; repeated rows are packed each on their own.
"""

from __future__ import annotations

import bisect
import zlib
from array import array
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common
from .bpe import MEMO_ENTRIES, Memo, chunks, kept, read_file, vocabulary

ROOM, SALTS, GROUPS = 2048, 32, 32


class LibraryEncoder(Memo):
    """Chunk -> packed ids by the tokenizers library's model, which takes the file's pre-tokens one by one."""

    def __init__(self, text: str, entries: int = MEMO_ENTRIES):
        from tokenizers import Tokenizer

        super().__init__(entries)
        self.vocabulary = vocabulary(text)
        tokenizer = Tokenizer.from_str(text)
        self.model, self.whole = tokenizer.model, tokenizer
        tokenizer.no_padding()
        tokenizer.no_truncation()

    def compute(self, chunk: str) -> bytes:
        if "<|" in chunk:  # may hold a special token
            return np.array(self.whole.encode(chunk, add_special_tokens=False).ids, "<u4").tobytes()
        if chunk.isascii() and chunk.isprintable():  # these bytes are the file's letters already
            low = chunk.lower()
            parts = (low,) if low.isalpha() else self.vocabulary.pieces.findall(low)
        else:
            parts = map(self.vocabulary.letters, self.vocabulary.pretokens(chunk))
        return array("I", [t.id for p in parts for t in self.model.tokenize(p)]).tobytes()


def pieces(docs: DataFrame, path: str | None = None, room: int = ROOM, end: int = 0) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of the token pieces of every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(read_file(path))
    docs = docs.select("doc_id", "text")
    schema = T.StructType([docs.schema["doc_id"], T.StructField("piece", T.IntegerType(), False), T.StructField("start", T.LongType(), False), T.StructField("length", T.LongType(), False), T.StructField("ids_crc32", T.LongType(), False)])
    stop = np.array([end], "<u4").tobytes()

    def run(batches):
        memo = kept(shared.value, LibraryEncoder)
        for batch in batches:
            texts = common.binary(batch.column(1))
            for a, b in common.slices(texts, 1 << 20):
                lists = [chunks(t.decode()) for t in texts.slice(a, b - a).to_pylist()]
                who, piece, start, length, crc = [], [], [], [], []
                for i, parts in enumerate(lists):
                    ids = b"".join(map(memo.__getitem__, parts)) + stop
                    for k in range(0, len(ids), 4 * room):
                        part = ids[k : k + 4 * room]
                        who.append(a + i)
                        piece.append(k // (4 * room))
                        start.append(k // 4)
                        length.append(len(part) // 4)
                        crc.append(zlib.crc32(part))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(who)), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))], names=schema.names)

    return docs.mapInArrow(run, schema)


@dataclass
class Bins:
    """``count`` sequences of equal make-up: lengths in order, and the room that is left."""

    count: int
    lengths: list[int]
    slack: int


def configurations(sizes: np.ndarray, demand: np.ndarray, room: int, most: int = 1500) -> list[tuple[np.ndarray, float]]:
    """(pattern, times) of a basic solution of min sum x, A x >= demand, by column generation."""
    m = len(sizes)
    columns = np.zeros((m, m))
    for i, s in enumerate(sizes):
        columns[i, i] = room // s
    for _ in range(most):
        prices = np.linalg.solve(columns.T, np.ones(m))
        value = np.zeros(room + 1)
        pick = np.full(room + 1, -1)
        for c in range(int(sizes.min()), room + 1):  # unbounded knapsack over the rounded sizes
            fits = np.flatnonzero(sizes <= c)
            gain = value[c - sizes[fits]] + prices[fits]
            j = int(np.argmax(gain))
            if gain[j] > value[c - 1] + 1e-12:
                value[c], pick[c] = gain[j], fits[j]
            else:
                value[c] = value[c - 1]
        if value[room] <= 1 + 1e-7:
            break
        new, c = np.zeros(m), room
        while c > 0:
            if pick[c] < 0:
                c -= 1
            else:
                new[pick[c]] += 1
                c -= int(sizes[pick[c]])
        x, d = np.linalg.solve(columns, demand.astype(float)), np.linalg.solve(columns, new)
        ratio = np.where(d > 1e-9, np.maximum(x, 0) / np.where(d > 1e-9, d, 1), np.inf)
        columns[:, int(np.argmin(ratio))] = new
    x = np.linalg.solve(columns, demand.astype(float))
    return [(columns[:, i].astype(int), float(x[i])) for i in range(m) if x[i] > 0]


def plan(histogram: dict[int, int], room: int = ROOM, groups: int = GROUPS) -> list[Bins]:
    """Sequences for all pieces of the histogram (length -> count).

    Lengths above a third or above a half of the room count as large; the better plan is taken.
    """
    return min((scheme(histogram, room, groups, small) for small in (room // 3, room // 2)), key=lambda p: sum(b.count for b in p))


def scheme(histogram: dict[int, int], room: int, groups: int, small: int) -> list[Bins]:
    """The linear grouping scheme with lengths above ``small`` as the large ones."""
    left = {n: c for n, c in histogram.items() if c}
    bins: list[Bins] = []
    if left.get(room):
        bins.append(Bins(left.pop(room), [room], 0))
    large = sorted((n for n in left if n > small), reverse=True)
    total = sum(left[n] for n in large)
    if total:
        each = -(-total // groups)
        member: list[list[list[int]]] = []  # for each group [length, count] from the longest
        seen = 0
        for n in large:
            count = left[n]
            while count:
                if seen % each == 0:
                    member.append([])
                take = min(count, each - seen % each)
                member[-1].append([n, take])
                seen += take
                count -= take
        sizes = np.array([g[0][0] for g in member])
        demand = np.array([sum(c for _, c in g) for g in member])
        for pattern, times in sorted(configurations(sizes, demand, room), key=lambda p: -p[1]):
            x = int(times + 1e-9)
            slots = [g for g in np.argsort(-sizes, kind="stable") for _ in range(pattern[g])]
            while x > 0:  # equal sequences as long as every slot's run of equal lengths lasts
                used: dict[int, int] = {}
                for g in slots:
                    used[g] = used.get(g, 0) + 1
                used = {g: u for g, u in used.items() if member[g]}
                if not used:
                    break
                batch = min(x, *(max(1, member[g][0][1] // u) for g, u in used.items()))
                make: list[int] = []
                for g, u in used.items():
                    for _ in range(u):
                        if member[g]:
                            run = member[g][0]
                            make.append(run[0])
                            left[run[0]] -= batch
                            run[1] -= batch
                            if not run[1]:
                                member[g].pop(0)
                bins.append(Bins(batch, make, room - sum(make)))
                x -= batch
    best_fit(bins, left, room)
    return bins


def best_fit(bins: list[Bins], left: dict[int, int], room: int) -> None:
    """Put what is left, longest first, into the sequences with the least room that still takes it."""
    by_slack: dict[int, list[Bins]] = {}
    for b in bins:
        by_slack.setdefault(b.slack, []).append(b)
    order = sorted(by_slack)

    def add(b: Bins) -> None:
        if b.slack not in by_slack:
            bisect.insort(order, b.slack)
            by_slack[b.slack] = []
        by_slack[b.slack].append(b)

    bins.clear()
    for n in sorted((n for n in left if left[n] > 0), reverse=True):
        count = left[n]
        while count:
            at = bisect.bisect_left(order, n)
            if at < len(order):
                slack = order[at]
                b = by_slack[slack].pop()
                if not by_slack[slack]:
                    del by_slack[slack]
                    order.pop(at)
            else:
                b = Bins(-(-count // (room // n)), [], room)
            each = min(b.slack // n, count)
            full = min(b.count, count // each)
            if b.count > full:
                add(Bins(b.count - full, b.lengths, b.slack))
            add(Bins(full, [*b.lengths, *[n] * each], b.slack - each * n))
            count -= full * each
        left[n] = 0
    for group in by_slack.values():
        bins.extend(b for b in group if b.lengths)


def places(bins: list[Bins]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted keys (length << 40 | first rank), first sequence and offset of each slot."""
    rank: dict[int, int] = {}
    out, base = [], 0
    for b in bins:
        offset = 0
        for n in b.lengths:
            out.append(((n << 40) | rank.get(n, 0), base, offset))
            rank[n] = rank.get(n, 0) + b.count
            offset += n
        base += b.count
    out.sort()
    a = np.array(out, np.int64).reshape(-1, 3)
    return a[:, 0], a[:, 1], a[:, 2]


def pack(rows: DataFrame, room: int = ROOM) -> DataFrame:
    """rows with a ``length`` of 1 to room -> the same rows with sequence_id and offset.

    Rows of just ``room`` fill a sequence each and are numbered where they are (below zero). rows is read
    three times, so it should be written already (``common.cut``).
    """
    full = rows.where(F.col("length") == room).select("*", (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rows = rows.where(F.col("length") < room)
    order = [c for c in ("doc_id", "piece", "ids_crc32") if c in rows.columns]
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(*order), F.lit(SALTS)).cast("int"))
    counts = salted.groupBy("length", "_salt").agg(F.count("*").alias("n")).collect()  # room * SALTS rows at most
    histogram: dict[int, int] = {}
    begin: dict[tuple[int, int], int] = {}
    for r in sorted(counts, key=lambda r: (r["length"], r["_salt"])):
        begin[(r["length"], r["_salt"])] = histogram.get(r["length"], 0)
        histogram[r["length"]] = histogram.get(r["length"], 0) + r["n"]
    keys, sequence, offset = places(plan(histogram, room))
    first = np.zeros((room + 1, SALTS), np.int64)
    for (n, s), v in begin.items():
        first[n, s] = v
    ranked = salted.withColumn("_rank", F.row_number().over(Window.partitionBy("length", "_salt").orderBy(*order)))
    schema = T.StructType([*rows.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    at_length, at_salt, at_rank = (ranked.columns.index(c) for c in ("length", "_salt", "_rank"))

    def run(batch: pa.RecordBatch):
        length, salt, rank = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (at_length, at_salt, at_rank))
        rank = first[length, salt] + rank - 1
        slot = np.searchsorted(keys, (length << 40) | rank, side="right") - 1
        number = sequence[slot] + rank - (keys[slot] & ((1 << 40) - 1))
        yield pa.RecordBatch.from_arrays([*batch.columns[:at_salt], pa.array(number), pa.array(offset[slot])], names=schema.names)

    return common.arrow_map(ranked, run, schema).unionByName(full)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(common.cut(pieces(common.table(spark, sf_dir, "documents"))))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline: the pieces of all documents with their sequences."""
    return pack(common.cut(pieces(docs)))
