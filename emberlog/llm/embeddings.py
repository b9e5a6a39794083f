"""Embedding near-duplicates (1): a random-projection tree forest.

Equal vectors are one node with a weight, so copies never meet as pairs. A bounded sample fits the trees: every node projects on random directions and splits one at its
median, points within a margin of the split going to both sides. The margin follows from the
threshold: a pair at the threshold, and the links that the sample has in the node, may be split
with the small chance that leaves ``recall`` over all levels and trees. A node where that sends more than ``most_spill`` of its rows to both
sides, in every direction tried, is dense and stays a leaf. Each row is then sent to all its
leaves in every tree as it stands (floats as floats), leaves are compared by cosine in double precision, and
links are joined into components. A pair is counted in the first leaf that it shares, which both rows' leaf lists
tell, so link counts are exact sums over leaves and no pair ever leaves a task: a leaf
returns a count and a spanning link for each row. Leaves with more than ``most`` rows are cut
into blocks, and each pair of blocks is compared by its own task.

Dense groups, which no split divides, are taken first as balls: the sample's dense places give centres, and rows within
half the threshold's angle of their nearest centre all link with each other, by the triangle inequality. A ball's links
are counted from its weight and never compared; it has blocks of its own in a large leaf, which meet only the leaf's other blocks.

Measured recall against brute force is in the tests (1.0 on the test tables).

Defined results: vectors that are null, empty, zero or hold null or non-finite components link
with nothing; vectors of different lengths never link; of rows that repeat a vec_id the one
with the smallest vector (by bytes) counts; rows without vec_id are returned alone, with a null component and
kept. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

THRESHOLD, TREES, LEAF, RECALL, MOST_SPILL, TRIED, SAMPLE, MOST = 0.9, 4, 2048, 0.997, 0.3, 8, 20_000, 4096
MOST_BALLS, PROBE = 256, 1024  # centres for vectors of one length; sample rows among which a dense place is looked for
MOST_SAMPLE, MOST_BYTES = 1 << 18, 128 << 20  # of the sample that the driver fits on: rows, and bytes of their components


def _split_chance(u: np.ndarray) -> np.ndarray:
    """E max(|z| - u, 0) of a standard normal z."""
    tail = np.array([math.erfc(k / math.sqrt(2)) for k in u])
    return 2 * np.exp(-u * u / 2) / math.sqrt(2 * math.pi) - u * tail


_WIDTHS = np.linspace(0, 4, 401)
_CHANCES = _split_chance(_WIDTHS)


class Forest:
    """Trees for vectors of one length. Nodes are numbered as in a heap; leaves are numbered over all trees.

    A node that isn't split sends all its rows to the left, down to the last level: its cut is infinite.
    """

    def __init__(self, x: np.ndarray, rows: int, trees: int = TREES, leaf: int = LEAF, recall: float = RECALL, most_spill: float = MOST_SPILL, threshold: float = THRESHOLD, seed: int = 11, most: int = MOST):
        rng = np.random.default_rng(seed)
        need = max(0, math.ceil(math.log2(max(rows, 1) / leaf))) if rows > leaf else 0
        self.depth = min(need, max(0, int(math.log2(max(len(x), 1) / 16))))
        self.trees, self.nodes = trees, (1 << self.depth) - 1
        self.loss = 1 - (1 - (1 - recall) ** (1 / trees)) ** (1 / max(self.depth, 1))
        self.most_spill, self.threshold = most_spill, threshold
        self.direction = np.zeros((trees, self.nodes, x.shape[1]))
        self.cut, self.margin = np.full((trees, self.nodes), np.inf), np.zeros((trees, self.nodes))
        for t in range(trees):
            inside = {0: np.arange(len(x))}
            for node in range(self.nodes):
                at = inside.pop(node, None)
                if at is None or not len(at):
                    continue
                found = self._split(x[at], rng)
                if found is None:
                    continue
                self.direction[t, node], self.cut[t, node], self.margin[t, node], p = found
                p = p - self.cut[t, node]
                inside[2 * node + 1], inside[2 * node + 2] = at[p <= self.margin[t, node]], at[p >= -self.margin[t, node]]
        self.centres = self._centres(x, rows, most, rng)

    def _centres(self, x: np.ndarray, rows: int, most: int, rng: np.random.Generator) -> np.ndarray:
        """Centres of balls that hold more than ``most`` rows, judged by the sample, densest places first."""
        self.core = math.cos(math.acos(self.threshold) / 2 - 1e-7)  # two rows this near to a centre link, whatever is rounded
        found, left = [], np.arange(len(x))
        while len(found) < MOST_BALLS and len(left) * rows > most * len(x):
            some = x[left if len(left) <= PROBE else rng.choice(left, PROBE, replace=False)]
            near = some @ some.T >= self.threshold
            k = int(np.argmax(near.sum(axis=1)))
            if near[k].sum() < 4:
                break
            centre = some[near[k]].mean(axis=0)
            centre /= np.linalg.norm(centre)
            p = (x @ centre)[left]  # no copy of the sample
            inside = p >= self.core
            if inside.sum() * rows > most * len(x):
                found.append(centre)
                left = left[~inside]
            else:  # a loose place: no ball, and not looked at again
                left = left[(p < self.threshold) & ((x @ some[k])[left] < self.threshold)]
        return np.array(found).reshape(len(found), x.shape[1])

    def balls(self, x: np.ndarray) -> np.ndarray:
        """Number of the ball of each row, -1 where none holds it."""
        if not len(self.centres):
            return np.full(len(x), -1, np.int32)
        p = x @ self.centres.T
        best = p.argmax(axis=1)
        return np.where(p[np.arange(len(x)), best] >= self.core, best, -1).astype(np.int32)

    def _split(self, x: np.ndarray, rng: np.random.Generator):
        """(direction, cut, margin, projections) of the direction that sends the fewest rows to both sides; None in a dense node."""
        some = x if len(x) <= 256 else x[rng.choice(len(x), 256, replace=False)]
        i, j = np.nonzero(np.triu(some @ some.T >= self.threshold, 1))
        if len(i) > 5000:
            few = rng.choice(len(i), 5000, replace=False)
            i, j = i[few], j[few]
        direction = rng.standard_normal((TRIED, x.shape[1]))
        direction /= np.linalg.norm(direction, axis=1, keepdims=True)
        p, q = x @ direction.T, some @ direction.T
        step = math.sqrt(max(2 - 2 * self.threshold, 1e-12) / x.shape[1])  # how far a pair at the threshold lies apart on a direction
        for part in ((0.5,), (0.25, 0.75)):  # off the median only where a dense group lies on it
            for cut in np.quantile(p, part, axis=0):
                away = np.abs(p - cut)
                near = np.maximum((away <= step).mean(axis=0) / 2, 1e-12)  # rows a step, at the cut
                margin = step / 2 * np.interp(-self.loss / near, -_CHANCES, _WIDTHS)
                if len(i):
                    margin = np.maximum(margin, np.quantile(np.minimum(cut - np.minimum(q[i], q[j]), np.maximum(q[i], q[j]) - cut), 1 - self.loss, axis=0))
                spilled = (away <= margin).mean(axis=0)
                best = int(np.argmin(spilled))
                if spilled[best] <= self.most_spill * min(1, 4 * part[0] * (1 - part[0])):
                    return direction[best], cut[best], margin[best], p[:, best]
        return None

    def leaves(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) for all leaves of all trees."""
        rows, leaves = [], []
        for t in range(self.trees):
            row, node = np.arange(len(x)), np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                p = np.einsum("ij,ij->i", x[row], self.direction[t, node]) - self.cut[t, node]
                low, high = p <= self.margin[t, node], p >= -self.margin[t, node]
                row, node = np.concatenate((row[low], row[high])), np.concatenate((2 * node[low] + 1, 2 * node[high] + 2))
            rows.append(row)
            leaves.append(node - self.nodes + t * (self.nodes + 1))
        return np.concatenate(rows), np.concatenate(leaves)


def _clean(vectors: DataFrame) -> DataFrame:
    """vec_id and v (floats or doubles, as given): one row for each id, v null where the vector can't link."""
    kind = vectors.schema["embedding"].dataType.elementType.simpleString()
    v = F.col("embedding").cast(f"array<{kind if kind in ('float', 'double') else 'double'}>")
    good = F.col("embedding").isNotNull() & (F.size("embedding") > 0) & ~F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))) & F.exists(v, lambda c: c != 0)
    named = vectors.where("vec_id IS NOT NULL").select("vec_id", F.when(good, v).alias("v"))
    return named.groupBy("vec_id").agg(F.min("v").alias("v"))


def _floats(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(float)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # no overflow or underflow in the norm
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def with_key(vectors: DataFrame) -> DataFrame:
    """vec_id, v and ``key``: 128 bits of BLAKE2b over the vector's bytes, null where v is."""
    schema = T.StructType([*vectors.select("vec_id", "v").schema.fields, T.StructField("key", T.BinaryType())])

    def run(batch: pa.RecordBatch):
        v = batch.column(1)
        width, data = v.values.to_numpy(zero_copy_only=False), v.offsets.to_numpy()
        keys = [blake2b(width[a:b].tobytes(), digest_size=16).digest() if ok else None for a, b, ok in zip(data[:-1].tolist(), data[1:].tolist(), v.is_valid().to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys, pa.binary())], names=schema.names)

    return common.arrow_map(vectors.select("vec_id", "v"), run, schema)


def fit(vectors: DataFrame, sample: int = SAMPLE, leaf: int = LEAF, **options) -> dict[int, Forest]:
    """A forest for each vector length that the sample holds; vectors of any other length share one leaf.

    The sample: rows with the smallest hash of the id, ``sample`` or 32 for each leaf wanted, MOST_SAMPLE rows and about
    MOST_BYTES at most. It reaches the driver as one Arrow table.
    """
    size = F.size("v")
    kind = vectors.schema["v"].dataType.elementType.simpleString()
    total, mean = vectors.agg(F.count("*"), F.avg(size)).first()
    most = min(MOST_SAMPLE, max(1, int(MOST_BYTES / ((4 if kind == "float" else 8) * (mean or 1)))))
    got = common.smallest(vectors.select("vec_id", "v"), min(most, max(sample, 32 * total // leaf)), "vec_id").select("v").toArrow().column(0)
    lengths = np.array(pc.list_value_length(got))
    by_length = {int(d): _floats(got.filter(pa.array(lengths == d)).combine_chunks()) for d in np.unique(lengths)}
    counts = {r["d"]: r["n"] for r in vectors.where(size.isin(*by_length)).groupBy(size.alias("d")).agg(F.count("*").alias("n")).collect()} if by_length else {}
    return {d: Forest(_unit(by_length[d]), n, leaf=leaf, **options) for d, n in counts.items()}


PLACED = [T.StructField(n, k, False) for n, k in (("leaf", T.StringType()), ("vec_id", T.LongType()), ("weight", T.LongType()), ("ball", T.IntegerType()), ("x", T.BinaryType()), ("all", T.BinaryType()))]
LINKED = T.StructType([T.StructField("vec_id", T.LongType(), False), T.StructField("n", T.LongType(), False), T.StructField("root", T.LongType(), False)])


def placed(vectors: DataFrame, forests: dict[int, Forest], leaves_only: bool = False) -> DataFrame:
    """(vec_id, weight, v) -> a row for each vector and leaf: its bytes and the list of all its leaves. Or just the leaves and balls, counted."""
    schema = T.StructType([PLACED[0], PLACED[3], T.StructField("rows", T.LongType(), False)] if leaves_only else PLACED)

    def run(batch: pa.RecordBatch):
        vectors_ = batch.column(2)
        sizes = np.diff(vectors_.offsets.to_numpy())
        for d in np.unique(sizes):
            at = np.flatnonzero(sizes == d)
            for k in range(0, len(at), 1000):
                part = batch.take(pa.array(at[k : k + 1000]))
                raw, forest = _floats(part.column(2)), forests.get(int(d))
                x = _unit(raw)
                row, leaf = forest.leaves(x) if forest else (np.arange(len(raw)), np.zeros(len(raw), np.int64))
                ball = forest.balls(x) if forest else np.full(len(raw), -1, np.int32)
                if leaves_only:
                    names, rows = np.unique(np.stack((leaf, ball[row])), axis=1, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([f"{d}:{n}" for n in names[0].tolist()]), pa.array(names[1].astype(np.int32)), pa.array(rows)], names=schema.names)
                    continue
                by = np.lexsort((leaf, row))
                row, leaf = row[by], leaf[by].astype("<i4")
                ends = np.searchsorted(row, np.arange(len(raw) + 1))
                every = [leaf[ends[i] : ends[i + 1]].tobytes() for i in range(len(raw))]
                data = [v.tobytes() for v in raw]
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays([pa.array([f"{d}:{n}" for n in leaf.tolist()]), part.column(0).take(take), part.column(1).take(take), pa.array(ball[row]), pa.array(data, pa.binary()).take(take), pa.array(every, pa.binary()).take(take)], names=schema.names)

    return common.arrow_map(vectors.select("vec_id", "weight", "v"), run, schema)


def within(vectors: DataFrame, forests: dict[int, Forest]) -> DataFrame:
    """(vec_id, weight, v) -> the links inside balls, as ``links`` gives those of leaves."""
    schema = T.StructType([T.StructField("ball", T.StringType(), False), PLACED[1], PLACED[2]])

    def run(batch: pa.RecordBatch):
        sizes = np.diff(batch.column(2).offsets.to_numpy())
        for d in np.unique(sizes):
            at = np.flatnonzero(sizes == d)
            for k in range(0, len(at) if int(d) in forests else 0, 1000):
                part = batch.take(pa.array(at[k : k + 1000]))
                ball = forests[int(d)].balls(_unit(_floats(part.column(2))))
                held = pa.array(np.flatnonzero(ball >= 0))
                yield pa.RecordBatch.from_arrays([pa.array([f"{d}:{b}" for b in ball.tolist()], pa.string()).take(held), part.column(0).take(held), part.column(1).take(held)], names=schema.names)

    members = common.cut(common.arrow_map(vectors.select("vec_id", "weight", "v"), run, schema))
    # MOST_BALLS rows for each length of the sample's vectors at most
    balls = members.groupBy("ball").agg(F.sum("weight").alias("all"), F.min("vec_id").alias("root"))
    return members.join(F.broadcast(balls), "ball").select("vec_id", (F.col("all") - F.col("weight")).alias("n"), "root")


def _compare(x: np.ndarray, y: np.ndarray, every_x: list, every_y: list, leaf: int, threshold: float, ball_x: np.ndarray, ball_y: np.ndarray):
    """(i, j) of linked pairs of x and y rows whose first common leaf is this one and that no ball holds, in blocks of rows.

    Rows with equal leaves are taken together: what shares an earlier leaf with a whole block was compared there.
    """
    order = np.array(sorted(range(len(x)), key=lambda k: (ball_x[k], every_x[k])), np.int64)
    held = np.repeat(np.arange(len(y)), [len(e) // 4 for e in every_y])
    holds = np.frombuffer(b"".join(every_y), "<i4")
    for at in range(0, len(x), 512):
        block = order[at : at + 512]
        names, times = np.unique(np.frombuffer(b"".join([every_x[k] for k in block]), "<i4"), return_counts=True)
        names = names[(times == len(block)) & (names < leaf)]
        new = np.ones(len(y), bool)
        new[held[np.isin(holds, names)]] = False
        if ball_x[block[0]] >= 0 and ball_x[block[0]] == ball_x[block[-1]]:
            new &= ball_y != ball_x[block[0]]
        new = np.flatnonzero(new)
        if not len(new):
            continue
        i, j = np.nonzero(x[block] @ y[new].T >= threshold)
        if not len(i):
            continue
        i, j = block[i], new[j]
        apart = (ball_x[i] < 0) | (ball_x[i] != ball_y[j])
        i, j = i[apart], j[apart]
        us, vs = np.unique(i), np.unique(j)
        flat = [np.frombuffer(every_x[u], "<i4") for u in us], [np.frombuffer(every_y[v], "<i4") for v in vs]
        known = np.unique(np.concatenate([*flat[0], *flat[1]]))
        known = known[known < leaf]
        if len(known):
            a, b = (np.zeros((len(f), len(known)), np.float32) for f in flat)
            for m, lists in ((a, flat[0]), (b, flat[1])):
                who = np.repeat(np.arange(len(lists)), [len(f) for f in lists])
                what = np.concatenate(lists)
                use = what < leaf
                m[who[use], np.searchsorted(known, what[use])] = 1
            fresh = (a @ b.T)[np.searchsorted(us, i), np.searchsorted(vs, j)] == 0
            i, j = i[fresh], j[fresh]
        yield i, j


def _spanning(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """root (the smallest index known to be reachable from each node) after the links (i, j)."""
    while True:
        before = root
        low = np.minimum(root[i], root[j])
        root = root.copy()
        for k in (i, j):
            np.minimum.at(root, before[k], low)  # the old root follows, and all its nodes with it
            np.minimum.at(root, k, low)
        while (root[root] != root).any():
            root = root[root]
        if (root == before).all():
            return root


def links(vectors: DataFrame, forests: dict[int, Forest], threshold: float = THRESHOLD, most: int = MOST) -> DataFrame:
    """(vec_id, weight, v) -> (vec_id, weight of the links counted in a leaf, smallest vec_id it is linked to there)."""
    kind = np.float32 if vectors.schema["v"].dataType.elementType.simpleString() == "float" else np.float64
    # a ball with rows for a quarter of a block has blocks of its own in a leaf, all other rows share the rest (-1)
    own = F.when((F.col("ball") >= 0) & (4 * F.col("n") > most), F.col("ball")).otherwise(-1)
    parts = placed(vectors, forests, leaves_only=True).groupBy("leaf", "ball").agg(F.sum("rows").alias("n")).withColumn("own", own).groupBy("leaf", "own").agg(F.sum("n").alias("n"))
    held = F.struct("own", F.ceil(F.col("n") / most).cast("int").alias("blocks"))
    before = lambda i: F.aggregate(F.slice("parts", 1, i), F.lit(0), lambda s, q: s + q["blocks"])
    places = F.map_from_entries(F.transform("parts", lambda q, i: F.struct(q["own"], F.struct(before(i).alias("first"), q["blocks"].alias("count")))))
    # as many rows as large leaves: trees x 2**depth of each length at most; few leaves hold parts of a dense ball
    large = parts.groupBy("leaf").agg(F.sum("n").alias("n"), F.collect_list(held).alias("parts")).where(F.col("n") > most).select("leaf", places.alias("places"), before(F.size("parts")).alias("blocks"))
    cut = placed(vectors, forests).join(F.broadcast(large), "leaf", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    mine = F.col("places")[F.col("ball")]
    place = F.coalesce(mine, F.col("places")[F.lit(-1)], F.struct(F.lit(0).alias("first"), F.lit(1).alias("count")))
    cut = cut.withColumn("pure", (F.col("ball") >= 0) & mine.isNotNull()).withColumn("place", place)
    cut = cut.withColumn("block", (F.col("place.first") + F.pmod(F.xxhash64("vec_id"), F.col("place.count"))).cast("int"))
    same = lambda o: F.col("pure") & (o >= F.col("place.first")) & (o < F.col("place.first") + F.col("place.count"))
    other = F.explode(F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: ~same(o))).alias("other")
    tiles = cut.select("*", other).withColumn("tile", F.concat_ws("|", "leaf", F.least("block", "other"), F.greatest("block", "other"))).select("tile", "block", "vec_id", "weight", "ball", "x", "all")

    def solve(key, t: pa.Table) -> pa.Table:
        leaf, low, high = key[0].as_py().split("|")
        leaf = int(leaf.split(":")[1])
        t = t.sort_by("vec_id")
        ids, block, weight, ball = (t.column(n).to_numpy() for n in ("vec_id", "block", "weight", "ball"))
        x = _unit(np.frombuffer(b"".join(t.column("x").to_pylist()), kind).reshape(len(ids), -1))
        every = t.column("all").to_pylist()
        a, b = np.flatnonzero(block == int(low)), np.flatnonzero(block == int(high))
        n, root = np.zeros(len(ids), np.int64), np.arange(len(ids))
        for i, j in _compare(x[a], x[b], [every[k] for k in a], [every[k] for k in b], leaf, threshold, ball[a], ball[b]):
            i, j = a[i], b[j]
            other = i != j
            i, j = i[other], j[other]
            n += np.bincount(i, weights=weight[j], minlength=len(ids)).astype(np.int64)
            if low != high:
                n += np.bincount(j, weights=weight[i], minlength=len(ids)).astype(np.int64)
            root = _spanning(root, i, j)
        has = (n > 0) | (root != np.arange(len(ids)))
        return pa.table([pa.array(ids[has]), pa.array(n[has]), pa.array(ids[root[has]])], names=LINKED.names)

    compared = tiles.groupBy("tile").applyInArrow(lambda key, t: solve(key, t), LINKED)
    return compared.unionByName(within(vectors, forests)) if any(len(f.centres) for f in forests.values()) else compared


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, most: int = MOST, **options) -> DataFrame:
    """vec_id, n_links, component_id, kept for each vector of (vec_id, embedding)."""
    every = common.cut(with_key(_clean(vectors)))
    nodes = common.cut(every.where("key IS NOT NULL").groupBy("key").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("weight"), F.min("v").alias("v")))
    found = common.cut(links(nodes, fit(nodes, threshold=threshold, most=most, **options), threshold, most).groupBy("vec_id", "root").agg(F.sum("n").alias("n")))
    counts = found.groupBy("vec_id").agg(F.sum("n").alias("n_links"))
    roots = common.connected_components(found.select(F.col("vec_id").alias("u"), F.col("root").alias("v")))
    known = nodes.select("key", "vec_id", "weight").join(counts, "vec_id", "left").join(roots.withColumnRenamed("node", "vec_id"), "vec_id", "left")
    links_ = (F.coalesce("n_links", F.lit(0)) + F.col("weight") - 1).cast("long")
    known = common.cut(known.select("key", "weight", links_.alias("n_links"), F.coalesce("component", "vec_id").alias("component_id")))
    kind = vectors.schema["vec_id"].dataType
    columns = [F.col("vec_id").cast(kind), "n_links", F.col("component_id").cast(kind), (F.col("vec_id") == F.col("component_id")).alias("kept")]
    out = common.join_heavy(every.where("key IS NOT NULL").select("vec_id", "key"), known, "key", "weight").select(*columns)
    alone = every.where("key IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")).select(*columns)
    nameless = vectors.where("vec_id IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.lit(None).cast(kind).alias("component_id"), F.lit(True).alias("kept"))
    return out.unionByName(alone).unionByName(nameless)


def op1_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(common.table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
