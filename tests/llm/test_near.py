"""SimHash and embedding near-duplicates against brute force."""

import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from emberlog.llm import embeddings, simhash


def brute_fingerprint(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def components(n, linked):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in linked:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    return [find(i) for i in range(n)]


def test_simhash_rows(spark, docs_of, table_dir, awkward):
    rnd = random.Random(3)
    base = [rnd.choice("abcdefghijklmnop") * rnd.randint(1, 5) for _ in range(80)]
    rows = [*awkward]
    for i in range(60):
        words = list(base)
        for _ in range(rnd.randint(0, 2)):
            words[rnd.randrange(80)] = "NEW" + str(rnd.random())
        rows.append((100 + i, " ".join(words)))
    got = simhash.op5_simhash(spark, table_dir(documents=docs_of(*rows))).collect()
    fp = [brute_fingerprint(t) for _, t in rows]
    roots = components(len(rows), [(a, b) for a in range(len(rows)) for b in range(a) if (fp[a] ^ fp[b]).bit_count() <= 4])
    least = {}
    for r, (i, _) in zip(roots, rows):
        if i is not None:
            least[r] = min(least.get(r, i), i)
    want = sorted((str(i), f"{f:016x}", str(least.get(r))) for (i, _), f, r in zip(rows, fp, roots))
    assert sorted((str(r["doc_id"]), r["fingerprint"], str(r["component_id"])) for r in got) == want


def test_pigeonring_finds_every_link(spark):
    rnd = random.Random(9)
    fps = {rnd.getrandbits(64) for _ in range(300)}
    for f in list(fps):
        for _ in range(rnd.randint(0, 3)):
            g = f
            for b in rnd.sample(range(64), rnd.randint(1, 5)):
                g ^= 1 << b
            fps.add(g)
    fps = sorted(fps)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    links = simhash.candidate_links(spark.createDataFrame([(s,) for s in signed], "_fp long")).collect()
    at = {s: i for i, s in enumerate(signed)}
    got = components(len(fps), [(at[r["u"]], at[r["v"]]) for r in links])
    assert all((fps[at[r["u"]]] ^ fps[at[r["v"]]]).bit_count() <= 4 for r in links)
    assert got == components(len(fps), [(a, b) for a in range(len(fps)) for b in range(a) if (fps[a] ^ fps[b]).bit_count() <= 4])


def test_simhash_stage_keeps_one_row_of_each_group(spark, docs_of):
    text = " ".join(f"w{i}" for i in range(50))
    df = docs_of((5, text), (3, text), (3, text), (9, "quite another text of its own"), (None, "no id at all here"), (None, "no id at all here"))
    out = simhash.stage(spark, df, "").collect()
    assert sorted(str(r["doc_id"]) for r in out) == ["3", "9", "None"] and out[0].asDict().keys() == df.first().asDict().keys()
    assert simhash.stage(spark, df.where("false"), "").count() == 0


def test_simhash_stage_groups_by_component(spark, docs_of):
    """A repeated id with another text stays; near copies without ids leave one."""
    base = [f"w{i}" for i in range(400)]
    near = " ".join([*base[:399], "other"])
    text, unlike = " ".join(base), " ".join(f"v{i}" for i in range(50))
    assert brute_fingerprint(text) != brute_fingerprint(near) and (brute_fingerprint(text) ^ brute_fingerprint(near)).bit_count() <= 4
    out = simhash.stage(spark, docs_of((1, text), (1, unlike), (2, near)), "").collect()
    assert sorted((r["doc_id"], r["text"]) for r in out) == sorted([(1, text), (1, unlike)])
    out = simhash.stage(spark, docs_of((None, text), (None, near), (None, unlike)), "").collect()
    assert len(out) == 2 and unlike in [r["text"] for r in out]


def brute_links(x, threshold=0.9):
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = x @ x.T >= threshold
    np.fill_diagonal(s, False)
    return s


def test_forest_recall_and_counts(spark, table_dir):
    """Brute force over 3,000 vectors: recall of links at the threshold is 0.9 at least, and none is false."""
    rng = np.random.default_rng(1)
    x = rng.standard_normal((3000, 64))
    for i in range(0, 900, 3):  # pairs from far above to just above and below the threshold
        x[i + 1] = x[i] + rng.standard_normal(64) * rng.uniform(0.0, 0.55)
    x[900:1300] = x[900] + rng.standard_normal((400, 64)) * 0.05
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    got = {r["vec_id"]: r for r in embeddings.near_duplicates(df, leaf=128).collect()}
    s = brute_links(x)
    found = np.array([got[i]["n_links"] for i in range(len(x))])
    assert (found <= s.sum(1)).all() and found.sum() >= 0.9 * s.sum()
    roots = components(len(x), np.argwhere(np.triu(s)).tolist())
    assert np.mean([got[i]["component_id"] == roots[i] for i in range(len(x))]) > 0.99


def test_hot_leaf_in_blocks(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal(32) + rng.standard_normal((150, 32)) * 0.02
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    nodes = embeddings._clean(df).withColumn("weight", F.lit(1).cast("long"))
    got = embeddings.links(nodes, embeddings.fit(nodes), most=40).groupBy("vec_id").sum("n").collect()
    assert sorted(r[1] for r in got) == [149] * 150


def test_dense_groups_are_balls_and_never_compared(spark):
    """A third of the rows in one dense group, a tenth in a looser one: exact counts, and no block of a ball meets its own."""
    rng = np.random.default_rng(8)
    x = rng.standard_normal((6000, 32))
    x[:2000] = x[0] + rng.standard_normal((2000, 32)) * 0.12
    x[2000:2600] = x[2000] + rng.standard_normal((600, 32)) * 0.3
    x[2600:2700] = x[0] + rng.standard_normal((100, 32)) * 0.45  # near the ball, partly linked with it
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    nodes = embeddings._clean(df).withColumn("weight", F.lit(1).cast("long"))
    (forest,) = embeddings.fit(nodes, leaf=256, most=200).values()
    ball = forest.balls(x / np.linalg.norm(x, axis=1, keepdims=True))
    assert (ball[:2000] == ball[0]).mean() > 0.9 and ball[0] >= 0
    s = brute_links(x)
    for b in range(len(forest.centres)):
        inside = np.flatnonzero(ball == b)
        assert s[np.ix_(inside, inside)].sum() == len(inside) * (len(inside) - 1)
    got = {r["vec_id"]: r for r in embeddings.near_duplicates(df, leaf=256, most=200).collect()}
    found = np.array([got[i]["n_links"] for i in range(len(x))])
    assert (found <= s.sum(1)).all() and found.sum() >= 0.99 * s.sum()
    roots = components(len(x), np.argwhere(np.triu(s)).tolist())
    assert np.mean([got[i]["component_id"] == roots[i] for i in range(len(x))]) > 0.99
    with_balls = embeddings.links(nodes, {32: forest}, most=200)
    total = with_balls.agg(F.sum("n")).first()[0]
    inside = embeddings.within(nodes, {32: forest}).agg(F.sum("n")).first()[0]
    assert total == found.sum() and inside > 0.8 * s[:2000, :2000].sum()  # from weights, not from comparisons


def test_odd_vectors(spark, table_dir):
    v = [1.0, 2.0, 3.0]
    rows = [(1, v), (2, [2.0, 4.0, 6.0]), (2, [2.0, 4.0, 6.0]), (3, None), (4, []), (5, [0.0, 0.0, 0.0]), (6, [1.0, None, 2.0]), (7, [float("nan"), 1.0, 1.0]), (8, [float("inf"), 1.0, 1.0]), (None, v), (9, [1.0, 2.0]), (10, [1e300, 2e300, 3e300])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "'x' AS leaf")
    got = {r["vec_id"]: tuple(r)[1:] for r in embeddings.op1_embedding_near_dedup(spark, table_dir(embeddings=df)).collect()}
    assert got[1] == (2, 1, True) and got[2] == (2, 1, False) and got[10] == (2, 1, False) and got[None] == (0, None, True)
    assert all(got[i] == (0, i, True) for i in (3, 4, 5, 6, 7, 8, 9)) and len(got) == 11
    assert embeddings.near_duplicates(df.where("false")).count() == 0


def test_forest_keeps_links_of_loose_groups_in_deep_trees():
    """Recall at depth 10, where a third of 2,000,000 rows is one loose group: over its pairs and over isolated pairs near the threshold."""
    rng = np.random.default_rng(5)
    for sigma in (0.2, 0.3, 0.34):
        x = rng.standard_normal((20_000, 64))
        x[:6600] = rng.standard_normal(64) + sigma * rng.standard_normal((6600, 64))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        forest = embeddings.Forest(x, 2_000_000)
        assert forest.depth == 10

        def held(v, forest=forest):
            row, leaf = forest.leaves(v)
            out = np.zeros((len(v), forest.trees << forest.depth), np.float32)
            out[row, leaf] = 1
            return out

        a = held(x[:1000])
        linked = brute_links(x[:1000])
        assert ((a @ a.T > 0) & linked).sum() >= 0.99 * linked.sum()
        y, z = x[7000:8000], rng.standard_normal((1000, 64))
        z -= (z * y).sum(1, keepdims=True) * y
        z = 0.91 * y + (1 - 0.91**2) ** 0.5 * z / np.linalg.norm(z, axis=1, keepdims=True)
        assert (held(y) * held(z)).any(1).mean() >= 0.99


@pytest.mark.parametrize("kind", ["float", "double"])
def test_copies_of_vectors_are_one_node(spark, kind):
    """A vector that a third of the rows repeats: counts and components as if every pair had been compared."""
    rng = np.random.default_rng(6)
    x = rng.standard_normal((900, 24)).astype(np.float32)
    x[:300] = x[0]
    x[300:310] = x[0] + rng.standard_normal((10, 24)).astype(np.float32) * np.float32(0.1)
    x[400:420] = x[400] * np.arange(1, 21, dtype=np.float32)[:, None]
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>").withColumn("embedding", F.col("embedding").cast(f"array<{kind}>"))
    got = {r["vec_id"]: r for r in embeddings.near_duplicates(df).collect()}
    s = brute_links(x.astype(float))
    roots = components(len(x), np.argwhere(np.triu(s)).tolist())
    assert [got[i]["n_links"] for i in range(900)] == s.sum(1).tolist()
    assert [got[i]["component_id"] for i in range(900)] == roots
    assert all(got[i]["kept"] == (roots[i] == i) for i in range(900))


@pytest.mark.parametrize("kind, room, want", [("float", 64 * 1000, 2000), ("double", 64 * 1000, 1000), ("float", 1 << 30, 3000), ("float", 1, 1)])
def test_sample_of_the_forest_is_bounded_in_bytes(spark, monkeypatch, kind, room, want):
    """The rows that the driver fits on follow from their components' width; more columns of floats mean fewer rows."""
    rows = spark.range(6000).select(F.col("id").alias("vec_id"), F.transform(F.sequence(F.lit(1), F.lit(8)), lambda k: F.rand(3) + k).cast(f"array<{kind}>").alias("v"))
    held = []
    monkeypatch.setattr(embeddings, "MOST_BYTES", room)
    monkeypatch.setattr(embeddings, "Forest", lambda x, n, **options: held.append((x.shape, n)))
    assert list(embeddings.fit(rows, sample=3000)) == [8]
    assert held == [((want, 8), 6000)]
    assert embeddings.fit(rows.where("false")) == {}
