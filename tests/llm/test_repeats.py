"""Suffix-array dedup and substring dedup against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from emberlog.llm import bwt, common, quality, repeats, substring, suffixdedup

LAST = 1 << 63


def order(rows):
    """Documents in the order of places: id, then (for equal ids) any fixed order of texts."""
    return sorted({(LAST if i is None else i, t or "") for i, t in rows})


def brute_bytes(rows, length=100):
    halves = lambda t: [int.from_bytes(hashlib.sha256(t.encode()).digest()[a : a + 8], "big", signed=True) for a in (0, 8)]
    seen, out = set(), {}
    for i, t in sorted({(LAST if i is None else i, t or "") for i, t in rows}, key=lambda r: (r[0], halves(r[1]))):
        b = t.encode()
        gone = np.zeros(len(b) + 1, int)
        for k in range(len(b) - length + 1):
            w = b[k : k + length]
            if w in seen:
                gone[k : k + length] = 1
            seen.add(w)
        g = gone[: len(b)] == 1
        runs = int((g & ~np.concatenate(([False], g[:-1]))).sum())
        out[(i, t)] = (len(b), int(g.sum()), runs, hashlib.sha256(np.frombuffer(b, np.uint8)[~g].tobytes()).hexdigest())
    return out


def brute_words(rows, window=13):
    docs = [(LAST if i is None else i, re.findall(r"[^\x20\x09-\x0D]+", t or ""), t or "") for i, t in rows]
    first = {}
    for i, w, _ in docs:
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            first[key] = min(first.get(key, i), i)
    out = {}
    for i, w, t in docs:
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < i:
                gone[k : k + window] = [True] * window
        kept = [x for x, g in zip(w, gone) if not g]
        out[(i, t)] = (len(w), sum(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest())
    return out


def passages(seed):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdefg") for _ in range(rnd.randint(1, 9)))
    shared = [" ".join(word() for _ in range(n)) for n in (14, 30, 60)]
    rows = []
    for i in range(40):
        parts = [" ".join(word() for _ in range(rnd.randint(0, 40)))]
        for _ in range(rnd.randint(0, 3)):
            parts += [rnd.choice(shared), " ".join(word() for _ in range(rnd.randint(0, 12)))]
        rows.append((rnd.randint(0, 25), " ".join(parts)))
    return rows + [(90, "xy" * 300), (91, "ab" + "xy" * 200), (92, "z" * 99), (93, "z" * 100), (94, "z" * 100)]


@pytest.mark.parametrize("case", ["awkward", 1, 2])
def test_bytes(docs_of, awkward, case):
    rows = awkward if case == "awkward" else passages(case)
    want = brute_bytes([r for r in rows if len(r[1] or "") < 50_000])
    out = suffixdedup.without_repeats(docs_of(*rows)).select("doc_id", "text", "_bytes", "_removed", "_runs", F.sha2("_kept", 256)).collect()
    assert len(out) == len(rows)
    # a row whose text stands with a smaller id goes as a whole
    least = {}
    for i, t in rows:
        least[t or ""] = min(least.get(t or "", LAST), LAST if i is None else i)
    for i, t, n, removed, runs, digest in out:
        key = (LAST if i is None else i, t or "")
        if key in want:
            assert (n, removed, runs, digest) == want[key]
        elif key[0] == least[key[1]]:
            assert n == len((t or "").encode()) and removed >= n - 100 - 1  # one letter repeated


@pytest.mark.parametrize("case", ["awkward", 3, 4])
def test_words(spark, docs_of, table_dir, awkward, case):
    rows = awkward if case == "awkward" else passages(case)
    got = substring.op8_substring_dedup(spark, table_dir(documents=docs_of(*rows)))
    want = sorted(v for (i, t), v in brute_words(rows).items() for _ in range(sum((LAST if a is None else a, b or "") == (i, t) for a, b in rows)))
    assert sorted((r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got.collect()) == want


def test_empty_table(docs_of):
    empty = docs_of((1, "x")).where("false")
    assert suffixdedup.without_repeats(empty).count() == 0
    assert substring.with_repeats(empty).count() == 0


def test_pipeline_stage_keeps_columns(spark, docs_of):
    p = "shared passage of letters and words that is long enough to count as a repeat of one hundred bytes or more, yes"
    df = docs_of((1, f"{p} one"), (2, f"two é {p}"), (3, None)).withColumn("_id", F.lit("clash"))
    out = {r["doc_id"]: r for r in suffixdedup.stage(spark, df, "").collect()}
    assert out[1]["text"] == f"{p} one" and out[2]["text"] == "two é " and out[3]["text"] is None
    assert out[2]["n_chars"] == 6 and out[2]["_id"] == "clash"


@pytest.mark.parametrize("seed", range(4))
def test_interval_expansion_finds_all_equal_windows(seed):
    rnd = random.Random(seed)
    contents = [bytes(rnd.choice(b"ab") for _ in range(rnd.randint(0, 60))) for _ in range(30)]
    for length in (1, 5, 12):
        klass, who, at = bwt.equal_windows(contents, length)
        got = {}
        for c, w, a in zip(klass, who, at):
            got.setdefault(int(c), set()).add((int(w), int(a)))
        want = {}
        for w, b in enumerate(contents):
            for a in range(len(b) - length + 1):
                want.setdefault(b[a : a + length], set()).add((w, a))
        assert sorted(map(sorted, got.values())) == sorted(sorted(v) for v in want.values() if len(v) > 1)


def test_components(spark):
    rnd = random.Random(5)
    edges = [(rnd.randint(0, 300), rnd.randint(0, 300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1040)] + [(5, 5), (None, 7)]
    got = {r["node"]: r["component"] for r in common.connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    root = {}
    find = lambda x: x if root.setdefault(x, x) == x else find(root[x])
    for u, v in edges:
        if u is not None and u != v:
            a, b = sorted((find(u), find(v)))
            root[b] = a
    assert got == {n: find(n) for n in root}


def test_suffix_stage_leaves_replacement_characters(spark, docs_of):
    """Only characters that a removed span cuts apart go; U+FFFD of the source stays."""
    passage = " ".join(f"word{i}" for i in range(40))
    out = suffixdedup.stage(spark, docs_of((1, "first " + passage), (2, "a \ufffd b \u00e9 " + passage + " c \ufffd d")), "").collect()
    text = {r["doc_id"]: (r["text"], r["n_chars"]) for r in out}[2]
    assert text == ("a \ufffd b \u00e9 c \ufffd d", len("a \ufffd b \u00e9 c \ufffd d"))
    data = np.frombuffer("\u00e9x\u20acy\ufffd".encode() + b"\x80z", np.uint8)
    for cut, want in (([1], "x\u20acy\ufffd"), ([4], "\u00e9xy\ufffd"), ([2, 3], "\u00e9y\ufffd"), ([6], "\u00e9x\u20ac\ufffd")):
        gone = np.isin(np.arange(len(data)), cut)
        assert data[~suffixdedup.widened(data, gone)].tobytes() == want.encode() + b"\x80z"


def test_components_say_when_rounds_run_out(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)], "u long, v long")
    with pytest.raises(RuntimeError):
        common.connected_components(edges, most_rounds=1)
    assert {r["component"] for r in common.connected_components(edges).collect()} == {0}


def thue_morse(swap=False):
    """1,024 letters; this text and its swapped one collide under every odd base modulo 2**64."""
    return "".join("aq"[(bin(i).count("1") + swap) % 2] for i in range(1024))


def test_colliding_words_and_lines_are_different(spark, docs_of, table_dir):
    a, b = thue_morse(), thue_morse(True)
    tail = " ".join(f"w{i}" for i in range(12))
    rows = [(1, f"{a} {tail}"), (2, f"{b} {tail}"), (3, f"{a}\n{b}\n"), (4, f"{a} x y z t {b} x y z t"), (5, f"{a} {tail}")]
    docs = docs_of(*rows)
    stats = {r["doc_id"]: r["stats"] for r in quality.with_statistics(docs).collect()}
    assert stats[3]["n_dup_lines"] == 0 and stats[4]["n_repeat_words"] == 0
    out = {r["doc_id"]: r["n_removed"] for r in substring.op8_substring_dedup(spark, table_dir(documents=docs)).collect()}
    assert out == {1: 0, 2: 0, 3: 0, 4: 0, 5: 13}
    got = {r["doc_id"]: (r["_removed"], r["_runs"]) for r in suffixdedup.without_repeats(docs).collect()}
    assert got == {i: want[1:3] for (i, _), want in brute_bytes(rows).items()}


@pytest.mark.parametrize("listed", [True, False])
def test_hot_anchor_with_many_surroundings(spark, docs_of, table_dir, monkeypatch, listed):
    """One line in 2,300 texts whose surroundings differ or repeat now and then: more contents than a block takes."""
    rnd = random.Random(9)
    line = " ".join(f"common{i}" for i in range(9)) + " aaa"
    side = lambda: " ".join(rnd.choice(("red", "green", "blue", "grey")) + str(rnd.randint(0, 9)) for _ in range(10))
    sides = [side() for _ in range(200)]
    pick = lambda: rnd.choice(sides) if rnd.random() < 0.3 else side()
    rows = [(i, f"{pick()} {line} {pick()}") for i in range(2300)]  # above 2 x MOST_CONTENTS: listed, too
    if not listed:
        monkeypatch.setattr(repeats, "hot_anchors", lambda *_: {})
    docs = docs_of(*rows)
    want = brute_bytes(rows)
    out = suffixdedup.without_repeats(docs).select("doc_id", "text", "_bytes", "_removed", "_runs", F.sha2("_kept", 256)).collect()
    assert [tuple(r)[2:] for r in out if tuple(r)[2:] != want[(r[0], r[1])]] == [] and len(out) == len(rows)
    got = substring.op8_substring_dedup(spark, table_dir(documents=docs)).collect()
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got} == {i: v for (i, _), v in brute_words(rows).items()}


def test_hot_anchors_are_found(docs_of, monkeypatch):
    monkeypatch.setattr(repeats, "MOST_CONTENTS", 20)
    rnd = random.Random(3)
    line = "one line that many of the texts of this table hold, whatever stands around it, again and again"
    rows = [(i, "".join(rnd.choice("abcdefgh ") for _ in range(120)) + line * (i % 2) + "".join(rnd.choice("abcdefgh ") for _ in range(90))) for i in range(120)]
    assert repeats.hot_anchors(repeats.keyed(docs_of(*rows)), repeats.Units(100, 24, by_words=False))
    assert not repeats.hot_anchors(repeats.keyed(docs_of(*rows[::2])), repeats.Units(100, 24, by_words=False))


def test_very_long_texts(spark, docs_of, table_dir):
    """Texts above the piece sizes (1 MiB of bytes, 16 MiB of words): a repeat across the border is found, others are not."""
    rnd = np.random.default_rng(4)
    letters = np.frombuffer(b"abcdefghijklmnop", np.uint8)
    body = letters[rnd.integers(0, 16, 5_000_000)].tobytes().decode()
    passage = body[(1 << 20) - 150 : (1 << 20) + 150]
    rows = [(1, body), (2, "Z" + passage + "Y"), (3, "unrelated " * 3)]
    out = {r["doc_id"]: (r["_bytes"], r["_removed"], r["_runs"]) for r in suffixdedup.without_repeats(docs_of(*rows)).collect()}
    assert out == {1: (5_000_000, 0, 0), 2: (302, 300, 1), 3: (30, 0, 0)}
    words = [f"{n:06x}" for n in rnd.integers(0, 1 << 24, 2_500_000)]
    border = words[(1 << 20) - 20 : (1 << 20) + 20]
    docs = docs_of((1, " ".join(words)), (2, " ".join(border)), (3, " ".join(words[-13:])))
    got = {r["doc_id"]: (r["n_words"], r["n_removed"]) for r in substring.op8_substring_dedup(spark, table_dir(documents=docs)).collect()}
    assert got == {1: (2_500_000, 0), 2: (40, 40), 3: (13, 13)}
