"""Periodic runs, source divergence and token counts against plain Python."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from emberlog.llm import divergence, periodic, tokencount
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.conftest import DOC

sha = lambda s: hashlib.sha256(s.encode()).hexdigest()


def rows_of(df):
    return [r.asDict(recursive=True) for r in df.collect()]


def sort_key(row):
    return tuple((v is None, str(v)) for v in row.values())


# -- periodic runs --------------------------------------------------------------------------------------------------------
def brute_runs(w, least):
    n, out = len(w), {}
    for p in range(1, n // 2 + 1):
        i = 0
        while i < n - p:
            if w[i] != w[i + p]:
                i += 1
                continue
            s = i
            while i < n - p and w[i] == w[i + p]:
                i += 1
            if i + p - s >= max(2 * p, least):
                out.setdefault((s, i + p), p)
    return sorted((s, e - s, p) for (s, e), p in out.items())


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(0, 3), max_size=12), st.integers(1, 4)), max_size=8), st.sampled_from([2, 5, 12]))
def test_runs_are_all_maximal_repetitions(parts, least):
    seq = [x for part, times in parts for x in part * times]
    assert periodic.runs_of(seq, least) == brute_runs(seq, least)


def test_runs_of_strings_with_many_runs():
    a, b = [0], [0, 1]
    while len(b) < 600:
        a, b = b, b + a
    assert periodic.runs_of(b, 2) == brute_runs(b, 2)
    assert periodic.runs_of([7] * 500) == [(0, 500, 1)]
    assert periodic.runs_of([]) == []


def expected_runs(doc_id, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(w)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(w, 12)
    best = min(((-n, s, p) for s, n, p in runs), default=None)
    gone = {i for s, n, p in runs for i in range(s + p, s + n)}
    row = {"doc_id": doc_id, "n_runs": len(runs), "start": None, "length": None, "period": None, "exponent_milli": None}
    if best:
        row |= {"start": best[1], "length": -best[0], "period": best[2], "exponent_milli": 1000 * -best[0] // best[2]}
    return row | {"runs_sha256": sha("".join(f"{s},{n},{p}\n" for s, n, p in runs)), "collapsed_sha256": sha(" ".join(x for i, x in enumerate(w) if i not in gone))}


def test_periodic_runs_query_against_brute_force(spark, docs_of, table_dir, awkward):
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice("abcde") * rng.randint(1, 2) for _ in range(rng.randint(0, 80)))) for i in range(200)]
    rows += [(300 + i, "\t".join(["x y  z"] * i)) for i in range(12)]
    rows += [r if r[1] is None or len(r[1]) < 20_000 or " " not in r[1] else (r[0], r[1][:3000]) for r in awkward]
    got = rows_of(periodic.op11_periodic_runs(spark, table_dir(documents=docs_of(*rows))))
    assert any(zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows)
    assert sorted(got, key=sort_key) == sorted((expected_runs(*r) for r in rows), key=sort_key)


def test_periodic_runs_keep_long_texts_and_empty_tables(spark, docs_of):
    unit = " ".join(f"w{i}" for i in range(40_000))
    got = rows_of(periodic.periodic_runs(docs_of((1, f"{unit} {unit} {unit}"), (2, "no repeats here")).withColumn("runs", periodic.F.lit(1))))
    assert {r["doc_id"]: r["runs"] for r in got} == {1: [{"start": 0, "length": 120_000, "period": 40_000}], 2: []}
    assert {r["doc_id"]: r["collapsed"] for r in got} == {1: unit, 2: "no repeats here"}
    assert rows_of(periodic.periodic_runs(docs_of())) == []


# -- source divergence ----------------------------------------------------------------------------------------------------
def brute_audit(rows, least=10, top=10):
    words, docs_with, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for _, text, lang, source, _ in rows:
        lang, source = lang or "", source or ""
        found = [x.decode() for x in re.findall(rb"[a-z\x80-\xff]+", (text or "").encode().lower())]
        words[lang, source].update(found)
        docs_with[lang].update(set(found))
        groups[lang].add(source)
    out = []
    for lang, sources in groups.items():
        kept = sorted(t for t, d in docs_with[lang].items() if d >= least)
        v = len(kept)

        def share(c):
            n = sum(c[t] for t in kept)
            return {t: 1 + 1_000_000_000 * (c[t] + 2) // (n + 2 * v) for t in kept}

        p = {s: share(words[lang, s]) for s in sources}
        q = share(sum((words[lang, s] for s in sources), Counter()))
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pairs = sorted(((-sum(f(p[s][t], p[o][t]) for t in kept), o) for o in sources - {s}), key=lambda x: (x[0], x[1].encode()))
            terms = sorted(((-f(p[s][t], q[t]), t) for t in kept if words[lang, s][t] and p[s][t] > q[t]), key=lambda x: (x[0], x[1].encode()))[:top]
            for part, ranked in (("pair", pairs), ("term", terms)):
                out += [{"lang": lang, "source": s, "part": part, "item": o, "value": -x, "rank": k + 1} for k, (x, o) in enumerate(ranked)]
    return sorted(out, key=sort_key)


def audit_rows(sources):
    rng = random.Random(8)
    rows = []
    for i in range(260):
        vocabulary = ["alpha", "Beta", "naïve", "été", "gamma", "ALPHA", "delta"] + [f"w{'abcdef'[i % 6]}"]
        text = " ".join(rng.choice(vocabulary[: rng.randint(1, 8)]) for _ in range(rng.randint(0, 30)))
        rows.append((i, rng.choice([text, text, text + " 12 x_y"]), rng.choice(["en", "fr", None]), f"s{rng.randrange(sources)}", 0))
    return rows + [(900, None, "en", None, 0), (901, "", "zz", "only", 0), (902, "rare words", "zz", "other", 0), (903, "alpha", "en", "lonely", 0), (903, "alpha", "en", "lonely", 0)]


@pytest.mark.parametrize(("sources", "seats"), [(5, 32), (7, 32), (9, 4), (1, 32)])
def test_audit_against_brute_force(spark, sources, seats):
    rows = audit_rows(sources)
    docs = spark.createDataFrame(rows, DOC).withColumn("term", divergence.F.lit("clash")).withColumn("value", divergence.F.lit(1))
    assert sorted(rows_of(divergence.audit(docs, seats=seats)), key=sort_key) == brute_audit(rows)


def test_audit_in_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(divergence, "TEAM_ENTRIES", 2)
    rows = audit_rows(6)
    assert sorted(rows_of(divergence.audit(spark.createDataFrame(rows, DOC))), key=sort_key) == brute_audit(rows)


def test_audit_of_an_empty_table(spark):
    assert rows_of(divergence.audit(spark.createDataFrame([], DOC))) == []


@pytest.mark.parametrize("seats", [2, 4, 6, 8, 20, 32])
def test_every_two_teams_meet_once(spark, seats):
    F = divergence.F
    met = spark.range(seats).select(F.col("id").cast("int").alias("team"), F.explode(F.sequence(F.lit(0), F.lit(seats - 2))).alias("round"))
    met = met.withColumn("other", divergence.opponent(F.col("team"), F.col("round"), seats)).collect()
    assert all(r["team"] != r["other"] for r in met)
    assert {(r["round"], r["other"], r["team"]) for r in met} == {(r["round"], r["team"], r["other"]) for r in met}
    assert {(r["team"], r["other"]) for r in met} == {(a, b) for a in range(seats) for b in range(seats) if a != b} and len(met) == seats * (seats - 1)


def test_shares_are_exact_for_large_counts():
    for c, n, v in ((10**12, 10**13, 5), (0, 0, 1), (10**15, 10**15, 10**6), (3, 7, 2)):
        assert int(divergence.shares(divergence.np.array([c]), n, v)[0]) == 1 + 10**9 * (c + 2) // (n + 2 * v)


# -- token counts ---------------------------------------------------------------------------------------------------------
@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def shortcut():
    text = tokencount.read_file()
    return tokencount.Shortcut(tokencount.ByteLevel(text), tokencount._proven(text), 64)


def test_whole_tokens_are_those_of_the_library(library, shortcut):
    strings = {t: shortcut.v.of_token(t) for t in shortcut.v.strings}
    whole = set(tokencount._proven(shortcut.v.text).tolist())
    spelled = [shortcut.v.strings[t] for t in strings]
    alone = {t for t, s in zip(strings, spelled, strict=True) if [x.id for x in library.model.tokenize(s)] == [t]}
    valid = {t for t in strings if strings[t].decode(errors="replace").encode() == strings[t]}
    assert whole == alone & valid and 0 < len(whole) < len(strings)


ODD = ["a", "The", "é", " ", "  ", "\n", "\t", "\x1c", "\x85", "\xa0", "'s", "'re", "'", "1", "²", "x" * 70, "<|endoftext|>", "<|", "中", "文", "—", "🙂", "́", "١", "!", "...", "\x00", "ǅ", "᠎", "​"]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(ODD), max_size=50).map("".join))
def test_counts_are_the_librarys(library, shortcut, text):
    want = len(library.encode(text, add_special_tokens=False).ids)
    assert shortcut.count(text) == want
    assert sum(shortcut[p] for part in tokencount.stretches(text, 8) for p in shortcut.pretokens(part)) == want or "<|endoftext|>" in text


def test_token_counts_query(spark, docs_of, table_dir, awkward, library):
    rows = [*awkward, (90, "a " * 1023 + "b"), (91, "a " * 1024 + "b"), (92, "<|endoftext|> x<|endoftext|>"), (93, "ab" * 60_000)]
    got = rows_of(tokencount.op13_token_counts(spark, table_dir(documents=docs_of(*rows))))
    want = []
    for i, t in rows:
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        want.append({"doc_id": i, "n_bytes": len((t or "").encode()), "n_tokens": n, "over_limit": n > 1024})
    assert sorted(got, key=sort_key) == sorted(want, key=sort_key)
    assert rows_of(tokencount.token_counts(docs_of().withColumn("n_tokens", divergence.F.lit(1)))) == []
