"""The pipeline against a plain Python one, sequence counts against bounds, and queries over empty tables."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from test_judges import brute_quality
from test_near import brute_fingerprint, components
from tokenizers import Tokenizer

from emberlog.llm import bpe, chat, common, packing, quality, simhash

LIBRARY = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def without_earlier_bytes(texts, length=100):
    """Texts in order of id, less every byte that a string seen before covers."""
    seen, out = set(), []
    for t in texts:
        b = t.encode()
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - length + 1):
            if b[k : k + length] in seen:
                gone[k : k + length] = True
            seen.add(b[k : k + length])
        out.append(np.frombuffer(b, np.uint8)[~gone].tobytes().decode())
    return out


def least_sequences(lengths, room=2048):
    """A lower bound: pieces over half a sequence are apart, and small ones fill what those leave."""
    x = np.array(sorted(lengths))
    best = 0
    for k in {0, *x[x <= room // 2].tolist()}:
        big, middle, small = x[x > room - k], x[(x > room // 2) & (x <= room - k)], x[(x >= k) & (x <= room // 2)]
        spare = len(middle) * room - middle.sum()
        best = max(best, len(big) + len(middle) + max(0, -(-int(small.sum() - spare) // room)))
    return best


def first_fit(lengths, room=2048):
    """Sequences of first-fit by decreasing length."""
    left = []
    for n in sorted(lengths, reverse=True):
        for i, r in enumerate(left):
            if n <= r:
                left[i] -= n
                break
        else:
            left.append(room - n)
    return len(left)


def planted():
    """Documents with rejects of every stage, near copies, shared passages, a very long text."""
    rnd = random.Random(5)
    vocabulary = ["".join(rnd.choice("abcdefghijklmnoprstuw") for _ in range(rnd.randint(2, 9))) for _ in range(4000)]
    prose = lambda n: " ".join(rnd.choice(vocabulary) for _ in range(n))
    docs = {k: prose(rnd.randint(30, 400)) for k in range(0, 80, 2)}
    passage = prose(40)
    for k in (4, 30, 31, 62):
        docs[k] = f"{prose(60)} {passage} {prose(60)}"
    docs[101], docs[103], docs[105] = None, "", "too few words"
    docs[107] = " ".join(["one two three four five six"] * 20)  # repeats itself
    docs[109] = " ".join(str(10**6 + k) for k in range(40))  # no letter: no language
    docs[111], docs[1] = docs[10], docs[20]  # copies, behind and before the first
    docs[113] = docs[12].upper()
    docs[115] = prose(9000)
    docs[117] = f"{docs[115]} and more of it {passage}"
    return docs


def plain_pipeline(docs):
    def passes(t):
        n, _, _, _, repeated = brute_quality(t)
        return n >= 10 and 100 * repeated <= 20 * n

    kept = {i: t for i, t in docs.items() if passes(t) and re.search(r"[A-Za-z]", t)}
    ids = sorted(kept)
    prints = [brute_fingerprint(kept[i]) for i in ids]
    root = components(len(ids), [(a, b) for a in range(len(ids)) for b in range(a) if (prints[a] ^ prints[b]).bit_count() <= 4])
    ids = [i for k, i in enumerate(ids) if root.index(root[k]) == k]
    rows = Counter()
    for i, t in zip(ids, without_earlier_bytes([kept[i] for i in ids])):
        tokens = [*LIBRARY.encode(t, add_special_tokens=False).ids, 0]
        for p, k in enumerate(range(0, len(tokens), 2048)):
            rows[(i, p, k, len(tokens[k : k + 2048]), zlib.crc32(np.array(tokens[k : k + 2048], "<u4").tobytes()))] += 1
    return rows


def assert_tight(rows):
    held = {}
    for r in rows:
        held.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in held.values():
        ends = np.cumsum([n for _, n in sorted(parts)])
        assert [o for o, _ in sorted(parts)] == [0, *ends[:-1].tolist()] and ends[-1] <= 2048
    lengths = [r["length"] for r in rows]
    assert least_sequences(lengths) <= len(held) <= min(first_fit(lengths), 1 + 1.02 * least_sequences(lengths))


def test_pipeline_is_the_plain_one(spark, docs_of, table_dir):
    import corpus_pipeline

    docs = planted()
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    sf = table_dir(documents=docs_of(*docs.items()), labels=labels)
    got, want = corpus_pipeline.run(spark, sf).collect(), plain_pipeline(docs)
    assert Counter(tuple(r)[:5] for r in got) == want
    ids = {w[0] for w in want}
    assert not ids & {101, 103, 105, 107, 109, 111, 113, 20} and {1, 10, 12, 115} <= ids  # what was planted went
    assert_tight(got)


@pytest.mark.parametrize("seed", range(6))
def test_sequences_are_near_the_bound(seed):
    rnd = random.Random(seed)
    mean = (60, 300, 700, 1000, 1400, 1900)[seed]
    lengths = [min(2048, max(1, int(rnd.gauss(mean, mean / 3)))) for _ in range(2000)]
    bins = sum(b.count for b in packing.plan(dict(Counter(lengths))))
    assert least_sequences(lengths) <= bins <= 1 + 1.02 * least_sequences(lengths) or bins <= first_fit(lengths)


def test_whole_table_is_packed_near_the_bound(spark, sf):
    rows = packing.op9_packing(spark, sf).collect()
    lengths = [r["length"] for r in rows]
    assert least_sequences(lengths) <= len({r["sequence_id"] for r in rows}) <= 1 + 1.02 * least_sequences(lengths)


def test_kept_is_what_the_learned_list_says(spark, sf):
    """Each row's verdict, recomputed in Python from the rules as they were learned."""
    sf = sf.replace("sf0.001", "sf0.1")  # enough labels to learn from
    docs = common.table(spark, sf, "documents")
    rules = quality.fit(quality.labelled_texts(docs, common.table(spark, sf, "labels")))
    features = {r["doc_id"]: r for r in quality.with_statistics(docs.select("doc_id", "text")).select("doc_id", *[quality_feature(n).alias(n) for n in feature_names(rules)]).collect()}
    holds = lambda x, term: x[term[0]] > term[2] if term[1] == ">" else x[term[0]] <= term[2]
    got = quality.op6_quality_rules(spark, sf).collect()
    assert len(got) == docs.count() and rules
    for r in got:
        base = r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"]
        rejected = any(all(holds(features[r["doc_id"]], t) for t in rule.terms) for rule in rules)
        assert r["base_failed"] == base and r["kept"] == (not base and not rejected)


def feature_names(rules):
    return sorted({t[0] for rule in rules for t in rule.terms})


def quality_feature(name):
    return quality.features(F.col("stats"))[name]


def test_queries_over_empty_tables(spark, docs_of, table_dir):
    conversations = spark.createDataFrame([], "conv_id long, turn int, role string, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    sf = table_dir(documents=docs_of((1, "x")).where("false"), conversations=conversations, labels=labels)
    for query in (bpe.op3_bpe, simhash.op5_simhash, quality.op6_quality_rules, packing.op9_packing):
        assert query(spark, sf).collect() == [], query.__name__
    assert [r["conv_id"] for r in chat.op2_chat_format(spark, sf).collect()] == [-7]  # the conversation that the query adds
