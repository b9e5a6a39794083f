"""Quality rules, URL filters, language ID and the pipeline."""

import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from emberlog.llm import common, langid, quality, urls


def brute_quality(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    cover = [False] * len(words)
    for i in range(len(words) - 4):
        if windows[tuple(words[i : i + 5])] > 1:
            cover[i : i + 5] = [True] * 5
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), sum(cover))


def test_statistics(spark, docs_of, awkward):
    rows = [*awkward, (50, "a\nb\na\n\nb c\n \na"), (51, "\r\nx|y #1\n" * 3), (52, "no newline at the end\nno newline at the end")]
    got = quality.with_statistics(docs_of(*rows).withColumn("n_words", F.lit("clash"))).collect()
    assert [tuple(r["stats"])[:5] for r in got] == [brute_quality(t) for _, t in rows]


def test_learned_list_separates_held_out_rows(spark, sf):
    sf = sf.replace("sf0.001", "sf0.1")  # some 4,000 labels
    docs, labels = common.table(spark, sf, "documents"), common.table(spark, sf, "labels")
    rules = quality.fit(quality.labelled_texts(docs, labels).where(F.xxhash64("text") % 2 == 0))
    assert rules
    held = docs.join(labels, "doc_id").where(F.xxhash64("text") % 2 != 0)
    got = quality.judge(held, rules).select("quality", "stats.kept", "stats.base_failed").collect()
    good = [r["kept"] for r in got if r["quality"] == 1 and not r["base_failed"]]
    bad = [r["kept"] for r in got if r["quality"] == 0]
    assert sum(good) >= 0.99 * len(good) and sum(bad) <= 0.2 * len(bad)


def test_without_labels_base_rules_decide(spark, docs_of, table_dir):
    df = docs_of((1, " ".join(f"w{i}" for i in range(30))), (2, "too short"), (3, None), (4, "a b c d e " * 20))
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    out = {r["doc_id"]: r for r in quality.op6_quality_rules(spark, table_dir(documents=df, labels=labels)).collect()}
    assert [out[i]["kept"] for i in (1, 2, 3, 4)] == [True, False, False, False] and all(out[i]["base_failed"] for i in (2, 3, 4))


URLS = {
    "http://A.Example.ORG/es/1": ("a.example.org", "/es/1", "example.org/es/", "block"),
    "https://example.org/en/1?x": ("example.org", "/en/1", "example.org/en/1", "block"),
    "https://example.org/en/2": ("example.org", "/en/2", "org/", "allow"),
    "http://notexample.org": ("notexample.org", "", None, None),
    "http://x.com/fr/": ("x.com", "/fr/", "com/fr/", "allow"),
    "http://com/de/": ("com", "/de/", "com/de/", "block"),
    "http://xcom/de/": ("xcom", "/de/", None, None),
    "x.com/fr/": ("", "", None, None),
    "http://h?q=http://x.com/fr/#f": ("h", "", None, None),
    "": ("", "", None, None),
    None: ("", "", None, None),
}


def test_rules(spark):
    df = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(URLS)], "page_id long, url string, host string")
    got = urls.with_verdict(df, urls.fit(urls.rule_labelled(df))).orderBy("page_id").collect()
    for r, (host, path, rule, verdict) in zip(got, URLS.values()):
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert r["verdict"] == verdict if verdict else r["verdict"] in ("allow", "block")


def test_trees_generalise_to_held_out_urls(spark):
    good = spark.range(600).select(F.concat(F.lit("https://site"), (F.col("id") % 50).cast("string"), F.lit(".example.com/en/page"), F.lit(".html")).alias("url"), F.lit(False).alias("blocked"), "id")
    bad = spark.range(600).select(F.concat(F.lit("http://x"), F.sha2(F.col("id").cast("string"), 256), F.lit(".example.net/a/b/c/d?u="), F.col("id").cast("string"), F.lit("&v=1&w=2")).alias("url"), F.lit(True).alias("blocked"), "id")
    rows = good.unionAll(bad)
    model = urls.fit(rows.where("id % 2 = 0"))
    got = urls.with_verdict(rows.where("id % 2 = 1"), model, rules=()).collect()
    assert sum((r["verdict"] == "block") == r["blocked"] for r in got) >= 0.98 * len(got)


def test_a_rare_label_is_learned(spark):
    """Two in a thousand URLs are blocked: a plain sample of 1,000 would hold two of them, a hundred are taken."""
    good = spark.range(60_000).select(F.concat(F.lit("https://site"), (F.col("id") % 50).cast("string"), F.lit(".example.com/en/page"), F.col("id").cast("string"), F.lit(".html")).alias("url"), F.lit(False).alias("blocked"), "id")
    bad = spark.range(120).select(F.concat(F.lit("http://x"), F.sha2(F.col("id").cast("string"), 256), F.lit(".example.net/a/b/c/d?u="), F.col("id").cast("string"), F.lit("&v=1&w=2")).alias("url"), F.lit(True).alias("blocked"), "id")
    rows = good.unionAll(bad)
    got = urls.with_verdict(rows.where("id % 2 = 1"), urls.fit(rows.where("id % 2 = 0"), sample=1000), rules=())
    wrong = got.where((F.col("verdict") == "block") != F.col("blocked")).count()
    assert wrong == 0 and got.where("blocked").count() == 60


def test_verdicts_against_plain_trees(spark, sf):
    """The nested conditional expression gives what walking the trees in Python gives, on every page."""
    pages = common.table(spark, sf, "pages").select("page_id", "url")
    model = urls.fit(urls.rule_labelled(pages))
    assert model.trees
    feats = urls.lexical(F.col("url"))
    rows = {r["page_id"]: r for r in pages.select("page_id", urls.suffix(urls.host_and_path(F.col("url"))[0]).alias("s"), *[c.alias(n) for n, c in feats.items()]).collect()}
    for r in urls.op4_url_filter(spark, sf).collect():
        row = rows[r["page_id"]]
        x = [row[n] for n in feats] + [model.suffixes.get(row["s"], model.suffixes[""])]
        score = model.base + sum(model.rate * urls._score(t, x) for t in model.trees)
        assert abs(score - r["score"]) < 1e-9
        if r["rule"] is None:
            assert r["verdict"] == ("block" if score > 0 else "allow")


def test_url_filter_on_odd_tables(spark, table_dir):
    pages = spark.createDataFrame([(1, "http://x.com/" + "a/1" * 50_000, "clash"), (2, None, "clash"), (2, None, "clash")], "page_id long, url string, _f0 string")
    got = urls.with_verdict(pages, urls.Model([], -1.0, {}, 0.3)).collect()
    assert [r["verdict"] for r in got] == ["allow"] * 3 and all(r["_f0"] == "clash" for r in got)
    assert urls.op4_url_filter(spark, table_dir(pages=pages.where("false"))).count() == 0


def test_native_plan(spark, sf):
    plan = urls.op4_url_filter(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_languages_of_held_out_texts(spark, sf):
    docs = common.table(spark, sf, "documents")
    model = langid.fit(docs.where("doc_id % 2 = 0").select("text", F.col("lang").alias("language")))
    rows = langid.with_address(docs.where("doc_id % 2 = 1"), F.col("source"), F.lit(None).cast("string"))
    got = langid.fused(langid.with_scores(rows, model), model).select("lang", "_lang", "_kept", "n_chars").collect()
    assert sum(r["lang"] == r["_lang"] for r in got) >= 0.97 * len(got) and sum(r["_kept"] for r in got) >= 0.99 * len(got)


def test_host_prior_and_declaration_decide_weak_texts(spark):
    texts = [("the cat and the dog went to the house of the king", "en", "h.example.com")] * 30 + [("der Hund und die Katze gingen in das Haus des Königs", "de", "k.example.de")] * 30
    df = spark.createDataFrame([*texts, ("zz", "de", "k.example.de"), ("zz", "en", "h.example.com"), ("123", None, None), (None, None, None)], "text string, lang string, source string")
    model = langid.fit(df.limit(60).select("text", F.col("lang").alias("language")))
    rows = langid.with_address(df, F.col("source"), F.col("lang"))
    got = langid.fused(langid.with_scores(rows, model), model).where("length(text) < 4 OR text IS NULL").select("lang", "_lang", "_kept").collect()
    assert {(r["lang"], r["_lang"]) for r in got if r["lang"]} == {("de", "de"), ("en", "en")}  # no text to go by: host and declaration
    assert not any(r["_kept"] for r in got)


def test_fusion_against_plain_recomputation(spark):
    """Posterior of every row from counts and sums written out in Python."""
    import math
    import random

    rnd = random.Random(2)
    words = {"en": "the and of house dog river".split(), "de": "der und von haus hund fluss".split(), "fr": "le et de maison chien riviere".split()}
    data = []
    for k in range(240):
        lang = rnd.choice(sorted(words))
        host = rnd.choice([f"{lang}.news.{'de' if lang == 'de' else 'com'}", "mixed.example.com", "plain", ""])
        n = rnd.choice([1, 2, 12, 30])
        data.append((k, " ".join(rnd.choice(words[lang]) for _ in range(n)) if k % 40 else ["", None, "1 2 3"][k // 40 % 3], lang, host or None, rnd.choice([lang, "en", "xx", None])))
    df = spark.createDataFrame(data, "id long, text string, lang string, source string, told string")
    model = langid.fit(df.where("id % 2 = 0").select("text", F.col("lang").alias("language")))
    scored = langid.with_scores(langid.with_address(df, F.col("source"), F.col("told")), model)
    got = {r["id"]: r for r in langid.fused(scored, model).collect()}
    L = model.languages
    ll = {r["id"]: (r["_scores"]["n"], list(r["_scores"]["ll"])) for r in scored.collect()}

    def address(host):
        host = host or ""
        return (host, ".".join(host.split(".")[-2:]) if "." in host else host, host.split(".")[-1] if "." in host else "")

    decided = {i: L[max(range(len(L)), key=lambda j, v=v: (v[j], -j))] for i, (n, v) in ll.items() if n >= 10}
    count = lambda pick: [sum(1 for r in data if decided.get(r[0]) == x and pick(r)) for x in L]
    every = count(lambda r: True)
    top = [(c + 1) / (sum(every) + len(L)) for c in every]
    smooth = lambda c, above: [(c[j] + langid.STRENGTH * above[j]) / (sum(c) + langid.STRENGTH) for j in range(len(L))]
    kinds = [*L, "other", "none"]
    told = lambda r: "none" if r[4] is None else r[4] if r[4] in L else "other"
    trust = [[1 + sum(1 for r in data if decided.get(r[0]) == x and told(r) == k) for k in kinds] for x in L]
    for r in data:
        host, domain, suffix = address(r[3])
        above = [(0.5 if langid.COUNTRY[suffix] == L[j] else 0.5 * top[j]) + 0.25 * top[j] for j in range(len(L))] if suffix in langid.COUNTRY else top
        ps = smooth(count(lambda q: address(q[3])[2] == suffix), above)
        pd = smooth(count(lambda q: address(q[3])[1:] == (domain, suffix)), ps)
        ph = smooth(count(lambda q: address(q[3]) == (host, domain, suffix)), pd)
        n, v = ll[r[0]]
        s = [v[j] + math.log(trust[j][kinds.index(told(r))] / sum(trust[j])) + math.log(ph[j]) for j in range(len(L))]
        e = [math.exp(x - max(s)) for x in s]
        best = s.index(max(s))
        assert got[r[0]]["_lang"] == L[best] and abs(got[r[0]]["_confidence"] - 1 / sum(e)) < 1e-9
        assert got[r[0]]["_kept"] == (n > 0 and 1 / sum(e) >= 0.5)


def test_language_query_on_odd_tables(spark, docs_of, table_dir, awkward):
    pages = spark.createDataFrame([(0, None, None), (1, "http://a.de/x", "<html lang=de><p>das Haus</p></html>")], "page_id long, url string, html string")
    got = langid.op10_language_id(spark, table_dir(documents=docs_of(*awkward, (50, "the same text with letters")), pages=pages)).collect()
    assert len(got) == len(awkward) + 3 and not any(r["kept"] for r in got if r["doc_id"] in (2, 3, -1))
    empty = langid.op10_language_id(spark, table_dir(documents=docs_of((1, "x")).where("false"), pages=pages.where("false")))
    assert empty.count() == 0


def test_language_stage_handles_empty_tables(spark, docs_of):
    empty = docs_of((1, "x")).where("false")
    assert langid.stage(spark, empty, "").count() == 0


def test_pages_and_documents(spark, sf):
    got = langid.op10_language_id(spark, sf)
    n = common.table(spark, sf, "documents").count() + common.table(spark, sf, "pages").count()
    assert got.count() == n and got.where("kept").count() >= 0.98 * n




@pytest.mark.parametrize("html, want", [('<html lang="fr">', "fr"), ("<HTML xml:lang=de-AT>", "de"), ("<html>", None), ("", None), (None, None)])
def test_declared(spark, html, want):
    assert spark.createDataFrame([(html,)], "h string").select(langid.declared_in(F.col("h"))).first()[0] == want


def test_pipeline_end_to_end(spark, sf):
    """Every stage on its predecessor's rows; clean rows stay, copies go, all tokens are packed."""
    import corpus_pipeline

    docs = common.table(spark, sf, "documents")
    columns, kept = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = common.cut(stage(spark, docs, sf))
        assert docs.columns == columns, name
        assert 0 < docs.count() <= kept, name
        kept = docs.count()
    last = corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()
    assert {r["doc_id"] for r in last} == {r["doc_id"] for r in docs.select("doc_id").collect()}
    assert len(corpus_pipeline.run(spark, sf).collect()) == len(last)


def test_bounded_sample_is_the_rows_of_smallest_hash(spark):
    rows = spark.range(3000).select(F.col("id").cast("string").alias("k"))
    want = [r["k"] for r in rows.orderBy(F.xxhash64("k"), "k").limit(10).collect()]
    assert [r["k"] for r in common.smallest(rows, 10, "k").collect()] == want
    assert common.smallest(rows.limit(5), 10, "k").count() == 5


def test_bounded_sample_of_copies(spark):
    """Copies neither empty the sample nor fill it: every distinct key counts once."""
    for k in range(6):
        few = spark.range(20_000).select(F.concat(F.lit(f"text {k} "), (F.col("id") % 2).cast("string")).alias("k"))
        assert sorted(r["k"] for r in common.smallest(few, 50, "k").collect()) == [f"text {k} 0", f"text {k} 1"]
    mixed = spark.range(20_000).select(F.when(F.col("id") < 19_000, F.col("id") % 3).otherwise(F.col("id")).cast("string").alias("k"))
    want = [r["k"] for r in mixed.distinct().orderBy(F.xxhash64("k"), "k").limit(50).collect()]
    assert [r["k"] for r in common.smallest(mixed, 50, "k").collect()] == want
