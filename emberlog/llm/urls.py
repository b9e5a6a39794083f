"""URL filters (4), native: path rules, then gradient-boosted trees over lexical features.

Everything that touches rows is a DataFrame expression: host, path and rule by string functions,
features by string and array functions, the trees as nested conditional expressions. The trees are
fitted on the driver from at most ``sample`` labelled URLs whose features are computed by the same expressions.

Defined results: a null url, or one without ``://``, has an empty host and path and is judged by the
model; without labelled URLs (or with one label only) the model allows everything; rows are judged one
by one, so ties, repeated rows and null ids change nothing.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))
SAMPLE, TREES, DEPTH, RATE, BINS, FOLDS = 5000, 24, 3, 0.3, 24, 5


def host_and_path(url: Column) -> tuple[Column, Column]:
    url = F.coalesce(url, F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.translate(host, UPPER, LOWER), path


def rule_and_action(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and what it says; null where none fits."""
    rule = action = None
    for h, p, a in sorted(rules, key=lambda r: (-len(r[0] + r[1]), r)):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        rule = F.when(fits, F.lit(h + p)) if rule is None else rule.when(fits, F.lit(h + p))
        action = F.when(fits, F.lit(a)) if action is None else action.when(fits, F.lit(a))
    none = F.lit(None).cast("string")
    return (none, none) if rule is None else (rule, action)


def _count(text: Column, pattern: str) -> Column:
    return (F.length(text) - F.length(F.regexp_replace(text, pattern, ""))).cast("double")


def lexical(url: Column) -> dict[str, Column]:
    """Features by name, as doubles."""
    url = F.coalesce(url, F.lit(""))
    host, path = host_and_path(url)
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    n = F.greatest(F.length(url), F.lit(1)).cast("double")
    letters = F.array_distinct(F.split(url, ""))
    times = lambda c: (F.length(url) - F.length(F.replace(url, c, F.lit("")))).cast("double")
    weight = F.aggregate(letters, F.lit(0.0), lambda s, c: s + F.when((F.length(c) > 0) & (times(c) > 0), times(c) * F.log2(times(c))).otherwise(0.0))
    return {
        "length": F.length(url).cast("double"),
        "host_length": F.length(host).cast("double"),
        "path_length": F.length(path).cast("double"),
        "depth": _count(path, "/"),
        "labels": _count(host, r"\."),
        "hyphens": _count(url, "-"),
        "digit_ratio": _count(url, r"[0-9]") / n,
        "entropy": F.log2(n) - weight / n,
        "params": F.when(F.length(query) > 0, _count(query, "&") + 1).otherwise(0.0),
        "has_fragment": F.contains(url, F.lit("#")).cast("double"),
    }


@dataclass
class Model:
    """trees: nested (feature, cut, low, high) or a leaf's value; suffixes: smoothed block rate of each suffix of the sample."""

    trees: list
    base: float
    suffixes: dict[str, float]
    rate: float


def suffix(host: Column) -> Column:
    return F.regexp_extract(host, r"([^.]*)$", 1)


def _grow(rows: list[list[float]], grad: list[float], hess: list[float], at: list[int], depth: int, cuts: list[list[float]]):
    g, h = sum(grad[i] for i in at), sum(hess[i] for i in at)
    leaf = -g / (h + 1.0)
    if not depth or len(at) < 20:
        return leaf
    best = (1e-6, None)
    for f, values in enumerate(cuts):
        # one pass fills a histogram of the feature's bins
        hist = [[0.0, 0.0, 0] for _ in range(len(values) + 1)]
        for i in at:
            b = hist[_bin(values, rows[i][f])]
            b[0] += grad[i]
            b[1] += hess[i]
            b[2] += 1
        lg = lh = ln = 0
        for k in range(len(values)):
            lg, lh, ln = lg + hist[k][0], lh + hist[k][1], ln + hist[k][2]
            if 5 <= ln <= len(at) - 5:
                gain = lg * lg / (lh + 1.0) + (g - lg) ** 2 / (h - lh + 1.0) - g * g / (h + 1.0)
                if gain > best[0]:
                    best = (gain, (f, values[k]))
    if best[1] is None:
        return leaf
    f, cut = best[1]
    low, high = [i for i in at if rows[i][f] <= cut], [i for i in at if rows[i][f] > cut]
    return (f, cut, _grow(rows, grad, hess, low, depth - 1, cuts), _grow(rows, grad, hess, high, depth - 1, cuts))


def _bin(values: list[float], x: float) -> int:
    lo, hi = 0, len(values)
    while lo < hi:
        mid = (lo + hi) // 2
        if x <= values[mid]:
            hi = mid
        else:
            lo = mid + 1
    return lo


def _score(tree, row) -> float:
    while isinstance(tree, tuple):
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree


def fit(labelled: DataFrame, sample: int = SAMPLE, trees: int = TREES, depth: int = DEPTH, rate: float = RATE) -> Model:
    """labelled: url, blocked (boolean). ``sample`` rows are used (smallest hash of the url first), and of a label that is
    rare among them further ones, up to a tenth of ``sample``; so 1.2 times ``sample`` rows at most."""
    feats = lexical(F.col("url"))
    rows = labelled.where("url IS NOT NULL AND blocked IS NOT NULL").select("url", "blocked")
    parts = [(rows, sample), *[(rows.where(F.col("blocked") == label), max(1, sample // 10)) for label in (False, True)]]
    few = reduce(DataFrame.unionByName, [common.smallest(part, most, "url", "blocked") for part, most in parts]).distinct()
    got = few.orderBy(F.xxhash64("url", "blocked"), "url", "blocked").select(F.col("blocked"), suffix(host_and_path(F.col("url"))[0]).alias("suffix"), *[c.alias(n) for n, c in feats.items()]).collect()
    y = [1.0 if r["blocked"] else 0.0 for r in got]
    if not y or not 0 < sum(y) < len(y):
        return Model([], -1.0, {}, rate)
    mean = sum(y) / len(y)
    # statistics of a suffix: a row of the fit sees only those of the other folds, so its own label isn't among them
    n, hits = Counter((r["suffix"], k % FOLDS) for k, r in enumerate(got)), Counter((r["suffix"], k % FOLDS) for k, r in enumerate(got) if r["blocked"])
    over = lambda c, s, out: sum(c[s, f] for f in range(FOLDS) if f != out)
    smooth = lambda s, out=None: (over(hits, s, out) + 10 * mean) / (over(n, s, out) + 10)
    suffixes = {s: smooth(s) for s, _ in sorted(n)} | {"": mean}
    rows = [[float(r[c]) for c in feats] + [smooth(r["suffix"], k % FOLDS) if r["suffix"] else mean] for k, r in enumerate(got)]
    cuts = []
    for f in range(len(rows[0])):
        v = sorted({r[f] for r in rows})
        mids = [(a + b) / 2 for a, b in zip(v, v[1:], strict=False)]
        cuts.append(mids if len(mids) <= BINS else sorted({mids[int(i * len(mids) / BINS)] for i in range(BINS)}))
    base = math.log(mean / (1 - mean))
    total, grown = [base] * len(y), []
    for _ in range(trees):
        p = [1 / (1 + math.exp(-t)) for t in total]
        tree = _grow(rows, [a - b for a, b in zip(p, y, strict=True)], [a * (1 - a) for a in p], list(range(len(y))), depth, cuts)
        grown.append(tree)
        total = [t + rate * _score(tree, r) for t, r in zip(total, rows, strict=True)]
    return Model(grown, base, suffixes, rate)


def with_verdict(pages: DataFrame, model: Model, rules=RULES, url: str = "url") -> DataFrame:
    """pages with host, path, rule, verdict and score (columns of these names are replaced)."""
    feats = lexical(F.col(url))
    host, path = host_and_path(F.col(url))
    out = pages.withColumn("host", host).withColumn("path", path)
    rule, action = rule_and_action(F.col("host"), F.col("path"), rules)
    rates = F.create_map(*[F.lit(x) for pair in model.suffixes.items() for x in pair]) if model.suffixes else F.create_map().cast("map<string,double>")
    known = F.coalesce(rates[suffix(F.col("host"))], F.lit(model.suffixes.get("", 0.5)))
    names = [*feats, "suffix_rate"]
    held = next(n for n in (f"_f{i}" for i in range(len(pages.columns) + 1)) if n not in pages.columns)
    out = out.withColumn(held, F.struct(*[c.alias(n) for n, c in feats.items()], known.alias("suffix_rate")))

    def expression(tree) -> Column:
        if not isinstance(tree, tuple):
            return F.lit(float(tree))
        return F.when(F.col(held).getField(names[tree[0]]) <= F.lit(tree[1]), expression(tree[2])).otherwise(expression(tree[3]))

    score = F.lit(model.base)
    for tree in model.trees:
        score = score + F.lit(model.rate) * expression(tree)
    return out.withColumn("rule", rule).withColumn("score", score).withColumn("verdict", F.coalesce(action, F.when(F.col("score") > 0, "block").otherwise("allow"))).drop(held)


def rule_labelled(pages: DataFrame, rules=RULES) -> DataFrame:
    """The labelled URLs of the query: pages that a rule decides."""
    host, path = host_and_path(F.col("url"))
    return pages.select("url", (rule_and_action(host, path, rules)[1] == "block").alias("blocked")).where("blocked IS NOT NULL")


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = common.table(spark, sf_dir, "pages").select("page_id", "url")
    return with_verdict(pages, fit(rule_labelled(pages))).select("page_id", "host", "path", "rule", "verdict", "score")
