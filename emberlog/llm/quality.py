"""Quality rules (6): learned decision lists over text statistics.

``text_statistics`` computes the statistics of whole texts; ``learn`` grows and prunes an
ordered list of threshold conjunctions by sequential covering (grown on two thirds of the
labelled rows, pruned on the rest); ``verdict`` turns the list into one ordered Spark
conditional expression. Only the fit sees values on the driver: a bounded labelled sample.

Defined results: a null text has no words, so it fails the base rules and is not kept; without
labelled rows the rule list is empty and keeps whatever passes the base rules; rows are judged
one by one, so ties, repeated rows and null ids change nothing. ``judge`` adds one struct
column under a name of the caller's choice, so extra columns never clash.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common
from .textstats import numbered, slices_of, sums, words

STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_bang")
STATS_TYPE = T.StructType([T.StructField(n, T.LongType(), False) for n in STATS])
WINDOW = 5
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True


def _repeated(*keys: np.ndarray) -> np.ndarray:
    """For each row of the key columns, whether it occurs twice or more."""
    order = np.lexsort(keys) if len(keys) > 1 else np.argsort(keys[0], kind="stable")
    hit = np.zeros(len(order), bool)
    if len(order):
        same = np.ones(len(order) - 1, bool)
        for k in keys:
            same &= k[order][1:] == k[order][:-1]
        hit[order] = np.concatenate((same, [False])) | np.concatenate(([False], same))
    return hit


def statistics(raw: np.ndarray, offs: np.ndarray) -> list[np.ndarray]:
    """The columns of STATS for texts laid one after another."""
    n = len(offs) - 1
    starts, ends, per = words(raw, offs)
    text_of = np.repeat(np.arange(n), per)
    lead = (raw & 0xC0) != 0x80  # first bytes of code points
    space = np.isin(raw, np.frombuffer(common.WORD_SPACE, np.uint8))
    chars = sums(lead & ~space, offs)
    # 5-word windows found twice or more in their text, compared word by word
    h = numbered(raw, starts, ends)
    repeat = np.zeros(n, np.int64)
    if len(h) >= WINDOW:
        at = np.flatnonzero(text_of[: len(h) - WINDOW + 1] == text_of[WINDOW - 1 :])
        for j in (0, WINDOW - 2):  # a window repeats only if its first and its last two words do; a slice's numbers fit
            at = at[_repeated((h[at + j] * len(h) + h[at + j + 1]) * n + text_of[at])]
        hit = _repeated(*[h[at + j] for j in range(WINDOW)], text_of[at])
        step = np.zeros(len(h) + 1, np.int64)
        np.add.at(step, at[hit], 1)
        np.add.at(step, at[hit] + WINDOW, -1)
        repeat = np.bincount(text_of, weights=np.cumsum(step[:-1]) > 0, minlength=n).astype(np.int64)
    # lines with a word that equal an earlier line of their text
    cut = np.flatnonzero(raw == 0x0A)
    line_start = np.union1d(np.concatenate((cut + 1, offs[:-1])), [])
    line_start = line_start[line_start < len(raw)].astype(np.int64)
    first_word = np.searchsorted(starts, line_start)
    dup = np.zeros(n, np.int64)
    if len(line_start) and len(starts):
        stop = np.concatenate((line_start[1:], [len(raw)]))
        line_end = np.where((stop > 0) & (raw[stop - 1] == 0x0A), stop - 1, stop)
        full = (first_word < len(starts)) & (starts[np.minimum(first_word, len(starts) - 1)] < line_end)
        line_start, line_end = line_start[full], line_end[full]
        doc = np.searchsorted(offs, line_start, side="right") - 1
        keys = numbered(raw, line_start, line_end) * n + doc
        _, first = np.unique(keys, return_index=True)
        again = np.ones(len(keys), bool)
        again[first] = False
        dup = np.bincount(doc[again], minlength=n).astype(np.int64)
    return [per, chars, sums(SYMBOLS[raw], offs), dup, repeat, sums((raw >= 65) & (raw <= 90), offs), sums(raw == 33, offs)]


def with_statistics(docs: DataFrame, into: str = "stats", text: str = "text") -> DataFrame:
    """docs with one struct column of STATS; one Arrow pass over whole texts, no shuffle."""
    schema = T.StructType([*docs.schema.fields, T.StructField(into, STATS_TYPE, False)])
    at = docs.columns.index(text)

    def run(batch: pa.RecordBatch):
        for a, b, raw, offs in slices_of(batch.column(at)):
            struct = pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in statistics(raw, offs)], names=list(STATS))
            yield pa.RecordBatch.from_arrays([*batch.slice(a, b - a).columns, struct], names=[*batch.schema.names, into])

    return common.arrow_map(docs, run, schema)


FEATURES = ("symbols", "bangs", "uppers", "repeats", "dup_lines", "chars_per_word", "n_words")


def features(stats: Column) -> dict[str, Column]:
    """Size-free features; the same formulas serve the fit and the verdict."""
    s = lambda n: stats.getField(n).cast("double")
    per_word = F.greatest(s("n_words"), F.lit(1.0))
    return {
        "symbols": s("n_symbols") / per_word,
        "bangs": s("n_bang") / per_word,
        "uppers": s("n_upper") / F.greatest(s("word_chars"), F.lit(1.0)),
        "repeats": s("n_repeat_words") / per_word,
        "dup_lines": s("n_dup_lines") / per_word,
        "chars_per_word": s("word_chars") / per_word,
        "n_words": s("n_words"),
    }


@dataclass(frozen=True)
class Rule:
    """Reject where every (feature, '>' or '<=', threshold) holds."""

    terms: tuple[tuple[str, str, float], ...]
    covered: int = 0
    precision: float = 0.0


def _holds(x: np.ndarray, terms) -> np.ndarray:
    hit = np.ones(len(x), bool)
    for name, op, cut in terms:
        v = x[:, FEATURES.index(name)]
        hit &= v > cut if op == ">" else v <= cut
    return hit


def learn(x: np.ndarray, bad: np.ndarray, *, precision: float = 0.97, support: int = 8, most_terms: int = 3, most_rules: int = 12, bins: int = 32) -> list[Rule]:
    """Sequential covering: grow the best conjunction, prune it, keep it if precise, drop its rows, repeat.

    x: rows of FEATURES; bad: the label to reject. Rows with every third index prune. A rule must
    reach ``precision`` on all rows left and cover ``support`` bad ones, so clean texts stay.
    """
    rules: list[Rule] = []
    left = np.ones(len(x), bool)
    prune_row = np.arange(len(x)) % 3 == 2
    while len(rules) < most_rules and (bad & left).sum() >= support:
        grow, prune = left & ~prune_row, left & prune_row
        terms: list[tuple[str, str, float]] = []
        now = grow.copy()
        while len(terms) < most_terms:
            p, n = (bad & now).sum(), now.sum()
            if not p or p == n:
                break
            base, best = np.log2(p / n), (1e-9, None)
            for j, name in enumerate(FEATURES):
                v = x[now, j]
                seen = np.unique(v)
                for i in np.unique(np.searchsorted(seen, np.quantile(v, np.linspace(0, 1, bins + 1)[:-1]), side="right") - 1):
                    cut = (seen[i] + seen[min(i + 1, len(seen) - 1)]) / 2  # between two values that occur
                    for op, hit in ((">", v > cut), ("<=", v <= cut)):
                        q, m = (bad[now] & hit).sum(), hit.sum()
                        if q and (gain := q * (np.log2(q / m) - base)) > best[0]:  # information gain of the covered
                            best = (gain, (name, op, float(cut)))
            if best[1] is None:
                break
            terms.append(best[1])
            now &= _holds(x, [best[1]])
        if not terms:
            break
        worth = lambda t: ((bad & prune & (h := _holds(x, t))).sum() - (~bad & prune & h).sum()) / max(1, (prune & h).sum())
        while len(terms) > 1 and worth(terms[:-1]) >= worth(terms):
            terms.pop()
        hit = _holds(x, terms) & left
        p, n = int((bad & hit).sum()), int(hit.sum())
        if p < support or p / max(n, 1) < precision:
            break
        rules.append(Rule(tuple(terms), p, p / n))
        left &= ~hit
    return rules


def fit(labelled: DataFrame, *, text: str = "text", label: str = "quality", sample: int = 6000) -> list[Rule]:
    """Learn from at most ``sample`` labelled rows (smallest hash of the text first).

    labelled: columns text and label (0 rejects, 1 keeps; null labels are ignored).
    """
    rows = labelled.where(F.col(label).isNotNull()).select(F.col(text).alias("text"), F.col(label).cast("int").alias("label"))
    rows = common.smallest(rows, sample, "text", "label")
    stats = with_statistics(rows).select("label", *[c.alias(n) for n, c in features(F.col("stats")).items()])
    got = stats.collect()
    if not got:
        return []
    got.sort(key=tuple)
    order = np.random.default_rng(7).permutation(len(got))
    x = np.array([[r[n] for n in FEATURES] for r in got], float)[order]
    bad = np.array([r["label"] == 0 for r in got])[order]
    return learn(x, bad)


def verdict(rules: list[Rule], stats: Column) -> Column:
    """True (keep) or false (reject) as one ordered conditional expression."""
    by = features(stats)
    out = None
    for rule in rules:
        test = F.lit(True)
        for name, op, cut in rule.terms:
            test = test & (by[name] > F.lit(cut) if op == ">" else by[name] <= F.lit(cut))
        out = F.when(test, F.lit(False)) if out is None else out.when(test, F.lit(False))
    return F.lit(True) if out is None else out.otherwise(F.lit(True))


def base_failed(stats: Column) -> Column:
    return (stats.getField("n_words") < 10) | (stats.getField("n_repeat_words") * 100 > stats.getField("n_words") * 20)


def labelled_texts(docs: DataFrame, labels: DataFrame, bound: int = 6000) -> DataFrame:
    """Texts of at most ``bound`` labelled ids; that many ids are small enough to broadcast."""
    ids = common.smallest(labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality")), bound, "doc_id")
    return docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").select("text", "quality")


def judge(docs: DataFrame, rules: list[Rule], into: str = "stats") -> DataFrame:
    """docs with the struct ``into`` of STATS, base_failed and kept."""
    out = with_statistics(docs, into)
    s = F.col(into)
    failed = base_failed(s)
    return out.withColumn(into, s.withField("base_failed", failed).withField("kept", F.when(failed, F.lit(False)).otherwise(verdict(rules, s))))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    rules = fit(labelled_texts(docs, common.table(spark, sf_dir, "labels")))
    out = judge(docs.select("doc_id", "text"), rules)
    return out.select("doc_id", *[F.col(f"stats.{n}").alias(n) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")])


@common.keeps_columns
def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline: documents that the base rules or the learned list reject go."""
    rules = fit(labelled_texts(docs, common.table(spark, sf_dir, "labels")))
    cols = docs.columns
    return judge(docs, rules, "_quality").where(F.col("_quality.kept")).select(*cols)
