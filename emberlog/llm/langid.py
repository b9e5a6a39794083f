"""Language ID (10): Bayesian fusion of text, declared language, address suffix and host.

Text gives tempered log-likelihoods of hashed byte trigrams under one model for each language,
fitted from a bounded sample of labelled texts. A first decision from the text alone is
counted by host, domain, address suffix and overall (grouped aggregation over all rows); each level is
smoothed toward the next, which gives every host a prior. How far declarations can be trusted is
counted the same way. The posterior is the normalised product of all four.

Rejected (``kept`` false): rows without any evidence of a language (no letters in the text), and
rows whose best posterior stays under ``least`` or is not among the wanted languages.

Defined results: null texts and texts without letters have no likelihood and are rejected; null
declarations and hosts are levels of their own; ties go to the language that comes first in the model;
rows are judged by their own evidence and shared counts, so repeated rows get equal answers. With no
labelled text at all, nothing can be told apart and every row with letters is kept with a null language.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common
from .textstats import slices_of
from .urls import host_and_path, suffix

BUCKETS, SAMPLE, STRENGTH, TEMPER = 1 << 15, 4000, 20.0, 60.0
#: country suffixes whose main language is one of the usual ones (fixed values)
COUNTRY = {"de": "de", "at": "de", "fr": "fr", "es": "es", "mx": "es", "ar": "es", "uk": "en", "us": "en", "au": "en", "ie": "en"}
SCORES = T.StructType([T.StructField("n", T.LongType(), False), T.StructField("ll", T.ArrayType(T.DoubleType(), False), False)])


def _fold() -> np.ndarray:
    """Bytes as the model sees them: a-z for both cases, other ASCII as space, high bytes as they are."""
    t = np.full(256, 32, np.uint32)
    for b in range(256):
        if 65 <= b <= 90 or 97 <= b <= 122:
            t[b] = b | 32
        elif b >= 128:
            t[b] = b
    return t


FOLD = _fold()


def trigrams(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, bucket) of the trigrams inside each text that hold a letter."""
    f = FOLD[raw]
    if len(f) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    h = (f[:-2] * np.uint32(0x9E3779B1) + f[1:-1] * np.uint32(0x85EBCA77) + f[2:] * np.uint32(0xC2B2AE3D)) >> np.uint32(17)
    text = np.repeat(np.arange(len(offs) - 1), np.diff(offs))
    ok = (text[:-2] == text[2:]) & ((f[:-2] != 32) | (f[1:-1] != 32) | (f[2:] != 32))
    at = np.flatnonzero(ok)
    return text[at], h[at].astype(np.int64)


class Model:
    """log P(bucket | language), one column for each language."""

    def __init__(self, languages: list[str], counts: np.ndarray):
        self.languages = languages
        smooth = counts + 0.5
        self.logp = np.log(smooth / smooth.sum(axis=0, keepdims=True)) if languages else np.zeros((BUCKETS, 0))


def fit(texts: DataFrame, sample: int = SAMPLE) -> Model:
    """texts: text, language (null ones don't count). At most ``sample`` rows (smallest hash of the text first)."""
    few = common.smallest(texts.where("text IS NOT NULL AND language IS NOT NULL").select("text", "language"), sample, "text", "language")
    schema = T.StructType([T.StructField("language", T.StringType()), T.StructField("counts", T.BinaryType())])

    def run(batch: pa.RecordBatch):
        names = np.array(batch.column(1).to_pylist(), object)
        total: dict[str, np.ndarray] = {}
        for a, b, raw, offs in slices_of(batch.column(0)):
            text, bucket = trigrams(raw, offs)
            for name in set(names[a:b]):
                use = (names[a:b] == name)[text]
                total.setdefault(name, np.zeros(BUCKETS, np.int64))
                total[name] += np.bincount(bucket[use], minlength=BUCKETS)
        yield pa.RecordBatch.from_arrays([pa.array(list(total)), pa.array([c.tobytes() for c in total.values()], pa.binary())], names=schema.names)

    counts: dict[str, np.ndarray] = {}
    for r in common.arrow_map(few.select("text", "language"), run, schema).collect():  # languages x batches of the sample
        counts[r["language"]] = counts.get(r["language"], 0) + np.frombuffer(r["counts"], np.int64)
    languages = sorted(counts)
    return Model(languages, np.stack([counts[n] for n in languages], 1).astype(float) if languages else np.zeros((BUCKETS, 0)))


def with_scores(docs: DataFrame, model: Model, into: str = "_scores", text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """docs (or its columns ``keep``) with the number of trigrams and tempered log-likelihoods of each whole text."""
    keep = docs.columns if keep is None else keep
    shared = docs.sparkSession.sparkContext.broadcast(model.logp.astype(np.float32))
    rows = docs.select(*keep, F.col(text).alias("_scored_text"))
    schema = T.StructType([*rows.schema.fields[:-1], T.StructField(into, SCORES, False)])

    def run(batch: pa.RecordBatch):
        logp = shared.value
        for a, b, raw, offs in slices_of(batch.column(batch.num_columns - 1)):
            who, bucket = trigrams(raw, offs)
            n = np.bincount(who, minlength=b - a)
            ll = np.stack([np.bincount(who, weights=logp[bucket, j], minlength=b - a) for j in range(logp.shape[1])], 1) if logp.shape[1] else np.zeros((b - a, 0))
            # trigrams overlap and repeat: evidence counts as at most TEMPER independent ones
            ll = ll * (np.minimum(n, TEMPER) / np.maximum(n, 1))[:, None]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(b - a + 1) * ll.shape[1], pa.int32()), pa.array(ll.ravel()))
            struct = pa.StructArray.from_arrays([pa.array(n.astype(np.int64)), lists], names=["n", "ll"])
            yield pa.RecordBatch.from_arrays([*(c.slice(a, b - a) for c in batch.columns[:-1]), struct], names=schema.names)

    return common.arrow_map(rows, run, schema)


def _best(values: Column, languages: list[str]) -> Column:
    at = F.array_position(values, F.array_max(values)).cast("int")
    return F.element_at(F.array(*[F.lit(x) for x in languages]), at)


def host_priors(scored: DataFrame, languages: list[str]) -> DataFrame:
    """_host, _prior, _rows: log priors of every host and its rows. Text-only decisions count, smoothed host -> domain -> suffix -> all."""
    n = len(languages)
    decided = F.when(F.col("_scores.n") >= 10, _best(F.col("_scores.ll"), languages))
    per = [F.sum((F.col("_lang") == x).cast("double")).alias(f"c{i}") for i, x in enumerate(languages)]
    per = [F.coalesce(c, F.lit(0.0)).alias(f"c{i}") for i, c in enumerate(per)]
    hosts = scored.select("_host", "_domain", "_suffix", decided.alias("_lang")).groupBy("_host", "_domain", "_suffix").agg(*per, F.count("*").alias("_rows"))
    up = [F.sum(f"c{i}").alias(f"c{i}") for i in range(n)]
    domains = hosts.groupBy("_domain", "_suffix").agg(*up)
    suffixes = domains.groupBy("_suffix").agg(*up)
    every = suffixes.agg(*up).first()  # one row
    total = sum(every[f"c{i}"] or 0.0 for i in range(n))
    top = [((every[f"c{i}"] or 0.0) + 1.0) / (total + n) for i in range(n)]

    def smooth(level: DataFrame, above: list[Column], keep: list[str], name: str) -> DataFrame:
        size = sum((F.col(f"c{i}") for i in range(n)), F.lit(0.0))
        return level.select(*keep, F.array(*[(F.col(f"c{i}") + STRENGTH * above[i]) / (size + STRENGTH) for i in range(n)]).alias(name))

    boost = lambda i: F.when(F.create_map(*[F.lit(x) for kv in COUNTRY.items() for x in kv])[F.col("_suffix")] == languages[i], F.lit(0.5)).otherwise(F.lit(0.5 * top[i]))
    known = F.col("_suffix").isin(*COUNTRY)
    s = smooth(suffixes, [F.when(known, boost(i) + F.lit(0.25 * top[i])).otherwise(F.lit(top[i])) for i in range(n)], ["_suffix"], "_ps")
    d = smooth(domains.join(s, "_suffix"), [F.col("_ps")[i] for i in range(n)], ["_domain", "_suffix"], "_pd")
    h = smooth(hosts.join(d, ["_domain", "_suffix"]), [F.col("_pd")[i] for i in range(n)], ["_host", "_rows"], "_ph")
    return h.select("_host", "_rows", F.transform("_ph", lambda p: F.log(p)).alias("_prior"))


def declared_trust(scored: DataFrame, languages: list[str]) -> Column:
    """log P(declaration | language) by the counts of declarations among text-only decisions, smoothed."""
    n = len(languages)
    told = F.when(F.col("_declared").isin(*languages), F.col("_declared")).otherwise(F.when(F.col("_declared").isNull(), "none").otherwise("other"))
    rows = scored.where("_scores.n >= 10").groupBy(told.alias("d"), _best(F.col("_scores.ll"), languages).alias("l")).count().collect()  # (languages + 2) * languages rows at most
    kinds = [*languages, "other", "none"]
    table = np.full((len(kinds), n), 1.0)
    for r in rows:
        table[kinds.index(r["d"]), languages.index(r["l"])] += r["count"]
    table = np.log(table / table.sum(axis=0, keepdims=True))
    out = F.array(*[F.lit(float(v)) for v in table[-1]])
    for kind, row in zip(kinds[:-1], table[:-1], strict=True):
        out = F.when(told == kind, F.array(*[F.lit(float(v)) for v in row])).otherwise(out)
    return out


def with_address(rows: DataFrame, host: Column, declared: Column) -> DataFrame:
    """_host, _domain, _suffix and _declared, never null but for the declaration."""
    host = F.coalesce(host, F.lit(""))
    dotted = F.contains(host, F.lit("."))
    return rows.withColumn("_host", host).withColumn("_domain", F.when(dotted, F.regexp_extract(host, r"([^.]*\.[^.]*)$", 1)).otherwise(host)).withColumn("_suffix", F.when(dotted, suffix(host)).otherwise("")).withColumn("_declared", F.lower(F.substring(declared, 1, 2)))


def fused(scored: DataFrame, model: Model, *, least: float = 0.5, wanted: list[str] | None = None) -> DataFrame:
    """scored with _lang, _confidence, _text_lang and _kept. Priors and trust are counted on scored, which should be a written table."""
    languages = model.languages
    if not languages:
        return scored.withColumn("_lang", F.lit(None).cast("string")).withColumn("_confidence", F.lit(0.0)).withColumn("_text_lang", F.lit(None).cast("string")).withColumn("_kept", F.col("_scores.n") > 0)
    trust = declared_trust(scored, languages)
    out = common.join_heavy(scored, common.cut(host_priors(scored, languages)), "_host", "_rows")
    total = F.zip_with(F.zip_with(F.col("_scores.ll"), trust, lambda a, b: a + b), "_prior", lambda a, b: a + b)
    out = out.withColumn("_sum", total)
    out = out.withColumn("_lang", _best(F.col("_sum"), languages)).withColumn("_text_lang", F.when(F.col("_scores.n") > 0, _best(F.col("_scores.ll"), languages)))
    top = F.array_max("_sum")
    out = out.withColumn("_confidence", 1.0 / F.aggregate("_sum", F.lit(0.0), lambda s, v: s + F.exp(v - top)))
    ok = (F.col("_scores.n") > 0) & (F.col("_confidence") >= least) & F.col("_lang").isin(*(wanted or languages))
    return out.withColumn("_kept", F.coalesce(ok, F.lit(False))).drop("_sum", "_prior")


def page_text(html: Column) -> Column:
    bare = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>", " ")
    return F.regexp_replace(F.regexp_replace(bare, r"(?s)<[^>]*>", " "), r"&[#a-zA-Z0-9]{1,8};", " ")


def declared_in(html: Column) -> Column:
    found = F.regexp_extract(html, r"(?i)<html[^>]*?\b(?:xml:)?lang\s*=\s*[\"']?([a-z]{2})", 1)
    return F.when(F.length(found) > 0, found)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents (source as host) and all pages (doc_id is -1 - page_id).

    The lang of documents labels the fit; only the markup of pages declares a language.
    """
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    pages = common.table(spark, sf_dir, "pages").select("page_id", "url", "html")
    model = fit(docs.select("text", F.col("lang").alias("language")))
    one = with_address(docs.select("doc_id", "text", "source"), F.col("source"), F.lit(None).cast("string")).drop("source")
    two = with_address(pages.select((-1 - F.col("page_id")).alias("doc_id"), page_text(F.col("html")).alias("text"), "url", "html"), host_and_path(F.col("url"))[0], declared_in(F.col("html"))).drop("url", "html")
    rows = one.unionByName(two)
    scored = common.cut(with_scores(rows, model, keep=["doc_id", "_host", "_domain", "_suffix", "_declared"]))
    out = fused(scored, model)
    return out.select("doc_id", F.col("_lang").alias("language"), F.round("_confidence", 6).alias("confidence"), F.col("_declared").alias("declared"), F.col("_text_lang").alias("text_language"), F.col("_kept").alias("kept"))


@common.keeps_columns
def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline: documents without a language that can be told go; lang stays as it was."""
    cols = docs.columns
    model = fit(docs.select("text", F.col("lang").alias("language")))
    scored = common.cut(with_scores(with_address(docs, F.col("source"), F.lit(None).cast("string")), model))
    return fused(scored, model).where("_kept").select(*cols)
