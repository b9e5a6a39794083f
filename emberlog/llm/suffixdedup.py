"""Suffix-array dedup (7): bytes of repeated passages go, the first place stays.

Equal windows are brought together by anchors (``repeats``); within an anchor the distinct
contents are laid into one text, whose Burrows-Wheeler transform is expanded by intervals up
to the minimum length (``bwt``). What the expansion leaves unbounded are equal windows; all but
the earliest place of each are marked. A content that is the only one of its anchor has nothing
to expand: its later places repeat its first, as copies of a whole text repeat that text.

Defined results: null and empty texts have no bytes; texts are whole UTF-8 bytes of any
length; rows that repeat (same id, same text) are one place and get equal answers; rows that
share an id but not the text are ordered by a hash of the text; null ids come after all others.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bwt, common
from .repeats import Units, answers, covered, keyed, with_marks

LENGTH, GRAM = 100, 24


def resolver(length: int):
    """Windows of each content that stand earlier in another place."""

    def resolve(contents: list[bytes], ids: np.ndarray, hashes: np.ndarray, firsts: np.ndarray):
        klass, who, at = bwt.equal_windows(contents, length)
        if not len(klass):
            return (np.zeros(0, np.int64),) * 3
        doc = np.lexsort((hashes, ids))
        step = np.concatenate(([False], (ids[doc][1:] != ids[doc][:-1]) | (hashes[doc][1:] != hashes[doc][:-1])))
        rank = np.empty(len(ids), np.int64)
        rank[doc] = np.cumsum(step)
        place = (rank[who] << 40) + firsts[who] + at
        by = np.lexsort((place, klass))
        klass, who, at, place = klass[by], who[by], at[by], place[by]
        lead = np.flatnonzero(np.concatenate(([True], klass[1:] != klass[:-1])))
        least = np.repeat(place[lead], np.diff(np.concatenate((lead, [len(klass)]))))
        hit = place > least
        return runs_of(who[hit], at[hit])

    return resolve


def runs_of(who: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Consecutive marked windows of each content as (content, first, last)."""
    by = np.lexsort((at, who))
    who, at = who[by], at[by]
    if not len(who):
        return who, at, at
    turn = np.flatnonzero(np.concatenate(([True], (who[1:] != who[:-1]) | (at[1:] != at[:-1] + 1))))
    end = np.concatenate((turn[1:], [len(who)])) - 1
    return who[turn], at[turn], at[end]


_NEED = np.zeros(256, np.int64)  # bytes of the character that each first byte announces
_NEED[:0x80], _NEED[0xC2:0xE0], _NEED[0xE0:0xF0], _NEED[0xF0:0xF5] = 1, 2, 3, 4


def widened(data: np.ndarray, gone: np.ndarray) -> np.ndarray:
    """gone with all bytes of the UTF-8 characters that it cuts apart; bytes outside of characters stand alone."""
    at = np.arange(len(data))
    first = np.maximum.accumulate(np.where((data & 0xC0) != 0x80, at, 0))
    starts = np.flatnonzero((first == at) | (at - first >= _NEED[data[first]]))
    return np.repeat(np.logical_or.reduceat(gone, starts), np.diff(np.append(starts, len(data))))


def without_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, characters: bool = False) -> DataFrame:
    """docs with ``_kept`` (the bytes that stay), ``_bytes``, ``_removed`` and ``_runs`` (counts).

    With ``characters``, what stays of characters that a span cuts apart is not in ``_kept``.
    """
    rows = keyed(docs)
    joined = with_marks(rows, answers(rows.select("_id", "_hash", "_more", "text"), Units(length, gram, by_words=False), resolver(length), by_document=False))
    fields = [f for f in joined.schema.fields if f.name != "_marks"]
    extra = [T.StructField("_kept", T.BinaryType(), False), *[T.StructField(n, T.LongType(), False) for n in ("_bytes", "_removed", "_runs")]]
    at, spans_at = joined.columns.index("text"), joined.columns.index("_marks")
    others = [i for i, n in enumerate(joined.columns) if n != "_marks"]

    def apply(batch: pa.RecordBatch):
        kept, size, removed, runs = [], [], [], []
        for value, spans in zip(common.binary(batch.column(at)), batch.column(spans_at), strict=True):
            text, spans = value.as_py(), spans.as_py()
            size.append(len(text))
            if spans is None:
                kept.append(text)
                removed.append(0)
                runs.append(0)
                continue
            gone = covered(spans, length, len(text))
            data = np.frombuffer(text, np.uint8)
            kept.append(data[~(widened(data, gone) if characters and gone.any() else gone)].tobytes())
            removed.append(int(gone.sum()))
            runs.append(int((gone & ~np.concatenate(([False], gone[:-1]))).sum()))
        arrays = [*[batch.column(i) for i in others], pa.array(kept, pa.binary()), *[pa.array(x, pa.int64()) for x in (size, removed, runs)]]
        yield pa.RecordBatch.from_arrays(arrays, names=[f.name for f in (*fields, *extra)])

    return common.arrow_map(joined, apply, T.StructType([*fields, *extra]))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    out = without_repeats(docs)
    return out.select("doc_id", F.col("_bytes").alias("n_bytes"), F.col("_removed").alias("n_removed"), F.col("_runs").alias("n_spans"), F.sha2("_kept", 256).alias("kept_sha256"))


@common.keeps_columns
def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline: every document stays, without the bytes that repeat earlier ones.

    Characters that a removed span cuts apart go too; null texts stay null; n_chars follows the text.
    """
    cols = docs.columns
    out = without_repeats(docs, characters=True)
    text = F.when(F.col("text").isNull(), F.lit(None).cast("string")).otherwise(F.when(F.col("_removed") == 0, F.col("text")).otherwise(F.col("_kept").cast("string")))
    out = out.withColumn("text", text)
    if "n_chars" in cols:
        out = out.withColumn("n_chars", F.when(F.col("_removed") == 0, F.col("n_chars")).otherwise(F.length("text").cast(dict(docs.dtypes)["n_chars"])))
    return out.select(*cols)
