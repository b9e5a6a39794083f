"""Substring dedup (8): words of windows that also start in an earlier document go.

Equal windows are brought together by anchors (``repeats``); within an anchor windows are
found by level-wise doubling: words that occur once are no candidates; windows of length L that
repeat are extended to 2L where both halves repeat, the last step being cut to the window's
length; each level keeps only what repeats, until none survives or the length is reached.

Defined results: null and empty texts have no words; windows are compared word for word,
unchanged; only strictly smaller doc_ids count as earlier, so repeats inside a document (or
among rows with one id, or among rows without id, which come last) stay.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from . import common
from .repeats import Units, answers, covered, keyed, with_marks
from .suffixdedup import runs_of

WINDOW, GRAM = 13, 5


def _name(pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A number for each distinct value, and whether it occurs twice or more."""
    _, name, count = np.unique(pairs, return_inverse=True, return_counts=True)
    return name, count[name] > 1


def doubled(units: np.ndarray, room: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, class) of the windows that repeat. units: word numbers; room: units from each start to its content's end."""
    name, again = _name(units)
    at, length = np.flatnonzero(again), 1
    label = np.full(len(units), -1, np.int64)
    label[at] = name[at]
    while length < window and len(at):
        step = min(length, window - length)
        at = at[room[at] >= length + step]
        at = at[label[at + step] >= 0]  # both halves repeat
        name, again = _name(label[at] * (len(units) + 1) + label[at + step]) if len(at) else (at, np.zeros(0, bool))
        label[:] = -1
        at, name = at[again], name[again]
        label[at] = name
        length += step
    return at, label[at]


def resolver(window: int):
    def resolve(contents: list[bytes], ids: np.ndarray, hashes: np.ndarray, firsts: np.ndarray):
        lists = [c.split(b" ") for c in contents]
        sizes = np.fromiter(map(len, lists), np.int64, len(lists))
        number: dict[bytes, int] = {}
        units = np.array([number.setdefault(w, len(number)) for ws in lists for w in ws], np.int64)
        ends = np.cumsum(sizes)
        who = np.repeat(np.arange(len(lists)), sizes)
        at, klass = doubled(units, ends[who] - np.arange(len(units)), window)
        if not len(at):
            return (np.zeros(0, np.int64),) * 3
        least = np.full(int(klass.max()) + 1, np.iinfo(np.int64).max)
        np.minimum.at(least, klass, ids[who[at]])
        hit = least[klass] < ids[who[at]]
        at = at[hit]
        return runs_of(who[at], at - (ends - sizes)[who[at]])

    return resolve


def with_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """docs with _marks of the windows that start in an earlier document (see repeats.with_marks)."""
    rows = keyed(docs)
    return with_marks(rows, answers(rows.select("_id", "_hash", "_more", "text"), Units(window, gram, by_words=True), resolver(window), by_document=True))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = with_repeats(common.table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "text", "_marks")
    schema = T.StructType([joined.schema["doc_id"], T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_sha256", T.StringType())])

    def apply(batch: pa.RecordBatch):
        out = []
        for value, spans in zip(common.binary(batch.column(1)), batch.column(2), strict=True):
            words, spans = value.as_py().split(), spans.as_py()
            kept, removed = words, 0
            if spans is not None:
                gone = covered(spans, WINDOW, len(words))
                removed = int(gone.sum())
                kept = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
            out.append((len(words), removed, hashlib.sha256(b" ".join(kept)).hexdigest()))
        n, r, h = zip(*out, strict=True)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(r, pa.int64()), pa.array(h)], names=schema.names)

    return common.arrow_map(joined, apply, schema)
