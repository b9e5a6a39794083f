"""Periodic run detection (11): Kolpakov and Kucherov's algorithm over the words of every text.

``Automaton`` is a suffix automaton with the first end of every state; walking it gives the Lempel-Ziv
factors (each the longest stretch that starts earlier, overlaps allowed) and where each occurred
before. A run that touches or crosses a factor's border is found by Main's algorithm from longest
common extensions at that border: over the factor and so much to its left as a run that ends in the
factor can reach. All other runs lie strictly inside a factor and are copied from its earlier
occurrence, in order of their starts. All of it is linear in the length.

Before it, words are compared through an exact reduction: a run of 12 words or more, or of two
periods, consists of six-word windows that occur twice in the text, so a word outside all such windows
(seen by their hashes, where a collision only keeps more) lies in no run. The algorithm gets the
stretches between those words, as exact word numbers, so prose without repeats costs no automaton.

A text is one task's work; its automaton takes some 100 bytes a word of a stretch. Texts are taken
in slices of bounded size, and nothing is shuffled.

Defined results: null and empty texts have no words, no runs and an empty collapsed text; an empty
table gives no rows; repeated rows, ties and null ids each give their own row; longest run by ties:
smallest start, then smallest period; further columns are not read, whatever their names.
"""

from __future__ import annotations

from array import array
from collections import defaultdict
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common
from .textstats import flatten, grams, mix, single_spaced, word_hashes, words

LEAST = 12


class Automaton:
    """Suffix automaton of a sequence of small integers. Most states have one way on, kept in arrays; the rest in dictionaries."""

    def __init__(self, seq: list[int]):
        n = len(seq)
        length, link, first = array("i", [0]), array("i", [-1]), array("i", [-1])
        symbol, to = array("i", [-1]), array("i", [-1])  # the first transition of each state
        more: dict[int, dict[int, int]] = {}
        last = 0
        for at in range(n):
            c = seq[at]
            new = len(length)
            length.append(length[last] + 1)
            link.append(0)
            first.append(at)
            symbol.append(-1)
            to.append(-1)
            p, q = last, -1
            while p >= 0:
                if symbol[p] == c:
                    q = to[p]
                    break
                if symbol[p] < 0:
                    symbol[p], to[p] = c, new
                else:
                    other = more.get(p)
                    if other is None:
                        more[p] = {c: new}
                    elif c in other:
                        q = other[c]
                        break
                    else:
                        other[c] = new
                p = link[p]
            if q >= 0:
                if length[q] == length[p] + 1:
                    link[new] = q
                else:
                    copy = len(length)
                    length.append(length[p] + 1)
                    link.append(link[q])
                    first.append(first[q])
                    symbol.append(symbol[q])
                    to.append(to[q])
                    if q in more:
                        more[copy] = dict(more[q])
                    while p >= 0:
                        if symbol[p] == c:
                            if to[p] != q:
                                break
                            to[p] = copy
                        elif p in more and more[p].get(c) == q:
                            more[p][c] = copy
                        else:
                            break
                        p = link[p]
                    link[q] = link[new] = copy
            last = new
        self.first, self.symbol, self.to, self.more = first, symbol, to, more

    def factors(self, seq: list[int]) -> list[tuple[int, int, int]]:
        """(start, length, distance to the earlier occurrence; 0 for a new letter) of the Lempel-Ziv factors."""
        first, symbol, to, more = self.first, self.symbol, self.to, self.more
        out, at, n = [], 0, len(seq)
        while at < n:
            state, j, end = 0, at, -1
            while j < n:
                c = seq[j]
                if symbol[state] == c:
                    state = to[state]
                else:
                    state = more[state][c]
                if first[state] >= j:
                    break
                end = first[state]
                j += 1
            if j == at:
                out.append((at, 1, 0))
                at += 1
            else:
                out.append((at, j - at, j - 1 - end))
                at = j
        return out


def z_values(s: list[int]) -> list[int]:
    """For each i the longest common prefix of s and s[i:]; z[0] = len(s)."""
    n = len(s)
    z = [0] * n
    if n:
        z[0] = n
    left = right = 0
    for i in range(1, n):
        k = min(right - i, z[i - left]) if i < right else 0
        while i + k < n and s[k] == s[i + k]:
            k += 1
        z[i] = k
        if i + k > right:
            left, right = i, i + k
    return z


def at_border(seq: list[int], before: int, border: int, end: int, least: int, found: dict[tuple[int, int], int]) -> None:
    """Main's algorithm: maximal repetitions of seq that touch or cross ``border`` and lie in seq[before:end].

    For each period, those with one period at least right of the border, then those with one left of it.
    """
    n, right, left = len(seq), end - border, border - before
    t, u = seq[before:border], seq[border:end]
    mark = [-1]
    ahead = z_values(u)  # how far u repeats itself from each place
    back = z_values(t[::-1] + mark + (t + u)[::-1])  # suffixes of t that end at each place of t + u, from the back
    onward = z_values(u + mark + t + u)  # prefixes of u that start at each place of t + u

    def keep(start: int, stop: int, p: int) -> None:
        if stop - start >= max(least, 2 * p) and (start == 0 or seq[start - 1] != seq[start - 1 + p]) and (stop == n or seq[stop] != seq[stop - p]):
            have = found.get((start, stop))
            if have is None or p < have:
                found[start, stop] = p

    for p in range(1, right + 1):
        more = ahead[p] if p < right else 0
        less = min(back[left + 1 + right - p], left) if left else 0  # common suffix of t and t + u[:p]
        if more + less >= p:
            keep(border - less, border + p + more, p)
    for p in range(1, left + 1):
        more = min(onward[right + 1 + left - p], right) if right else 0
        less = back[left + 1 + right + p] if p < left else 0  # common suffix of t and t[:-p]
        if more + less >= p:
            keep(border - p - less, border + more, p)


def runs_of(seq: list[int], least: int = LEAST) -> list[tuple[int, int, int]]:
    """(start, length, smallest period) of all runs of at least ``least`` letters and two periods, by start, then period."""
    n = len(seq)
    if n < max(least, 2):
        return []
    factors = Automaton(seq).factors(seq)
    found: dict[tuple[int, int], int] = {}
    for (_, short, _), (border, size, _) in zip([(0, 0, 0), *factors], [*factors, (n, 0, 0)], strict=True):
        if 2 * (short + size) >= least:  # a run that ends in this factor, or with the one before, is shorter than that
            at_border(seq, max(0, border - 2 * short - size), border, border + size, least, found)
    starts: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for (start, stop), p in found.items():
        starts[start].append((stop, p))
    for row in starts.values():
        row.sort()
    for border, size, distance in factors:
        if distance and size >= least + 2:
            stop_before = border + size - distance
            for at in range(border + 1, border + size - least):
                source = starts.get(at - distance)
                if source:
                    new = []
                    for stop, p in source:
                        if stop >= stop_before:
                            break
                        if (at, stop + distance) not in found:
                            found[at, stop + distance] = p
                            new.append((stop + distance, p))
                    if new:
                        starts[at] = sorted(starts.get(at, []) + new)
    return sorted((start, stop - start, p) for (start, stop), p in found.items())


def candidates(h: np.ndarray, text_of: np.ndarray, window: int) -> np.ndarray:
    """Which words lie in a window of ``window`` words that occurs twice or more in their text (by hash; copies of a hash count as equal)."""
    inside = np.zeros(len(h), bool)
    g = grams(h, window)
    if not len(g):
        return inside
    one_text = text_of[: len(g)] == text_of[window - 1 :]
    at = np.flatnonzero(one_text)
    key = mix(g[at] ^ mix(text_of[at].astype(np.uint64) + np.uint64(1)))
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(at), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    for k in range(window):
        inside[at[twice] + k] = True
    return inside


def text_runs(data: bytes, starts: np.ndarray, ends: np.ndarray, inside: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Runs of one text's words; ``inside`` marks the words that can lie in one."""
    at = np.flatnonzero(inside)
    if len(at) < least:
        return []
    out = []
    for part in np.split(at, np.flatnonzero(np.diff(at) > 1) + 1):
        if len(part) >= least:
            first, number = int(part[0]), defaultdict(count().__next__)
            seq = [number[data[a:b]] for a, b in zip(starts[part].tolist(), ends[part].tolist(), strict=True)]
            out += [(first + s, n, p) for s, n, p in runs_of(seq, least)]
    return out


RUN = T.ArrayType(T.StructType([T.StructField("start", T.LongType(), False), T.StructField("length", T.LongType(), False), T.StructField("period", T.LongType(), False)]), False)
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def periodic_runs(docs: DataFrame, least: int = LEAST, keep: str = "doc_id", text: str = "text") -> DataFrame:
    """keep, runs (by start, then period) and collapsed: the text's words without those that a run repeats, joined by one space."""
    docs = docs.select(keep, text)
    schema = T.StructType([docs.schema[keep], T.StructField("runs", RUN, False), T.StructField("collapsed", T.StringType(), False)])
    window = -(-least // 2)  # a run of ``least`` words, or of two periods, repeats this many at its period's distance

    def run(batches):
        for batch in batches:
            column = common.binary(batch.column(1))
            for a, b in common.slices(column, 1 << 20):
                raw, offs = flatten(column.slice(a, b - a))
                starts, ends, n_words = words(raw, offs)
                bounds = np.concatenate(([0], np.cumsum(n_words)))
                inside = candidates(word_hashes(raw, starts, ends), np.repeat(np.arange(b - a), n_words), window)
                line, to, stop = single_spaced(raw, starts, ends)
                held = np.add.reduceat(np.append(inside, False).astype(np.int64), np.minimum(bounds[:-1], len(inside))) if len(n_words) else []
                found, text = [], []
                for i in range(b - a):
                    x, y = int(bounds[i]), int(bounds[i + 1])
                    runs = text_runs(line, to[x:y], stop[x:y], inside[x:y], least) if y > x and held[i] >= least else []
                    found.append([{"start": s, "length": n, "period": p} for s, n, p in runs])
                    text.append(_collapsed(line, to[x:y], stop[x:y], runs))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(found, pa.list_(_RUN)), pa.array(text, pa.binary()).cast(pa.string())], names=schema.names)
            pa.default_memory_pool().release_unused()

    return docs.mapInArrow(run, schema)


def _collapsed(line: bytes, to: np.ndarray, stop: np.ndarray, runs: list[tuple[int, int, int]]) -> bytes:
    if not len(to):
        return b""
    if not runs:
        return line[int(to[0]) : int(stop[-1])]
    edge = np.zeros(len(to) + 1, np.int64)
    for start, n, p in runs:
        edge[start + p] += 1
        edge[start + n] -= 1
    kept = np.flatnonzero(np.cumsum(edge[:-1]) == 0)
    return b" ".join([line[a:b] for a, b in zip(to[kept].tolist(), stop[kept].tolist(), strict=True)])


def planted(docs: DataFrame) -> DataFrame:
    """doc_id and text with the query's periodic tails: where crc32 of the id is divisible by ten, words from ``a`` on repeat
    the ``p`` words there. A null id has no checksum and leaves its text alone."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    split = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    hot = docs.select("doc_id", "text", h.alias("h")).where("h % 10 = 0").withColumn("words", split).withColumn("n", F.size("words").cast("long"))
    hot = hot.withColumn("g", F.floor(F.col("h") / 10)).withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")).otherwise(0).cast("int"))
    hot = hot.withColumn("tail", (F.col("n") - F.col("a")).cast("int")).withColumn("p", (1 + F.floor(F.col("tail") / (3 + F.col("g") % 8))).cast("int"))
    unit = F.slice("words", F.col("a") + 1, F.col("p"))
    times = F.ceil(F.col("tail") / F.col("p")).cast("int")
    turned = F.concat(F.slice("words", F.lit(1), F.col("a")), F.slice(F.flatten(F.array_repeat(unit, times)), F.lit(1), F.col("tail")))
    hot = hot.select("doc_id", F.when(F.col("n") > 0, F.array_join(turned, " ")).otherwise(F.col("text")).alias("text"))
    return docs.select("doc_id", "text").where((h % 10 != 0) | h.isNull()).unionAll(hot)


def digests(found: DataFrame) -> DataFrame:
    """The query's columns from runs and collapsed texts, natively."""
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("l"), r["start"].alias("s"), r["period"].alias("p"))))
    lines = F.concat_ws("", F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))))
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        best["s"].alias("start"),
        (-best["l"]).alias("length"),
        best["p"].alias("period"),
        F.floor(F.lit(1000) * -best["l"] / best["p"]).alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed"), 256).alias("collapsed_sha256"),
    )


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(periodic_runs(planted(common.table(spark, sf_dir, "documents"))))
