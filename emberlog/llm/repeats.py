"""Repeated text across a corpus: content-defined anchors bring equal windows together.

Both repeat operators (suffix-array and word-substring dedup) need every window of a fixed
length that also occurs elsewhere. A window's anchor is its leftmost smallest k-gram, a
function of the window's content alone, so equal windows share their anchor wherever they
stand. The plan:

1. scan     texts -> anchors with the run of windows each one stands for, the "region" those
            windows cover, and its digest (Arrow, numpy; no text is sent anywhere);
2. meet     anchors are dealt by hash in packed rows. Equal regions are one content: its later
            places repeat its first one. Anchors with two contents or more are open;
3. fetch    the first places of open contents are cut out of their texts, dealt by anchor, a hot
            anchor's in blocks of about MOST_CONTENTS;
4. resolve  per anchor (and block), the operator's own method decides which windows of the distinct
            contents repeat something earlier;
5. merge    windows that the blocks of a hot anchor leave unmarked meet by digest, as in 2;
6. apply    marked windows return to their texts.

No step holds more than a bounded slice of rows, pairs of copies are never made, and contents
are pre-aggregated before they are dealt (one place of each content for each slice). Anchors that
a bounded sample finds in many texts are hot from the start: their contents are dealt by content.
That only chooses how rows travel; every window meets its equals either way.

Contents are equal where 128 bits of BLAKE2b are; a text is known by 128 bits of SHA-256. Copies of a
whole text are answered by that text's row with the least id: rows with larger ids repeat it
throughout. Places are ordered by id, then by the text's hash (rows that share an id but not a
text), then by position; null ids come last.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common
from .textstats import digests, grams, mix, prefix, single_spaced, slices_of, word_hashes, words

NO_ID = (1 << 63) - 1
KEY = [T.StructField(n, T.LongType(), False) for n in ("_id", "_hash", "_more")]


@dataclass(frozen=True)
class Scan:
    """For each run of windows with one anchor: its text, first and last window (in units), anchor hash, region digest (two columns)."""

    text: np.ndarray
    first: np.ndarray
    last: np.ndarray
    anchor: np.ndarray
    digest: np.ndarray


def nothing() -> Scan:
    return Scan(*(np.zeros(0, np.int64),) * 3, np.zeros(0, np.uint64), np.zeros((0, 2), np.uint64))


def keyed(docs: DataFrame) -> DataFrame:
    """_id, _hash and _more: a row's identity, also where doc_id or text is null."""
    half = lambda at: F.conv(F.substring("_sha", at, 16), 16, -10).cast("long")
    out = docs.withColumn("_id", F.coalesce("doc_id", F.lit(NO_ID))).withColumn("_sha", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256))
    return out.withColumn("_hash", half(1)).withColumn("_more", half(17)).drop("_sha")


def _runs(g: np.ndarray, start_of: np.ndarray, text: np.ndarray, window: int, k: int) -> Scan:
    """g: k-gram hashes by unit; start_of: units where a window may start, ascending; text: of each of them."""
    span = window - k + 1
    low = np.uint64((1 << 24) - 1)
    key = (g & ~low) | np.arange(len(g), dtype=np.uint64)
    best, width = key, 1
    while width * 2 <= span:
        best = np.minimum(best[: len(best) - width], best[width:])
        width *= 2
    if width < span:
        best = np.minimum(best[: len(key) - span + 1], best[span - width : span - width + len(key) - span + 1])
    at = (best[start_of] & low).astype(np.int64)
    if not len(at):
        return nothing()
    turn = np.flatnonzero(np.concatenate(([True], (at[1:] != at[:-1]) | (start_of[1:] != start_of[:-1] + 1) | (text[1:] != text[:-1]))))
    end = np.concatenate((turn[1:], [len(at)])) - 1
    return Scan(text[turn], start_of[turn], start_of[end], g[at[turn]], np.zeros((0, 2), np.uint64))


def _window_starts(per: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, unit) of every window start; per: units of each text, laid one after another."""
    count = np.maximum(per - window + 1, 0)
    first = np.cumsum(per) - per
    text = np.repeat(np.arange(len(per)), count)
    return text, np.repeat(first - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))


def scan_bytes(raw: np.ndarray, offs: np.ndarray, window: int, k: int) -> Scan:
    """Anchors of all ``window``-byte windows inside the texts."""
    text, start = _window_starts(np.diff(offs), window)
    if not len(start):
        return nothing()
    s, down = prefix(raw)
    got = _runs(mix((s[k:] - s[:-k]) * down[: len(raw) - k + 1]), start, text, window, k)
    return replace(got, digest=digests(raw.tobytes(), got.first, got.last + window))


def scan_words(raw: np.ndarray, offs: np.ndarray, window: int, k: int) -> Scan:
    """Anchors of all windows of ``window`` words; places count words from the slice's start."""
    starts, ends, per = words(raw, offs)
    text, start = _window_starts(per, window)
    if not len(start):
        return nothing()
    h = word_hashes(raw, starts, ends)
    got = _runs(grams(h, k), start, text, window, k)
    line, begin, end = single_spaced(raw, starts, ends)
    first = np.cumsum(per) - per
    got = replace(got, digest=digests(line, begin[got.first], end[got.last + window - 1]))
    return replace(got, first=got.first - first[got.text], last=got.last - first[got.text])


MOST_UNITS = 1 << 20  # bytes of one text scanned at once; _runs packs places into 24 bits


def _pieces(raw: np.ndarray, offs: np.ndarray, overlap: int):
    """Slices of at most MOST_UNITS bytes: whole texts, or overlapping pieces of a single very long text.

    Yields (raw, offsets, index of the first text, bytes skipped at its start).
    """
    if len(raw) <= MOST_UNITS:
        yield raw, offs, 0, 0
        return
    step = MOST_UNITS - overlap
    for i in range(len(offs) - 1):
        a, b = int(offs[i]), int(offs[i + 1])
        if b - a <= MOST_UNITS:
            yield raw[a:b], np.array([0, b - a]), i, 0
            continue
        for at in range(a, max(a + 1, b - overlap), step):
            to = min(b, at + MOST_UNITS)
            yield raw[at:to], np.array([0, to - at]), i, at - a


def _joined(parts: list[Scan]) -> Scan:
    return Scan(*(np.concatenate([getattr(p, f) for p in parts]) for f in ("text", "first", "last", "anchor", "digest"))) if parts else nothing()


class Units:
    """How an operator counts: windows of bytes or of words, with k-gram anchors."""

    def __init__(self, window: int, k: int, by_words: bool):
        self.window, self.k, self.by_words = window, k, by_words

    def scan(self, raw: np.ndarray, offs: np.ndarray) -> Scan:
        """Runs of windows of whole texts; places count units from each text's start."""
        if self.by_words:
            if len(raw) < 1 << 24:
                return scan_words(raw, offs, self.window, self.k)
            parts = []
            for i in range(len(offs) - 1):  # very long texts: pieces of words that overlap by a window
                text = raw[offs[i] : offs[i + 1]]
                starts, ends, _ = words(text, np.array([0, len(text)]))
                step = 1 << 20
                for w in range(0, max(1, len(starts) - self.window + 1), step):
                    to = min(len(starts), w + step + self.window - 1)
                    if to > w:
                        piece = text[starts[w] : ends[to - 1]]
                        got = scan_words(piece, np.array([0, len(piece)]), self.window, self.k)
                        parts.append(replace(got, text=got.text + i, first=got.first + w, last=got.last + w))
            return _joined(parts)
        parts = []
        for r, o, i, skip in _pieces(raw, offs, self.window - 1):
            got = scan_bytes(r, o, self.window, self.k)
            parts.append(replace(got, text=got.text + i, first=got.first - o[got.text] + skip, last=got.last - o[got.text] + skip))
        return _joined(parts)

    def units(self, text: bytes):
        """The text's units: bytes themselves, or its list of words."""
        return text.split() if self.by_words else text

    def content(self, units, a: int, b: int) -> bytes:
        return b" ".join(units[a:b]) if self.by_words else units[a:b]

    def windows(self, contents: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(index of the content, start in units, digest) of every window of contents that ``content`` gave."""
        raw = np.frombuffer(b"".join(contents), np.uint8)
        offs = np.concatenate(([0], np.cumsum(np.fromiter(map(len, contents), np.int64, len(contents)))))
        begin, end, per = words(raw, offs) if self.by_words else (np.arange(len(raw)), np.arange(1, len(raw) + 1), np.diff(offs))
        text, at = _window_starts(per, self.window)
        return text, at - (np.cumsum(per) - per)[text], digests(raw.tobytes(), begin[at], end[at + self.window - 1])


def buckets(docs: DataFrame, each: int = 16 << 20, least: int = 128) -> int:
    """Packed rows are dealt to so many buckets: about ``each`` bytes of text stand behind one."""
    return max(least, -(-common.table_bytes(docs) // each))


PARTS = ("docs", "per", "anchor", "digest", "first", "size")
KINDS = dict(zip(PARTS, ("<i8", "<u4", "<u8", "<u8", "<u4", "u1"), strict=True))
PACKED = T.StructType([T.StructField("bucket", T.LongType()), T.StructField("known", T.BooleanType()), *[T.StructField(n, T.BinaryType()) for n in PARTS]])
MET = T.StructType([*KEY, T.StructField("marks", T.BinaryType()), T.StructField("wanted", T.BinaryType())])
MARK = np.dtype([("first", "<u4"), ("last", "<u4")])
WANT = np.dtype([("first", "<u4"), ("last", "<u4"), ("anchor", "<u8"), ("blocks", "<u4")])
MOST_CONTENTS = 1000  # contents of an anchor that are resolved together


def _groups(*keys: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal keys (already sorted)."""
    if not len(keys[0]):
        return np.zeros(0, np.int64)
    turn = np.zeros(len(keys[0]), bool)
    turn[0] = True
    for k in keys:
        turn[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(turn)


def _first_of_group(group: np.ndarray, n: int) -> np.ndarray:
    """For each of n sorted rows the start of its group."""
    return np.repeat(group, np.diff(np.concatenate((group, [n]))))


def _row(bucket: int, known: bool, key: np.ndarray, got: Scan) -> tuple:
    """One packed row: the texts' keys, entries of each, and the entries in columns (no anchors: the digest stands for them)."""
    turn = _groups(got.text)
    per = np.diff(np.concatenate((turn, [len(got.text)]))).astype("<u4")
    docs = key[got.text[turn]].astype("<i8")
    return (bucket, known, docs.tobytes(), per.tobytes(), *((None, None) if known else (None if got.anchor is None else got.anchor.tobytes(), got.digest.tobytes())), got.first.astype("<u4").tobytes(), (got.last - got.first).astype("u1").tobytes())


def _take(got: Scan, at: np.ndarray) -> Scan:
    return Scan(*(None if getattr(got, f) is None else getattr(got, f)[at] for f in ("text", "first", "last", "anchor", "digest")))


def packed_rows(got: Scan, key: np.ndarray, n_buckets: int, by_document: bool, hot: np.ndarray) -> list[tuple]:
    """Packed rows of some scans. Of a content met twice here only the first place is dealt by anchor (by content, if it's hot)."""
    ids, hashes = key[got.text, 0], key[got.text, 1]
    one, two = got.digest[:, 0], got.digest[:, 1]
    order = np.lexsort((got.first, hashes, ids, two, one))
    lead = order[_first_of_group(_groups(one[order], two[order]), len(order))]
    later = lead != order
    if by_document:
        later &= ids[order] > ids[lead]
    out = []
    for known, rows in ((True, np.sort(order[later])), (False, np.sort(order[~later]))):
        if not len(rows):
            continue
        to = mix(hashes[rows].astype(np.uint64)) if known else one[rows] if got.anchor is None else np.where(np.isin(got.anchor[rows], hot), one[rows], got.anchor[rows])
        to = (to % np.uint64(n_buckets)).astype(np.int64)
        by = np.argsort(to, kind="stable")
        turn = _groups(to[by])
        for x, y in zip(turn.tolist(), [*turn[1:].tolist(), len(by)], strict=True):
            out.append(_row(int(to[by[x]]), known, key, _take(got, rows[by[x:y]])))
    return out


def packed_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.bool_(), *[pa.binary()] * len(PARTS)]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=PACKED.names)


def meeting(by_document: bool, hot: dict[int, int]):
    """The function of one bucket of packed rows: sure marks, and wanted regions of open anchors. hot: blocks of the hot anchors."""
    hot_anchors = np.array(sorted(hot), np.uint64)
    hot_blocks = np.array([hot[a] for a in sorted(hot)], np.int64)

    def meet(rows: pa.Table) -> pa.Table:
        flag = rows.column("known").to_numpy(zero_copy_only=False)
        col = {n: rows.column(n).to_pylist() for n in PARTS}

        def read(known: bool) -> dict[str, np.ndarray]:
            at = np.flatnonzero(flag == known)
            out = {n: np.frombuffer(b"".join(col[n][i] or b"" for i in at), KINDS[n]) for n in PARTS}
            out["key"] = np.repeat(out.pop("docs").reshape(-1, 3), out.pop("per"), axis=0)
            out["digest"] = out["digest"].reshape(-1, 2)
            return out

        o, k = read(False), read(True)
        one, two = o["digest"][:, 0], o["digest"][:, 1]
        anchor = o["anchor"] if len(o["anchor"]) else one
        order = np.lexsort((o["key"][:, 0], o["first"], o["key"][:, 2], o["key"][:, 1], two, one))
        order = order[_groups(one[order], two[order], o["key"][order, 1], o["key"][order, 2], o["first"][order])]  # copies of a text: the least id
        order = order[np.lexsort((o["first"][order], o["key"][order, 1], o["key"][order, 0], two[order], one[order], anchor[order]))]
        ids = o["key"][order, 0]
        groups = _groups(anchor[order], one[order], two[order])
        lead = _first_of_group(groups, len(order))
        later = ids > ids[lead] if by_document else lead != np.arange(len(order))
        by_anchor = _groups(anchor[order])
        contents = np.diff(np.concatenate((np.searchsorted(groups, by_anchor), [len(groups)])))
        blocks = np.repeat(-(-contents // MOST_CONTENTS) * (contents > 1), np.diff(np.concatenate((by_anchor, [len(order)]))))
        if len(hot_anchors) and len(order):
            at = np.minimum(np.searchsorted(hot_anchors, anchor[order]), len(hot_anchors) - 1)
            blocks = np.where(hot_anchors[at] == anchor[order], hot_blocks[at], blocks)
        out: dict[tuple, list] = {}

        def put(column: int, kind: np.dtype, key: np.ndarray, first: np.ndarray, size: np.ndarray, **more: np.ndarray) -> None:
            by = np.lexsort((first, key[:, 2], key[:, 1], key[:, 0]))
            entry = np.empty(len(by), kind)
            entry["first"], entry["last"] = first[by], first[by].astype(np.int64) + size[by]
            for name, values in more.items():
                entry[name] = values[by]
            key = key[by]
            turn = _groups(key[:, 0], key[:, 1], key[:, 2])
            for x, y in zip(turn.tolist(), [*turn[1:].tolist(), len(by)], strict=True) if len(by) else ():
                out.setdefault(tuple(key[x].tolist()), [None, None])[column] = entry[x:y].tobytes()

        mark = order[later]
        put(0, MARK, np.concatenate((o["key"][mark], k["key"])), np.concatenate((o["first"][mark], k["first"])), np.concatenate((o["size"][mark], k["size"])))
        pick = (blocks > 0) & ~later
        want = order[pick]
        put(1, WANT, o["key"][want], o["first"][want], o["size"][want], anchor=anchor[want], blocks=blocks[pick])
        keys = np.array(list(out), np.int64).reshape(-1, 3)
        return pa.table([*(pa.array(keys[:, i]) for i in range(3)), *(pa.array([v[i] for v in out.values()], pa.binary()) for i in (0, 1))], names=MET.names)

    return meet


def scanned(units: Units):
    """An Arrow function: of copies of a text in a batch the least id, in slices (key, scan) of bounded size."""

    def scan(batch: pa.RecordBatch):
        key = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)], 1)
        order = np.lexsort((key[:, 0], key[:, 2], key[:, 1]))
        once = np.sort(order[_groups(key[order, 1], key[order, 2])])
        key, texts = key[once], batch.column(3).take(pa.array(once))
        parts, held = [], 0
        for a, _, raw, offs in slices_of(texts):
            got = units.scan(raw, offs)
            parts.append(replace(got, text=got.text + a))
            held += len(got.text)
            if held > 120_000:
                yield key, _joined(parts)
                parts, held = [], 0
        if held:
            yield key, _joined(parts)

    return scan


SAMPLE, MOST_HOT = 8000, 1000


def hot_anchors(docs: DataFrame, units: Units) -> dict[int, int]:
    """Anchors of many texts, with the blocks to deal their contents in, by a sample of about SAMPLE texts of at most 1 MB.

    Only the way of these anchors' rows depends on it, never a result.
    """
    total = docs.agg(F.count("*").alias("n")).first()["n"]
    some = docs.select("_id", "_hash", "_more", "text").where(F.octet_length("text") <= 1 << 20).sample(fraction=min(1.0, SAMPLE / max(total, 1)), seed=5)
    scan = scanned(units)

    def anchors(batch: pa.RecordBatch):
        for key, got in scan(batch):
            pair = np.stack((got.text.astype(np.uint64), got.anchor), 1)
            found, texts = np.unique(np.unique(pair, axis=0)[:, 1], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(texts)], names=["anchor", "texts"])

    schema = T.StructType([T.StructField("anchor", T.LongType()), T.StructField("texts", T.LongType())])
    counts = common.arrow_map(some, anchors, schema).groupBy("anchor").agg(F.sum("texts").alias("texts"))
    scale = max(1.0, total / SAMPLE)
    top = counts.where(F.col("texts") >= max(16, 2 * MOST_CONTENTS / scale)).orderBy(F.desc("texts"), "anchor").limit(MOST_HOT).collect()
    return {r["anchor"] % (1 << 64): -(-int(r["texts"] * scale) // MOST_CONTENTS) for r in top}


def met_anchors(docs: DataFrame, units: Units, by_document: bool) -> DataFrame:
    """(_id, _hash, _more, marks, wanted): windows that repeat for sure, and regions of open anchors."""
    texts = docs.select("_id", "_hash", "_more", "text")
    n_buckets, hot, scan = buckets(docs), hot_anchors(texts, units), scanned(units)
    names = np.array(sorted(hot), np.uint64)

    def pack(batch: pa.RecordBatch):
        for key, got in scan(batch):
            yield packed_batch(packed_rows(got, key, n_buckets, by_document, names))

    return met(common.arrow_map(texts, pack, PACKED), by_document, hot)


def met(packed: DataFrame, by_document: bool, hot: dict[int, int]) -> DataFrame:
    meet = meeting(by_document, hot)
    return packed.groupBy("bucket").applyInArrow(lambda t: meet(t), MET)


REGION = T.StructType([*[T.StructField(n, T.LongType(), False) for n in ("anchor", "block", "blocks")], *KEY, T.StructField("first", T.LongType(), False), T.StructField("content", T.BinaryType(), False)])


def regions(docs: DataFrame, met: DataFrame, units: Units) -> DataFrame:
    """The wanted regions, cut out of their texts; those of a hot anchor with the block they fall in."""
    wanted = met.where("wanted IS NOT NULL").groupBy("_id", "_hash", "_more").agg(F.collect_list("wanted").alias("wanted"))

    def fetch(batch: pa.RecordBatch):
        key = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)], 1)
        texts, packed = common.binary(batch.column(3)), batch.column(4).to_pylist()
        who, entries, contents, held = [], [], [], 0

        def flush() -> pa.RecordBatch:
            e, k = np.concatenate(entries), key[np.array(who)]
            blocks = e["blocks"].astype(np.int64)
            block = (mix(k[:, 1].astype(np.uint64) + e["first"]) % blocks.astype(np.uint64)).astype(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(e["anchor"].astype(np.int64)), pa.array(block), pa.array(blocks), *(pa.array(k[:, i]) for i in range(3)), pa.array(e["first"].astype(np.int64)), pa.array(contents, pa.binary())], names=REGION.names)

        for i in range(batch.num_rows):
            text = units.units(texts[i].as_py())
            e = np.frombuffer(b"".join(packed[i]), WANT)
            e = e[np.argsort(e["first"], kind="stable")]
            entries.append(e)
            who.extend([i] * len(e))
            for first, last in zip(e["first"].tolist(), e["last"].tolist(), strict=True):
                contents.append(units.content(text, first, last + units.window))
                held += len(contents[-1])
            if held > 4 << 20:
                yield flush()
                who, entries, contents, held = [], [], [], 0
        if who:
            yield flush()

    # repeated rows (same id, same text) give equal regions of equal places: harmless
    return common.arrow_map(docs.select("_id", "_hash", "_more", "text").join(wanted, ["_id", "_hash", "_more"]), fetch, REGION)


#: resolve(contents, ids, hashes, firsts) -> (index of the content, first window, last window): one entry for each run of
#: windows that repeats something earlier than the content's place (id, hash, first)
Resolve = Callable[[list[bytes], np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]
SOLVED = T.StructType([*[T.StructField(f.name, f.dataType) for f in KEY], T.StructField("marks", T.BinaryType()), *PACKED.fields])


def resolved(rows: DataFrame, units: Units, resolve: Resolve, by_document: bool, n_buckets: int, most: int = 1 << 20) -> DataFrame:
    """Marks of the regions' windows that repeat something earlier, and packed rows of what hot anchors' blocks leave unmarked.

    An anchor's block holds about MOST_CONTENTS contents, so what is held grows with ``most`` and that number only.
    """
    rows = rows.repartition("anchor", "block").sortWithinPartitions("anchor", "block")
    names, n_key = SOLVED.names, len(KEY)

    def solve(t: pa.Table):
        key = np.stack([t.column(n).to_numpy() for n in ("_id", "_hash", "_more")], 1)
        first, contents = t.column("first").to_numpy(), t.column("content").to_pylist()
        who, a, b = resolve(contents, key[:, 0], key[:, 1], first)
        if len(who):
            mark = np.empty(len(who), MARK)
            mark["first"], mark["last"] = first[who] + a, first[who] + b
            by = np.lexsort(key[who].T[::-1])
            mark, k = mark[by], key[who[by]]
            turn = _groups(*k.T)
            packed = [mark[x:y].tobytes() for x, y in zip(turn.tolist(), [*turn[1:].tolist(), len(by)], strict=True)]
            nothing_else = [pa.nulls(len(turn), kind) for kind in (pa.int64(), pa.bool_(), *[pa.binary()] * len(PARTS))]
            yield pa.RecordBatch.from_arrays([*(pa.array(k[turn, i]) for i in range(n_key)), pa.array(packed, pa.binary()), *nothing_else], names=names)
        hot = np.flatnonzero(t.column("blocks").to_numpy() > 1)
        if len(hot):
            text, at, digest = units.windows([contents[i] for i in hot])
            gone = {}
            for c, x, y in zip(who.tolist(), a.tolist(), b.tolist(), strict=True):
                gone.setdefault(c, []).append((x, y))
            left = np.ones(len(at), bool)
            begin = np.searchsorted(text, np.arange(len(hot)))
            for n, c in enumerate(hot.tolist()):
                for x, y in gone.get(c, ()):
                    left[begin[n] + x : begin[n] + y + 1] = False
            text, at, digest = text[left], at[left], digest[left]
            got = Scan(hot[text], first[hot[text]] + at, first[hot[text]] + at, None, digest)
            batch = packed_batch(packed_rows(got, key, n_buckets, by_document, np.zeros(0, np.uint64)))
            yield pa.RecordBatch.from_arrays([*[pa.nulls(len(batch), pa.int64())] * n_key, pa.nulls(len(batch), pa.binary()), *batch.columns], names=names)

    def run(batches):
        held, size = [], 0
        for batch in batches:  # sorted: all but the last block are complete
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                held.append(part)
                size += part.nbytes
                if size < most:
                    continue
                t = pa.Table.from_batches(held)
                anchor, block = t.column("anchor").to_numpy(), t.column("block").to_numpy()
                to = len(t) - int(np.argmax(((anchor != anchor[-1]) | (block != block[-1]))[::-1]))
                if anchor[0] == anchor[-1] and block[0] == block[-1]:
                    to = 0
                if to:
                    yield from solve(t.slice(0, to))
                held = t.slice(to).to_batches()
                size = sum(b.nbytes for b in held)
        if held and sum(b.num_rows for b in held):
            yield from solve(pa.Table.from_batches(held))

    return rows.mapInArrow(run, SOLVED)


def answers(docs: DataFrame, units: Units, resolve: Resolve, by_document: bool) -> DataFrame:
    """(_hash, _more, _least, marks) of every distinct text: its least id and that row's packed marks."""
    spark = docs.sparkSession
    found = common.cut(met_anchors(docs, units, by_document))
    common.release(spark)
    solved = common.cut(resolved(regions(docs, found, units), units, resolve, by_document, 8 * buckets(docs)))
    common.release(spark)
    merged = met(solved.where("bucket IS NOT NULL").select(*PACKED.names), by_document, {})
    marks = [df.where("marks IS NOT NULL").select(*[f.name for f in KEY], "marks") for df in (found, solved, merged)]
    texts = docs.groupBy("_hash", "_more").agg(F.min("_id").alias("_least"))
    every = marks[0].unionAll(marks[1]).unionAll(marks[2])
    packed = texts.withColumnRenamed("_least", "_id").join(every, ["_id", "_hash", "_more"]).groupBy("_hash", "_more").agg(F.collect_list("marks").alias("marks"))
    return common.cut(texts.join(packed, ["_hash", "_more"], "left"))


def with_marks(docs: DataFrame, found: DataFrame) -> DataFrame:
    """keyed docs with _marks: null (nothing repeats), packed marks, or an empty list (every window repeats)."""
    joined = docs.join(found, ["_hash", "_more"])
    return joined.withColumn("_marks", F.when(F.col("_id") > F.col("_least"), F.array().cast("array<binary>")).otherwise(F.col("marks"))).drop("_id", "_hash", "_more", "_least", "marks")


def covered(marks: list[bytes], window: int, n: int) -> np.ndarray:
    """Which of n units the marked windows cover; no marks at all: every window is marked."""
    if not marks:
        return np.full(n, n >= window)
    m = np.frombuffer(b"".join(marks), MARK).astype([("first", "<i8"), ("last", "<i8")])
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, m["first"], 1)
    np.add.at(step, m["last"] + window, -1)
    return np.cumsum(step[:n]) > 0
