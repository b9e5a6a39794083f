"""Records that span lines, read in parallel: multi-line events, quoted CSV cells, JSON arrays.

Spark's text reader cuts files into splits and gives each split's lines in order. A *cutter* says which lines
begin a record. Where that depends on what came before (inside quotes, at which depth), a first pass
learns what each split does to the state and a fold over each file's splits gives the state at every
split's start. The second pass groups lines to records inside the splits. Records that touch a split's
border come out as fragments, which one small aggregate joins, however many splits they span. The result doesn't depend
on the split size.

Rows on the move: one for each split in the fold, two fragments for each split at the border, none of the
rest. Split states are broadcast while there are at most MOST_SPLITS of them; beyond that lines are joined with them
by a shuffle and sorted back into their order. A record longer than ``longest`` characters is cut and flagged,
so neither an unclosed quote nor a missing start can fill a task.
"""

from __future__ import annotations

import csv
import io
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

LONGEST, MOST_SPLITS = 1 << 20, 100_000


class Cutter:
    """What begins a record. ``stateful``: it takes the state (mode, depth, base) at the split's start to tell."""

    sep = "\n"
    stateful = False

    def flag(self) -> Column:
        """A native column of each line that the cutter wants: for a stateless one, whether it begins a record."""
        return F.lit(False)

    def effect(self, mode: int, lines: Iterator) -> tuple[int, int]:
        """The mode after these lines, and the change of depth."""
        raise TypeError("this cutter has no state")

    def base(self, first: str) -> int:
        return 0

    def begin(self, mode: int, depth: int, base: int, first: str | None) -> None:
        """A split starts."""

    def starts(self, lines: list, flags: list) -> list[bool]:
        """For each line whether it begins a record."""
        return flags

    def open(self) -> bool:
        """Whether the record at the end of what was read can go on."""
        return True

    def finish(self, text: str) -> str | None:
        """A whole record as it goes out; None leaves it out."""
        return text


class Begins(Cutter):
    """A record begins at each line that matches a pattern; other lines belong to the record before them."""

    def __init__(self, pattern: str):
        self.pattern = pattern

    def flag(self) -> Column:
        return F.col("value").rlike(self.pattern)


class Quoted(Cutter):
    """Rows of delimited text: a line ends a row unless it ends inside a quoted cell. Rows go out as JSON objects by the file's header.

    Quotes count only where a cell begins, doubled ones stand for one; what follows a closing quote belongs to the cell.
    """

    stateful = True

    def __init__(self, delimiter: str):
        self.delimiter, self.inside, self.names = delimiter, 0, []

    def flag(self) -> Column:
        return F.contains("value", F.lit('"'))

    def _after(self, line: str, inside: int) -> int:
        d, at = self.delimiter, 0
        if not inside and line.startswith('"'):
            inside, at = 1, 1
        while True:
            if inside:
                q = line.find('"', at)
                if q < 0:
                    return 1
                if line.startswith('""', q):
                    at = q + 2
                    continue
                inside, at = 0, q + 1
            cut = line.find(d, at)
            if cut < 0:
                return 0
            at = cut + len(d)
            if line.startswith('"', at):
                inside, at = 1, at + 1

    def effect(self, mode: int, lines: Iterator) -> tuple[int, int]:
        for line in lines:
            mode = self._after(line, mode)
        return mode, 0

    def begin(self, mode: int, depth: int, base: int, first: str | None) -> None:
        self.inside = mode
        self.header = (first or "").lstrip("\ufeff").rstrip("\r")
        self.names = [h.strip() for h in next(csv.reader([self.header], delimiter=self.delimiter), [])]

    def starts(self, lines: list, flags: list) -> list[bool]:
        out = []
        for line, quotes in zip(lines, flags, strict=True):
            out.append(not self.inside)
            if quotes:
                self.inside = self._after(line, self.inside)
        return out

    def open(self) -> bool:
        return bool(self.inside)

    def finish(self, text: str) -> str | None:
        text = text.rstrip("\r")
        if '"' in text:
            cells = next(csv.reader(io.StringIO(text, newline=""), delimiter=self.delimiter), [])
        else:
            cells = text.split(self.delimiter)
        if not any(map(str.strip, cells)):
            return None
        row: dict = dict(zip(self.names, cells, strict=False))
        if len(cells) > len(self.names):
            row["_extra"] = cells[len(self.names) :]
        return json.dumps(row, ensure_ascii=False)


class Braces(Cutter):
    """Objects of a JSON array (or of one object, or of several after each other): the file is read in pieces that end at ``}``."""

    sep = "}"
    stateful = True
    _MARKS = re.compile(r'\\.|["{}\[\]]', re.DOTALL)

    def __init__(self):
        self.mode = self.depth = self.at_base = 0

    def flag(self) -> Column:
        return F.lit(True)

    def _after(self, piece: str, mode: int) -> tuple[int, int]:
        depth = 0
        for m in self._MARKS.findall(piece):
            if m == '"':
                mode ^= 1
            elif not mode and m[0] != "\\":
                depth += 1 if m in "{[" else -1
        return mode, depth

    def effect(self, mode: int, lines: Iterator) -> tuple[int, int]:
        total = 0
        for piece in lines:
            mode, depth = self._after(piece, mode)
            total += depth - (not mode)
        return mode, total

    def base(self, first: str) -> int:
        return int(first.lstrip("\ufeff \t\r\n").startswith("["))

    def begin(self, mode: int, depth: int, base: int, first: str | None) -> None:
        self.mode, self.depth, self.at_base = mode, depth, base

    def starts(self, lines: list, flags: list) -> list[bool]:
        out = []
        for piece in lines:
            out.append(not self.mode and self.depth <= self.at_base)
            self.mode, change = self._after(piece, self.mode)
            self.depth += change
            if not self.mode and self.depth > self.at_base:
                self.depth -= 1  # the brace that ended the piece; else it is what follows the last object
        return out

    def open(self) -> bool:
        return bool(self.mode) or self.depth > self.at_base

    def finish(self, text: str) -> str | None:
        """The items of a record as the inside of a JSON array."""
        text = re.sub(r"^[\ufeff\s]*(?:\]\s*)?(?:\[|,)?\s*", "", text)
        mode, depth = self._after(text, 0)
        if mode or depth > 0:
            text += "}"
        elif depth < 0:
            text = re.sub(r"\]\s*$", "", text)
        return text if text.strip() else None


SPLIT = T.StructType([T.StructField("file", T.StringType()), T.StructField("block", T.LongType()), T.StructField("out0", T.IntegerType()), T.StructField("step0", T.LongType()), T.StructField("out1", T.IntegerType()), T.StructField("step1", T.LongType()), T.StructField("base", T.IntegerType()), T.StructField("first", T.StringType())])
STATE = T.StructType([T.StructField("file", T.StringType()), T.StructField("block", T.LongType()), T.StructField("mode", T.IntegerType()), T.StructField("depth", T.LongType()), T.StructField("base", T.IntegerType()), T.StructField("first", T.StringType())])
PART = T.StructType([T.StructField("file", T.StringType()), T.StructField("block", T.LongType()), T.StructField("line", T.LongType()), T.StructField("n_lines", T.LongType()), T.StructField("head", T.BooleanType()), T.StructField("last", T.BooleanType()), T.StructField("too_long", T.BooleanType()), T.StructField("value", T.StringType()), T.StructField("first", T.StringType())])


def _stretches(batch: pa.RecordBatch) -> Iterator[tuple[int, int]]:
    """Row ranges of a batch that come from one split."""
    file, block = batch.column(0), batch.column(1).to_numpy()
    n = len(block)
    new = np.ones(n, bool)
    if n > 1:
        new[1:] = (block[1:] != block[:-1]) | pc.not_equal(file.slice(1), file.slice(0, n - 1)).to_numpy(zero_copy_only=False)
    at = [*np.flatnonzero(new).tolist(), n]
    yield from zip(at[:-1], at[1:], strict=True)


def _effects(cutter: Cutter):
    """What each split does to both modes. Lines that can't change anything arrive as nulls."""

    def run(batches):
        key, row = None, None

        def out():
            return pa.RecordBatch.from_pylist([row], schema=_arrow(SPLIT))

        for batch in batches:
            for a, b in _stretches(batch):
                file, block = batch.column(0)[a].as_py(), batch.column(1)[a].as_py()
                if (file, block) != key:
                    if row:
                        yield out()
                    key, first = (file, block), batch.column(3)[a].as_py() if block == 0 else None
                    row = {"file": file, "block": block, "out0": 0, "step0": 0, "out1": 1, "step1": 0, "base": cutter.base(first) if first is not None else 0, "first": first}
                lines = batch.column(2).slice(a, b - a).drop_null().to_pylist()
                for k in "01":
                    mode, step = cutter.effect(row[f"out{k}"], iter(lines))
                    row[f"out{k}"], row[f"step{k}"] = mode, row[f"step{k}"] + step
        if row:
            yield out()

    return run


def _arrow(schema: T.StructType) -> pa.Schema:
    kinds = {T.StringType: pa.string(), T.LongType: pa.int64(), T.IntegerType: pa.int32(), T.BooleanType: pa.bool_()}
    return pa.schema([(f.name, kinds[type(f.dataType)]) for f in schema.fields])


def _fold(table: pa.Table) -> pa.Table:
    """The state at the start of each split of one file."""
    out, mode, depth, base, first = [], 0, 0, 0, None
    for row in sorted(table.to_pylist(), key=lambda r: r["block"]):
        if row["block"] == 0:
            base, first = row["base"], row["first"]
        out.append({"file": row["file"], "block": row["block"], "mode": mode, "depth": depth, "base": base, "first": first})
        depth += row[f"step{mode}"]
        mode = row[f"out{mode}"]
    return pa.Table.from_pylist(out, schema=_arrow(STATE))


def _parts(cutter: Cutter, loose: bool, longest: int):
    """Records that lie inside their split, or (``loose``) the fragments at its borders."""

    def run(batches):
        key, held, size, start, line, head, first = None, [], 0, 0, 0, True, None
        rows: list[tuple] = []

        def put(last: bool) -> None:
            nonlocal held, size
            fragment = head or (last and cutter.open())
            if held and fragment == loose:
                text = cutter.sep.join(held)
                cut = size > longest
                value = text[:longest] if cut else text
                if not loose:
                    value = cutter.finish(value)
                if value is not None:
                    rows.append((*key, start, count, head, last, cut, value, first if loose else None))
            held, size = [], 0

        def batch_of() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows, strict=True), _arrow(PART), strict=True)], schema=_arrow(PART))
            rows.clear()
            return out

        count = 0
        for batch in batches:
            for a, b in _stretches(batch):
                now = (batch.column(0)[a].as_py(), batch.column(1)[a].as_py())
                if now != key:
                    if key is not None:
                        put(True)
                    key, start, line, head, count = now, 0, 0, True, 0
                    first = batch.column(7)[a].as_py()
                    cutter.begin(batch.column(4)[a].as_py(), batch.column(5)[a].as_py(), batch.column(6)[a].as_py(), first)
                lines = batch.column(2).slice(a, b - a).to_pylist()
                for text, begins in zip(lines, cutter.starts(lines, batch.column(3).slice(a, b - a).to_pylist()), strict=True):
                    if begins:
                        put(False)
                        head, start, count = False, line, 0
                    if size <= longest:
                        held.append(text)
                    size += len(text) + len(cutter.sep) if held else 0
                    count += 1
                    line += 1
            if len(rows) >= 4096:
                yield batch_of()
        if key is not None:
            put(True)
        if rows:
            yield batch_of()

    return run


def _with_states(lines: DataFrame, states: DataFrame | None) -> DataFrame:
    if states is None:
        return lines.withColumns({"mode": F.lit(0), "depth": F.lit(0).cast("long"), "base": F.lit(0), "first": F.lit(None).cast("string")})
    if states.count() <= MOST_SPLITS:
        return lines.join(F.broadcast(states), ["file", "block"])  # the lines stream by in their order
    numbered = lines.withColumn("_row", F.monotonically_increasing_id())
    return numbered.join(states, ["file", "block"]).repartition("file", "block").sortWithinPartitions("file", "block", "_row").drop("_row")


def spanning(spark: SparkSession, path: str | list[str], cutter: Cutter, *, recursive: bool = False, longest: int = LONGEST) -> DataFrame:
    """value (one whole record), source (file name), file, block and line (its place), n_lines, too_long.

    Text before a file's first record goes out as a record of its own. Blank records go.
    """
    reader = spark.read.option("lineSep", cutter.sep).option("recursiveFileLookup", str(recursive).lower())
    lines = reader.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")
    states, crossing = None, True
    if cutter.stateful:
        seen = lines.select("file", "block", F.when(cutter.flag(), F.col("value")).alias("changes"), F.when(F.col("block") == 0, F.col("value")).alias("first"))
        states = seen.mapInArrow(_effects(cutter), SPLIT).groupBy("file").applyInArrow(_fold, STATE).persist()
        crossing = states.where("mode <> 0 OR depth > base").limit(1).count() > 0
    columns = ["file", "block", "value", "flag", "mode", "depth", "base", "first"]
    ready = _with_states(lines.withColumn("flag", cutter.flag()), states).select(*columns)
    whole = ready.mapInArrow(_parts(cutter, False, longest), PART)
    if crossing or not cutter.stateful:
        whole = whole.unionByName(_joined(ready.mapInArrow(_parts(cutter, True, longest), PART), cutter, longest))
    return whole.where(F.length(F.trim("value")) > 0).select("value", F.element_at(F.split("file", "/"), -1).alias("source"), "file", "block", "line", "n_lines", "too_long")


def _joined(parts: DataFrame, cutter: Cutter, longest: int) -> DataFrame:
    """Fragments to records: those that continue a record follow the one that began it."""
    place = Window.partitionBy("file").orderBy("block", "line")
    numbered = parts.withColumn("_record", F.sum(F.when(F.col("head"), 0).otherwise(1)).over(place))
    text = F.array_sort(F.collect_list(F.struct("block", "line", "value")))
    one = numbered.groupBy("file", "_record").agg(F.min(F.struct("block", "line")).alias("at"), F.sum("n_lines").alias("n_lines"), F.bool_or("too_long").alias("cut"), text.alias("text"), F.max("first").alias("first"))
    joined = F.array_join(F.transform("text", lambda p: p["value"]), cutter.sep)
    one = one.withColumn("joined", joined).select(
        "file", F.col("at.block").alias("block"), F.col("at.line").alias("line"), "n_lines", F.lit(False).alias("head"), F.lit(False).alias("last"),
        (F.col("cut") | (F.length("joined") > longest)).alias("too_long"), F.left("joined", F.lit(longest)).alias("value"), "first",
    )

    def finish(batches):
        for batch in batches:
            t = batch.to_pylist()
            for row in t:
                cutter.begin(0, 0, 0, row["first"])
                row["value"] = cutter.finish(row["value"])
            kept = [row for row in t if row["value"] is not None]
            if kept:
                yield pa.RecordBatch.from_pylist(kept, schema=_arrow(PART))

    return one.mapInArrow(finish, PART)
