"""Chat formatting (2): budgeted, turn-aligned windows with masked repeats.

Each conversation is read once, sorted by turn. Running sums of turn tokens decide how many new
turns fit a window beside the leading system turn and a limited tail of earlier turns, which
each window repeats. Repeated turns carry no loss; every assistant text is a target once. A turn
that is larger than the budget gets a window of its own (``over_budget``). Memory is that of one window,
also where a single conversation holds most of the rows.

The template is ``<|im_start|>role<|im_sep|>text<|im_end|>``. Inside roles and texts a backslash
is doubled and every control string (of this and of other common templates) gets a backslash
after its first character, so no text can end its turn; ``unescape`` reverses both.

Defined results: null text and null role count as empty; null turns come first; equal turns are
ordered by role, then text, and repeated rows are turns of their own; rows without conv_id form
one conversation; columns beyond the four are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections import deque
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common
from .bpe import chunks, kept, read_file
from .packing import LibraryEncoder

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
CONTROL = (START, SEP, END, "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|endoftext|>", "<|startoftext|>")
_ESCAPE = re.compile("|".join(["\\\\", *(re.escape(c) for c in CONTROL)]))
_UNESCAPE = re.compile(r"\\(\\?)")
_TURN = re.compile(f"{re.escape(START)}(.*?){re.escape(SEP)}(.*?){re.escape(END)}", re.DOTALL)
BUDGET, HISTORY, OVERHEAD = 1024, 256, 4


def escape(text: str) -> str:
    return _ESCAPE.sub(lambda m: "\\\\" if m[0] == "\\" else f"{m[0][0]}\\{m[0][1:]}", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1", text)


def turn_words(text: str) -> int:
    """A counter without a tokenizer: words and a fixed share for the marks."""
    return len(text.split()) + OVERHEAD


class TurnTokens:
    """Tokens of a tokenizer file (its path on the driver; default as in ``bpe``) and a fixed share for the marks."""

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.shared, self.memo = spark.sparkContext.broadcast(read_file(path)), None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"memo": None}  # tasks find their worker's own

    def __call__(self, text: str) -> int:
        if self.memo is None:  # once for each task: the look-up hashes the whole file
            self.memo = kept(self.shared.value, LibraryEncoder)
        return sum(len(self.memo[c]) for c in chunks(text)) // 4 + OVERHEAD


WINDOW = [
    T.StructField("window", T.LongType(), False),
    T.StructField("formatted", T.StringType(), False),
    T.StructField("n_repeated", T.IntegerType(), False),
    T.StructField("n_new", T.IntegerType(), False),
    T.StructField("n_tokens", T.LongType(), False),
    T.StructField("over_budget", T.BooleanType(), False),
    T.StructField("loss", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])), False),
]


class Windows:
    """The windows of one conversation, turn by turn."""

    def __init__(self, budget: int, history: int, count=turn_words):
        self.budget, self.history, self.count = budget, history, count
        self.system: tuple[str, str, int] | None = None
        self.tail: deque[tuple[str, str, int]] = deque()
        self.tail_tokens = self.number = self.total = self.begun = 0
        self.new: list[tuple[str, str, int]] = []

    def _frame(self) -> int:
        return (self.system[2] if self.system else 0) + self.tail_tokens

    def add(self, role: str, text: str):
        """The window that is complete before this turn, if there is one."""
        turn = (role, text, self.count(text))
        out = None
        # total - begun: tokens of the new turns, as the difference of two running sums
        if self.new and self._frame() + self.total - self.begun + turn[2] > self.budget:
            out = self.flush()
        while self.tail and not self.new and self._frame() + turn[2] > self.budget:
            self.tail_tokens -= self.tail.popleft()[2]
        self.new.append(turn)
        self.total += turn[2]
        return out

    def flush(self) -> tuple:
        parts, loss, at = [], [], 0
        repeated = [*([self.system] if self.system else []), *self.tail]
        for i, (role, text, _) in enumerate([*repeated, *self.new]):
            head, body = f"{START}{escape(role)}{SEP}", escape(text)
            if i >= len(repeated) and role == "assistant":
                loss.append({"start": at + len(head), "end": at + len(head) + len(body)})
            parts.append(head + body + END)
            at += len(parts[-1])
        tokens = self._frame() + self.total - self.begun
        row = (self.number, "".join(parts), len(repeated), len(self.new), tokens, tokens > self.budget, loss)
        if self.number == 0 and self.new[0][0] == "system":
            self.system, rest = self.new[0], self.new[1:]
        else:
            rest = self.new
        for turn in rest:
            self.tail.append(turn)
            self.tail_tokens += turn[2]
        while self.tail and self.tail_tokens > self.history:
            self.tail_tokens -= self.tail.popleft()[2]
        self.number += 1
        self.new, self.begun = [], self.total
        return row


def windows(conversations: DataFrame, budget: int = BUDGET, history: int = HISTORY, count: Callable[[str], int] = turn_words) -> DataFrame:
    """conv_id and the columns of WINDOW; the windows of a conversation follow each other in one partition."""
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    schema = T.StructType([rows.schema["conv_id"], *WINDOW])
    names = schema.names
    kinds = [None, pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.bool_(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))]

    def run(batches):
        now, state, out, held, kind = None, None, [], 0, pa.int64()

        def ready():
            cols = list(zip(*out, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(c, k or kind) for c, k in zip(cols, kinds, strict=True)], names=names)

        for batch in batches:
            kind = batch.column(0).type
            for conv, role, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if state is None or conv != now:
                    if state is not None:
                        out.append((now, *state.flush()))
                    now, state = conv, Windows(budget, history, count)
                if (row := state.add(role, text)) is not None:
                    out.append((now, *row))
                    held += len(row[1])
                if held > 4 << 20 or len(out) > 4000:
                    if out:
                        yield ready()
                    out, held = [], 0
        if state is not None:
            out.append((now, *state.flush()))
        if out:
            yield ready()

    return rows.mapInArrow(run, schema)


def read_back(formatted: str, skip: int) -> list[tuple[str, str]]:
    """(role, text) of the turns of a window after its repeated ones."""
    return [(unescape(r), unescape(t)) for r, t in _TURN.findall(formatted)[skip:]]


def digests(formatted: DataFrame) -> DataFrame:
    """What ``windows`` says, read back from its text and masks; keeps its partitions, so it must follow it directly."""
    schema = T.StructType([formatted.schema["conv_id"], *[T.StructField(n, k, False) for n, k in (("n_turns", T.LongType()), ("turns_sha256", T.StringType()), ("loss_chars", T.LongType()), ("loss_sha256", T.StringType()), ("formatted_chars", T.LongType()), ("n_windows", T.LongType()))]])

    def run(batches):
        now, state, out, kind = None, None, [], pa.int64()

        def close():
            n, turns, chars, loss, total, count = state
            out.append((now, n, turns.hexdigest(), chars, loss.hexdigest(), total, count))

        def ready():
            cols = list(zip(*out, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, [kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()], strict=True)], names=schema.names)

        for batch in batches:
            kind = batch.column(0).type
            at = {n: batch.column(i).to_pylist() for i, n in enumerate(batch.schema.names)}
            for i, conv in enumerate(at["conv_id"]):
                if state is None or conv != now:
                    if state is not None:
                        close()
                    now, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
                text = at["formatted"][i]
                for role, said in read_back(text, at["n_repeated"][i]):
                    state[0] += 1
                    state[1].update(f"{role}\n{said}\n".encode())
                for span in at["loss"][i]:
                    target = unescape(text[span["start"] : span["end"]])
                    state[2] += len(target)
                    state[3].update(target.encode())
                state[4] += len(text)
                state[5] += 1
            if out:
                yield ready()
                out.clear()
        if state is not None:
            close()
            yield ready()

    return formatted.mapInArrow(run, schema)


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = common.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = spark.range(2).select(F.lit(-7).cast(rows.schema["conv_id"].dataType).alias("conv_id"), F.col("id").cast(rows.schema["turn"].dataType).alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    return digests(windows(rows.unionByName(said), count=TurnTokens(spark)))
