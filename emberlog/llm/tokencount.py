"""Token counts (13): the whole-token shortcut for byte-level BPE files.

Merging is needed only for pre-tokens that are not one token already. ``Shortcut`` runs the merge
procedure once over every vocabulary string, on the driver, and keeps those that come out as their
own single id: a proof, as some strings of a vocabulary can't be reached by its merges. In the tasks
a pre-token that is one of them counts 1 by a dictionary lookup; only the rest is merged, and a
bounded memo remembers how many tokens it gave. The proven ids (four bytes each, as many as the file
has at most) are broadcast with the file.

Texts are cut before a white space that follows another character, where no pre-token spans, so
what a task holds beside its Arrow batch is bounded unless a text has no white space at all.
Special tokens inside texts are found first and count 1 each, as the library does by default.

Defined results: null text counts as empty (0 bytes, 0 tokens, not over the limit); an empty table gives
no rows; every row is counted on its own, so repeats, ties and null ids change nothing; further
columns of the table are not read, whatever their names.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from . import common
from .bpe import WHITE, Vocabulary, byte_letters, kept

STRETCH, MEMO_ENTRIES, LIMIT, NEVER = 1 << 14, 1 << 19, 1024, 1 << 62
BORDER = re.compile(f"(?<=[^{WHITE}])[ \\n\\t]")


class ByteLevel(Vocabulary):
    """Merges and special tokens of a byte-level BPE file without word ends."""

    def __init__(self, text: str):
        data = json.loads(text)
        model, vocab = data["model"], data["model"]["vocab"]
        if data["normalizer"] or data["pre_tokenizer"]["type"] != "ByteLevel" or data["pre_tokenizer"]["add_prefix_space"] or not data["pre_tokenizer"]["use_regex"]:
            raise ValueError("not a plain byte-level BPE file")
        if model["end_of_word_suffix"] or model["continuing_subword_prefix"] or model["ignore_merges"]:
            raise ValueError("this BPE model has word marks or ignores its merges")
        self.text, self.library = text, None
        self.unletter = {c: b for b, c in enumerate(byte_letters())}
        self.inner = [vocab[c] for c in byte_letters()]
        self.strings = {i: s for s, i in vocab.items()}
        self.merges = {(vocab[a], vocab[b]): (rank, vocab[a + b]) for rank, (a, b) in enumerate(model["merges"])}
        special = [t["content"] for t in data["added_tokens"]]
        self.specials = regex.compile("|".join(regex.escape(s) for s in sorted(special, key=len, reverse=True))) if special else None

        self.packed = {pair: rank << 20 | z for pair, (rank, z) in self.merges.items()}  # orders by rank, carries the result

    def merge(self, symbols: list[int]) -> list[int]:
        """Lowest rank first, leftmost first; after a merge only its two neighbours are looked up again."""
        if len(symbols) > 64:
            return super().merge(symbols)
        s, get = symbols, self.packed.get
        found = [get(pair, NEVER) for pair in itertools.pairwise(s)]
        while found:
            best = min(found)
            if best == NEVER:
                break
            i, new = found.index(best), best & 0xFFFFF
            s[i : i + 2] = [new]
            del found[i]
            if i:
                found[i - 1] = get((s[i - 1], new), NEVER)
            if i < len(found):
                found[i] = get((new, s[i + 1]), NEVER)
        return s

    def of_token(self, token: int) -> bytes:
        return bytes(map(self.unletter.__getitem__, self.strings[token]))

    def tokens(self, piece: bytes) -> list[int]:
        return self.merge([self.inner[b] for b in piece])


# -- fixed values: the pre-tokens of byte-level BPE files -----------------------------------------------------------------
ENDINGS = "'s|'t|'re|'ve|'m|'ll|'d"
ASCII_PIECES = re.compile(rf"{ENDINGS}| ?[A-Za-z]+| ?[0-9]+| ?[^A-Za-z0-9\t-\r ]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+")
PIECES = regex.compile(rf"{ENDINGS}| ?\p{{L}}+| ?\p{{N}}+| ?[^{WHITE}\p{{L}}\p{{N}}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+")


def whole_tokens(v: ByteLevel) -> np.ndarray:
    """Ids of the vocabulary strings that the merges rebuild as that one token and that can be a text's characters."""
    found = []
    for token in v.strings:
        piece = v.of_token(token)
        try:
            piece.decode()
        except UnicodeDecodeError:
            continue
        if v.tokens(piece) == [token]:
            found.append(token)
    return np.array(found, np.int32)


@functools.lru_cache(maxsize=2)
def _proven(text: str) -> np.ndarray:
    return whole_tokens(ByteLevel(text))


def stretches(text: str, size: int = STRETCH) -> Iterator[str]:
    """The text in parts of about ``size`` characters that no pre-token spans."""
    at = 0
    while len(text) - at > size:
        border = BORDER.search(text, at + size)
        if border is None:
            break
        yield text[at : border.start()]
        at = border.start()
    yield text[at:] if at else text


class Shortcut(dict):
    """Pre-token -> number of tokens. Proven whole tokens are there from the start; the rest is merged when asked for
    and remembered up to ``entries``."""

    def __init__(self, v: ByteLevel, whole: np.ndarray, entries: int = MEMO_ENTRIES):
        super().__init__()
        self.v, self.most, self.merged = v, len(whole) + entries, 0
        self.whole = dict.fromkeys((v.of_token(int(t)).decode() for t in whole), 1)
        self.update(self.whole)

    def __missing__(self, piece: str) -> int:
        n = len(self.v.tokens(piece.encode()))
        self.merged += 1
        if len(piece) <= 256:
            if len(self) >= self.most:
                self.clear()
                self.update(self.whole)
            self[piece] = n
        return n

    def pretokens(self, part: str) -> list[str]:
        """Scripts beyond Latin are split by the library, as versions of Unicode differ in what is a letter."""
        if part.isascii():
            return ASCII_PIECES.findall(part)
        if max(part) <= "ɏ":
            return PIECES.findall(part)
        if self.v.library is None:
            from tokenizers.pre_tokenizers import ByteLevel as Splitter

            self.v.library = Splitter(add_prefix_space=False, use_regex=True)
        return [part[a:b] for _, (a, b) in self.v.library.pre_tokenize_str(part)]

    def count(self, text: str) -> int:
        """Tokens of one whole text."""
        if self.v.specials is not None and "<" in text:
            parts = self.v.specials.split(text)
        else:
            parts = [text]
        n = len(parts) - 1
        for part in parts:
            for stretch in stretches(part):
                n += sum(map(self.__getitem__, self.pretokens(stretch)))
        return n


def read_file(path: str | None = None) -> str:
    """The tokenizer file's text, read on the driver."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    with open(path, encoding="utf-8") as f:
        return f.read()


def token_counts(docs: DataFrame, path: str | None = None, keep: str = "doc_id", text: str = "text", limit: int = LIMIT) -> DataFrame:
    """keep, n_bytes, n_tokens and over_limit of every whole text."""
    file = read_file(path)
    shared = docs.sparkSession.sparkContext.broadcast((file, _proven(file), hashlib.sha256(file.encode()).hexdigest()))
    docs = docs.select(keep, text)
    schema = T.StructType([docs.schema[keep], T.StructField("n_bytes", T.LongType(), False), T.StructField("n_tokens", T.LongType(), False), T.StructField("over_limit", T.BooleanType(), False)])

    def make(text: str) -> Shortcut:
        return Shortcut(ByteLevel(text), shared.value[1])

    def run(batches):
        counts = kept(shared.value[0], _maker(shared.value[2], make))
        for batch in batches:
            texts = batch.column(1)
            n = pa.array([counts.count(t) if t else 0 for t in map(pa.StringScalar.as_py, texts)], pa.int64())
            size = pc.fill_null(pc.binary_length(texts), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), size, n, pc.greater(n, limit)], names=schema.names)

    return docs.mapInArrow(run, schema)


_MAKERS: dict = {}


def _maker(key: str, make):
    """The same function object for the same file, so that a worker finds what it has built."""
    return _MAKERS.setdefault(key, make)


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(common.table(spark, sf_dir, "documents"))
