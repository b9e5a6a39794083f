"""BPE encoding and decoding (3): a bounded-lookahead streaming transducer.

A merge that needs symbols beyond the ones read so far can only change tokens to its left
through a chain of merges of increasing rank, each starting where the one before it starts.
``sufficient_lookahead`` computes the longest such chain from the merge list, so a token that
ends at least that many symbols before the end of what was read is stable. ``Transducer`` reads
symbols piece by piece, emits stable tokens and keeps only the rest: constant memory however
long a word is. Decoding maps ids to bytes and runs an incremental UTF-8 state machine.

Texts are split at white space into chunks, which no token spans; a bounded memo holds the ids
of chunks seen before. Null texts encode as empty ones (no ids); empty tables give empty
results; rows are independent, so ties, repeats and null ids change nothing.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import json
import unicodedata
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from . import common

WHITE = r"\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"  # Unicode white space
SEPARATORS = regex.compile(f"[{WHITE}]+")
ONLY_PYTHON_SPACE = regex.compile("[\x1c-\x1f]")
MEMO_ENTRIES = 3 << 16


def byte_letters() -> list[str]:
    """The printable stand-in for each byte: Latin-1 letters stand for themselves, others from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in own else chr(next(spare)) for b in range(256)]


class Vocabulary:
    """Merges, ids and pre-tokenisation of a word-end BPE file of the tokenizers library."""

    def __init__(self, text: str):
        data = json.loads(text)
        self.text, self.library = text, None
        model = data["model"]
        self.end = model["end_of_word_suffix"] or ""
        vocab: dict[str, int] = model["vocab"]
        letters = self.byte = byte_letters()
        self.unletter = {c: b for b, c in enumerate(letters)}
        self.inner = [vocab[c] for c in letters]
        self.final = [vocab[c + self.end] for c in letters]
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.strings = [""] * size
        for table in (vocab, self.special):
            for s, i in table.items():
                self.strings[i] = s
        self.parts: dict[int, tuple[int, int]] = {}
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, (a, b) in enumerate(model["merges"]):
            x, y, z = vocab[a], vocab[b], vocab[a + b]
            self.merges[(x, y)] = (rank, z)
            self.parts.setdefault(z, (x, y))
        split = next(p for p in data["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")["pattern"]["Regex"]
        self.pieces = regex.compile(split.replace(r"\s", WHITE))
        self.specials = regex.compile("|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True))) if self.special else None
        self.lookahead = self.sufficient_lookahead()

    def letters(self, piece: bytes) -> str:
        """The bytes of a pre-token as the file's letters."""
        return "".join(map(self.byte.__getitem__, piece))

    def pretokens(self, chunk: str) -> list[bytes]:
        """Normalised pre-tokens of a chunk. Scripts beyond Latin go through the library's own normaliser and splitter,
        as versions of Unicode differ in what counts as a letter."""
        if chunk.isascii():
            return [p.encode() for p in self.pieces.findall(chunk.lower())]
        if max(chunk) <= "\u024f":
            return [p.encode() for p in self.pieces.findall(folded(chunk))]
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_str(self.text)
        parts = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(chunk))
        return [bytes(map(self.unletter.__getitem__, p)) for p, _ in parts]

    def length(self, token: int) -> int:
        s = self.strings[token]
        return len(s) - len(self.end) if self.end and s.endswith(self.end) and len(s) > len(self.end) else len(s)

    def sufficient_lookahead(self) -> int:
        """Most symbols that a change at the end of the input can reach to the left.

        reach[x]: the longest chain whose last merge has x as its left token. A merge (x, y) extends
        chains that end at a token with which y starts, as the border then lies where y starts.
        """
        reach: dict[int, int] = {}
        for (x, y), _ in sorted(self.merges.items(), key=lambda m: m[1][0]):
            best, t = 0, y
            while True:
                best = max(best, reach.get(t, 0))
                if t not in self.parts:
                    break
                t = self.parts[t][0]
            reach[x] = max(reach.get(x, 0), best + self.length(x))
        return max(reach.values(), default=0) + 1  # and one symbol to know whether it ends its word

    def merge(self, symbols: list[int]) -> list[int]:
        """The BPE tokens of a symbol sequence: lowest rank first, leftmost first."""
        get = self.merges.get
        if len(symbols) <= 24:
            s = symbols
            while len(s) > 1:
                best, at = None, -1
                for i in range(len(s) - 1):
                    m = get((s[i], s[i + 1]))
                    if m is not None and (best is None or m < best):
                        best, at = m, i
                if best is None:
                    break
                s[at : at + 2] = [best[1]]
            return s
        n = len(symbols)
        s, left, right, alive = list(symbols), list(range(-1, n - 1)), list(range(1, n + 1)), [True] * n
        heap = [(m[0], i, m[1], s[i], s[i + 1]) for i in range(n - 1) if (m := get((s[i], s[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, new, a, b = heapq.heappop(heap)
            j = right[i]
            if not alive[i] or s[i] != a or j >= n or s[j] != b:
                continue
            s[i], alive[j] = new, False
            right[i] = right[j]
            if right[j] < n:
                left[right[j]] = i
            for p, q in ((left[i], i), (i, right[i])):
                if p >= 0 and q < n and (m := get((s[p], s[q]))) is not None:
                    heapq.heappush(heap, (m[0], p, m[1], s[p], s[q]))
        return [s[i] for i in range(n) if alive[i]]


class Transducer:
    """Symbols in, stable tokens out. One word at a time: feed(...), then finish()."""

    def __init__(self, vocabulary: Vocabulary, window: int = 4096):
        self.vocabulary = vocabulary
        self.limit = vocabulary.lookahead + max(window, vocabulary.lookahead)
        self.held = bytearray()

    def feed(self, piece: bytes) -> Iterator[int]:
        v = self.vocabulary
        for at in range(0, len(piece), self.limit):
            self.held += piece[at : at + self.limit]
            if len(self.held) > self.limit:
                stable = len(self.held) - v.lookahead
                end = 0
                for token in v.merge([v.inner[b] for b in self.held]):
                    if end + v.length(token) > stable:
                        break
                    end += v.length(token)
                    yield token
                del self.held[:end]

    def finish(self) -> list[int]:
        if not self.held:
            return []
        v = self.vocabulary
        symbols = [v.inner[b] for b in self.held]
        symbols[-1] = v.final[self.held[-1]]
        self.held.clear()
        return v.merge(symbols)


def folded(chunk: str) -> str:
    """NFC and lower case of Latin letters."""
    return unicodedata.normalize("NFC", chunk).lower()


def chunks(text: str) -> Iterable[str]:
    """The runs of a text without Unicode white space."""
    return [c for c in SEPARATORS.split(text) if c] if ONLY_PYTHON_SPACE.search(text) else text.split()


class Memo(dict):
    """Chunk without white space -> its ids as little-endian 32-bit words. Two generations of bounded size: what is
    asked for again outlives a full generation."""

    def __init__(self, entries: int = MEMO_ENTRIES):
        super().__init__()
        self.entries, self.older = entries, {}

    def compute(self, chunk: str) -> bytes:
        raise NotImplementedError

    def __missing__(self, chunk: str) -> bytes:
        out = self.older.get(chunk)
        if out is None:
            out = self.compute(chunk)
            if len(chunk) > 256:
                return out
        if len(self) >= self.entries:
            self.older = dict(self)
            self.clear()
        self[chunk] = out
        return out


class Encoder(Memo):
    """Chunk -> ids through the transducer."""

    def __init__(self, vocabulary: Vocabulary, entries: int = MEMO_ENTRIES):
        super().__init__(entries)
        self.vocabulary = vocabulary
        self.transducer = Transducer(vocabulary)

    def compute(self, chunk: str) -> bytes:
        return array("I", self._ids(chunk)).tobytes()

    def _ids(self, chunk: str) -> Iterator[int]:
        v, at = self.vocabulary, 0
        if "<" in chunk and v.specials:
            for m in v.specials.finditer(chunk):
                yield from self._plain(chunk[at : m.start()])
                yield v.special[m[0]]
                at = m.end()
        yield from self._plain(chunk[at:] if at else chunk)

    def _plain(self, chunk: str) -> Iterator[int]:
        if not chunk:
            return
        for piece in self.vocabulary.pretokens(chunk):
            yield from self.transducer.feed(piece)
            yield from self.transducer.finish()

    def encode(self, text: str | None) -> np.ndarray:
        """Token ids of a whole text as unsigned 32-bit integers."""
        return np.frombuffer(b"".join(map(self.__getitem__, chunks(text or ""))), "<u4")


class Decoder:
    """Ids to text, piece by piece: an incremental UTF-8 machine over the tokens' bytes.

    literal: tokens as the file spells them, joined by one space (what the library does for a file
    without a decoder). Otherwise the bytes that the tokens stand for, word ends as one space.
    """

    def __init__(self, vocabulary: Vocabulary, literal: bool = True):
        self.joint = b" " if literal else b""
        if literal:
            self.table = [s.encode() for s in vocabulary.strings]
        else:
            byte = {c: b for b, c in enumerate(byte_letters())}
            special, end = set(vocabulary.special), vocabulary.end
            self.table = []
            for s in vocabulary.strings:
                stop = bool(end) and s.endswith(end) and s not in special
                body = s[: -len(end)] if stop else s
                self.table.append(s.encode() if s in special else bytes(byte[c] for c in body) + b" " * stop)
        self.reset()

    def reset(self) -> None:
        self.machine = codecs.getincrementaldecoder("utf-8")("replace")
        self.begun = False

    def feed(self, ids: list[int]) -> str:
        if not ids:
            return ""
        data = self.joint.join(map(self.table.__getitem__, ids))
        if self.begun:
            data = self.joint + data
        self.begun = True
        return self.machine.decode(data)

    def finish(self) -> str:
        out = self.machine.decode(b"", final=True)
        self.reset()
        return out


_HERE: dict[str, dict] = {}


def kept(text: str, make):
    """What ``make`` builds from a tokenizer file, once for each worker process: later tasks find its memo filled."""
    key = hashlib.sha256(text.encode()).hexdigest()
    if key not in _HERE:
        _HERE.clear()
        _HERE[key] = {}
    if make not in _HERE[key]:
        _HERE[key][make] = make(text)
    return _HERE[key][make]


def vocabulary(text: str) -> Vocabulary:
    return kept(text, Vocabulary)


def encoder(text: str) -> Encoder:
    return Encoder(vocabulary(text))


def read_file(path: str | None = None) -> str:
    """The tokenizer file's text; read on the driver and broadcast (a file of a few MB)."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    with open(path, encoding="utf-8") as f:
        return f.read()


def digests(docs: DataFrame, path: str | None = None, keep: str = "doc_id", text: str = "text") -> DataFrame:
    """keep, n_tokens, ids_sha256, decoded_sha256 of every whole text: encoded, then decoded."""
    shared = docs.sparkSession.sparkContext.broadcast(read_file(path))
    docs = docs.select(keep, text)
    schema = T.StructType([docs.schema[keep], T.StructField("n_tokens", T.LongType(), False), T.StructField("ids_sha256", T.StringType(), False), T.StructField("decoded_sha256", T.StringType(), False)])

    def run(batches):
        v = vocabulary(shared.value)
        memo, decoder = kept(shared.value, encoder), Decoder(v)
        spelled = [b"%d" % i for i in range(len(v.strings))]
        for batch in batches:
            n, a, b = [], [], []
            for value in batch.column(1).to_pylist():
                ids = memo.encode(value)
                one, two, first = hashlib.sha256(), hashlib.sha256(), True
                for at in range(0, len(ids), 1 << 16):
                    part = ids[at : at + (1 << 16)].tolist()
                    one.update((b"" if first else b" ") + b" ".join(map(spelled.__getitem__, part)))
                    two.update(decoder.feed(part).encode())
                    first = False
                two.update(decoder.finish().encode())
                n.append(len(ids))
                a.append(one.hexdigest())
                b.append(two.hexdigest())
            if n:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(a), pa.array(b)], names=schema.names)

    return docs.mapInArrow(run, schema)


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(common.table(spark, sf_dir, "documents"))
