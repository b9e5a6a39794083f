"""BPE, packing and chat windows: exact against the tokenizers library and exact round trips."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from emberlog.llm import bpe, chat, packing

V = bpe.Vocabulary(bpe.read_file())
LIBRARY = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
ENCODER, DECODER, PACKER = bpe.Encoder(V, entries=50), bpe.Decoder(V), packing.LibraryEncoder(bpe.read_file(), entries=50)
TEXT = st.text(st.characters(exclude_categories=["Cs"]), max_size=60) | st.text("ab'stre Σσİé\x1c\u2003ſ½<|endoftext|>!?\n", max_size=60)


def same(text):
    want = LIBRARY.encode(text, add_special_tokens=False).ids
    assert ENCODER.encode(text).tolist() == want
    assert DECODER.feed(want[:3]) + DECODER.feed(want[3:]) + DECODER.finish() == LIBRARY.decode(want, skip_special_tokens=False)
    chunks = [c for c in bpe.SEPARATORS.split(text) if c]
    assert np.frombuffer(b"".join(map(PACKER.__getitem__, chunks)), "<u4").tolist() == want


@settings(max_examples=300, deadline=None)
@given(TEXT)
def test_any_text(text):
    same(text)


@pytest.mark.parametrize("text", ["", "the<|endoftext|> Foo's <|startoftext|>x", "a" * 30_000, "".join(random.Random(1).choice("abcdeilnorst") for _ in range(40_000)), "ΑΣ ΣΑΣ", "x\x00y \x1fz"])
def test_long_and_special(text):
    same(text)


def test_transducer_keeps_bounded_memory():
    t = bpe.Transducer(V, window=64)
    rnd, most, out = random.Random(2), 0, []
    word = "".join(rnd.choice("abcdefghinorst") for _ in range(60_000)).encode()
    for at in range(0, len(word), 100):
        out += list(t.feed(word[at : at + 100]))
        most = max(most, len(t.held))
    out += t.finish()
    assert most <= 2 * t.limit and out == LIBRARY.encode(word.decode(), add_special_tokens=False).ids


def test_lookahead_is_enough_for_every_prefix():
    rnd = random.Random(4)
    for _ in range(60):
        word = "".join(rnd.choice("aeinrsth") for _ in range(V.lookahead + rnd.randint(50, 400))).encode()
        at = rnd.randint(V.lookahead + 1, len(word) - 1)
        a, b = V.merge([V.inner[x] for x in word[:at]]), V.merge([V.inner[x] for x in word])
        end = 0
        for x, y in zip(a, b):
            end += V.length(x)
            if end > at - V.lookahead:
                break
            assert x == y


def test_byte_decoder_round_trip():
    d = bpe.Decoder(V, literal=False)
    text = "naïve café 日本"
    ids = ENCODER.encode(text).tolist()
    assert "".join([d.feed([i]) for i in ids]) + d.finish() == text + " "


def test_bpe_rows(spark, docs_of, table_dir, awkward):
    got = bpe.op3_bpe(spark, table_dir(documents=docs_of(*awkward))).collect()
    want = []
    for i, t in awkward:
        ids = LIBRARY.encode(t or "", add_special_tokens=False).ids
        want.append((str(i), len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(LIBRARY.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert sorted((str(r["doc_id"]), *tuple(r)[1:]) for r in got) == sorted(want)


def test_packing_rows(spark, docs_of, table_dir, awkward):
    got = packing.op9_packing(spark, table_dir(documents=docs_of(*awkward))).collect()
    want = Counter()
    for i, t in awkward:
        ids = [*LIBRARY.encode(t or "", add_special_tokens=False).ids, 0]
        for p, k in enumerate(range(0, len(ids), 2048)):
            want[(i, p, k, len(ids[k : k + 2048]), zlib.crc32(np.array(ids[k : k + 2048], "<u4").tobytes()))] += 1
    assert Counter(tuple(r)[:5] for r in got) == want
    held = {}
    for r in got:
        held.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in held.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048


@pytest.mark.parametrize("seed", range(5))
def test_plans_are_whole_and_tight(seed):
    rnd = random.Random(seed)
    h = Counter(min(2048, max(1, int(rnd.expovariate(1 / rnd.choice((100, 600, 1500)))))) for _ in range(3000))
    bins = packing.plan(dict(h))
    seen = Counter()
    for b in bins:
        assert b.count > 0 and sum(b.lengths) <= 2048
        for n in b.lengths:
            seen[n] += b.count
    assert seen == h
    assert sum(b.count for b in bins) <= 1.02 * -(-sum(n * c for n, c in h.items()) // 2048) + 1 or max(h) > 1024
    assert packing.plan({}) == []


@settings(max_examples=200, deadline=None)
@given(st.text("\\<|im_start>sepnd/[INST]SY \n", max_size=40))
def test_escape_is_reversible(text):
    safe = chat.escape(text)
    assert chat.unescape(safe) == text
    assert not any(c in safe for c in chat.CONTROL)


def test_windows_keep_system_repeat_history_and_mask_repeats():
    w = chat.Windows(budget=40, history=15)
    turns = [("system", "be brief")] + [(("user", "assistant")[i % 2], f"turn {i} " + "w " * 6) for i in range(12)]
    out = [r for t in turns if (r := w.add(*t)) is not None] + [w.flush()]
    assert len(out) > 2 and all(r[1].startswith("<|im_start|>system") for r in out)
    assert all(r[4] <= 40 and not r[5] for r in out) and any(r[2] > 1 for r in out)
    assert [t for r in out for t in chat.read_back(r[1], r[2])] == turns
    assert [r[1][s["start"] : s["end"]] for r in out for s in r[6]] == [t for role, t in turns if role == "assistant"]


def test_chat_rows(spark, table_dir):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "</s>\\ <|im_end|>"), (1, 1, "assistant", "</s>\\ <|im_end|>"), (2, 0, None, None), (None, 5, "tool", "x"), (3, 0, "user", "long " * 5000), (3, 1, "assistant", "né"), (4, None, "assistant", "")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS window")
    got = {r["conv_id"]: r for r in chat.op2_chat_format(spark, table_dir(conversations=df)).collect()}
    assert set(got) == {1, 2, 3, 4, None, -7}
    for c in (1, 2, 3, 4, None):
        mine = [(r or "", t or "") for k, _, r, t in rows if k == c]
        loss = "".join(t for r, t in mine if r == "assistant")
        assert (got[c]["n_turns"], got[c]["turns_sha256"]) == (len(mine), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in mine).encode()).hexdigest())
        assert (got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert got[-7]["n_turns"] == 2 and got[-7]["loss_chars"] == 21 and got[3]["n_windows"] == 2


def test_turns_count_as_the_library_counts_them(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    count = chat.TurnTokens(spark)
    for text in ("", "Hello  there, World 123!", "\x1cna\u00efve caf\u00e9\u3000\u4f60\u597d", "<|endoftext|> x"):
        assert count(text) == len(whole.encode(text, add_special_tokens=False).ids) + chat.OVERHEAD
