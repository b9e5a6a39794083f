"""Vectorised byte-level text primitives: words, their hashes and positions, for many texts at once.

All arithmetic is modulo 2**64 on numpy arrays over the concatenated texts of a slice of rows;
boundaries come from offsets, never from content. Polynomial hashes (``prefix``, ``word_hashes``,
``grams``) can be made to collide, so they only choose candidates: equality is decided by
``numbered`` (the words or lines themselves) or by ``digests`` (128 bits of BLAKE2b).
"""

from __future__ import annotations

import itertools
from collections import defaultdict
from hashlib import blake2b

import numpy as np
import pyarrow as pa

BASE = 0x9E3779B97F4A7C15  # odd, so that it has an inverse modulo 2**64
_POWERS: list[tuple[np.ndarray, np.ndarray]] = []

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i for i up to n, kept between calls up to 4M entries."""
    have = _POWERS[0] if _POWERS else None
    if have is None or len(have[0]) < n + 1:
        size = max(n + 1, 1 << 18)
        a, b = np.full(size, BASE, np.uint64), np.full(size, pow(BASE, -1, 1 << 64), np.uint64)
        a[0] = b[0] = 1
        have = (np.multiply.accumulate(a), np.multiply.accumulate(b))
        if size <= 1 << 22:
            _POWERS[:] = [have]
    return have[0][: n + 1], have[1][: n + 1]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: makes all bits of a polynomial hash depend on each other."""
    x = x ^ (x >> np.uint64(32))
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def flatten(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts one after another (views Arrow's buffer), and n + 1 offsets."""
    wide = pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offs - offs[0]


def prefix(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(S, inverse powers): the hash of raw[i:j] is (S[j] - S[i]) * inverse[i]."""
    up, down = powers(len(raw))
    s = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[: len(raw)], out=s[1:])
    return s, down


def words(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of every text, and the number of words of each text."""
    keep = ~SPACE[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[offs] = True
    before = np.concatenate(([False], keep[:-1])) if len(keep) else keep
    starts = np.flatnonzero(keep & (~before | edge[: len(raw)]))
    after = np.concatenate((keep[1:], [False])) if len(keep) else keep
    ends = np.flatnonzero(keep & (~after | edge[1:])) + 1
    return starts, ends, np.diff(np.searchsorted(starts, offs))


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """One 64-bit hash for each word; equal words have equal hashes, the reverse can fail."""
    s, down = prefix(raw)
    return mix((s[ends] - s[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k consecutive word hashes (len(h) - k + 1 of them)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out *= np.uint64(BASE)
        out += h[j : j + n]
    return mix(out)


def digests(data: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The 128-bit BLAKE2b digest of each data[start:end], as two columns of 64 bits."""
    got = b"".join([blake2b(data[a:b], digest_size=16).digest() for a, b in zip(starts.tolist(), ends.tolist(), strict=True)])
    return np.frombuffer(got, "<u8").reshape(-1, 2)


def numbered(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A number for each raw[start:end]: equal numbers exactly where the bytes are equal."""
    data, number = raw.tobytes(), defaultdict(itertools.count().__next__)
    return np.fromiter([number[data[a:b]] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], np.int64, len(starts))


def single_spaced(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The words one after another with one space behind each, and where each starts and ends there."""
    size = ends - starts
    to = np.cumsum(size + 1) - size - 1
    line = np.full(int((size + 1).sum()), 0x20, np.uint8)
    letter = np.ones(len(line), bool)
    letter[to + size] = False
    line[letter] = raw[~SPACE[raw]]
    return line.tobytes(), to, to + size


def sums(values: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Sum of values over each range offs[i]:offs[i+1] (empty ranges give 0)."""
    total = np.concatenate(([0], np.cumsum(values, dtype=np.int64)))
    return total[offs[1:]] - total[offs[:-1]]


def slices_of(column: pa.Array, most: int = 1 << 20):
    """(first row, end row, bytes, offsets) for slices of about ``most`` bytes of a text column."""
    from .common import binary, slices

    column = binary(column)
    for a, b in slices(column, most):
        yield (a, b, *flatten(column.slice(a, b - a)))
