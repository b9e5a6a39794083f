"""Burrows-Wheeler transform and threshold-bounded interval expansion.

Common-prefix boundaries are derived by increasing value: starting from the interval of the
empty string, every interval is extended backward by each character that precedes it, and the
right end of an extension that no shorter string has ended before gets the current length.
Expansion stops at the minimum length, so what is left unbounded are rows of the transform
whose neighbours share at least that many characters.
"""

from __future__ import annotations

import numpy as np


def suffix_order(t: np.ndarray, depth: int) -> np.ndarray:
    """Starts of the suffixes of t (codes from 0) ordered by their first ``depth`` characters or more."""
    n = len(t)
    bits = max(1, int(t.max()).bit_length())
    step = max(1, 63 // bits)
    key = np.zeros(n, np.int64)
    padded = np.concatenate((t.astype(np.int64), np.zeros(step, np.int64)))
    for j in range(step):
        key = (key << bits) | padded[j : j + n]
    order = np.argsort(key, kind="stable")
    while True:
        ranked = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.concatenate(([0], ranked[1:] != ranked[:-1])))
        if step >= depth or rank[order[-1]] == n - 1:
            return order
        later = np.full(n, 0, np.int64)
        later[: n - step] = rank[step:] + 1
        key = rank * (n + 1) + later
        order = np.argsort(key, kind="stable")
        step *= 2


def boundaries(t: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """For each row r (and n): whether it shares fewer than ``length`` characters with row r - 1."""
    n = len(t)
    before = t[order - 1]  # the transform; the first suffix wraps round to the last character
    source = np.argsort(before, kind="stable")  # row of the extension -> row it extends
    lf = np.empty(n, np.int64)
    lf[source] = np.arange(n)
    head = before[source]
    last_of_char = np.concatenate((head[1:] != head[:-1], [True]))
    first_of_char = np.concatenate(([True], head[1:] != head[:-1]))
    up = np.concatenate((source[1:], [n]))  # source of the next extension
    down = np.concatenate(([-1], source[:-1]))
    bound = np.zeros(n + 1, bool)
    bound[0] = bound[n] = True
    low, high = np.array([0]), np.array([n])
    for _ in range(length):
        size = high - low
        rows = np.repeat(low - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        to = lf[rows]
        lows, highs = np.repeat(low, size), np.repeat(high, size)
        ends = np.sort(to[last_of_char[to] | (up[to] >= highs)]) + 1
        starts = np.sort(to[first_of_char[to] | (down[to] < lows)])
        fresh = ~bound[ends]
        low, high = starts[fresh], ends[fresh]
        bound[high] = True
        if not len(low):
            break
    return bound


def equal_windows(contents: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(class, index of the content, start) of every ``length``-byte window that occurs twice or more."""
    sizes = np.fromiter(map(len, contents), np.int64, len(contents))
    raw = np.frombuffer(b"\0".join(contents) + b"\0", np.uint8)
    starts = np.concatenate(([0], np.cumsum(sizes + 1)[:-1]))
    stop = starts + sizes
    used = np.zeros(256, bool)
    inside = np.ones(len(raw), bool)
    inside[stop] = False
    used[raw[inside]] = True
    code = np.cumsum(used)  # 1.. for characters that occur, 0 for ends of contents
    t = np.where(inside, code[raw], 0)
    order = suffix_order(t, length)
    klass = np.cumsum(boundaries(t, order, length)[:-1])
    who = np.searchsorted(starts, order, side="right") - 1
    whole = order + length <= stop[who]  # windows that lie inside their content
    klass, who, at = klass[whole], who[whole], (order - starts[who])[whole]
    count = np.bincount(klass) if len(klass) else np.zeros(1, np.int64)
    many = count[klass] > 1
    return klass[many], who[many], at[many]
