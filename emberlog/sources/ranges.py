"""Key ranges of a database table with about equal row counts, found by counting inside the database."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import SparkSession

GRID = 64  # parts of a cell that holds too many rows


def histogram(ask, table: str, key: str, n: int) -> list[tuple[int, int, int]]:
    """(first key, last key, rows) of cells in key order; each holds half a share at most, or a single key.

    One grouped query a round counts the parts of every cell that is still too full: at most 2 n cells, and a cell
    shrinks to a 64th each round, so 11 rounds do for 64-bit keys. Empty parts are left out.
    """
    low, high, rows = ask(f"SELECT MIN({key}) AS low_key, MAX({key}) AS high_key, COUNT({key}) AS n_rows FROM {table}")[0]
    if not rows:
        return []
    fine, done, full = max(1, rows // (2 * n)), [], [(int(low), int(high), int(rows))]
    while full:
        split = [c for c in full if c[2] > fine and c[0] < c[1]]
        done += [c for c in full if c[2] <= fine or c[0] == c[1]]
        if not split:
            break
        width = {c: -(-(c[1] - c[0] + 1) // GRID) for c in split}
        arms = " ".join(f"WHEN {key} BETWEEN {a} AND {b} THEN {i * GRID} + FLOOR(({key} - {a}) / {width[a, b, k]})" for i, (a, b, k) in enumerate(split))
        where = " OR ".join(f"{key} BETWEEN {a} AND {b}" for a, b, _ in split)
        parts = ask(f"SELECT cell, COUNT(*) AS n_rows FROM (SELECT CASE {arms} END AS cell FROM {table} WHERE {where}) parts GROUP BY cell")
        full = []
        for cell, count in parts:
            i, part = divmod(int(cell), GRID)
            a, b = split[i][:2]
            first = a + part * width[split[i]]
            full.append((first, min(b, first + width[split[i]] - 1), int(count)))
    return sorted(done)


def key_ranges(spark: SparkSession, url: str, table: str, key: str, n: int, options: Mapping[str, str] | None = None) -> list[str]:
    """At most ``n`` predicates over a whole-number key that cut the table into parts of about equal row counts.

    Every row is in exactly one: null keys are in the first, and the outer ranges are open, so rows that come
    meanwhile are read too. All rows of one key stay together. Empty list: no row has a key.
    """
    ask = lambda sql: [tuple(r) for r in spark.read.format("jdbc").option("url", url).option("query", sql).options(**(options or {})).load().collect()]
    cells = histogram(ask, table, key, n)
    total, before, starts = sum(c[2] for c in cells), 0, []
    for first, _, rows in cells:
        if before and before * n >= total * (len(starts) + 1):  # a whole share lies before this cell
            starts.append(first)
        before += rows
    if not starts:
        return []
    inner = [f"{key} >= {a} AND {key} < {b}" for a, b in zip(starts, starts[1:])]
    return [f"{key} < {starts[0]} OR {key} IS NULL", *inner, f"{key} >= {starts[-1]}"]
