"""Keyed draws: repeatable random numbers that depend on a row's key.

``rand()`` and ``uuid()`` are evaluated again when a task is retried, so one
lost executor would leave a table masked two ways. A keyed draw is a digest of
(column key, row key, draw number): any task, on any attempt, gets the same one.
It never depends on the value being hidden, so guessing values gains nothing.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, functions as F

#: Draws are 13 hex digits of a digest.
DRAW_SPAN = 1 << 52


def column_key(secret: str, table: str, column: str) -> str:
    """Per-column key. Only this digest reaches a plan, never the secret."""
    return hashlib.sha256(f"{secret}|{table}.{column}".encode()).hexdigest()


def row_key(*cols: Column) -> Column:
    """One text per row out of its key columns.

    Several are told apart by their lengths, so no two keys read the same; NULL is
    not the empty text there. Of a single column a NULL counts as empty.
    """
    if len(cols) == 1:
        return F.coalesce(cols[0].cast("string"), F.lit(""))
    def part(c: Column) -> Column:
        text = c.cast("string")
        return F.coalesce(F.concat(F.length(text).cast("string"), F.lit(":"), text), F.lit("-"))

    return F.concat_ws("|", *[part(c) for c in cols])


def digest(key: str, row: Column, number: Column | int = 0) -> Column:
    """32 hex digits for draw ``number`` of a row."""
    number = F.lit(number) if isinstance(number, int) else number
    return F.md5(F.concat_ws("|", F.lit(key), row, number.cast("string")))


def draw(key: str, row: Column, number: int = 0) -> Column:
    """A whole number in [0, 2**52)."""
    return F.conv(F.substring(digest(key, row, number), 1, 13), 16, 10).cast("bigint")


class Staged:
    """Columns a projection computes once, for the expressions above it to share.

    A draw used in several branches would be digested again in each of them;
    staged, it is one column, and both projections stay in one code stage.
    """

    def __init__(self, prefix: str = "__staged") -> None:
        self._prefix = prefix
        self._columns: dict[str, Column] = {}
        self._names: dict[tuple, str] = {}

    def column(self, key: tuple, build) -> Column:
        """The staged column for ``key``, built on first use."""
        if key not in self._names:
            name = f"{self._prefix}_{len(self._names)}"
            self._names[key], self._columns[name] = name, build()
        return F.col(self._names[key])

    def on(self, df):
        """The frame with everything staged so far."""
        return df.withColumns(self._columns) if self._columns else df


def unit(n: Column) -> Column:
    """A draw as a double in [0, 1)."""
    return n / F.lit(float(DRAW_SPAN))


def pick(words: list[str], n: Column) -> Column:
    """The word a draw falls on."""
    return F.element_at(F.array(*[F.lit(w) for w in words]), (n % len(words) + 1).cast("int"))


def part(n: Column, below: int) -> Column:
    """What is left of a draw once ``below`` outcomes have been taken from it."""
    return F.call_function("div", n, F.lit(below))
