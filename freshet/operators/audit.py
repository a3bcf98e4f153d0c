"""Audits of masked tables: what a mask must give is known, so a copy is held against that.

Draws are keyed, so the masks evaluated again on the originals give the very values a
written copy must hold. A table with a row key is compared with it row by row; one without
is compared as a bag of rows, by sums of row hashes that no order or partitioning changes.
:func:`mask_audit` reports how a masked table differs from its originals, for people.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.expressions import quote_identifier


@dataclass(frozen=True)
class Expect:
    """What a masked column must look like; None for a column nothing may touch.

    ``kept_share`` is the share of a column's values that may equal their originals by
    chance: 1 for kinds that write a constant, more than the default for those that draw
    from a few values only.
    """

    pattern: str | None = None
    low: float | None = None
    high: float | None = None
    keeps_null: bool = True
    kept_share: float = 0.2


COUNTS = [
    "rows_before", "rows_after", "unpaired_before", "unpaired_after", "kept_allowed", "nulls_changed", "kept_values",
    "pattern_misses", "out_of_range", "differences",
]


def mask_audit(
    original: DataFrame, masked: DataFrame, keys: list[str], expected: Mapping[str, Expect | None]
) -> DataFrame:
    """One row per column with the counts in ``COUNTS``.

    One full outer join on the row key (one shuffle a side, none if both tables
    are bucketed on it) and one aggregate over every column at once. Row keys
    are unique, so no key is hot. ``kept_values`` counts masked values that
    equal the original, ``kept_allowed`` how many of the values compared may by
    chance (what each value must be, :func:`replay_audit` knows); the unpaired
    are rows whose key the other side lacks.
    """
    columns = list(expected)
    before = original.select(
        *[F.col(quote_identifier(k)).alias(f"_k{i}") for i, k in enumerate(keys)],
        F.lit(True).alias("_in_before"),
        *[F.col(quote_identifier(c)).alias(f"_b{i}") for i, c in enumerate(columns)],
    )
    after = masked.select(
        *[F.col(quote_identifier(k)).alias(f"_k{i}") for i, k in enumerate(keys)],
        F.lit(True).alias("_in_after"),
        *[F.col(quote_identifier(c)).alias(f"_a{i}") for i, c in enumerate(columns)],
    )
    both = before.join(after, [f"_k{i}" for i in range(len(keys))], "full_outer")
    paired = F.col("_in_before").isNotNull() & F.col("_in_after").isNotNull()

    sums = [
        F.count("_in_before").alias("_rows_before"), F.count("_in_after").alias("_rows_after"),
        F.count_if(F.col("_in_after").isNull()).alias("_unpaired_before"),
        F.count_if(F.col("_in_before").isNull()).alias("_unpaired_after"),
    ]
    for i, name in enumerate(columns):
        expect, old, new = expected[name], F.col(f"_b{i}"), F.col(f"_a{i}")
        never = F.lit(False)
        rule = expect or Expect()
        low = new < rule.low if rule.low is not None else never
        high = new > rule.high if rule.high is not None else never
        checks = {
            "nulls_changed": paired & (old.isNull() != new.isNull()) if rule.keeps_null else never,
            "kept_values": paired & (old == new) if expect else never,
            "pattern_misses": ~new.cast("string").rlike(rule.pattern) if rule.pattern else never,
            "out_of_range": low | high,
            "differences": never if expect else paired & ~old.eqNullSafe(new),
        }
        valued = F.count_if(paired & old.isNotNull() & new.isNotNull())
        sums.append(F.floor(valued * F.lit(rule.kept_share)).alias(f"_kept_allowed_{i}"))
        sums += [F.count_if(F.coalesce(check, never)).alias(f"_{what}_{i}") for what, check in checks.items()]
    totals = both.agg(*sums)
    lines = F.array(*[
        F.struct(
            F.lit(name).alias("column"),
            F.col("_rows_before").alias("rows_before"),
            F.col("_rows_after").alias("rows_after"),
            F.col("_unpaired_before").alias("unpaired_before"),
            F.col("_unpaired_after").alias("unpaired_after"),
            *[F.col(f"_{what}_{i}").alias(what) for what in COUNTS[4:]],
        )
        for i, name in enumerate(columns)
    ])
    return totals.select(F.inline(lines))


def passed() -> Column:
    """Whether a line of a report fits what was expected of its column."""
    return (
        (F.col("unpaired_before") == 0)
        & (F.col("unpaired_after") == 0)
        & (F.col("rows_before") == F.col("rows_after"))
        & (F.col("kept_values") <= F.col("kept_allowed"))
        & (F.col("nulls_changed") == 0)
        & (F.col("pattern_misses") == 0)
        & (F.col("out_of_range") == 0)
        & (F.col("differences") == 0)
    )


def audit_passed(report: DataFrame) -> bool:
    """Whether every line of a report passes."""
    good = F.col("agrees") if "agrees" in report.columns else passed()
    return report.where(~good).isEmpty()


REPLAY = "column string, rows_expected bigint, rows_staged bigint, missing bigint, extra bigint, differences bigint, agrees boolean"

#: The line of a report that stands for whole rows.
ROWS = "*"


def _holds_map(dtype: T.DataType) -> bool:
    if isinstance(dtype, T.ArrayType):
        return _holds_map(dtype.elementType)
    if isinstance(dtype, T.StructType):
        return any(_holds_map(f.dataType) for f in dtype.fields)
    return isinstance(dtype, (T.MapType, T.VariantType))


def _comparable(df: DataFrame, name: str) -> Column:
    """A column as something that can be hashed and compared: maps and variants as their text."""
    column = F.col(quote_identifier(name))
    return F.to_json(F.struct(column.alias("v"))) if _holds_map(df.schema[name].dataType) else column


def _not_alike(expected: DataFrame, staged: DataFrame) -> list[str]:
    """Columns only one side has, or that differ in type."""
    types = [{f.name: f.dataType.simpleString() for f in df.schema.fields} for df in (expected, staged)]
    return sorted(n for n in types[0].keys() | types[1].keys() if types[0].get(n) != types[1].get(n))


def replay_by_key(expected: DataFrame, staged: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One line per column: how often a staged value is not the expected one, null-safely.

    Rows are paired by their key, which masks must have left alone and which is unique.
    ``missing`` and ``extra`` count rows whose key only one side has. A column of another type, or
    that one side lacks, differs in every row.
    """
    apart = _not_alike(expected, staged)
    columns = [c for c in expected.columns if c not in keys and c not in apart]

    def side(df: DataFrame, mark: str) -> DataFrame:
        return df.select(
            *[_comparable(df, k).alias(f"_k{i}") for i, k in enumerate(keys)], F.lit(True).alias(f"_in_{mark}"),
            *[_comparable(df, c).alias(f"_{mark}{i}") for i, c in enumerate(columns)],
        )

    left, right = side(expected, "e"), side(staged, "s")
    pairs = F.lit(True)
    for i in range(len(keys)):  # a key may be null, and then only meets a null
        pairs = pairs & left[f"_k{i}"].eqNullSafe(right[f"_k{i}"])
    both = left.join(right, pairs, "full_outer")
    paired = F.col("_in_e").isNotNull() & F.col("_in_s").isNotNull()
    totals = both.agg(
        F.count_if(F.col("_in_s").isNull()).alias("_missing"), F.count_if(F.col("_in_e").isNull()).alias("_extra"),
        *[F.count_if(paired & ~F.col(f"_e{i}").eqNullSafe(F.col(f"_s{i}"))).alias(f"_differ{i}") for i in range(len(columns))],
    )
    # A key that is doubled on one side pairs twice: rows are counted before they are paired.
    counts = [expected.agg(F.count("*").alias("_expected")), staged.agg(F.count("*").alias("_staged"))]
    for more in counts:
        totals = totals.unionByName(more, allowMissingColumns=True)
    totals = totals.agg(*[F.max(c).alias(c) for c in totals.columns])
    differ = {c: F.col(f"_differ{i}") for i, c in enumerate(columns)} | {c: F.col("_expected") for c in apart}
    lines = []
    for column in [*keys, *columns, *[c for c in apart if c not in keys]]:
        found = F.lit(0).cast("bigint") if column in keys and column not in apart else differ[column]
        good = (F.col("_expected") == F.col("_staged")) & (F.col("_missing") == 0) & (F.col("_extra") == 0) & (found == 0) & F.lit(column not in apart)
        lines.append(F.struct(
            F.lit(column).alias("column"), F.col("_expected").alias("rows_expected"), F.col("_staged").alias("rows_staged"),
            F.col("_missing").alias("missing"), F.col("_extra").alias("extra"), found.alias("differences"), good.alias("agrees")))
    return totals.select(F.inline(F.array(*lines)))


def fingerprints(df: DataFrame) -> DataFrame:
    """A line per column, and one for whole rows: the rows, and two sums of 64-bit hashes.

    Sums of hashes are the same for the same bag of rows in any order and partitioning, and
    one pass folds them to a single row per task: nothing is shuffled but those. A null
    counts as a value of its own, so values that change places between columns show.
    """
    names = df.columns
    values = {n: F.struct(F.col(quote_identifier(n)).isNull(), _comparable(df, n)) for n in names}
    hashed = {n: [v] for n, v in values.items()} | {ROWS: list(values.values())}
    sums = [F.count("*").alias("_rows")]
    for i, parts in enumerate(hashed.values()):
        for j, salt in enumerate(("first", "second")):
            sums.append(F.sum(F.xxhash64(F.lit(salt), *parts).cast("decimal(20,0)")).alias(f"_{i}_{j}"))
    nothing = F.lit(0).cast("decimal(30,0)")
    lines = F.array(*[
        F.struct(F.lit(n).alias("column"), F.col("_rows").alias("rows"),
                 *[F.coalesce(F.col(f"_{i}_{j}"), nothing).alias(k) for j, k in enumerate(("first", "second"))])
        for i, n in enumerate(hashed)
    ])
    return df.agg(*sums).select(F.inline(lines))


def replay_by_bag(expected: DataFrame, staged: DataFrame) -> DataFrame:
    """One line per column, and one for whole rows, of tables without a row key.

    A row dropped, doubled, added or changed moves the sums of the whole rows; the lines of
    single columns tell where. Counts of missing and extra rows are not known this way.
    """
    sides = [fingerprints(df).withColumn("_staged", F.lit(mark)) for df, mark in ((expected, False), (staged, True))]
    both = sides[0].unionByName(sides[1]).groupBy("column")
    same = [F.count("*") == 2, *[F.min(c) == F.max(c) for c in ("rows", "first", "second")]]
    agrees = same[0]
    for more in same[1:]:
        agrees = agrees & more
    unknown = F.lit(None).cast("bigint")
    of = {mark: F.max(F.when(F.col("_staged") == mark, F.col("rows"))) for mark in (False, True)}
    lines = both.agg(of[False].alias("rows_expected"), of[True].alias("rows_staged"), agrees.alias("_agrees"))
    apart = _not_alike(expected, staged)
    return lines.select(
        "column", "rows_expected", "rows_staged", unknown.alias("missing"), unknown.alias("extra"), unknown.alias("differences"),
        (F.col("_agrees") & ~F.col("column").isin(apart)).alias("agrees"),
    )


def replay_audit(expected: DataFrame, staged: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """A staged table against the masks evaluated again on its originals: a line per column."""
    return replay_by_key(expected, staged, keys) if keys else replay_by_bag(expected, staged)


def rule_misses(staged: DataFrame, expected: Mapping[str, Expect | None]) -> DataFrame:
    """A line per column with a rule: values that miss its pattern or lie outside its range."""
    rules = {c: e for c, e in expected.items() if e is not None and (e.pattern, e.low, e.high) != (None, None, None)}
    never, sums = F.lit(False), []
    for i, (name, rule) in enumerate(rules.items()):
        value = F.col(quote_identifier(name))
        low = value < rule.low if rule.low is not None else never
        high = value > rule.high if rule.high is not None else never
        miss = ~value.cast("string").rlike(rule.pattern) if rule.pattern else never
        sums.append(F.count_if(F.coalesce(low, never) | F.coalesce(high, never) | F.coalesce(miss, never)).alias(f"_{i}"))
    if not rules:
        return staged.sparkSession.createDataFrame([], "column string, misses bigint, agrees boolean")
    lines = [F.struct(F.lit(n).alias("column"), F.col(f"_{i}").alias("misses"), (F.col(f"_{i}") == 0).alias("agrees")) for i, n in enumerate(rules)]
    return staged.agg(*sums).select(F.inline(F.array(*lines)))
