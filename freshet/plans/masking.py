"""From a manifest to masked tables: plan, one projection per table, outcome.

The plan is a DataFrame of one row per mask with a status. It is the only thing
collected (its size is the manifest's), and it turns into one ``select`` per
table, so masking a table costs its scan and nothing more.
"""

from __future__ import annotations

import datetime as dt
import warnings
from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException, ParseException, PySparkException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..functions import draws, masks
from ..functions.expressions import quote_identifier
from ..sources.catalog import catalog_frame, catalog_rows

OK = "ok"

PLAN_COLUMNS = [
    "schema", "table", "column", "kind", "range", "seq",
    "data_type", "is_nullable", "column_default", "status",
]


class MaskError(RuntimeError):
    """A mask could not be applied and the caller did not choose to tolerate that."""

    def __init__(self, message: str, failures: list[dict] | None = None) -> None:
        super().__init__(message)
        self.failures = failures or []


def _known_kinds() -> tuple[list[str], dict[str, list[str] | None]]:
    kinds = masks.mask_kinds()
    return sorted(kinds), {name: masks.ASSIGNABLE[kind.writes] for name, kind in kinds.items()}


def _mismatch(kind: Column, data_type: Column) -> Column:
    """Kinds whose value cannot be stored in the column's type."""
    names, assignable = _known_kinds()
    by_types: dict[tuple[str, ...], list[str]] = {}
    for name in names:
        if assignable[name] is not None:
            by_types.setdefault(tuple(assignable[name]), []).append(name)
    wrong = F.lit(False)
    for types, group in by_types.items():
        wrong = wrong | (kind.isin(group) & ~data_type.isin(list(types)))
    return wrong


def _overflow(kind: Column, bounds: Column, data_type: Column, digits: Column) -> Column:
    """Ranges that reach outside what the column, or a 32-bit draw, can hold."""
    low, high = bounds["lo"], bounds["hi"]
    for name, (least, most) in masks.DEFAULT_RANGES.items():
        low, high = F.coalesce(low, F.when(kind == name, least)), F.coalesce(high, F.when(kind == name, most))
    out = (kind == "integer") & ((low < -(2.0**31)) | (high > 2.0**31 - 1))
    for name, limit in masks.WHOLE_LIMITS.items():
        out = out | ((data_type == name) & ((low < -float(limit)) | (high > float(limit) - 1)))
    # A decimal rounds what it is given, up to the half before its next power of ten.
    widest = F.pow(F.lit(10.0), digits) - 0.5
    out = out | F.coalesce((F.abs(low) >= widest) | (F.abs(high) >= widest), F.lit(False))
    finite = ~F.isnan(low) & ~F.isnan(high) & (F.abs(low) < float("inf")) & (F.abs(high) < float("inf"))
    return kind.isin(list(masks.DEFAULT_RANGES)) & F.coalesce(out | ~finite, F.lit(False))


def mask_plan(manifest: DataFrame, catalog: DataFrame) -> DataFrame:
    """Every column mask of a manifest with what the catalogue knows and a status.

    ``ok``, ``missing_column``, ``unknown_kind``, ``unsupported_type``,
    ``nil_not_nullable``, ``no_default``, ``type_mismatch`` or ``out_of_range``.
    Names match case by case: the join compares text, not Spark identifiers.
    """
    names, _ = _known_kinds()
    kind, data_type = F.col("kind"), F.col("data_type")
    typed = masks.NUMERIC_TYPES + masks.TEXT_TYPES + masks.BINARY_TYPES
    emptied = typed + masks.JSON_TYPES + [masks.ARRAY_TYPE]
    status = (
        F.when(data_type.isNull(), "missing_column")
        .when(~kind.isin(names), "unknown_kind")
        .when((kind == "zero") & ~data_type.isin(typed), "unsupported_type")
        .when((kind == "empty") & ~data_type.isin(emptied), "unsupported_type")
        .when((kind == "nil") & ~F.col("is_nullable"), "nil_not_nullable")
        .when((kind == "default") & F.col("column_default").isNull(), "no_default")
        .when(_mismatch(kind, data_type), "type_mismatch")
        .when(_overflow(kind, F.col("range"), data_type, F.col("whole_digits")), "out_of_range")
        .otherwise(OK)
    )
    if "whole_digits" not in catalog.columns:
        catalog = catalog.withColumn("whole_digits", F.lit(None).cast("int"))
    columns = manifest.where(F.col("column").isNotNull())
    extra = [c for c in columns.columns if c not in PLAN_COLUMNS]
    return columns.join(catalog, ["schema", "table", "column"], "left").select(
        *extra, *PLAN_COLUMNS[:-1], status.alias("status")
    )


def table_plan(manifest: DataFrame) -> DataFrame:
    """Every table mask with its status: only ``truncate`` is one."""
    return manifest.where(F.col("column").isNull()).select(
        *[c for c in manifest.columns if c not in ("column", "range")],
        F.when(F.col("kind") == "truncate", OK).otherwise("unknown_kind").alias("status"),
    )


def referencing_closure(edges: Iterable[tuple[str, str]], start: Iterable[str]) -> set[str]:
    """Tables a cascade reaches: everything that refers, at any distance, to ``start``.

    ``edges`` are (referring, referred) table names, a few per table of a schema.
    """
    pairs, reached = list(edges), set(start)
    while True:
        more = {child for child, parent in pairs if parent in reached} - reached
        if not more:
            return reached
        reached |= more


@dataclass
class Outcome:
    """Counts of one masking run. Attempted includes failed."""

    columns_attempted: int = 0
    columns_failed: int = 0
    tables_attempted: int = 0
    tables_failed: int = 0

    @property
    def phase(self) -> str:
        return "partial" if self.columns_failed or self.tables_failed else "complete"


def outcome_frame(columns: DataFrame, tables: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Outcome counts and phase per ``keys`` (or overall) over plan statuses."""
    keys = keys or []
    failed = F.count_if(F.col("status") != OK)
    per_column = columns.select(*keys, F.lit("column").alias("level"), "status")
    per_table = tables.select(*keys, F.lit("table").alias("level"), "status")
    is_column = F.col("level") == "column"
    counts = per_column.unionByName(per_table).groupBy(*keys).agg(
        F.count_if(is_column).alias("columns_attempted"),
        F.count_if(is_column & (F.col("status") != OK)).alias("columns_failed"),
        F.count_if(~is_column).alias("tables_attempted"),
        F.count_if(~is_column & (F.col("status") != OK)).alias("tables_failed"),
    )
    partial = (F.col("columns_failed") > 0) | (F.col("tables_failed") > 0)
    return counts.withColumn("phase", F.when(partial, "partial").otherwise("complete"))


@dataclass
class Masking:
    """How to mask: the secret, the row keys and what to do about failures.

    Rotate ``secret`` per run to get new fakes every time; keep it to get the
    same ones, which lets masked copies be compared from run to run.
    """

    secret: str
    row_keys: Mapping[str, tuple[str, ...]] = field(default_factory=dict)
    on_error: str = "fail"
    as_of: dt.date = dt.date(2026, 1, 1)

    def __post_init__(self) -> None:
        if self.on_error not in ("fail", "tolerate"):
            raise ValueError("on_error is 'fail' or 'tolerate'")
        if not self.secret:
            raise ValueError("masking needs a secret")

    def __repr__(self) -> str:
        return f"Masking(secret=<hidden>, on_error={self.on_error!r})"


def _repeatable(df: DataFrame) -> bool:
    """Whether a task that runs again computes the same rows."""
    return df._jdf.queryExecution().analyzed().deterministic()


def _column(name: str) -> Column:
    return F.col(quote_identifier(name))


def _row_key(df: DataFrame, table: str, masked: set[str], settings: Masking) -> Column:
    named = settings.row_keys.get(table)
    if named:
        return draws.row_key(*[_column(c) for c in named])
    rest = [c for c in df.columns if c not in masked]
    if not rest:
        raise MaskError(f"{table}: every column is masked, so name its key columns")
    warnings.warn(f"{table} has no row key: rows alike in every unmasked column share their fakes", stacklevel=2)
    return F.sha2(F.to_json(F.struct(*[_column(c) for c in rest]), {"ignoreNullFields": "false"}), 256)


def _default_fails(spark: SparkSession, default: str, dtype: T.DataType) -> bool:
    """Whether a default that names no column cannot be stored in the column."""
    try:
        one = spark.range(1).select(F.expr(default).cast(dtype))
    except (AnalysisException, ParseException):
        return False  # over columns of the table, or no expression: analysis over the table tells
    try:
        one.collect()
        return False
    except PySparkException:
        return True


def mask_table(
    df: DataFrame, table: str, entries: list, settings: Masking
) -> tuple[DataFrame, list[tuple[str, str]]]:
    """One table with all its ok masks in a single projection.

    ``entries`` are plan rows of this table in manifest order. Returns the
    masked table and ``(column, status)`` of masks that turned out not to fit:
    ``missing_column``, ``type_mismatch``, ``no_default``, ``default_fails`` or
    ``not_repeatable``. Constant defaults are computed once, here, so that one
    that fails only when it runs is found before the table is read.
    """
    by_column: dict[str, list] = {}
    for entry in sorted(entries, key=lambda e: tuple(e["seq"])):
        by_column.setdefault(entry["column"], []).append(entry)
    if not by_column:
        return df, []
    by_known = set(by_column) & set(df.columns)
    if not by_known:
        return df, [(name, "missing_column") for name, group in by_column.items() for _ in group]
    key = draws.Staged("__row")
    row = key.column(("row",), lambda: _row_key(df, table, by_known, settings))
    keyed, staged = key.on(df), draws.Staged("__draw")
    dtypes = {f.name: f.dataType for f in df.schema.fields}

    chosen: dict[str, Column] = {}
    broken: list[tuple[str, str]] = []
    for name, group in by_column.items():
        if name not in dtypes:
            broken += [(name, "missing_column")] * len(group)
            continue
        if any(e["kind"] == "default" and _default_fails(df.sparkSession, e["column_default"], dtypes[name]) for e in group):
            broken += [(name, "default_fails")] * len(group)
            continue
        ctx = masks.MaskContext(
            col=_column(name),
            dtype=dtypes[name],
            data_type=group[0]["data_type"],
            key=draws.column_key(settings.secret, table, name),
            row=row,
            default=group[0]["column_default"],
            as_of=settings.as_of,
            staged=staged,
        )
        kinds = [(e["kind"], tuple(e["range"]) if e["range"] else None) for e in group]
        try:
            value = masks.chain(kinds, ctx)
            # Analysis only: a mask that does not fit is found before anything is read.
            tried = staged.on(keyed).select(value)
        except (AnalysisException, ParseException):
            default = any(kind == "default" for kind, _ in kinds)
            broken += [(name, "no_default" if default else "type_mismatch")] * len(kinds)
            continue
        if _repeatable(df) and not _repeatable(tried):
            # A default such as uuid() would mask a row differently on every attempt.
            broken += [(name, "not_repeatable")] * len(kinds)
            continue
        chosen[name] = value
    out = [chosen[c].alias(c) if c in chosen else _column(c) for c in df.columns]
    return staged.on(keyed).select(*out), broken


@dataclass
class MaskedTables:
    """Masked tables, how it went, the kinds applied by table and column, and the tables emptied."""

    tables: dict[str, DataFrame]
    outcome: Outcome
    failures: list[dict]
    applied: dict[str, dict[str, list[str]]] = field(default_factory=dict)
    emptied: set[str] = field(default_factory=set)

    @property
    def phase(self) -> str:
        return self.outcome.phase


def mask_tables(
    spark: SparkSession,
    tables: Mapping[str, DataFrame],
    manifest: DataFrame,
    settings: Masking,
    catalog: DataFrame | None = None,
    references: Iterable[tuple[str, str]] = (),
) -> MaskedTables:
    """Mask a set of tables (named ``schema.table``) under a manifest.

    Truncations run first and cascade along ``references`` (referring, referred).
    With ``on_error='fail'`` any mask that cannot apply raises; with
    ``'tolerate'`` its column stays in the clear and the outcome is partial.
    """
    if catalog is None:
        rows = [r for name, df in tables.items() for r in catalog_rows(df, *name.split(".", 1))]
        catalog = catalog_frame(spark, rows)
    both = mask_plan(manifest, catalog).unionByName(table_plan(manifest), allowMissingColumns=True)
    entries = [r.asDict() for r in both.collect()]
    plan = [e for e in entries if e["column"] is not None]
    truncations = [e for e in entries if e["column"] is None]

    failures = []
    for entry in truncations:
        if entry["status"] == OK and f"{entry['schema']}.{entry['table']}" not in tables:
            entry["status"] = "missing_table"
    emptied = referencing_closure(
        references,
        [f"{e['schema']}.{e['table']}" for e in truncations if e["status"] == OK],
    )
    by_table: dict[str, list] = {}
    for entry in plan:
        if entry["status"] == OK and f"{entry['schema']}.{entry['table']}" not in tables:
            entry["status"] = "missing_table"
        if entry["status"] == OK:
            by_table.setdefault(f"{entry['schema']}.{entry['table']}", []).append(entry)

    out: dict[str, DataFrame] = {}
    applied: dict[str, dict[str, list[str]]] = {}
    for name, df in tables.items():
        masked, broken = mask_table(df, name, by_table.get(name, []), settings)
        failures += [{"table": name, "column": c, "status": s} for c, s in broken]
        out[name] = masked.limit(0) if name in emptied else masked
        failed = {c for c, _ in broken}
        for entry in by_table.get(name, []):
            if entry["column"] not in failed and name not in emptied:
                applied.setdefault(name, {}).setdefault(entry["column"], []).append(entry["kind"])
    column_failures = len(failures)
    for entry in plan:
        if entry["status"] != OK:
            column_failures += 1
            failures.append({"table": f"{entry['schema']}.{entry['table']}",
                             "column": entry["column"], "status": entry["status"]})
    for entry in truncations:
        if entry["status"] != OK:
            failures.append({"table": f"{entry['schema']}.{entry['table']}",
                             "column": None, "status": entry["status"]})
    if failures and settings.on_error == "fail":
        raise MaskError(f"{len(failures)} mask(s) cannot apply: {failures}", failures)
    outcome = Outcome(
        columns_attempted=len(plan),
        columns_failed=column_failures,
        tables_attempted=len(truncations),
        tables_failed=sum(e["status"] != OK for e in truncations),
    )
    return MaskedTables(out, outcome, failures, applied, emptied & set(tables))
