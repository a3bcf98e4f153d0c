"""One refresh from start to end: mask, scrub, carry over, stage, audit, publish."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from ..operators.audit import Expect, replay_audit, rule_misses
from ..operators.carry import carry_schemas, run_within, select_over, split_droppable
from ..operators.scrub import scrub_rows
from ..sources.publish import current_run, index_tables, publish, stage_tables, written_tables
from .masking import MaskedTables, Masking, mask_tables

#: How staged tables are audited: paired by row key where there is one, or all as bags of rows,
#: which reads both sides once and shuffles neither.
AUDITS = ("rows", "bags")


@dataclass
class CarrySpec:
    """Schemas to carry from the published copy, with the SQL of their views."""

    schemas: list[str] = field(default_factory=list)
    views: dict[str, str] = field(default_factory=dict)
    budget_seconds: float | None = None


@dataclass
class RefreshSpec:
    """What one refresh does. ``root`` holds the staged runs and the pointer.

    ``pre_sql`` maps a table to a query over the copy's tables that replaces it,
    in order, before masks; ``scrub`` names the column of a table whose
    encrypted values go; ``drop_schemas`` are left out of the copy. ``audit``
    says how staged tables are held against their masks evaluated again, and
    ``expect``, by table and column, what else their values must fit.
    """

    root: str
    run_id: str
    masking: Masking
    manifest: DataFrame
    catalog: DataFrame | None = None
    references: Iterable[tuple[str, str]] = ()
    scrub: Mapping[str, str] = field(default_factory=dict)
    drop_schemas: Sequence[str] = ()
    carry: CarrySpec = field(default_factory=CarrySpec)
    pre_sql: Mapping[str, str] = field(default_factory=dict)
    expect: Mapping[str, Mapping[str, Expect | None]] = field(default_factory=dict)
    audit: str = "rows"

    def __post_init__(self) -> None:
        if self.audit not in AUDITS:
            raise ValueError(f"audit is one of {AUDITS}")


@dataclass
class RefreshResult:
    """How a refresh went. ``refused`` has the audit's failing lines by table; ``error`` is what
    broke it off, for callers to raise again."""

    masking_phase: str
    carry_phase: str | None = None
    published: bool = False
    failures: list[dict] = field(default_factory=list)
    refused: dict[str, list[dict]] = field(default_factory=dict)
    error: Exception | None = None


def _schema_of(table: str) -> str:
    return table.split(".", 1)[0]


def audit_staged(
    spark: SparkSession, masked: MaskedTables, paths: Mapping[str, str], spec: RefreshSpec,
) -> dict[str, list[dict]]:
    """Failing lines, by table, of staged files held against their masks evaluated again.

    Every table that was masked or emptied is audited: row by row if it has a row key that no
    mask changes, else as a bag of rows. A constant left in the clear differs from the constant,
    and a value that equals its original by chance is the value expected.
    """
    refused = {}
    for name in sorted(set(masked.applied) | masked.emptied):
        if name not in paths:
            continue
        staged, keys = spark.read.parquet(paths[name]), spec.masking.row_keys.get(name, ())
        if spec.audit == "bags" or set(keys) & set(masked.applied.get(name, {})):
            keys = ()
        lines = [replay_audit(masked.tables[name], staged, keys), rule_misses(staged, spec.expect.get(name, {}))]
        bad = [r.asDict() for lines_of in lines for r in lines_of.where("NOT agrees").collect()]
        if bad:
            refused[name] = bad
    return refused


def refresh(spark: SparkSession, spec: RefreshSpec, tables: Mapping[str, DataFrame]) -> RefreshResult:
    """Build a new copy out of ``tables`` (``schema.table``) and publish it.

    Only a copy whose masks ran and whose staged files pass the audit is published;
    otherwise, whatever failed and whenever it did, readers stay on the one they
    have. Carried schemas replace what the new copy has under their names, and
    going over their time budget leaves them out rather than holding it up.
    """
    droppable, _ = split_droppable(list(spec.drop_schemas))
    kept = {n: df for n, df in tables.items() if _schema_of(n) not in droppable}
    carried = list(spec.carry.schemas)
    try:
        for name, column in spec.scrub.items():
            if name in kept:
                kept[name] = scrub_rows(kept[name], column)
        for name, sql in spec.pre_sql.items():
            kept[name] = select_over(spark, sql, kept)
        masked = mask_tables(spark, kept, spec.manifest, spec.masking, spec.catalog, spec.references)
        before = current_run(spark, spec.root)
        # What is not carried, or has no copy to be carried from, comes from this run.
        own = {n: df for n, df in masked.tables.items() if before is None or _schema_of(n) not in carried}
        paths = stage_tables(own, spec.root, spec.run_id)
        bad = audit_staged(spark, masked, paths, spec)
    except Exception as err:  # any failure of these steps holds the copy back
        return RefreshResult(f"failed: {err}", failures=getattr(err, "failures", []), error=err)
    if bad:
        return RefreshResult(f"failed: the audit refuses {list(bad)}", failures=masked.failures, refused=bad)

    phase, moved = "complete", {}
    if before is not None:
        staged = {n: spark.read.parquet(path) for n, path in paths.items()}
        rest = {n: df for n, df in masked.tables.items() if n not in own}
        old = {n: p for n, p in written_tables(spark, spec.root, before).items() if _schema_of(n) in carried}
        held = {n: spark.read.parquet(path) for n, path in old.items()}
        done = carry_schemas(spark, {**staged, **rest}, held, carried, spec.carry.views)
        phase = done.phase
        # Tables of carried schemas the old copy does not have are new, and were not audited yet.
        late = {n: df for n, df in done.tables.items() if n in rest and n not in held and n not in spec.carry.views}
        over = {n: df for n, df in done.tables.items() if n not in staged and n not in late}

        def carry_over() -> None:
            moved.update(stage_tables(over, spec.root, spec.run_id, threads=1 if spec.carry.budget_seconds else 4))

        try:
            late_paths = stage_tables(late, spec.root, spec.run_id)
            bad = audit_staged(spark, masked, late_paths, spec)
            if bad:
                return RefreshResult(f"failed: the audit refuses {list(bad)}", failures=masked.failures, refused=bad)
            paths |= late_paths
            if spec.carry.budget_seconds is None:
                carry_over()
            elif not run_within(spark, spec.carry.budget_seconds, carry_over):
                # What was carried so far stays without an entry in the index: unreadable.
                phase, moved = "timeout-skipped", {}
        except Exception as err:
            return RefreshResult(f"failed: {err}", failures=masked.failures, error=err)
    index_tables(spark, {**paths, **moved}, spec.root, spec.run_id)
    publish(spark, spec.root, spec.run_id, masked.phase)
    return RefreshResult(masked.phase, phase, True, masked.failures)
