"""Carrying derived schemas from the previous copy into the new one."""

from __future__ import annotations

import re
import threading
import time
import uuid
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.expressions import RESERVED_SCHEMAS, droppable_schema

FALLBACK_BUDGET_SECONDS = 3600
BUDGET_DIVISOR = 5


def schemas_present(wanted: DataFrame, existing: DataFrame, keys: Sequence[str] = ("copy",)) -> DataFrame:
    """Wanted schemas ``(…keys, pos, schema)`` with whether the source copy has them."""
    found = existing.select(*keys, "schema").distinct().withColumn("_found", F.lit(True))
    joined = wanted.join(found, [*keys, "schema"], "left")
    return joined.select(
        *wanted.columns, F.when(F.col("_found"), "carry").otherwise("skipped").alias("action")
    )


def carry_plan(
    new_tables: DataFrame, previous_tables: DataFrame, carried: DataFrame, keys: Sequence[str] = ("copy",)
) -> DataFrame:
    """Tables of the staged copy: carried schemas come from the previous copy only."""
    on = [*keys, "schema"]
    kept = new_tables.join(carried, on, "left_anti").withColumn("origin", F.lit("new"))
    moved = previous_tables.join(carried, on, "left_semi").withColumn("origin", F.lit("previous"))
    return kept.unionByName(moved)


def droppable(schemas: DataFrame, column: str = "schema") -> DataFrame:
    """Adds ``droppable``: reserved schemas are refused, whoever names them."""
    return schemas.withColumn("droppable", droppable_schema(F.col(column)))


def split_droppable(schemas: Sequence[str]) -> tuple[list[str], list[str]]:
    """Driver-side twin for a configured list: (droppable, refused), order kept."""
    def allowed(name: str) -> bool:
        return name not in RESERVED_SCHEMAS and not name.startswith("pg_")

    return [s for s in schemas if allowed(s)], [s for s in schemas if not allowed(s)]


def budget_seconds(interval_seconds: Column) -> Column:
    """A fifth of the interval between two runs, an hour if there is none."""
    fifth = F.call_function("div", interval_seconds.cast("bigint"), F.lit(BUDGET_DIVISOR))
    return F.coalesce(fifth, F.lit(FALLBACK_BUDGET_SECONDS).cast("bigint"))


def over_budget(elapsed_seconds: Column, interval_seconds: Column) -> Column:
    """Whether a carry-over ran past its budget; an unknown start never has."""
    return F.coalesce(elapsed_seconds > budget_seconds(interval_seconds), F.lit(False))


def measured_delta(database_bytes: Column, snapshot_bytes: Column) -> Column:
    """What the derived schemas add to a database, as the next volume should allow for."""
    return F.greatest(database_bytes - snapshot_bytes, F.lit(0).cast("bigint"))


def carry_phase(errors: DataFrame, keys: Sequence[str] = ("copy",)) -> DataFrame:
    """``complete``, or ``partial`` with the number of statement errors, per copy."""
    counts = errors.groupBy(*keys).agg(F.count_if(F.col("error").isNotNull()).alias("errors"))
    phase = F.when(F.col("errors") == 0, "complete").otherwise(
        F.concat(F.lit("partial: "), F.col("errors").cast("string"), F.lit(" statement error(s)"))
    )
    return counts.withColumn("phase", phase)


@dataclass
class Carried:
    """The new copy's tables after carry-over, and how it went."""

    tables: dict[str, DataFrame]
    phase: str = "complete"
    skipped: list[str] = field(default_factory=list)
    errors: dict[str, str] = field(default_factory=dict)


def _schema_of(table: str) -> str:
    return table.split(".", 1)[0]


def _mention(name: str) -> re.Pattern:
    return re.compile(rf"(?<![\w.`]){re.escape(name)}(?![\w`])")


def select_over(spark: SparkSession, sql: str, tables: Mapping[str, DataFrame]) -> DataFrame:
    """A query's text read over a copy's tables (``schema.table``) instead of the session's."""
    arguments = {}
    for name, df in tables.items():
        mention = _mention(name)
        if mention.search(sql):
            alias = f"t{len(arguments)}"
            sql = mention.sub("{" + alias + "}", sql)
            arguments[alias] = df
    return spark.sql(sql, **arguments)


def carry_schemas(
    spark: SparkSession,
    new: Mapping[str, DataFrame],
    previous: Mapping[str, DataFrame] | None,
    schemas: Sequence[str],
    views: Mapping[str, str] | None = None,
) -> Carried:
    """Put the schemas' tables of the previous copy into the new one.

    Names are ``schema.table``. Whatever the new copy has in those schemas is
    dropped first. Views are built again from their SQL, over the new copy; one
    that no longer analyses is an error that is counted and tolerated, since a
    copy short of a view beats no copy.
    """
    views = views or {}
    if previous is None or not schemas:
        return Carried(dict(new))
    held = {_schema_of(n) for n in previous} | {_schema_of(n) for n in views}
    present = [s for s in schemas if s in held]
    skipped = [s for s in schemas if s not in held]
    if not present:
        return Carried(dict(new), skipped=skipped)

    tables = {n: df for n, df in new.items() if _schema_of(n) not in present}
    tables |= {n: df for n, df in previous.items() if _schema_of(n) in present}
    # A view may read another one: those that analyse go in first, until none is added.
    waiting = {name: sql for name, sql in views.items() if _schema_of(name) in present}
    errors: dict[str, str] = {}
    while waiting:
        errors, built = {}, []
        for name, sql in waiting.items():
            if any(other != name and _mention(other).search(sql) for other in waiting):
                errors[name] = "it reads a view that is not built"
                continue
            try:
                tables[name] = select_over(spark, sql, tables)
                built.append(name)
            except PySparkException as err:
                errors[name] = str(err).splitlines()[0]
        waiting = {name: sql for name, sql in waiting.items() if name not in built}
        if not built:
            break
    phase = f"partial: {len(errors)} statement error(s)" if errors else "complete"
    return Carried(tables, phase, skipped, errors)


def run_within(spark: SparkSession, seconds: float, work: Callable[[], object]) -> bool:
    """Run Spark work, cancelling its jobs past a budget. False if it was cut off.

    ``work`` starts its jobs in this thread or in threads made with
    ``inheritable_thread_target``, which carry the tag the jobs are cancelled by. Jobs
    that start after the cut are cancelled too, until the work gives up.
    """
    tag, done, started = f"freshet-{uuid.uuid4().hex}", threading.Event(), time.monotonic()

    def stop() -> None:
        while not done.wait(max(0.0, seconds - (time.monotonic() - started)) or 0.2):
            spark.sparkContext.cancelJobsWithTag(tag)

    watch = threading.Thread(target=stop, daemon=True)
    spark.sparkContext.addJobTag(tag)
    watch.start()
    try:
        work()
        return time.monotonic() - started <= seconds
    except Exception:
        if time.monotonic() - started >= seconds:
            return False
        raise
    finally:
        done.set()
        watch.join()
        spark.sparkContext.removeJobTag(tag)
