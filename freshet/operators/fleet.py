"""State of the fleet: what each replica is on, what is stale, due, failing or off."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.expressions import slug
from .ordered import SEGMENT, cut, running

# Fixed values.
IN_PROGRESS = ["Pending", "Restoring", "Migrating", "Ready"]
MAX_LIVE_COPIES = 3
FAILED_GRACE_SECONDS = 300
BACKOFF_BASE_SECONDS = 60
BACKOFF_MIN_SECONDS = 120
BACKOFF_MAX_SECONDS = 3600
BACKOFF_MAX_EXPONENT = 20
DURATION_BUCKETS = [0.01, 0.05, 0.1, 0.5, 1.0, 5.0, 10.0, 30.0, 60.0]
PER_VERSION_INTENT = "reporting-schema"


def _age_seconds(since: str | Column, as_of: Column) -> Column:
    since = F.col(since) if isinstance(since, str) else since
    return (F.unix_micros(as_of) - F.unix_micros(since.cast("timestamp"))) / F.lit(1_000_000)


def roles(restores: DataFrame, order: str = "seq") -> DataFrame:
    """Each replica's active, switching and in-progress restore, the first of each."""
    def first(phase: Column) -> Column:
        return F.min_by(F.when(phase, F.col("restore")), F.when(phase, F.col(order)))

    phase = F.col("phase")
    return restores.groupBy("replica").agg(
        first(phase == "Active").alias("active"),
        first(phase == "Switching").alias("switching"),
        first(phase.isin(IN_PROGRESS)).alias("in_progress"),
    )


def _settled(phase: str) -> Column:
    return F.col(phase).isNull() | (F.col(phase) != "active")


def removable(replicas: DataFrame, restores: DataFrame, as_of: Column) -> DataFrame:
    """Restores to remove, with the reason: superseded, or failed a while ago.

    ``replicas`` has ``replica, current, last_completed_at, grace_seconds,
    carries, migration_phase, redaction_phase``; ``restores`` has ``replica,
    restore, phase, created_at``. A superseded copy goes only if the current one
    is really there and Active, its grace period is over, and no step that may
    still read from the old copy is running.
    """
    active = restores.where("phase = 'Active'").select("replica", "restore")
    ready = replicas.where(
        (~F.col("carries") | _settled("migration_phase"))
        & _settled("redaction_phase")
        & (_age_seconds("last_completed_at", as_of) > F.col("grace_seconds"))
    ).select("replica", "current")
    confirmed = ready.join(
        active.select("replica", F.col("restore").alias("current")), ["replica", "current"], "left_semi"
    )
    stale = (
        active.join(confirmed, "replica")
        .where(F.col("restore") != F.col("current"))
        .select("replica", "restore", F.lit("superseded").alias("reason"))
    )
    failed = restores.where(
        (F.col("phase") == "Failed") & (_age_seconds("created_at", as_of) > FAILED_GRACE_SECONDS)
    ).select("replica", "restore", F.lit("failed").alias("reason"))
    return stale.unionByName(failed)


def live_counts(restores: DataFrame) -> DataFrame:
    """Copies that have not failed, per replica, and whether another one is refused."""
    live = F.col("phase").isNull() | (F.col("phase") != "Failed")
    counted = restores.groupBy("replica").agg(F.count_if(live).alias("live"))
    return counted.withColumn("blocked", F.col("live") >= MAX_LIVE_COPIES)


def blocking_copies(restores: DataFrame) -> DataFrame:
    """The live copies of every blocked replica, one row each.

    Rows rather than one list per replica: a replica may have any number.
    """
    live = restores.where(F.col("phase").isNull() | (F.col("phase") != "Failed"))
    blocked = live_counts(restores).where("blocked").select("replica", "live")
    return live.join(blocked, "replica").select("replica", "restore", "live")


def refresh_due(replicas: DataFrame, restores: DataFrame, as_of: Column) -> DataFrame:
    """Which replicas should start a restore now, and every reason for it.

    ``replicas`` has ``replica, current, verified, desired, last_completed_at,
    next_scheduled_at, failures, minimum_ttl_seconds``. Nothing starts while a
    restore is in progress. ``next_scheduled_at`` comes from the schedule's
    owner; a missing one counts as due.
    """
    actives = restores.where("phase = 'Active'").select(
        "replica", F.col("restore").alias("active"), F.col("snapshot").alias("active_snapshot"), "seq"
    )
    first_active = actives.groupBy("replica").agg(
        F.min_by(F.struct("active", "active_snapshot"), "seq").alias("a")
    )
    state = replicas.join(roles(restores).select("replica", "in_progress"), "replica", "left").join(
        first_active, "replica", "left"
    )
    no_active = F.col("a").isNull()
    next_at = F.col("next_scheduled_at").cast("timestamp")
    backing_off = (F.coalesce("failures", F.lit(0)) > 0) & F.coalesce(as_of < next_at, F.lit(False))
    within_ttl = F.coalesce(
        _age_seconds("last_completed_at", as_of) < F.col("minimum_ttl_seconds"), F.lit(False)
    )
    never = no_active & F.col("last_completed_at").isNull() & F.col("verified").isNull() & ~backing_off
    gone = no_active & F.col("current").isNotNull()
    carried = F.coalesce("a.active_snapshot", "verified")
    newer = F.col("desired").isNotNull() & ~carried.eqNullSafe(F.col("desired")) & ~within_ttl
    scheduled = next_at.isNull() | ((as_of >= next_at) & ~within_ttl)
    reasons = F.array_compact(F.array(
        F.when(never, "never restored"),
        F.when(gone, "current copy gone"),
        F.when(newer, "newer snapshot desired"),
        F.when(scheduled, "schedule due"),
    ))
    idle = F.col("in_progress").isNull()
    return state.select(
        "replica",
        F.when(idle, reasons).otherwise(F.array().cast("array<string>")).alias("reasons"),
    ).withColumn("due", F.size("reasons") > 0)


def backoff_seconds(failures: Column) -> Column:
    """Delay after so many failures in a row: doubling from 2 minutes to an hour; none for 0."""
    exponent = F.least(failures, F.lit(BACKOFF_MAX_EXPONENT)).cast("int")
    doubled = (F.lit(BACKOFF_BASE_SECONDS) * F.pow(F.lit(2.0), exponent)).cast("bigint")
    clamped = F.least(
        F.greatest(doubled, F.lit(BACKOFF_MIN_SECONDS).cast("bigint")), F.lit(BACKOFF_MAX_SECONDS).cast("bigint")
    )
    return F.when(failures > 0, clamped)


def failure_streaks(
    attempts: DataFrame, ok: Column, keys: Sequence[str] = ("replica",),
    order: Sequence[str] = ("at", "seq"), segments: int | None = None,
) -> DataFrame:
    """Adds ``streak``, failures in a row up to each attempt, and its ``backoff_s``.

    Failures up to the row, less the failures up to the last success: both are
    running values, so a replica may have any number of attempts.
    """
    marked = attempts.withColumn("_failed", F.when(ok, F.lit(0)).otherwise(F.lit(1)).cast("bigint"))
    pieces = cut(marked, keys, order, segments)
    counted = running(pieces, keys, order, {"_failures": ("sum", F.col("_failed"))})
    settled = running(
        counted, keys, order, {"_at_success": ("max", F.when(F.col("_failed") == 0, F.col("_failures")))}
    )
    streak = F.col("_failures") - F.coalesce("_at_success", F.lit(0))
    return settled.select(*attempts.columns, streak.alias("streak"), backoff_seconds(streak).alias("backoff_s"))


def current_streaks(
    attempts: DataFrame, ok: Column, keys: Sequence[str] = ("replica",), order: Sequence[str] = ("at", "seq")
) -> DataFrame:
    """Only the newest streak per replica: two folds and no window at all."""
    at = F.struct(*order)
    successes = attempts.where(ok).groupBy(*keys).agg(F.max(at).alias("_last"))
    after = attempts.join(successes, list(keys), "left").groupBy(*keys).agg(
        F.count_if(F.col("_last").isNull() | (at > F.col("_last"))).alias("streak")
    )
    return after.withColumn("backoff_s", backoff_seconds(F.col("streak")))


def diff(desired: DataFrame, actual: DataFrame, keys: Sequence[str] = ("identity",)) -> DataFrame:
    """What to do about each identity: create, refresh, keep or remove.

    ``desired`` has ``desired_snapshot`` and ``actual`` has ``actual_snapshot``;
    wanting no particular snapshot never changes one.
    """
    wanted = desired.select(*keys, "desired_snapshot", F.lit(True).alias("_wanted"))
    there = actual.select(*keys, "actual_snapshot", F.lit(True).alias("_there"))
    same = F.col("desired_snapshot").isNull() | F.col("desired_snapshot").eqNullSafe(F.col("actual_snapshot"))
    action = (
        F.when(F.col("_there").isNull(), "create")
        .when(F.col("_wanted").isNull(), "remove")
        .when(same, "keep")
        .otherwise("refresh")
    )
    return wanted.join(there, list(keys), "full_outer").select(
        *keys, "desired_snapshot", "actual_snapshot", action.alias("action")
    )


def identity(name: Column, replica_id: Column, server_id: Column, intent: Column, version_id: Column) -> Column:
    """Name and eight hex digits that tell one replica from every other.

    The version is part of it only where one declaration has a replica for each.
    """
    def raw(uuid: Column) -> Column:
        return F.unhex(F.replace(uuid, F.lit("-"), F.lit("")))

    version = F.when(
        (intent == PER_VERSION_INTENT) & version_id.isNotNull(), raw(version_id)
    ).otherwise(F.unhex(F.lit("")))
    digest = F.sha2(F.concat(raw(replica_id), raw(server_id), version), 256)
    return F.concat(slug(name), F.lit("-"), F.substring(digest, 1, 8))


def condition_history(
    updates: DataFrame, keys: Sequence[str] = ("replica", "type"),
    order: Sequence[str] = ("at", "seq"), segments: int | None = None,
) -> DataFrame:
    """Adds ``last_transition_at``: it moves only when the status changes."""
    seen = running(cut(updates, keys, order, segments), keys, order, {"_before": ("previous", F.struct("status"))})
    changed = F.col("_before").isNull() | ~F.col("_before.status").eqNullSafe(F.col("status"))
    moved = running(seen, keys, order, {"last_transition_at": ("last", F.when(changed, F.col(order[0])))})
    return moved.drop("_before", SEGMENT)


def spec_changes(
    events: DataFrame, keys: Sequence[str] = ("replica",),
    order: Sequence[str] = ("at", "seq"), segments: int | None = None,
) -> DataFrame:
    """Events whose generation differs from the last one seen for their key.

    ``events`` has ``generation, deleted``. A key's first event counts; a
    deletion forgets the key and is no change itself.
    """
    before = F.struct("generation", "deleted")
    seen = running(cut(events, keys, order, segments), keys, order, {"_before": ("previous", before)})
    same = ~F.col("_before.deleted") & F.col("_before.generation").eqNullSafe(F.col("generation"))
    return seen.where(~F.col("deleted") & ~F.coalesce(same, F.lit(False))).drop("_before", SEGMENT)


def run_metrics(runs: DataFrame, keys: Sequence[str] = ("controller",)) -> DataFrame:
    """Runs, errors and a cumulative duration histogram, with its sum, per controller."""
    buckets = [
        F.count_if(F.col("duration_s") <= bound).alias("le_" + f"{bound:g}".replace(".", "_"))
        for bound in DURATION_BUCKETS
    ]
    return runs.groupBy(*keys).agg(
        F.count("*").alias("runs"),
        F.count_if(F.col("error")).alias("errors"),
        *buckets,
        F.count("duration_s").alias("le_inf"),
        # In whole milliseconds, so that the sum is the same in any order.
        F.coalesce(F.sum(F.round(F.col("duration_s") * 1000).cast("bigint")), F.lit(0)).alias("duration_sum_ms"),
    )


def notification_counts(sent: DataFrame) -> DataFrame:
    """Notifications by name and event, sent and failed."""
    return sent.groupBy("name", "event").agg(
        F.count_if(~F.col("failed")).alias("sent"), F.count_if(F.col("failed")).alias("failed")
    )
