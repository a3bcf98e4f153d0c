"""Watching long rebuilds: has the progress of a run stopped moving?

An observation is ``(…keys, at, seq, ok, progress)``: ``progress`` is an opaque
text compared only for change, NULL when nothing is rebuilding; ``ok`` is false
for an observation that failed, which keeps the last progress but counts as seen.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from .ordered import cut, running

# Fixed values.
STALL_SECONDS = 30 * 60
OBSERVE_SECONDS = 60
ABANDONED_SECONDS = 10 * 60

WAIT, NOT_REINDEXING, STALLED = "Wait", "NotReindexing", "Stalled"


def _seconds(start: Column, end: Column) -> Column:
    return (F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))) / F.lit(1_000_000)


def verdict(progress: Column, changed_at: Column, now: Column) -> Column:
    """Waiting, not rebuilding, or stalled for more than half an hour."""
    return (
        F.when(progress.isNull(), NOT_REINDEXING)
        .when(_seconds(changed_at, now) > STALL_SECONDS, STALLED)
        .otherwise(WAIT)
    )


def watch(
    observations: DataFrame, keys: Sequence[str] = ("restore",),
    order: Sequence[str] = ("at", "seq"), segments: int | None = None, moved_at: str | None = None,
) -> DataFrame:
    """Each observation with the watch after it: ``progress, changed_at, verdict``.

    A run unseen for ten minutes is forgotten and watched afresh; failed
    observations with nothing watched yet give no row. ``moved_at`` names a column that
    says, where not NULL, when the progress of an observation had begun: it carries on a
    watch from before.
    """
    at, kept = F.col(order[0]), [c for c in observations.columns if c != "progress"]
    good = F.when(F.col("ok"), F.struct(at.alias("at"), "progress"))

    seen = running(cut(observations, keys, order, segments), keys, order, {
        "_before": ("previous", at), "_good_before": ("previous", good),
    })
    fresh = F.col("_before").isNull() | (_seconds(F.col("_before"), at) > ABANDONED_SECONDS)
    begun = running(seen, keys, order, {"_since": ("last", F.when(fresh, at)), "_good": ("last", good)})
    continued = F.col("_good_before").isNotNull() & (F.col("_good_before.at") >= F.col("_since"))
    same = continued & F.col("_good_before.progress").eqNullSafe(F.col("progress"))
    begun_at = at if moved_at is None else F.coalesce(moved_at, at)
    moved = F.when(F.col("ok") & ~F.coalesce(same, F.lit(False)), begun_at)
    timed = running(begun, keys, order, {"changed_at": ("last", moved)})
    progress = F.col("_good.progress")
    return timed.where(F.col("_good.at") >= F.col("_since")).select(
        *kept, progress.alias("progress"), "changed_at", verdict(progress, F.col("changed_at"), at).alias("verdict")
    )


def past_budget(elapsed: Column, budget: Column, verdict_: Column) -> Column:
    """Why a run past its readiness budget fails; NULL while it may go on.

    A NULL verdict means it was not asked for: the budget is the last word.
    """
    late = F.concat(
        F.lit("the copy was not ready "), elapsed.cast("string"),
        F.lit("s after its restore completed (budget "), budget.cast("string"), F.lit("s)"),
    )
    stalled = F.concat(late, F.lit(f"; its rebuild made no progress for {STALL_SECONDS}s"))
    return F.when(elapsed > budget, F.when(verdict_.isNull() | (verdict_ == NOT_REINDEXING), late)
                  .when(verdict_ == STALLED, stalled))
