"""The two streams that need each key's rows in order: changes and stalls.

A micro-batch is worked off by the batch operators: dealt into even segments by key
and order, however much of it one key holds, with one row in front of each key for
what earlier batches left. What a batch leaves in turn goes into a keyed table, a
version per batch, once the batch's results are written. So a batch that is run
again starts from what its first attempt started from, replaces its own results,
or finds its version there and changes nothing.

Batches follow each other as they come. Inside a batch rows are put in order by
(at, seq); a row older than what its key has seen counts when it arrives.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.fleet import spec_changes
from ..operators.stalls import watch
from ..session import scratch
from .keyed import KeyedTable

#: The version that holds what a backlog left; batch n, counted from 0, leaves version n + 1.
BACKLOG = 0

#: Steps take (carried or None, batch, keys) and give a batch's results, and, from those
#: once written, what they leave.
Step = Callable[[DataFrame | None, DataFrame, Sequence[str]], DataFrame]
Left = Callable[[DataFrame, DataFrame, Sequence[str]], DataFrame]


def _newest(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Of a key's states the one of the latest batch."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col("batch")).alias("n")).select(*keys, "n.*")


def state_table(spark, checkpoint: str, keys: Sequence[str] = ("key",)) -> KeyedTable:
    """What the stream of a checkpoint carries from batch to batch."""
    return KeyedTable(spark, f"{checkpoint}/carried", lambda rows: _newest(rows, keys), F.col("live"))


def _run(
    stream: DataFrame, sink: str, checkpoint: str, keys: Sequence[str], step: Step, left: Left,
    initial: DataFrame | None, trigger: dict,
) -> StreamingQuery:
    if initial is not None:
        backlog = initial.withColumns({"live": F.lit(True), "batch": F.lit(-1).cast("bigint")})
        state_table(stream.sparkSession, checkpoint, keys).keep(BACKLOG, backlog)

    def work(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        state, version = state_table(spark, checkpoint, keys), number + 1
        known = state.versions()
        if known and known[-1] >= version:
            return
        with scratch(spark):
            met = batch.select(*keys).distinct()
            carried = state.read(met, keys).drop("live", "batch") if known else None
            results = step(carried, batch, keys)
            place = f"{sink}/batch={number}"
            results.write.mode("overwrite").parquet(place)
            written = spark.read.schema(results.schema).parquet(place)
            state.keep(version, left(batch, written, keys).withColumn("batch", F.lit(number).cast("bigint")))

    return (
        stream.writeStream.outputMode("append").foreachBatch(work)
        .option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
    )


def _changes(carried: DataFrame | None, batch: DataFrame, keys: Sequence[str]) -> DataFrame:
    rows = batch.select(*keys, "at", "seq", "generation", "deleted", F.lit(1).alias("_turn"))
    if carried is not None:
        rows = rows.unionByName(carried.select(
            *keys, F.timestamp_micros(F.lit(0)).alias("at"), F.lit(0).cast("bigint").alias("seq"),
            "generation", F.lit(False).alias("deleted"), F.lit(0).alias("_turn"),
        ))
    changed = spec_changes(rows, keys, order=("_turn", "at", "seq"))
    return changed.where(F.col("_turn") == 1).select(*keys, "at", "seq", "generation")


def changes_state(events: DataFrame, keys: Sequence[str] = ("key",)) -> DataFrame:
    """What a stream of changes should know after these events: a fold per key."""
    last = _last_events(events, keys)
    return last.where("live").drop("live")


def _last_events(events: DataFrame, keys: Sequence[str]) -> DataFrame:
    newest = F.max_by(F.struct("generation", "deleted"), F.struct("at", "seq"))
    return events.groupBy(*keys).agg(newest.alias("n")).select(
        *keys, F.col("n.generation").alias("generation"), (~F.col("n.deleted")).alias("live"))


def run_changes(
    events: DataFrame, sink: str, checkpoint: str, initial: DataFrame | None = None,
    keys: Sequence[str] = ("key",), **trigger,
) -> StreamingQuery:
    """Write the changes of a stream of ``(…keys, at, seq, generation, deleted)`` to ``sink``.

    ``initial`` is the :func:`changes_state` of a backlog worked off before.
    """
    return _run(events, sink, checkpoint, keys, _changes, lambda batch, _, by: _last_events(batch, by), initial, trigger)


def _stalls(carried: DataFrame | None, batch: DataFrame, keys: Sequence[str]) -> DataFrame:
    rows = batch.select(*keys, "at", "seq", "ok", "progress")
    if carried is None:
        rows = rows.withColumns({"seen_at": F.col("at"), "_turn": F.lit(1), "_changed": F.lit(None).cast("timestamp")})
    else:
        clocks = carried.select(*keys, "observed_at")
        rows = rows.join(clocks, list(keys), "left").select(
            *rows.columns, F.greatest("at", "observed_at").alias("seen_at"), F.lit(1).alias("_turn"),
            F.lit(None).cast("timestamp").alias("_changed"),
        ).unionByName(carried.select(
            *keys, F.col("observed_at").alias("at"), F.lit(0).cast("bigint").alias("seq"), F.lit(True).alias("ok"),
            "progress", F.col("observed_at").alias("seen_at"), F.lit(0).alias("_turn"), F.col("changed_at").alias("_changed"),
        ))
    watched = watch(rows, keys, order=("seen_at", "_turn", "at", "seq"), moved_at="_changed")
    return watched.where(F.col("_turn") == 1).select(*keys, "at", "seq", "progress", "changed_at", "verdict", "seen_at")


def _last_watches(watched: DataFrame, keys: Sequence[str]) -> DataFrame:
    newest = F.max_by(F.struct("progress", F.col("seen_at").alias("observed_at"), "changed_at"), F.struct("seen_at", "at", "seq"))
    return watched.groupBy(*keys).agg(newest.alias("n")).select(*keys, "n.*")


def stalls_state(observations: DataFrame, keys: Sequence[str] = ("key",)) -> DataFrame:
    """What a stream of watches should know after these observations."""
    return _last_watches(watch(observations, keys=list(keys)).withColumn("seen_at", F.col("at")), keys)


def run_stalls(
    observations: DataFrame, sink: str, checkpoint: str, initial: DataFrame | None = None,
    keys: Sequence[str] = ("key",), **trigger,
) -> StreamingQuery:
    """Write the watches of a stream of ``(…keys, at, seq, ok, progress)`` to ``sink``.

    No observation is too late: one from before what its run has been seen at counts as
    seen at that time, ``seen_at``, which the verdict goes by. ``initial`` is the
    :func:`stalls_state` of a backlog worked off before.
    """
    def left(batch: DataFrame, written: DataFrame, by: Sequence[str]) -> DataFrame:
        return _last_watches(written, by).withColumn("live", F.lit(True))

    return _run(observations, sink, checkpoint, keys, _stalls, left, initial, trigger)
