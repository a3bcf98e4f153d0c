"""Registered queries for the streams and their batch twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import fleet, stalls
from ..session import fresh_path
from ..streaming import latest, progress
from ..streaming.base import read_files
from ..streaming.keyed import KeyedTable, keep_folded
from ..streaming.ordered import run_changes, run_stalls
from .base import derive, plain, table

QUERIES, ORACLES = {}, {}


def events_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The given events as a file stream, with instants in place of local times."""
    schema = table(spark, sf_dir, "events").schema
    stream = read_files(spark, sf_dir, schema, pathGlobFilter="events.parquet")
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


# --- progress ------------------------------------------------------------------------

# A cumulative counter per user: minutes since the start never go back.
_UUID = "md5('run' || CAST(user_id AS string))"
SAMPLES = f"""
SELECT ts AS at, event_id, CASE WHEN event_id % 23 = 0 THEN 'not json' WHEN event_id % 29 = 0 THEN '{{{{"run_id": "x"}}}}'
  ELSE '{{{{"run_id": "' || {_UUID} || '", "type": "' || CASE WHEN user_id % 2 = 0 THEN 'restore' ELSE 'verify' END ||
  '", "sent_raw_bytes": ' || CAST(CASE WHEN event_id % 31 = 0 THEN -1 ELSE event_id * 7 END AS string) ||
  ', "sent_payload_bytes": ' || CASE WHEN user_id % 11 = 0 THEN '18446744073709551615' ELSE CAST(event_id * 5 AS string) END ||
  ', "received_raw_bytes": ' || CASE WHEN event_id % 37 = 0 THEN '1.5' ELSE CAST(event_id * 3 AS string) END ||
  ', "received_payload_bytes": ' || CAST(event_id AS string) || '}}}}' END AS body
FROM {{events}}"""
_SAMPLES_OK = f"""
ok AS (SELECT "at", {_UUID} AS run_id, CASE WHEN user_id % 2 = 0 THEN 'restore' ELSE 'verify' END AS type,
  event_id * 7 AS sent_raw_bytes,
  CASE WHEN user_id % 11 = 0 THEN 9223372036854775807 ELSE event_id * 5 END AS sent_payload_bytes,
  event_id * 3 AS received_raw_bytes, event_id AS received_payload_bytes
  FROM (SELECT *, ts AS "at" FROM events) e WHERE event_id % 23 <> 0 AND event_id % 29 <> 0 AND event_id % 31 <> 0 AND event_id % 37 <> 0)"""
_TOTALS_SQL = f"WITH {_SAMPLES_OK} SELECT run_id, type, " + ", ".join(
    f"max({c})::BIGINT AS {c}" for c in progress.COUNTERS
) + " FROM ok GROUP BY run_id, type"


def _with_bodies(events: DataFrame) -> DataFrame:
    """The sample texts of SAMPLES, over a stream as well as a table."""
    view = f"events_{id(events)}"
    events.createOrReplaceTempView(view)
    try:
        return events.sparkSession.sql(SAMPLES.format(events=view))
    finally:
        events.sparkSession.catalog.dropTempView(view)


def progress_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return progress.totals(progress.parse_samples(derive(spark, sf_dir, SAMPLES)))


def progress_totals_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    sink, checkpoint = fresh_path(spark, "progress"), fresh_path(spark, "progress-state")
    samples = progress.parse_samples(_with_bodies(events_stream(spark, sf_dir)))
    keep_folded(samples.drop("at", "event_id"), sink, progress.totals, checkpoint).awaitTermination()
    return KeyedTable(spark, sink, progress.totals).read()


def progress_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rates = progress.rates(progress.parse_samples(derive(spark, sf_dir, SAMPLES)))
    return rates.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


QUERIES["progress_totals"] = progress_totals
ORACLES["progress_totals"] = _TOTALS_SQL
QUERIES["progress_totals_stream"] = progress_totals_stream
ORACLES["progress_totals_stream"] = _TOTALS_SQL
QUERIES["progress_rates"] = progress_rates
ORACLES["progress_rates"] = f"WITH {_SAMPLES_OK}, w AS (SELECT run_id, type, date_trunc('hour', ok.at)::TIMESTAMP AS window_start, " + ", ".join(
    f"max({c}) AS {c}" for c in progress.COUNTERS
) + " FROM ok GROUP BY ALL) SELECT run_id, type, window_start, " + ", ".join(
    f"greatest({c} - coalesce(max({c}) OVER (PARTITION BY run_id, type ORDER BY window_start"
    f" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 0)::BIGINT AS {c}" for c in progress.COUNTERS
) + " FROM w"

# --- stalls --------------------------------------------------------------------------

# Two hundred runs or so are seen every few minutes; a user's events are its observations.
OBSERVATIONS = """
SELECT event_id % 4 AS key, ts AS at, event_id AS seq, event_type <> 'error' AS ok,
  CASE WHEN event_id % 400 < 40 THEN NULL ELSE 'step ' || CAST(CAST(floor(event_id / 120) AS bigint) AS string) END AS progress
FROM {events}"""
STALLS_SQL = f"""
WITH obs AS ({plain(OBSERVATIONS)}),
seen AS (SELECT *, lag("at") OVER w AS before FROM obs WINDOW w AS (PARTITION BY key ORDER BY "at", seq)),
sessions AS (SELECT *, sum(CASE WHEN before IS NULL OR epoch_us("at") - epoch_us(before) > 600000000 THEN 1 ELSE 0 END)
               OVER (PARTITION BY key ORDER BY "at", seq) AS session FROM seen),
counted AS (SELECT *, count(*) FILTER (WHERE ok) OVER (PARTITION BY key, session ORDER BY "at", seq) AS goods FROM sessions),
goods AS (SELECT key, session, goods, "at" AS good_at, progress,
            lag(progress) OVER w AS last_progress, row_number() OVER w AS n FROM counted WHERE ok
          WINDOW w AS (PARTITION BY key, session ORDER BY goods)),
moves AS (SELECT *, max(CASE WHEN n = 1 OR progress IS DISTINCT FROM last_progress THEN good_at END)
            OVER (PARTITION BY key, session ORDER BY goods) AS changed_at FROM goods)
SELECT c.key, c."at", c.seq, m.progress, m.changed_at,
  CASE WHEN m.progress IS NULL THEN 'NotReindexing'
       WHEN epoch_us(c."at") - epoch_us(m.changed_at) > 1800000000 THEN 'Stalled' ELSE 'Wait' END AS verdict
FROM counted c JOIN moves m ON m.key = c.key AND m.session = c.session AND m.goods = c.goods"""


def stall_watch(spark: SparkSession, sf_dir: str) -> DataFrame:
    watched = stalls.watch(derive(spark, sf_dir, OBSERVATIONS), keys=["key"])
    return watched.select("key", "at", "seq", "progress", "changed_at", "verdict")


def stall_watch_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = events_stream(spark, sf_dir)
    observations = events.select(
        (F.col("event_id") % 4).alias("key"), F.col("ts").alias("at"), F.col("event_id").alias("seq"),
        (F.col("event_type") != "error").alias("ok"),
        F.when(F.col("event_id") % 400 >= 40, F.concat(
            F.lit("step "), F.floor(F.col("event_id") / 120).cast("string"))).alias("progress"),
    )
    sink = fresh_path(spark, "stalls")
    run_stalls(observations, sink, fresh_path(spark, "stalls-state")).awaitTermination()
    out = spark.read.parquet(sink).drop("batch", "seen_at")
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("at", "changed_at")})


def stall_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    watched = stall_watch(spark, sf_dir)
    elapsed = F.col("seq") * 3
    asked = F.when(F.col("seq") % 5 != 0, F.col("verdict"))
    return watched.select("seq", stalls.past_budget(elapsed, F.lit(1800), asked).alias("failure"))


QUERIES["stall_watch"] = stall_watch
ORACLES["stall_watch"] = STALLS_SQL
QUERIES["stall_watch_stream"] = stall_watch_stream
ORACLES["stall_watch_stream"] = STALLS_SQL
QUERIES["stall_budget"] = stall_budget
ORACLES["stall_budget"] = f"""
SELECT seq, CASE WHEN seq * 3 > 1800 AND (seq % 5 = 0 OR verdict <> 'Wait') THEN
  'the copy was not ready ' || (seq * 3)::VARCHAR || 's after its restore completed (budget 1800s)' ||
  CASE WHEN seq % 5 <> 0 AND verdict = 'Stalled' THEN '; its rebuild made no progress for 1800s' ELSE '' END END AS failure
FROM ({STALLS_SQL}) t"""

# --- latest payloads and changes -------------------------------------------------------

PAYLOADS = "SELECT user_id AS key, ts AS at, event_id AS seq, event_type || ' ' || props AS payload FROM {events}"


def _as_of() -> F.Column:
    return F.to_timestamp(F.lit("2024-01-30 20:00:00"))


_HELD_SQL = f"""
WITH src AS ({plain(PAYLOADS)})
SELECT key, "at", seq, payload FROM src
QUALIFY row_number() OVER (PARTITION BY key ORDER BY "at" DESC, seq DESC) = 1
  AND epoch_us(TIMESTAMP '2024-01-30 20:00:00') - epoch_us("at") < 86400000000::BIGINT"""


def latest_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest.held(derive(spark, sf_dir, PAYLOADS), _as_of(), max_age_seconds=86400)


def latest_payloads_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    payloads = events_stream(spark, sf_dir).select(
        F.col("user_id").alias("key"), F.col("ts").alias("at"), F.col("event_id").alias("seq"),
        F.concat("event_type", F.lit(" "), "props").alias("payload"),
    )
    sink, checkpoint = fresh_path(spark, "latest"), fresh_path(spark, "latest-state")
    keep_folded(payloads, sink, latest.newest, checkpoint).awaitTermination()
    held = latest.held(KeyedTable(spark, sink, latest.newest).read(), _as_of(), max_age_seconds=86400)
    return held.withColumn("at", F.col("at").cast("timestamp_ntz"))


QUERIES["latest_payloads"] = latest_payloads
ORACLES["latest_payloads"] = _HELD_SQL
QUERIES["latest_payloads_stream"] = latest_payloads_stream
ORACLES["latest_payloads_stream"] = _HELD_SQL


def spec_changes_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = events_stream(spark, sf_dir).select(
        F.col("user_id").alias("key"), F.col("ts").alias("at"), F.col("event_id").alias("seq"),
        (F.floor("value").cast("bigint") % 2).alias("generation"), (F.col("event_type") == "error").alias("deleted"),
    )
    sink = fresh_path(spark, "changes")
    run_changes(events, sink, fresh_path(spark, "changes-state")).awaitTermination()
    return spark.read.parquet(sink).drop("batch").withColumn("at", F.col("at").cast("timestamp_ntz"))


QUERIES["spec_changes_stream"] = spec_changes_stream
ORACLES["spec_changes_stream"] = """
WITH seen AS (SELECT user_id AS key, ts AS "at", event_id AS seq, event_type = 'error' AS deleted,
    CAST(floor(value) AS bigint) % 2 AS generation, row_number() OVER w AS n,
    lag(CAST(floor(value) AS bigint) % 2) OVER w AS g, lag(event_type = 'error') OVER w AS d
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT key, "at", seq, generation FROM seen WHERE NOT deleted AND (n = 1 OR d OR g <> generation)"""
