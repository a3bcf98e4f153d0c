"""Registered queries for fleet state, verification, access and shared expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import expressions as ex
from ..operators import access, fleet, verify
from ..session import fresh_path
from ..sources.publish import write_reports
from .base import derive, plain, table

QUERIES, ORACLES = {}, {}
AS_OF = "2001-06-01 12:00:00"


def _as_of() -> F.Column:
    return F.to_timestamp(F.lit(AS_OF))


RESTORES = """
SELECT o_custkey AS replica, 'x' || CAST(o_orderkey AS string) AS restore, o_orderkey AS seq,
  's' || CAST(o_orderkey % 97 AS string) AS snapshot,
  CASE o_orderkey % 9 WHEN 0 THEN NULL WHEN 1 THEN 'Pending' WHEN 2 THEN 'Switching' WHEN 3 THEN 'Ready'
       ELSE CASE o_orderstatus WHEN 'F' THEN 'Failed' WHEN 'O' THEN 'Active' ELSE 'Failed' END END AS phase,
  CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE o_orderdate END AS created_at
FROM {orders}"""
REPLICAS = """
SELECT c_custkey AS replica,
  CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE newest END AS current,
  CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE last_at END AS last_completed_at,
  CAST(c_custkey % 4 AS bigint) * 86400 AS grace_seconds,
  c_custkey % 3 = 0 AS carries,
  CASE c_custkey % 6 WHEN 0 THEN 'active' WHEN 1 THEN 'complete' WHEN 2 THEN 'failed: no' ELSE NULL END AS migration_phase,
  CASE c_custkey % 8 WHEN 0 THEN 'active' WHEN 1 THEN 'partial' ELSE NULL END AS redaction_phase,
  CASE WHEN c_custkey % 3 = 1 THEN 's' || CAST(c_custkey % 97 AS string) END AS verified,
  CASE WHEN c_custkey % 2 = 0 THEN 's' || CAST(c_custkey % 11 AS string) END AS desired,
  CASE WHEN c_custkey % 10 = 0 THEN NULL WHEN c_custkey % 2 = 0 THEN TIMESTAMP '2001-05-01 00:00:00'
       ELSE TIMESTAMP '2001-07-01 00:00:00' END AS next_scheduled_at,
  c_custkey % 3 AS failures,
  CASE WHEN c_custkey % 4 = 1 THEN 86400 * 300 END AS minimum_ttl_seconds
FROM {customer} LEFT JOIN (
  SELECT o_custkey, max(o_orderdate) AS last_at,
         'x' || CAST(max(CASE WHEN o_orderstatus = 'O' THEN o_orderkey END) AS string) AS newest
  FROM {orders} GROUP BY o_custkey) o ON o_custkey = c_custkey"""
_FLEET = f"restores AS ({plain(RESTORES)}), replicas AS ({plain(REPLICAS)})"


def _register(name: str, run, oracle: str) -> None:
    QUERIES[name], ORACLES[name] = run, oracle


def fleet_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fleet.roles(derive(spark, sf_dir, RESTORES))


ROLES_SQL = """SELECT replica,
  arg_min(restore, seq) FILTER (WHERE phase = 'Active') AS active,
  arg_min(restore, seq) FILTER (WHERE phase = 'Switching') AS switching,
  arg_min(restore, seq) FILTER (WHERE phase IN ('Pending', 'Restoring', 'Migrating', 'Ready')) AS in_progress
FROM restores GROUP BY replica"""
_register("fleet_roles", fleet_roles, f"WITH {_FLEET} {ROLES_SQL}")


def fleet_removable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fleet.removable(derive(spark, sf_dir, REPLICAS), derive(spark, sf_dir, RESTORES), _as_of())


_register("fleet_removable", fleet_removable, f"""
WITH {_FLEET}
SELECT r.replica, r.restore, 'superseded' AS reason FROM restores r JOIN replicas p USING (replica)
WHERE r.phase = 'Active' AND r.restore <> p.current
  AND (NOT carries OR migration_phase IS NULL OR migration_phase <> 'active')
  AND (redaction_phase IS NULL OR redaction_phase <> 'active')
  AND date_diff('second', last_completed_at, TIMESTAMP '{AS_OF}') > grace_seconds
  AND EXISTS (SELECT 1 FROM restores c WHERE c.replica = p.replica AND c.restore = p.current AND c.phase = 'Active')
UNION ALL
SELECT replica, restore, 'failed' FROM restores
WHERE phase = 'Failed' AND date_diff('second', created_at, TIMESTAMP '{AS_OF}') > 300""")


def fleet_live_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fleet.live_counts(derive(spark, sf_dir, RESTORES))


_LIVE = "count(*) FILTER (WHERE phase IS NULL OR phase <> 'Failed')"
_register("fleet_live_counts", fleet_live_counts,
          f"WITH {_FLEET} SELECT replica, {_LIVE} AS live, {_LIVE} >= 3 AS blocked FROM restores GROUP BY replica")


def fleet_blocking_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fleet.blocking_copies(derive(spark, sf_dir, RESTORES))


_register("fleet_blocking_copies", fleet_blocking_copies, f"""
WITH {_FLEET}
SELECT replica, restore, live FROM (
  SELECT *, count(*) OVER (PARTITION BY replica) AS live FROM restores WHERE phase IS NULL OR phase <> 'Failed') t
WHERE live >= 3""")


def fleet_refresh_due(spark: SparkSession, sf_dir: str) -> DataFrame:
    due = fleet.refresh_due(derive(spark, sf_dir, REPLICAS), derive(spark, sf_dir, RESTORES), _as_of())
    return due.withColumn("reasons", F.array_join("reasons", "; "))


_register("fleet_refresh_due", fleet_refresh_due, f"""
WITH {_FLEET},
roles AS ({ROLES_SQL}),
act AS (SELECT replica, arg_min(snapshot, seq) AS active_snapshot FROM restores WHERE phase = 'Active' GROUP BY replica),
flags AS (
  SELECT p.replica, in_progress, active, p.current, p.verified, desired, last_completed_at, next_scheduled_at,
    failures > 0 AND next_scheduled_at IS NOT NULL AND TIMESTAMP '{AS_OF}' < next_scheduled_at AS backing_off,
    coalesce(date_diff('second', last_completed_at, TIMESTAMP '{AS_OF}') < minimum_ttl_seconds, false) AS within_ttl,
    coalesce(active_snapshot, p.verified) AS carried
  FROM replicas p LEFT JOIN roles USING (replica) LEFT JOIN act USING (replica)),
reasons AS (
  SELECT replica, CASE WHEN in_progress IS NOT NULL THEN '' ELSE concat_ws('; ',
    CASE WHEN active IS NULL AND last_completed_at IS NULL AND verified IS NULL AND NOT backing_off
         THEN 'never restored' END,
    CASE WHEN active IS NULL AND current IS NOT NULL THEN 'current copy gone' END,
    CASE WHEN desired IS NOT NULL AND carried IS DISTINCT FROM desired AND NOT within_ttl
         THEN 'newer snapshot desired' END,
    CASE WHEN next_scheduled_at IS NULL OR (TIMESTAMP '{AS_OF}' >= next_scheduled_at AND NOT within_ttl)
         THEN 'schedule due' END) END AS reasons FROM flags)
SELECT replica, reasons, reasons <> '' AS due FROM reasons""")

ATTEMPTS = "SELECT o_custkey AS replica, o_orderkey AS seq, o_orderdate AS at, o_orderstatus AS status FROM {orders}"
_BACKOFF = "CASE WHEN streak > 0 THEN least(greatest(60 * power(2, least(streak, 20)), 120), 3600)::BIGINT END"
STREAKS_SQL = f"""
attempts AS ({plain(ATTEMPTS)}),
islands AS (SELECT *, count(*) FILTER (WHERE status = 'O') OVER (PARTITION BY replica ORDER BY "at", seq) AS island
            FROM attempts),
streaks AS (SELECT replica, seq, "at", status,
              count(*) FILTER (WHERE status <> 'O') OVER (PARTITION BY replica, island ORDER BY "at", seq) AS streak
            FROM islands)"""


def failure_streaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fleet.failure_streaks(derive(spark, sf_dir, ATTEMPTS), F.col("status") == "O")


_register("failure_streaks", failure_streaks,
          f"WITH {STREAKS_SQL} SELECT *, {_BACKOFF} AS backoff_s FROM streaks")


def failure_current_streaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fleet.current_streaks(derive(spark, sf_dir, ATTEMPTS), F.col("status") == "O")


_register("failure_current_streaks", failure_current_streaks, f"""
WITH {STREAKS_SQL}, newest AS (SELECT replica, arg_max(streak, ("at", seq)) AS streak FROM streaks GROUP BY replica)
SELECT *, {_BACKOFF} AS backoff_s FROM newest""")

DESIRED = """
SELECT 'i' || CAST(c_custkey AS string) AS identity,
  CASE WHEN c_custkey % 6 = 0 THEN NULL ELSE 's' || CAST(c_custkey % 5 AS string) END AS desired_snapshot
FROM {customer}"""
ACTUAL = """
SELECT 'i' || CAST(o_custkey + 40 AS string) AS identity,
  CASE WHEN min(o_orderkey) % 7 = 0 THEN NULL ELSE 's' || CAST(min(o_orderkey) % 5 AS string) END AS actual_snapshot
FROM {orders} GROUP BY o_custkey"""


def fleet_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fleet.diff(derive(spark, sf_dir, DESIRED), derive(spark, sf_dir, ACTUAL))


_register("fleet_diff", fleet_diff, f"""
WITH d AS ({plain(DESIRED)}), a AS ({plain(ACTUAL)})
SELECT coalesce(d.identity, a.identity) AS identity, desired_snapshot, actual_snapshot,
  CASE WHEN a.identity IS NULL THEN 'create' WHEN d.identity IS NULL THEN 'remove'
       WHEN desired_snapshot IS NULL OR desired_snapshot IS NOT DISTINCT FROM actual_snapshot THEN 'keep'
       ELSE 'refresh' END AS action
FROM d FULL JOIN a ON d.identity = a.identity""")

DECLARED = """
SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'Suva  Prod (' || o_orderpriority || ')' WHEN 1 THEN '---'
  WHEN 2 THEN 'Çá ' || o_orderpriority ELSE 'a-very-long-name-for-a-replica-of-many-things-that-goes-on ' || o_orderpriority END AS name,
  substr(m, 1, 8) || '-' || substr(m, 9, 4) || '-' || substr(m, 13, 4) || '-' || substr(m, 17, 4) || '-' || substr(m, 21) AS replica_id,
  md5('server' || CAST(o_custkey AS string)) AS server_id,
  CASE WHEN o_orderkey % 3 = 0 THEN 'reporting-schema' ELSE 'verify' END AS intent,
  CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE md5('version' || o_orderstatus) END AS version_id
FROM (SELECT *, md5(CAST(o_orderkey AS string)) AS m FROM {orders}) o"""


def fleet_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    declared = derive(spark, sf_dir, DECLARED)
    columns = [F.col(c) for c in ("name", "replica_id", "server_id", "intent", "version_id")]
    return declared.select("o_orderkey", fleet.identity(*columns).alias("identity"))


_SLUG = """regexp_replace(substr(coalesce(nullif(lower(regexp_replace(regexp_replace({0}, '[^A-Za-z0-9]+', '-', 'g'),
  '^-+|-+$', '', 'g')), ''), 'replica'), 1, 50), '-+$', '')"""
_register("fleet_identity", fleet_identity, f"""
WITH src AS ({plain(DECLARED)})
SELECT o_orderkey, {_SLUG.format('name')} || '-' || substr(sha256(unhex(replace(replica_id, '-', '') || server_id ||
  CASE WHEN intent = 'reporting-schema' THEN coalesce(version_id, '') ELSE '' END)), 1, 8) AS identity FROM src""")

CONDITIONS = """
SELECT user_id AS replica, 'c' || CAST(event_id % 2 AS string) AS type, ts AS at, event_id AS seq,
  CASE WHEN event_type IN ('error', 'signup') THEN 'False' ELSE 'True' END AS status, event_type AS reason FROM {events}"""


def condition_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fleet.condition_history(derive(spark, sf_dir, CONDITIONS))


_register("condition_history", condition_history, f"""
WITH src AS ({plain(CONDITIONS)}),
seen AS (SELECT *, lag(status) OVER w AS before, row_number() OVER w AS n FROM src
         WINDOW w AS (PARTITION BY replica, type ORDER BY "at", seq)),
moved AS (SELECT *, CASE WHEN n = 1 OR before <> status THEN "at" END AS moved_at FROM seen)
SELECT replica, type, "at", seq, status, reason, max(moved_at) OVER (PARTITION BY replica, type ORDER BY "at", seq) AS last_transition_at
FROM moved""")

SPEC_EVENTS = """
SELECT user_id AS replica, ts AS at, event_id AS seq, event_type = 'error' AS deleted,
  CAST(floor(value) AS bigint) % 2 AS generation FROM {events}"""


def spec_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fleet.spec_changes(derive(spark, sf_dir, SPEC_EVENTS))


CHANGES_SQL = f"""
WITH src AS ({plain(SPEC_EVENTS)}),
seen AS (SELECT *, lag(generation) OVER w AS g, lag(deleted) OVER w AS d, row_number() OVER w AS n FROM src
         WINDOW w AS (PARTITION BY replica ORDER BY "at", seq))
SELECT replica, "at", seq, deleted, generation FROM seen
WHERE NOT deleted AND (n = 1 OR d OR g <> generation)"""
_register("spec_changes", spec_changes, CHANGES_SQL)

RUNS = """
SELECT event_type AS controller, value / 10 AS duration_s, event_id % 7 = 0 AS error FROM {events}"""


def run_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fleet.run_metrics(derive(spark, sf_dir, RUNS))


_register("run_metrics", run_metrics, f"""
WITH src AS ({plain(RUNS)})
SELECT controller, count(*) AS runs, count(*) FILTER (WHERE error) AS errors,
  """ + ", ".join(
    f"count(*) FILTER (WHERE duration_s <= {b!r}) AS le_{format(b, 'g').replace('.', '_')}" for b in fleet.DURATION_BUCKETS
) + ", count(duration_s) AS le_inf, coalesce(sum(round(duration_s * 1000)::BIGINT), 0)::BIGINT AS duration_sum_ms FROM src GROUP BY controller")

SENT = "SELECT source AS name, lang AS event, doc_id % 5 = 0 AS failed FROM {documents}"


def notification_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fleet.notification_counts(derive(spark, sf_dir, SENT))


_register("notification_counts", notification_counts, f"""
WITH src AS ({plain(SENT)})
SELECT name, event, count(*) FILTER (WHERE NOT failed) AS sent, count(*) FILTER (WHERE failed) AS failed
FROM src GROUP BY name, event""")

# --- verification --------------------------------------------------------------------

OUTCOMES = """
SELECT o_orderkey AS restore, CASE WHEN o_orderstatus = 'F' THEN 'failure' ELSE 'success' END AS outcome,
  CASE WHEN o_orderstatus = 'F' THEN 'lost ' || o_orderpriority END AS error FROM {orders}"""
SIZES = """
SELECT l_orderkey AS restore, CASE WHEN l_partkey % 4 = 0 THEN 'app' || CAST(l_linenumber AS string)
  WHEN l_partkey % 4 = 1 THEN 'template0' ELSE 'postgres' END AS name,
  CAST(l_quantity AS bigint) * 1000 AS bytes,
  CAST(l_linenumber AS bigint) * 1000000000000000 + l_partkey * 1000000000
    + CAST(floor(l_extendedprice * 100) AS bigint) AS position FROM {lineitem}"""


def verify_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verify.verdicts(derive(spark, sf_dir, OUTCOMES), derive(spark, sf_dir, SIZES))


_register("verify_verdicts", verify_verdicts, f"""
WITH runs AS ({plain(OUTCOMES)}), sizes AS ({plain(SIZES)}),
known AS (SELECT restore, count(*) FILTER (WHERE name NOT IN ('postgres', 'template0', 'template1')) AS apps
          FROM sizes GROUP BY restore)
SELECT restore, CASE WHEN outcome = 'success' AND apps = 0 THEN 'failure' ELSE outcome END AS outcome,
  CASE WHEN outcome = 'success' AND apps = 0 THEN '{verify.NO_APPLICATION_DATABASE}' ELSE error END AS error
FROM runs LEFT JOIN known USING (restore)""")

HEALTH = """
SELECT o_orderkey AS restore, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_custkey END AS restore_duration_sec,
  CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE '{{"locale":true,"reindex":' ||
    CASE WHEN o_orderkey % 2 = 0 THEN 'true' ELSE 'false' END || '}}' END AS fixes,
  o_orderkey % 5 = 0 AS has_build, o_custkey AS elapsed FROM {orders}"""


def verify_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verify.health_details(_health_runs(spark, sf_dir), derive(spark, sf_dir, SIZES))


def _health_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = derive(spark, sf_dir, HEALTH)
    built = F.struct(F.lit(True).alias("built"), F.col("elapsed").alias("elapsed_sec"), F.lit(None).cast("string").alias("error"))
    return runs.withColumn("build", F.when(F.col("has_build"), built)).drop("has_build", "elapsed")


def verify_health_unsized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports of runs whose databases nobody could ask."""
    return verify.health_details(_health_runs(spark, sf_dir))


_register("verify_health", verify_health, f"""
WITH runs AS ({plain(HEALTH)}), sizes AS ({plain(SIZES)}),
each AS (SELECT restore, name, arg_max(bytes, position) AS bytes FROM sizes WHERE name <> 'template0' GROUP BY ALL),
maps AS (SELECT restore, '{{' || string_agg('"' || name || '":' || bytes::VARCHAR, ',' ORDER BY name) || '}}' AS m
         FROM each GROUP BY restore),
body AS (SELECT restore, concat_ws(',', '"restore_duration_sec":' || restore_duration_sec::VARCHAR, '"sizes":' || m,
  CASE WHEN m IS NOT NULL THEN '"fixes":' || coalesce(fixes, '{{}}') END,
  CASE WHEN has_build THEN '"schema_build":{{"built":true,"elapsed_sec":' || elapsed::VARCHAR || '}}' END) AS b
  FROM runs LEFT JOIN maps USING (restore))
SELECT restore, CASE WHEN b <> '' THEN '{{' || b || '}}' END AS health_details FROM body""")

_register("verify_health_unsized", verify_health_unsized, f"""
WITH runs AS ({plain(HEALTH)}),
body AS (SELECT restore, concat_ws(',', '"restore_duration_sec":' || restore_duration_sec::VARCHAR,
  CASE WHEN has_build THEN '"schema_build":{{"built":true,"elapsed_sec":' || elapsed::VARCHAR || '}}' END) AS b FROM runs)
SELECT restore, CASE WHEN b <> '' THEN '{{' || b || '}}' END AS health_details FROM body""")

REPORTS = """
SELECT o_orderkey AS restore, CASE o_orderkey % 3 WHEN 0 THEN 'upgrade' WHEN 1 THEN 'verify' ELSE NULL END AS intent,
  CASE WHEN o_orderstatus = 'F' THEN 'failure' ELSE 'success' END AS outcome,
  CASE WHEN o_orderstatus = 'F' THEN 'lost "' || o_orderpriority || '"' END AS error,
  o_orderstatus <> 'F' AS replica_healthy, o_custkey AS received_bytes FROM {orders}"""


def verify_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "reports")
    write_reports(derive(spark, sf_dir, REPORTS), path)
    return spark.read.text(path).withColumnRenamed("value", "report")


_register("verify_reports", verify_reports, f"""
WITH src AS ({plain(REPORTS)})
SELECT '{{' || concat_ws(',', '"restore":' || restore::VARCHAR, '"intent":"' || intent || '"', '"outcome":"' || outcome || '"',
  '"error":"' || replace(error, '"', chr(92) || '"') || '"', '"replica_healthy":' || replica_healthy::VARCHAR,
  '"received_bytes":' || received_bytes::VARCHAR) || '}}' AS report FROM src""")

LABELLED = """
SELECT o_orderkey AS replica, o_custkey AS parent,
  CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE md5('g' || CAST(o_custkey AS string)) END AS "group",
  CASE o_orderkey % 5 WHEN 0 THEN NULL WHEN 1 THEN 'not-a-uuid' ELSE md5('s' || CAST(o_orderkey AS string)) END AS server,
  CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE md5('d' || CAST(o_orderkey AS string)) END AS declaration
FROM {orders}"""
PARENTS = """
SELECT c_custkey AS parent, md5('g' || CAST(c_custkey AS string)) AS "group",
  CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE md5('ps' || CAST(c_custkey AS string)) END AS server,
  CASE WHEN c_custkey % 7 = 0 THEN 'bad' ELSE md5('pd' || CAST(c_custkey AS string)) END AS declaration
FROM {customer}"""


def verify_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    replicas = derive(spark, sf_dir, LABELLED.replace('"group"', "`group`"))
    parents = derive(spark, sf_dir, PARENTS.replace('"group"', "`group`"))
    return verify.recover_identity(replicas, parents).withColumn("missing", F.array_join("missing", ","))


_GOOD = "length({0}) = 32"
_register("verify_identity", verify_identity, f"""
WITH r AS ({plain(LABELLED)}), p AS ({plain(PARENTS)}),
j AS (SELECT r.*, p."group" AS pg, p.server AS ps, p.declaration AS pd,
        coalesce(length(r."group") = 32 AND length(r.server) = 32 AND length(r.declaration) = 32, false) AS good
      FROM r LEFT JOIN p USING (parent)),
v AS (SELECT replica, good, CASE WHEN good THEN "group" ELSE coalesce("group", pg) END AS "group",
        CASE WHEN good THEN server ELSE coalesce(server, ps) END AS server,
        CASE WHEN good THEN declaration ELSE coalesce(declaration, pd) END AS declaration FROM j)
SELECT replica, "group", server, declaration,
  concat_ws(',', CASE WHEN NOT coalesce(length("group") = 32, false) THEN 'group' END,
    CASE WHEN NOT coalesce(length(server) = 32, false) THEN 'server' END,
    CASE WHEN NOT coalesce(length(declaration) = 32, false) THEN 'declaration' END) AS missing,
  NOT good AND coalesce(length("group") = 32 AND length(server) = 32 AND length(declaration) = 32, false) AS recovered
FROM v""")

INTENTS = """
SELECT o_orderkey AS restore, CASE o_orderkey % 3 WHEN 0 THEN 'upgrade' WHEN 1 THEN 'reporting-schema' ELSE 'verify' END AS intent,
  CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE '2.' || CAST(o_custkey AS string) || '.0' END AS target_version,
  CASE WHEN o_orderkey % 5 = 0 THEN 'nope' WHEN o_orderkey % 7 = 0 THEN NULL
       ELSE upper(md5(CAST(o_custkey AS string))) END AS target_version_id,
  CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_custkey END AS elapsed FROM {orders}"""


def verify_intents(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = derive(spark, sf_dir, INTENTS)
    result = F.when(F.col("elapsed").isNotNull(), F.struct("elapsed"))
    blocks = verify.intent_blocks(runs.withColumns({"migration": result, "build": result}))
    return blocks.select(
        "restore", F.to_json("migration_block").alias("migration_block"), F.to_json("build_block").alias("build_block")
    )


_register("verify_intents", verify_intents, f"""
WITH src AS ({plain(INTENTS)}), i AS (SELECT *, CASE WHEN length(target_version_id) = 32
  THEN lower(target_version_id) END AS id FROM src)
SELECT restore,
  CASE WHEN intent = 'upgrade' AND elapsed IS NOT NULL AND id IS NOT NULL
       THEN '{{"target_version_id":"' || id || '","migration":{{"elapsed":' || elapsed::VARCHAR || '}}}}' END AS migration_block,
  CASE WHEN intent = 'reporting-schema' AND elapsed IS NOT NULL
       THEN '{{' || concat_ws(',', '"build":{{"elapsed":' || elapsed::VARCHAR || '}}', '"target_version":"' || target_version || '"',
              '"target_version_id":"' || id || '"') || '}}' END AS build_block
FROM i""")

SPANS = """
SELECT event_id, ts AS started_at, CASE event_id % 4 WHEN 0 THEN NULL WHEN 1 THEN TIMESTAMP '2024-01-15 00:00:00'
  ELSE date_trunc('hour', ts) END AS ended_at FROM {events}"""


def verify_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    as_of = F.to_timestamp(F.lit("2024-02-01 00:00:00"))
    start, end = F.col("started_at").cast("timestamp"), F.col("ended_at").cast("timestamp")
    return derive(spark, sf_dir, SPANS).select("event_id", ex.seconds_between(start, end, as_of).alias("seconds"))


_register("verify_durations", verify_durations, f"""
WITH src AS ({plain(SPANS)})
SELECT event_id, greatest((epoch_us(coalesce(ended_at::TIMESTAMP, TIMESTAMP '2024-02-01')) - epoch_us(started_at)) // 1000000, 0)::BIGINT
  AS seconds FROM src""")

BUILDS = """
SELECT o_orderkey AS restore, o_orderkey % 17 = 0 AS settled,
  CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE 'builder' END AS image,
  CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE '2.1.0' END AS target_version,
  o_orderkey % 7 <> 0 AS has_migration, CASE WHEN o_orderkey % 10 = 3 THEN 'm1' END AS failed_migration,
  CASE WHEN o_orderkey % 6 = 1 THEN 'bad' ELSE md5(o_orderpriority) END AS group_own,
  CASE WHEN o_orderkey % 4 = 1 THEN md5(o_orderstatus) END AS group_label,
  CASE o_orderkey % 9 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE 'production' END AS rank,
  CASE WHEN o_orderkey % 5 = 2 THEN NULL ELSE 'CREATE SCHEMA é' || o_orderpriority END AS payload,
  CASE WHEN o_orderkey % 8 = 2 THEN 'refused' END AS registration_error,
  o_orderkey % 2 = 0 AS receipt, o_custkey % 7 AS attempts
FROM {orders}"""


def build_grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    graded = verify.grade_builds(derive(spark, sf_dir, BUILDS))
    return graded.select("restore", "to_do", "retry", "built", "build_error", "schema_bytes")


_TO_DO = """CASE WHEN settled THEN 'settled' WHEN image IS NULL THEN 'no image' WHEN target_version IS NULL THEN 'no target'
  WHEN NOT has_migration OR failed_migration IS NOT NULL THEN 'unmigrated'
  WHEN group_own = 'bad' AND group_label IS NULL THEN 'no group'
  WHEN coalesce(rank, '') = '' THEN 'no rank' ELSE 'build' END"""
_register("build_grades", build_grades, f"""
WITH src AS (SELECT *, {_TO_DO} AS to_do FROM ({plain(BUILDS)}) b),
again AS (SELECT *, to_do = 'build' AND payload IS NULL AND receipt AND attempts < 5 AS retry FROM src)
SELECT restore, to_do, retry,
  CASE WHEN to_do = 'build' AND NOT retry THEN payload IS NOT NULL AND registration_error IS NULL END AS built,
  CASE WHEN to_do = 'build' AND NOT retry THEN coalesce(registration_error,
    CASE WHEN payload IS NULL THEN 'the build produced no schema' END) END AS build_error,
  CASE WHEN to_do = 'build' AND NOT retry THEN strlen(payload)::BIGINT END AS schema_bytes
FROM again""")


def build_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verify.build_reasons(derive(spark, sf_dir, BUILDS))


_register("build_reasons", build_reasons,
          f"SELECT {_TO_DO} AS to_do, count(*) AS runs FROM ({plain(BUILDS)}) b GROUP BY ALL")

# --- access --------------------------------------------------------------------------

USERS = """
SELECT c_custkey AS replica, 'analyst' AS main_user,
  ' reporting, ' || lower(c_mktsegment) || ':dbt+ staging +dbt+ , analyst:dbt,, ' || lower(c_name) || ':' ||
  CASE WHEN c_custkey % 3 = 0 THEN 'public+gone' ELSE '' END || ', ' || lower(c_mktsegment) || ':public' AS users
FROM {customer}"""
SCHEMA_CATALOG = """
SELECT o_custkey AS replica, CASE o_orderkey % 3 WHEN 0 THEN 'app' WHEN 1 THEN 'template1' ELSE 'template0' END AS database,
  CASE o_orderkey % 4 WHEN 0 THEN 'dbt' WHEN 1 THEN 'public' WHEN 2 THEN 'staging' ELSE 'other' END AS schema FROM {orders}"""


def access_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = derive(spark, sf_dir, USERS).withColumn("users", access.parse_users(F.col("users")))
    return access.clean_users(users)


def access_users_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return access_users(spark, sf_dir).withColumn("schemas", F.array_join("schemas", "+"))


USERS_SQL = f"""
src AS ({plain(USERS)}),
items AS (SELECT replica, main_user, trim(u.item) AS item, u.n FROM src,
          (SELECT unnest(string_split(users, ',')) AS item, generate_subscripts(string_split(users, ','), 1) AS n) u
          WHERE trim(u.item) <> ''),
named AS (SELECT replica, n, trim(split_part(item, ':', 1)) AS name,
            list_filter(list_transform(string_split(split_part(item, ':', 2), '+'), lambda s: trim(s)), lambda s: s <> '') AS raw
          FROM items WHERE trim(split_part(item, ':', 1)) NOT IN ('', main_user)),
firsts AS (SELECT *, list_filter(raw, lambda s, i: list_position(raw, s) = i) AS schemas FROM named
           QUALIFY row_number() OVER (PARTITION BY replica, name ORDER BY n) = 1)"""
_register("access_users", access_users_text, f"""
WITH {USERS_SQL}
SELECT replica, (row_number() OVER (PARTITION BY replica ORDER BY n) - 1)::INTEGER AS position, name,
       array_to_string(schemas, '+') AS schemas FROM firsts""")


def access_grants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return access.expand_grants(access_users(spark, sf_dir), derive(spark, sf_dir, SCHEMA_CATALOG))


_register("access_grants", access_grants, f"""
WITH {USERS_SQL},
wanted AS (SELECT replica, name AS "user", unnest(schemas) AS schema FROM firsts),
there AS (SELECT DISTINCT * FROM ({plain(SCHEMA_CATALOG)}) c WHERE database <> 'template0')
SELECT w.replica, database, "user", w.schema, p.privilege FROM wanted w
JOIN there t ON t.replica = w.replica AND t.schema = w.schema,
(VALUES ('usage on schema'), ('select on tables'), ('select on sequences'), ('default select on tables')) p(privilege)""")

RELATIONS = """
SELECT CASE p_partkey % 6 WHEN 0 THEN 'public' WHEN 1 THEN 'pg_catalog' WHEN 2 THEN 'pg_toast_1' WHEN 3 THEN 'information_schema'
  WHEN 4 THEN 'pg_temp_3' ELSE lower(p_type) END AS schema, p_name || CAST(p_partkey AS string) AS name,
  substr('rvmSfpcti', CAST(1 + p_size % 9 AS int), 1) AS relkind, CASE WHEN p_size % 5 = 0 THEN 'p' ELSE 'f' END AS prokind,
  p_brand AS owner, substr('rSfTnx', CAST(1 + p_size % 6 AS int), 1) AS objtype, p_partkey % 4 <> 0 AS is_public FROM {part}"""


def access_public(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = derive(spark, sf_dir, RELATIONS)
    schemas = rows.select("schema", "is_public").distinct()
    return access.public_exposure(schemas, rows, rows, rows)


_OPEN = "is_public AND schema NOT IN ('pg_catalog', 'information_schema') AND NOT starts_with(schema, 'pg_toast') AND NOT starts_with(schema, 'pg_temp')"
_register("access_public", access_public, f"""
WITH src AS ({plain(RELATIONS)})
SELECT DISTINCT 'schema' AS kind, schema, schema AS name FROM src WHERE {_OPEN}
UNION ALL SELECT 'relation', schema, name FROM src WHERE {_OPEN} AND relkind IN ('r', 'v', 'm', 'S', 'f', 'p')
UNION ALL SELECT CASE WHEN prokind = 'p' THEN 'procedure' ELSE 'function' END, schema, name FROM src
  WHERE is_public AND schema NOT IN ('pg_catalog', 'information_schema')
UNION ALL SELECT 'default privilege', schema, owner || ' on ' || CASE objtype WHEN 'r' THEN 'tables' WHEN 'S' THEN 'sequences'
  WHEN 'f' THEN 'functions' WHEN 'T' THEN 'types' ELSE 'schemas' END FROM src
  WHERE is_public AND objtype IN ('r', 'S', 'f', 'T', 'n')""")

# --- shared expressions --------------------------------------------------------------

TEXTS = """
SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN '2.' || CAST(o_custkey AS string) || '.1' WHEN 1 THEN '../' || o_orderstatus
  WHEN 2 THEN '1.0-rc' || '+' || o_orderstatus WHEN 3 THEN '' ELSE 'v 1' END AS version,
  CASE o_orderkey % 4 WHEN 0 THEN 'production' WHEN 1 THEN 'Production' WHEN 2 THEN 'dev' ELSE NULL END AS rank,
  CASE WHEN o_orderkey % 2 = 0 THEN 'we`ird' ELSE lower(o_orderpriority) END AS name,
  ' a,, ' || o_orderpriority || ' ,' AS items,
  CASE o_orderkey % 5 WHEN 0 THEN 'failed: ' || o_orderpriority WHEN 1 THEN 'failed:' WHEN 2 THEN 'complete'
       WHEN 3 THEN 'timeout-skipped' ELSE 'partial' END AS phase,
  o_custkey * 1000000 AS bytes, CASE WHEN o_orderkey % 6 = 0 THEN 1800 END AS explicit_s FROM {orders}"""


def shared_expressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    return derive(spark, sf_dir, TEXTS).select(
        "o_orderkey",
        ex.safe_version(c("version")).alias("safe"),
        ex.known_rank(c("rank")).alias("known"),
        ex.quote_name(c("name")).alias("quoted"),
        F.array_join(ex.comma_list(c("items")), "|").alias("items"),
        ex.failed_reason(c("phase")).alias("reason"),
        ex.ceil_units(c("bytes"), "Mi").alias("mib"),
        ex.readiness_budget(c("explicit_s"), c("bytes") * 1000, 1800).alias("ready_s"),
        ex.slug(c("name")).alias("slug"),
    )


_register("shared_expressions", shared_expressions, f"""
WITH src AS ({plain(TEXTS)})
SELECT o_orderkey, regexp_full_match(version, '[A-Za-z0-9][A-Za-z0-9.+-]*') AS safe,
  rank IN ('production', 'clone', 'demo', 'test', 'dev') AS known, '`' || replace(name, '`', '``') || '`' AS quoted,
  array_to_string(list_filter(list_transform(string_split(items, ','), lambda s: trim(s)), lambda s: s <> ''), '|') AS items,
  CASE WHEN starts_with(phase, 'failed:') THEN trim(substr(phase, 8)) END AS reason,
  ceil(bytes / 1048576.0)::BIGINT AS mib,
  coalesce(explicit_s, 1800 + floor(bytes * 1000 / 107374182400.0::DOUBLE * 900)::BIGINT)::BIGINT AS ready_s,
  {_SLUG.format('name')} AS slug FROM src""")
