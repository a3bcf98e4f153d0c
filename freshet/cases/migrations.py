"""Registered queries for migration audits and job logs."""

from __future__ import annotations

from itertools import product

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import logs, migrations
from .base import derive, plain, table

QUERIES, ORACLES = {}, {}

# Orders are runs; each of their lines is a logged batch of three migrations.
BATCHES = """
SELECT l_orderkey AS restore,
  CAST(l_linenumber AS bigint) * 1000000000000000 + l_partkey * 1000000000
    + CAST(floor(l_extendedprice * 100) AS bigint) AS batch,
  l_shipdate AS logged_at, CASE WHEN l_returnflag = 'R' THEN 'down' ELSE 'up' END AS direction,
  '["' || one || '", "' || two || '", "late"]' AS names,
  CASE WHEN l_partkey % 3 = 0 THEN NULL ELSE CAST(l_quantity AS bigint) * 9970 END AS batch_duration_ms,
  CASE WHEN l_partkey % 29 = 0 THEN NULL ELSE
  '{{"durationMsPerMigration": {{"' || one || '": ' || CAST(CAST(l_quantity AS bigint) * 997 AS string) ||
  CASE WHEN l_suppkey % 4 = 0 THEN '' WHEN l_suppkey % 4 = 1 THEN ', "' || two || '": "12500"'
       ELSE ', "' || two || '": 12500' END || '}}' ||
  CASE l_partkey % 7 WHEN 0 THEN '' WHEN 1 THEN ', "preSnapshot": {{"databaseSizeBytes": -1}}'
       WHEN 2 THEN ', "preSnapshot": {{"databaseSizeBytes": "' || CAST(l_partkey * 1000 AS string) || '"}}'
       WHEN 3 THEN ', "preSnapshot": {{"databaseSizeBytes": "lots"}}'
       ELSE ', "preSnapshot": {{"databaseSizeBytes": ' || CAST(l_partkey * 1000 AS string) || '}}' END ||
  CASE WHEN l_suppkey % 3 = 0 THEN ', "failedMigration": "' || two || '"' ELSE '' END ||
  CASE l_partkey % 5 WHEN 0 THEN '' WHEN 1 THEN ', "error": {{"name": "LookupFailed", "message": " no relation "}}'
       WHEN 2 THEN ', "error": {{"code": "23503", "name": "X", "message": "violates", "table": "bookings",' ||
         ' "column": "room_id", "constraint": "fk_room", "detail": "Key (id)=(' || CAST(l_partkey AS string) || ')."}}'
       WHEN 3 THEN ', "error": {{"code": "  ", "column": "c", "hint": "try again"}}'
       ELSE ', "error": {{"message": 5, "constraint": "only"}}' END || '}}' END AS stats
FROM (SELECT *, 'm' || CAST(l_partkey AS string) || '-a.ts' AS one,
             'm' || CAST(l_suppkey AS string) || '-b.ts' AS two FROM {lineitem}) l
"""
RUNS = """
SELECT o_orderkey AS restore, o_orderdate AS started_at, o_orderstatus = 'F' AS job_failed,
  CAST(floor(o_totalprice * 100) AS bigint) AS bytes_after,
  CASE WHEN o_orderkey % 2 = 0 THEN 'tail of ' || CAST(o_orderkey AS string) ELSE '' END AS log_tail
FROM {orders}"""


def _batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.from_json("names", "array<string>")
    return derive(spark, sf_dir, BATCHES).withColumn("migrations", names).drop("names")


def _newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return migrations.run_batches(_batches(spark, sf_dir), derive(spark, sf_dir, RUNS))


AUDIT_SQL = f"""
batches AS ({plain(BATCHES)}), runs AS ({plain(RUNS)}),
base AS (SELECT r.restore, max(b.logged_at) AS baseline FROM runs r
         LEFT JOIN batches b ON b.restore = r.restore AND b.logged_at < r.started_at GROUP BY r.restore),
newest AS (SELECT b.* FROM batches b JOIN base USING (restore)
           WHERE direction = 'up' AND (baseline IS NULL OR logged_at > baseline)
           QUALIFY row_number() OVER (PARTITION BY restore ORDER BY logged_at DESC, batch DESC) = 1)"""
_DURATION = """CASE WHEN json_type(stats, '$.durationMsPerMigration."' || name || '"') IN ('BIGINT', 'UBIGINT')
  THEN (stats->>('$.durationMsPerMigration."' || name || '"'))::BIGINT ELSE 0 END // 1000"""


def migration_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return migrations.baselines(_batches(spark, sf_dir), derive(spark, sf_dir, RUNS))


QUERIES["migration_baseline"] = migration_baseline
ORACLES["migration_baseline"] = f"WITH {AUDIT_SQL} SELECT restore, baseline FROM base"


def migration_newest_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _newest(spark, sf_dir).select("restore", "batch", "logged_at", "batch_duration_ms")


QUERIES["migration_newest_batch"] = migration_newest_batch
ORACLES["migration_newest_batch"] = f"WITH {AUDIT_SQL} SELECT restore, batch, logged_at, batch_duration_ms FROM newest"


def migration_timing_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return migrations.migration_timings(_batches(spark, sf_dir))


QUERIES["migration_timings"] = migration_timing_rows
ORACLES["migration_timings"] = f"""
WITH batches AS ({plain(BATCHES)}),
each AS (SELECT restore, batch, stats, n.key::INTEGER AS position, n.value->>'$' AS name
         FROM batches, json_each(names) n)
SELECT restore, batch, position, name, ({_DURATION})::BIGINT AS elapsed_seconds FROM each"""


def migration_result_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return migrations.migration_results(derive(spark, sf_dir, RUNS), _newest(spark, sf_dir))


def migration_result(spark: SparkSession, sf_dir: str) -> DataFrame:
    timing_text = F.array_join(
        F.transform("timings", lambda t: F.concat(t["name"], F.lit("="), t["elapsed_seconds"].cast("string"))), ","
    )
    return migration_result_rows(spark, sf_dir).withColumn("timings", timing_text)


_FIELDS = ["code", "name", "message", "table", "column", "constraint", "detail", "hint"]
ERROR_SQL = ", ".join(
    f"""CASE WHEN json_type(stats, '$.error.{f}') = 'VARCHAR'
        THEN nullif(trim(stats->>'$.error.{f}'), '') END AS e_{f}""" for f in _FIELDS
)
ERROR_LINE = """nullif(concat_ws(' ', nullif(concat_ws(': ', coalesce(e_code, e_name), e_message), ''),
  '[' || nullif(concat_ws(', ', nullif(concat_ws('.', e_table, e_column), ''), e_constraint), '') || ']',
  'DETAIL: ' || e_detail, 'HINT: ' || e_hint), '')"""
RESULT_SQL = f"""
{AUDIT_SQL},
each AS (SELECT restore, stats, n.key::INTEGER AS position, n.value->>'$' AS name FROM newest, json_each(names) n),
timed AS (SELECT restore, position, name, ({_DURATION})::BIGINT AS s FROM each),
texts AS (SELECT restore, string_agg(name || '=' || s::VARCHAR, ',' ORDER BY position) AS timings, sum(s)::BIGINT AS total
          FROM timed GROUP BY restore),
errors AS (SELECT restore, stats, batch_duration_ms, {ERROR_SQL} FROM newest),
results AS (
  SELECT r.restore, e.restore IS NOT NULL AS has_batch,
    coalesce(batch_duration_ms // 1000, total, 0)::BIGINT AS elapsed_seconds,
    CASE WHEN job_failed THEN coalesce(CASE WHEN json_type(stats, '$.failedMigration') = 'VARCHAR'
      THEN stats->>'$.failedMigration' END, 'unknown') END AS failed_migration,
    CASE WHEN job_failed THEN coalesce({ERROR_LINE}, nullif(log_tail, '')) END AS error,
    coalesce(CASE WHEN TRY_CAST(stats->>'$.preSnapshot.databaseSizeBytes' AS BIGINT) >= 0
      THEN TRY_CAST(stats->>'$.preSnapshot.databaseSizeBytes' AS BIGINT) END, bytes_after) AS bytes_before,
    bytes_after, coalesce(timings, '') AS timings
  FROM runs r LEFT JOIN errors e USING (restore) LEFT JOIN texts USING (restore))"""

QUERIES["migration_result"] = migration_result
ORACLES["migration_result"] = f"WITH {RESULT_SQL} SELECT * FROM results"


def migration_error_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    return migrations.error_lines(_batches(spark, sf_dir))


QUERIES["migration_error_line"] = migration_error_line
ORACLES["migration_error_line"] = f"""
WITH batches AS ({plain(BATCHES)}), e AS (SELECT restore, batch, {ERROR_SQL} FROM batches)
SELECT restore, batch, {ERROR_LINE} AS error FROM e"""


def migration_growth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return migrations.growth(migration_result_rows(spark, sf_dir))


QUERIES["migration_growth"] = migration_growth
ORACLES["migration_growth"] = f"""
WITH {RESULT_SQL} SELECT restore, bytes_after - bytes_before AS growth_bytes FROM results"""


def migration_growth_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return migrations.growth(migration_result_rows(spark, sf_dir), top=20)


QUERIES["migration_growth_top"] = migration_growth_top
ORACLES["migration_growth_top"] = f"""
WITH {RESULT_SQL} SELECT restore, bytes_after - bytes_before AS growth_bytes FROM results
ORDER BY growth_bytes DESC, restore LIMIT 20"""

# --- logs ---------------------------------------------------------------------------

# Documents are logs; every sentence is put on a line of its own, some name an error.
LOGS = """
SELECT doc_id AS job, CASE WHEN doc_id % 19 = 0 THEN '' ELSE
  CASE WHEN doc_id % 4 = 0 THEN 'starting' || chr(10) || '  Error: could not start ' || lang || chr(10) ELSE '' END ||
  replace(text, '. ', '.' || chr(10)) ||
  CASE WHEN doc_id % 6 = 0 THEN chr(10) || 'at last: DatabaseError raised' ELSE '' END || chr(10) END AS log
FROM {documents}"""


def log_tail_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.log_tail(derive(spark, sf_dir, LOGS))


def log_tail_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = derive(spark, sf_dir, LOGS).select("job", F.posexplode(logs.log_lines(F.col("log"))).alias("line_no", "line"))
    return logs.log_tail_lines(lines)


_MARKED = " OR ".join(
    f"starts_with(ltrim(line), '{m}') OR contains(ltrim(line), ' {m}')" for m in logs.ERROR_MARKERS
)
# Bytes are cut on the hexadecimal form, where a character's later bytes start with 8, 9, A or B.
TAIL_SQL = f"""
logs AS ({plain(LOGS)}),
bodies AS (SELECT job, CASE WHEN log = '' THEN []::VARCHAR[]
             ELSE string_split(CASE WHEN log LIKE '%' || chr(10) THEN log[:-2] ELSE log END, chr(10)) END AS lines FROM logs),
numbered AS (SELECT job, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM bodies),
errors AS (SELECT job, min(pos) AS pos FROM numbered WHERE {_MARKED} GROUP BY job),
tails AS (SELECT b.job, lines, greatest(len(lines) - 40, 0) AS start, array_to_string(lines[-40:], chr(10)) AS tail, e.pos
          FROM bodies b LEFT JOIN errors e USING (job)),
heads AS (SELECT *, CASE WHEN pos IS NOT NULL AND (pos - 1 < start OR strlen(tail) > 2000)
                    THEN regexp_replace(lines[pos], '^\\s+|\\s+$', '', 'g') END AS whole FROM tails),
cut AS (SELECT *, CASE WHEN strlen(whole) <= 500 THEN whole ELSE decode(unhex(
          CASE WHEN regexp_matches(substr(hex(encode(whole)), 1001, 1), '[89AB]')
               THEN regexp_replace(substr(hex(encode(whole)), 1, 1000), '[C-F][0-9A-F]([89AB][0-9A-F])*$', '')
               ELSE substr(hex(encode(whole)), 1, 1000) END)) END AS headline FROM heads),
room AS (SELECT *, CASE WHEN headline IS NULL THEN 2000 ELSE 2000 - strlen(headline) - 5 END AS budget FROM cut),
kept AS (SELECT *, CASE WHEN strlen(tail) <= budget THEN tail ELSE decode(unhex(
           regexp_replace(right(hex(encode(tail)), 2 * budget), '^([89AB][0-9A-F])+', ''))) END AS k FROM room),
done AS (SELECT job, CASE WHEN headline IS NULL OR contains(k, headline) THEN k
                     ELSE headline || chr(10) || '…' || chr(10) || k END AS log_tail, len(lines) AS n FROM kept)"""

QUERIES["log_tail"] = log_tail_texts
ORACLES["log_tail"] = f"WITH {TAIL_SQL} SELECT job, log_tail FROM done"
QUERIES["log_tail_lines"] = log_tail_lines
ORACLES["log_tail_lines"] = f"WITH {TAIL_SQL} SELECT job, log_tail FROM done WHERE n > 0"

SECRETS = ["the", "k@y.1~z", ""]
COLOURED = """
SELECT doc_id AS job, chr(27) || '[1;31m' || lang || chr(27) || '[0m' || chr(10) ||
  'postgresql://user:k@y.1~z@host retry k%40y%2E1%7Ez then k%40y.1~z' || chr(9) || text ||
  CASE WHEN doc_id % 3 = 0 THEN chr(27) || ']0;title' || chr(7) || source ELSE '' END AS log
FROM {documents}"""


def log_redact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive(spark, sf_dir, COLOURED).select("job", logs.redact(F.col("log"), SECRETS).alias("log"))


QUERIES["log_redact"] = log_redact
ORACLES["log_redact"] = f"""
WITH src AS ({plain(COLOURED)}),
plain AS (SELECT job, regexp_replace(regexp_replace(regexp_replace(log, '\\x1b\\[[0-?]*[ -/]*[@-~]', '', 'g'),
            '\\x1b\\][^\\x07\\x1b]*\\x07', '', 'g'), '[\\x00-\\x09\\x0b-\\x1f]', '', 'g') AS log FROM src)
SELECT job, replace(replace(replace(replace(log, 'the', '[redacted]'), 'k@y.1~z', '[redacted]'),
  'k%40y%2E1%7Ez', '[redacted]'), 'k%40y.1~z', '[redacted]') AS log FROM plain"""

_CONSONANTS, _VOWELS = "bcdfghjklmnpqrstvwxyz", "aeiou"


def log_redact_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every syllable of three letters is a secret: 2,205 of them, blotted out in one pass."""
    secrets = ["".join(s) for s in product(_CONSONANTS, _VOWELS, _CONSONANTS)]
    return derive(spark, sf_dir, COLOURED).select("job", logs.redact(F.col("log"), secrets).alias("log"))


QUERIES["log_redact_many"] = log_redact_many
ORACLES["log_redact_many"] = f"""
WITH src AS ({plain(COLOURED)}),
plain AS (SELECT job, regexp_replace(regexp_replace(regexp_replace(log, '\\x1b\\[[0-?]*[ -/]*[@-~]', '', 'g'),
            '\\x1b\\][^\\x07\\x1b]*\\x07', '', 'g'), '[\\x00-\\x09\\x0b-\\x1f]', '', 'g') AS log FROM src)
SELECT job, regexp_replace(log, '[{_CONSONANTS}][{_VOWELS}][{_CONSONANTS}]', '[redacted]', 'g') AS log FROM plain"""
