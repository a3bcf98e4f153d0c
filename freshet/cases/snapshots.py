"""Registered queries for listings, snapshot choice and carry-over."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.expressions import unix_path
from ..functions.globs import glob_match
from ..operators import carry
from ..operators.snapshots import (
    SnapshotFilter, application_database, count_matches, latest_snapshot, match_filter_table,
    match_filters, named_snapshot, not_covered, storage_plan, tags_match,
)
from ..session import fresh_path, local_frame
from ..sources.listing import parse_listings
from ..sources.publish import read_staged, write_tables
from .base import derive, plain, table

QUERIES, ORACLES = {}, {}

# One listing per page: log lines around an array of none, one or two snapshots.
LISTINGS = """
SELECT page_id, 'r' || CAST(page_id % 20 AS string) AS repository,
  CASE WHEN page_id % 17 = 0 THEN 'nothing to list'
  WHEN page_id % 23 = 0 THEN 'odd ] then [ brackets'
  ELSE 'Connected to repository.' || chr(10) || '[' || one ||
       CASE WHEN page_id % 5 = 0 THEN ', ' || replace(one, '"id": "', '"id": "b') ELSE '' END ||
       ']' || chr(10) || 'done' END AS raw
FROM (SELECT page_id, '{{"id": "k' || CAST(page_id AS string) || '", "description": "' || lang || ' site", ' ||
  '"source": {{"host": "' || host || '", "userName": "u", "path": "' ||
  CASE WHEN page_id % 2 = 1 THEN 'C:' || chr(92) || chr(92) || lang || chr(92) || chr(92) || 'Full'
       ELSE '/' || lang || '/data' END || '"}}, "tags": {{' ||
  CASE WHEN page_id % 3 = 0 THEN '"lang": "' || lang || '"' ELSE '"tag:lang": "' || lang || '", "env": "prod"' END ||
  '}}, "startTime": "2024-0' || CAST(1 + page_id % 9 AS string) || '-11T0' || CAST(page_id % 4 AS string) || ':00:00Z"' ||
  CASE WHEN page_id % 7 = 0 THEN '' ELSE ', "stats": {{"totalSize": ' || CAST(page_id * 104857600 AS string) || '}}' END ||
  '}}' AS one
  FROM (SELECT page_id, split_part(split_part(url, '//', 2), '/', 1) AS host,
               substr(split_part(split_part(url, '//', 2), '/', 2), 1, 2) AS lang FROM {pages}) p) q
"""

SNAPSHOTS_SQL = f"""
listings AS ({plain(LISTINGS)}),
arrays AS (
  SELECT page_id, repository, CASE WHEN strpos(raw, '[') = 0 THEN '[]'
         WHEN length(raw) - strpos(reverse(raw), ']') + 1 < strpos(raw, '[') THEN '[]'
         ELSE substr(raw, strpos(raw, '['), length(raw) - strpos(reverse(raw), ']') + 2 - strpos(raw, '['))
         END AS doc FROM listings),
snaps AS (
  SELECT page_id, repository, e.key::BIGINT AS position, e.value->>'$.id' AS id,
         coalesce(e.value->>'$.description', '') AS description,
         coalesce(e.value->>'$.source.host', '') AS host, coalesce(e.value->>'$.source.userName', '') AS user_name,
         coalesce(e.value->>'$.source.path', '') AS path, json_extract(e.value, '$.tags') AS tags,
         coalesce(e.value->>'$.startTime', '') AS start_time,
         coalesce((e.value->>'$.stats.totalSize')::BIGINT, 0) AS total_size
  FROM arrays, json_each(doc) e)"""


def _snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse_listings(derive(spark, sf_dir, LISTINGS))


def listing_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _snapshots(spark, sf_dir).select(
        "page_id", "repository", F.col("position").cast("bigint").alias("position"), "id", "description",
        "host", "user_name", "path", F.try_element_at("tags", F.lit("lang")).alias("lang"),
        F.try_element_at("tags", F.lit("tag:lang")).alias("tag_lang"), "start_time", "total_size",
    )


QUERIES["listing_parse"] = listing_parse
ORACLES["listing_parse"] = f"""
WITH {SNAPSHOTS_SQL}
SELECT page_id, repository, position, id, description, host, user_name, path,
       tags->>'$.lang' AS lang, tags->>'$."tag:lang"' AS tag_lang, start_time, total_size FROM snaps"""


def snapshot_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    required = {"lang": "en", "env": "prod"}
    return _snapshots(spark, sf_dir).where(tags_match(F.col("tags"), required)).select("id", "repository")


QUERIES["snapshot_tags"] = snapshot_tags
ORACLES["snapshot_tags"] = f"""
WITH {SNAPSHOTS_SQL}
SELECT id, repository FROM snaps
WHERE (tags->>'$.lang' = 'en' OR tags->>'$."tag:lang"' = 'en')
  AND (tags->>'$.env' = 'prod' OR tags->>'$."tag:env"' = 'prod')"""

# Globs and the regular expressions that say the same, written by hand.
GLOBS = {
    "star": ("*.example.com", r"^.*\.example\.com$"),
    "one": ("m.?h*", r"^m\..h.*$"),
    "any_of": ("[mt]*.{com,net}", r"^[mt].*\.(com|net)$"),
    "none_of": ("[!a-m]*", r"^[^a-m].*$"),
    "escaped": ("\\*", r"^\*$"),
    "broken": ("[oops", None),
}


def snapshot_globs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _snapshots(spark, sf_dir).select(
        "id", "host", *[glob_match(F.col("host"), glob).alias(name) for name, (glob, _) in GLOBS.items()]
    )


QUERIES["snapshot_globs"] = snapshot_globs
ORACLES["snapshot_globs"] = f"WITH {SNAPSHOTS_SQL} SELECT id, host, " + ", ".join(
    f"regexp_matches(host, '{regex}') AS {name}" if regex else f"false AS {name}"
    for name, (_, regex) in GLOBS.items()
) + " FROM snaps"


def snapshot_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    unix = unix_path(F.col("path"))
    return _snapshots(spark, sf_dir).select(
        "id", "path", unix.alias("unix_path"), glob_match(unix, "/C/*").alias("on_c"),
        glob_match(unix, "*/data").alias("is_data"),
    )


QUERIES["snapshot_paths"] = snapshot_paths
ORACLES["snapshot_paths"] = f"""
WITH {SNAPSHOTS_SQL},
p AS (SELECT id, path, regexp_replace(replace(path, chr(92), '/'), '^([A-Za-z]):', '/\\1') AS unix_path FROM snaps)
SELECT *, starts_with(unix_path, '/C/') AS on_c, unix_path LIKE '%/data' AS is_data FROM p"""

PARTS = {
    "everything": {},
    "english": {"tags": {"lang": "en"}, "host": "*.example.*"},
    "windows": {"path": "/C/*", "description": "*site"},
    "mobile": {"host": "m.*", "path": "/{de,en,fr}/*"},
    "broken": {"host": "[oops"},
}
FILTERS = [
    *[SnapshotFilter(f"{name}-r{n}", f"r{n}", **parts) for n in range(20) for name, parts in PARTS.items()],
    SnapshotFilter("tied", "r3", description="?? *"),
]
MATCHED_SQL = f"""
{SNAPSHOTS_SQL},
paths AS (SELECT *, regexp_replace(replace(path, chr(92), '/'), '^([A-Za-z]):', '/\\1') AS unix_path FROM snaps),
matched AS (
  SELECT 'everything-' || repository AS replica, * FROM paths
  UNION ALL SELECT 'english-' || repository, * FROM paths
    WHERE (tags->>'$.lang' = 'en' OR tags->>'$."tag:lang"' = 'en') AND regexp_matches(host, '\\.example\\.')
  UNION ALL SELECT 'windows-' || repository, * FROM paths WHERE starts_with(unix_path, '/C/') AND description LIKE '%site'
  UNION ALL SELECT 'mobile-' || repository, * FROM paths
    WHERE starts_with(host, 'm.') AND regexp_matches(unix_path, '^/(de|en|fr)/')
  UNION ALL SELECT 'tied', * FROM paths WHERE repository = 'r3' AND description LIKE '__ %')"""


def snapshot_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match_filters(_snapshots(spark, sf_dir), FILTERS).select("replica", "repository", "id")


QUERIES["snapshot_matches"] = snapshot_matches
ORACLES["snapshot_matches"] = f"WITH {MATCHED_SQL} SELECT replica, repository, id FROM matched"


def snapshot_matches_by_repository(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filters that stand in a table: one for each customer's name of a repository."""
    names = "SELECT DISTINCT 'c' || CAST(c_nationkey AS string) AS replica, 'r' || CAST(c_custkey % 20 AS string) AS repository FROM {customer}"
    specs = derive(spark, sf_dir, names).selectExpr(
        "*", "map('lang', 'en') AS required", "CAST(NULL AS string) AS host_re", "CAST(NULL AS string) AS description_re",
        "CAST(NULL AS string) AS path_re")
    return match_filter_table(_snapshots(spark, sf_dir), specs).select("replica", "repository", "id")


QUERIES["snapshot_matches_by_repository"] = snapshot_matches_by_repository
ORACLES["snapshot_matches_by_repository"] = f"""
WITH {SNAPSHOTS_SQL}, names AS (
  SELECT DISTINCT 'c' || CAST(c_nationkey AS string) AS replica, 'r' || CAST(c_custkey % 20 AS string) AS repository FROM customer)
SELECT replica, repository, id FROM snaps JOIN names USING (repository)
WHERE tags->>'$.lang' = 'en' OR tags->>'$."tag:lang"' = 'en'"""


# A filter for each page: its repository, a tag most have, and the beginning of its host.
MANY_FILTERS = """
SELECT 'p' || CAST(page_id AS string) AS replica, 'r' || CAST(page_id % 20 AS string) AS repository,
  left(split_part(split_part(url, '//', 2), '/', 1), 9) AS host_start FROM {pages}"""


def snapshot_matches_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As many filters as listings, filed under the beginnings of hosts; how many of them each snapshot meets."""
    specs = derive(spark, sf_dir, MANY_FILTERS).select(
        "*", F.expr("map('env', 'prod')").alias("required"),
        F.concat(F.lit(r"(?s)\A"), F.replace("host_start", F.lit("."), F.lit(r"\.")), F.lit(r".*\z")).alias("host_re"),
        *(F.lit(None).cast("string").alias(c) for c in ("description_re", "path_re")))
    return count_matches(_snapshots(spark, sf_dir), specs)


QUERIES["snapshot_matches_many"] = snapshot_matches_many
ORACLES["snapshot_matches_many"] = f"""
WITH {SNAPSHOTS_SQL}, filters AS ({plain(MANY_FILTERS)})
SELECT repository, id, count(*) AS replicas, min(replica) AS first_replica
FROM snaps JOIN filters USING (repository)
WHERE starts_with(host, host_start) AND (tags->>'$.env' = 'prod' OR tags->>'$."tag:env"' = 'prod')
GROUP BY repository, id"""


def snapshot_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    matched = match_filters(_snapshots(spark, sf_dir), FILTERS)
    best = latest_snapshot(matched, ["replica", "repository"], ["page_id", "position"])
    return best.select("replica", "repository", "id", "start_time", "total_size")


QUERIES["snapshot_latest"] = snapshot_latest
ORACLES["snapshot_latest"] = f"""
WITH {MATCHED_SQL}
SELECT replica, repository, id, start_time, total_size FROM matched
QUALIFY row_number() OVER (PARTITION BY replica, repository
                           ORDER BY start_time DESC, page_id DESC, position DESC) = 1"""

WANTED = """
SELECT 'c' || CAST(c_custkey AS string) AS replica, 'r' || CAST(c_custkey % 20 AS string) AS repository,
  CASE WHEN c_custkey % 9 = 0 THEN NULL WHEN c_custkey % 5 = 0 THEN 'bk' || CAST(c_custkey AS string)
       ELSE 'k' || CAST(c_custkey AS string) END AS desired FROM {customer}"""


def snapshot_named(spark: SparkSession, sf_dir: str) -> DataFrame:
    return named_snapshot(derive(spark, sf_dir, WANTED), _snapshots(spark, sf_dir))


QUERIES["snapshot_named"] = snapshot_named
ORACLES["snapshot_named"] = f"""
WITH {SNAPSHOTS_SQL}, wanted AS ({plain(WANTED)})
SELECT w.replica, w.repository, w.desired, s.start_time, s.total_size,
       CASE WHEN s.id IS NULL THEN 'desired snapshot missing' END AS reason
FROM wanted w LEFT JOIN snaps s ON s.repository = w.repository AND s.id = w.desired"""

CANDIDATES = """
SELECT o_custkey AS replica, 's' || CAST(o_orderkey % 97 AS string) AS snapshot,
  CASE WHEN o_orderkey % 10 = 0 THEN 's' || CAST(o_orderkey % 97 AS string)
       WHEN o_orderkey % 3 = 0 THEN NULL ELSE 's1' END AS verified FROM {orders}"""
RESTORES = """
SELECT o_custkey AS replica, 's' || CAST((o_orderkey * 7) % 97 AS string) AS snapshot,
  CASE WHEN o_orderkey % 8 = 0 THEN NULL WHEN o_orderstatus = 'F' THEN 'Failed'
       WHEN o_orderstatus = 'O' THEN 'Active' ELSE 'Ready' END AS phase FROM {orders}"""


def snapshot_not_covered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return not_covered(derive(spark, sf_dir, CANDIDATES), derive(spark, sf_dir, RESTORES))


QUERIES["snapshot_not_covered"] = snapshot_not_covered
ORACLES["snapshot_not_covered"] = f"""
WITH c AS ({plain(CANDIDATES)}), r AS ({plain(RESTORES)})
SELECT c.replica, c.snapshot, c.verified FROM c
WHERE (verified IS NULL OR verified <> snapshot)
  AND NOT EXISTS (SELECT 1 FROM r WHERE r.replica = c.replica AND r.snapshot = c.snapshot
                  AND (r.phase IS NULL OR r.phase <> 'Failed'))"""

VOLUMES = """
SELECT o_orderkey, CAST(floor(o_totalprice * 1000000) AS bigint) AS total_size, o_orderstatus = 'F' AS writes,
  CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE CAST(floor(o_totalprice * 300000) AS bigint) END AS delta,
  CASE o_orderkey % 6 WHEN 0 THEN '300Gi' WHEN 1 THEN '1.5Ti' WHEN 2 THEN 'junk' WHEN 3 THEN NULL
       WHEN 4 THEN '120G' ELSE '5000000' END AS floor_size,
  CASE o_orderkey % 5 WHEN 0 THEN '400Gi' WHEN 1 THEN 'what' WHEN 2 THEN '1Ti' WHEN 3 THEN '200G'
       ELSE '2Ti' END AS maximum_size
FROM {orders}"""
_QUANTITY = {
    "300Gi": 300 << 30, "1.5Ti": 3 << 39, "120G": 120 * 10**9, "5000000": 5 * 10**6,
    "400Gi": 400 << 30, "1Ti": 1 << 40, "200G": 200 * 10**9, "2Ti": 2 << 40,
}


def _bytes_sql(column: str) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{q}' THEN {n}" for q, n in _QUANTITY.items()) + " END::DECIMAL(30,1)"


def storage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return storage_plan(derive(spark, sf_dir, VOLUMES)).select(
        "o_orderkey", "storage_bytes", "storage_error"
    )


QUERIES["storage_plan"] = storage
ORACLES["storage_plan"] = f"""
WITH src AS ({plain(VOLUMES)}),
a AS (SELECT *, total_size::DECIMAL(28,1) AS s, (total_size::DECIMAL(20,0) * 0.1)::DECIMAL(28,1) AS tenth,
             {_bytes_sql('floor_size')} AS floor_bytes,
             coalesce({_bytes_sql('maximum_size')}, {2 << 40}) AS cap FROM src),
b AS (SELECT *, CASE WHEN writes THEN s + greatest(tenth, coalesce(delta, 0)) + {5 << 30}
                     ELSE s + tenth END AS computed FROM a)
SELECT o_orderkey,
       CASE WHEN computed <= cap THEN least(greatest(computed, coalesce(floor_bytes, computed)), cap) END::DECIMAL(30,1)
         AS storage_bytes,
       CASE WHEN computed > cap THEN 'storage limit exceeded' END AS storage_error
FROM b"""

SIZES = """
SELECT l_orderkey AS restore,
  CASE l_linenumber % 7 WHEN 1 THEN 'postgres' WHEN 2 THEN 'template1' WHEN 3 THEN 'template0'
       ELSE 'app' || CAST(l_partkey % 50 AS string) END AS name,
  CAST(floor(l_quantity / 10) AS bigint) * 1000 AS bytes,
  CAST(l_linenumber AS bigint) * 1000000000000000 + l_partkey * 1000000000
    + CAST(floor(l_extendedprice * 100) AS bigint) AS position
FROM {lineitem}"""


def application_databases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return application_database(derive(spark, sf_dir, SIZES))


QUERIES["application_database"] = application_databases
ORACLES["application_database"] = f"""
WITH src AS ({plain(SIZES)})
SELECT restore, arg_max(name, (bytes, position))
         FILTER (WHERE name NOT IN ('postgres', 'template0', 'template1')) AS database
FROM src GROUP BY restore"""

# --- carry-over -------------------------------------------------------------------

WANTED_SCHEMAS = """
SELECT c_custkey AS copy, 0 AS pos, c_mktsegment AS schema FROM {customer}
UNION ALL SELECT c_custkey, 1, CASE WHEN c_custkey % 4 = 0 THEN 'missing' ELSE 'staging' END FROM {customer}
UNION ALL SELECT c_custkey, 2, CASE WHEN c_custkey % 3 = 0 THEN 'dbt' ELSE 'gone' END FROM {customer}"""
PREVIOUS_TABLES = """
SELECT o_custkey AS copy, CASE WHEN o_orderkey % 5 = 0 THEN 'dbt' WHEN o_orderkey % 5 = 1 THEN 'public'
  ELSE seg END AS schema, 't' || CAST(o_orderkey AS string) AS name
FROM {orders} JOIN (SELECT c_custkey, c_mktsegment AS seg FROM {customer}) c ON c_custkey = o_custkey"""
NEW_TABLES = """
SELECT o_custkey AS copy, CASE WHEN o_orderkey % 3 = 0 THEN 'dbt' ELSE 'public' END AS schema,
  'n' || CAST(o_orderkey AS string) AS name FROM {orders}"""


def carry_schemas_present(spark: SparkSession, sf_dir: str) -> DataFrame:
    return carry.schemas_present(derive(spark, sf_dir, WANTED_SCHEMAS), derive(spark, sf_dir, PREVIOUS_TABLES))


PRESENT_SQL = f"""
wanted AS ({plain(WANTED_SCHEMAS)}), previous AS ({plain(PREVIOUS_TABLES)}), fresh AS ({plain(NEW_TABLES)}),
present AS (SELECT w.*, CASE WHEN EXISTS (SELECT 1 FROM previous p WHERE p.copy = w.copy AND p.schema = w.schema)
                             THEN 'carry' ELSE 'skipped' END AS action FROM wanted w)"""
QUERIES["carry_schemas_present"] = carry_schemas_present
ORACLES["carry_schemas_present"] = f"WITH {PRESENT_SQL} SELECT * FROM present"


def carry_table_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    present = carry_schemas_present(spark, sf_dir).where("action = 'carry'").select("copy", "schema")
    return carry.carry_plan(derive(spark, sf_dir, NEW_TABLES), derive(spark, sf_dir, PREVIOUS_TABLES), present)


QUERIES["carry_table_plan"] = carry_table_plan
ORACLES["carry_table_plan"] = f"""
WITH {PRESENT_SQL}, carried AS (SELECT copy, schema FROM present WHERE action = 'carry')
SELECT *, 'new' AS origin FROM fresh WHERE (copy, schema) NOT IN (SELECT copy, schema FROM carried)
UNION ALL
SELECT *, 'previous' FROM previous WHERE (copy, schema) IN (SELECT copy, schema FROM carried)"""


def carry_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Carry two schemas of real tables over, stage the copy, count what arrived."""
    nation, part = table(spark, sf_dir, "nation"), table(spark, sf_dir, "part")
    previous = {"reporting.nation_names": nation.select("n_nationkey", "n_name"), "dbt.parts": part}
    new = {
        "public.region": table(spark, sf_dir, "region"),
        "public.nation": nation.drop("n_regionkey"),
        "dbt.parts": part.limit(0),
    }
    views = {
        "reporting.nations_v": "SELECT n.n_nationkey, n.n_name FROM public.nation n",
        "reporting.broken_v": "SELECT n_regionkey FROM public.nation",
    }
    done = carry.carry_schemas(spark, new, previous, ["reporting", "dbt", "absent"], views)
    root = fresh_path(spark, "carried")
    write_tables(done.tables, root, "run")
    counts = None
    for name in sorted(done.tables):
        rows = read_staged(spark, root, "run", name).agg(F.count("*").alias("row_count"))
        rows = rows.select(F.lit(name).alias("name"), "row_count", F.lit(done.phase).alias("phase"))
        counts = rows if counts is None else counts.unionByName(rows)
    return counts


QUERIES["carry_tables"] = carry_tables
ORACLES["carry_tables"] = """
SELECT name, row_count, 'partial: 1 statement error(s)' AS phase FROM (
  SELECT 'dbt.parts' AS name, count(*) AS row_count FROM part
  UNION ALL SELECT 'public.nation', count(*) FROM nation
  UNION ALL SELECT 'public.region', count(*) FROM region
  UNION ALL SELECT 'reporting.nation_names', count(*) FROM nation
  UNION ALL SELECT 'reporting.nations_v', count(*) FROM nation) t"""

STATEMENTS = """
SELECT o_custkey AS copy, CASE WHEN o_orderstatus = 'F' AND o_orderkey % 4 = 0
  THEN 'ERROR: ' || o_orderpriority END AS error FROM {orders}"""


def carry_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    return carry.carry_phase(derive(spark, sf_dir, STATEMENTS))


QUERIES["carry_outcome"] = carry_outcome
ORACLES["carry_outcome"] = f"""
WITH src AS ({plain(STATEMENTS)})
SELECT copy, count(error) AS errors, CASE WHEN count(error) = 0 THEN 'complete'
  ELSE 'partial: ' || count(error)::VARCHAR || ' statement error(s)' END AS phase
FROM src GROUP BY copy"""

BUDGETS = """
SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE 3600 * (1 + o_orderkey % 24) + 3 END AS interval_s,
  CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_custkey * 3 END AS elapsed_s FROM {orders}"""


def carry_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    interval = F.col("interval_s")
    return derive(spark, sf_dir, BUDGETS).select(
        "o_orderkey", carry.budget_seconds(interval).alias("budget_s"),
        carry.over_budget(F.col("elapsed_s"), interval).alias("timed_out"),
    )


QUERIES["carry_budget"] = carry_budget
ORACLES["carry_budget"] = f"""
WITH src AS ({plain(BUDGETS)}), b AS (SELECT *, coalesce(interval_s // 5, 3600)::BIGINT AS budget_s FROM src)
SELECT o_orderkey, budget_s, coalesce(elapsed_s > budget_s, false) AS timed_out FROM b"""


def carry_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    size = (F.col("o_totalprice") * 100).cast("bigint")
    return orders.select("o_orderkey", carry.measured_delta(size, F.col("o_custkey") * 20000).alias("delta"))


QUERIES["carry_delta"] = carry_delta
ORACLES["carry_delta"] = """
SELECT o_orderkey, greatest(trunc(o_totalprice * 100)::BIGINT - o_custkey * 20000, 0)::BIGINT AS delta FROM orders"""

SCHEMA_NAMES = """
SELECT s_suppkey, CASE s_suppkey % 6 WHEN 0 THEN 'public' WHEN 1 THEN 'pg_' || lower(s_name)
  WHEN 2 THEN 'information_schema' WHEN 3 THEN 'public_' || lower(s_name) ELSE lower(s_name) END AS schema
FROM {supplier}"""


def carry_reserved(spark: SparkSession, sf_dir: str) -> DataFrame:
    return carry.droppable(derive(spark, sf_dir, SCHEMA_NAMES))


QUERIES["carry_reserved"] = carry_reserved
ORACLES["carry_reserved"] = f"""
SELECT *, schema NOT IN ('public', 'information_schema') AND substr(schema, 1, 3) <> 'pg_' AS droppable
FROM ({plain(SCHEMA_NAMES)}) t"""
