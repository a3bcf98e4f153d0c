"""Registered queries for masks, manifests, the mask plan and the audit."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import masks, wordlists
from ..functions.expressions import base_version
from ..operators.audit import Expect, mask_audit
from ..operators.scrub import scrub_rows
from ..plans.masking import (
    Masking, mask_plan, mask_tables, outcome_frame, table_plan, OK,
)
from ..session import fresh_path
from ..sources.catalog import catalog_frame, catalog_rows
from ..sources.manifest import flatten_manifests, manifest_from_text
from ..sources.publish import publish, read_current, write_tables
from .base import SECRET, derive, digest_sql, draw_sql, list_sql, plain, table, unit_sql

QUERIES, ORACLES = {}, {}


def manifest_doc(name: str, columns: dict, table_mask: str | None = None) -> str:
    schema, table_name = name.split(".")
    node = {
        "schema": schema,
        "name": table_name,
        "columns": {c: {"config": {"meta": {"masking": m}}} for c, m in columns.items()},
    }
    if table_mask:
        node["config"] = {"meta": {"masking": table_mask}}
    return json.dumps({"sources": {name: node}})


def masked(
    spark: SparkSession, df: DataFrame, name: str, columns: dict, keys: tuple[str, ...],
    types: dict | None = None, defaults: dict | None = None,
) -> DataFrame:
    """A table masked under an in-code manifest."""
    manifest = manifest_from_text(spark, manifest_doc(name, columns))
    catalog = catalog_frame(spark, catalog_rows(df, *name.split("."), types=types, defaults=defaults))
    settings = Masking(SECRET, {name: keys})
    return mask_tables(spark, {name: df}, manifest, settings, catalog).tables[name]


def _register(
    name: str, source: str, table_name: str, columns: dict, key: str, oracle: str, given: str | None = None, **extra
):
    """A masked table. ``given`` is what Spark reads where the SQL's own source would not hold all values."""
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return masked(spark, derive(spark, sf_dir, given or source), table_name, columns, (key,), **extra)

    QUERIES[name] = run
    ORACLES[name] = f"WITH src AS ({plain(source)}) {oracle}"


def _pick(words: list[str], draw: str) -> str:
    return f"{list_sql(words)}[(({draw}) % {len(words)}) + 1]"


def _fake_name(column: str, key: str) -> tuple[str, str, str]:
    n = draw_sql(column, key)
    firsts, lasts = len(wordlists.FIRST_NAMES), len(wordlists.LAST_NAMES)
    return (
        _pick(wordlists.FIRST_NAMES, n),
        _pick(wordlists.LAST_NAMES, f"({n}) // {firsts}"),
        f"(({n}) // {firsts} // {lasts})",
    )


def _name_sql(col: str, column: str, key: str) -> str:
    first, last, _ = _fake_name(column, key)
    return (
        f"CASE WHEN {col} IS NULL THEN NULL WHEN contains({col}, ' ')"
        f" THEN {first} || ' ' || {last} ELSE {first} END"
    )


def _money_sql(column: str, key: str, low: float, high: float) -> str:
    u = unit_sql(draw_sql(column, key))
    spread = f"({u} * {high - low!r}::DOUBLE + {low!r}::DOUBLE)"
    return f"round({spread}::DECIMAL(28,10), 2)::DOUBLE"


# --- the flagship: masked customers next to their (unmasked) nation ---------------

CUSTOMER = "public.customer"
CUSTOMER_MASKS = {
    "c_name": "name",
    "c_acctbal": {"kind": "money", "range": "0-10000"},
    "c_nationkey": {"kind": "integer", "range": "0-24"},
}


def masked_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return masked(spark, table(spark, sf_dir, "customer"), CUSTOMER, CUSTOMER_MASKS, ("c_custkey",))


def masked_customer_by_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    customers = masked_customer(spark, sf_dir)
    return customers.join(nation, customers["c_nationkey"] == nation["n_nationkey"]).select(
        "c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment", "n_name"
    )


_CUSTOMER_KEY = "c_custkey::VARCHAR"
_INTEGER_0_24 = (
    f"CAST(floor({unit_sql(draw_sql('public.customer.c_nationkey', _CUSTOMER_KEY))} * 25.0::DOUBLE) AS INTEGER)"
)
MASKED_CUSTOMER_SQL = f"""
SELECT c_custkey,
       {_name_sql('c_name', 'public.customer.c_name', _CUSTOMER_KEY)} AS c_name,
       CASE WHEN c_nationkey IS NOT NULL THEN {_INTEGER_0_24} END AS c_nationkey,
       CASE WHEN c_acctbal IS NOT NULL
            THEN {_money_sql('public.customer.c_acctbal', _CUSTOMER_KEY, 0.0, 10000.0)} END AS c_acctbal,
       c_mktsegment
FROM customer"""

QUERIES["masked_customer_by_nation"] = masked_customer_by_nation
ORACLES["masked_customer_by_nation"] = f"""
SELECT m.*, n_name FROM ({MASKED_CUSTOMER_SQL}) m JOIN nation ON c_nationkey = n_nationkey"""

# --- one query per mask kind ------------------------------------------------------

_register(
    "mask_date",
    "SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN NULL"
    " ELSE CAST(o_orderdate AS date) END AS born FROM {orders}",
    "public.people", {"born": "date"}, "o_orderkey",
    "SELECT o_orderkey, CASE WHEN born IS NOT NULL THEN DATE '1900-01-01' + CAST("
    + draw_sql("public.people.born", "o_orderkey::VARCHAR")
    + " % (date_diff('day', DATE '1900-01-01', DATE '2026-01-01') + 1) AS INTEGER) END AS born FROM src",
)

_register(
    "mask_datetime",
    "SELECT event_id, CASE WHEN event_id % 9 = 0 THEN NULL ELSE ts END AS seen_at FROM {events}",
    "public.visits", {"seen_at": "datetime"}, "event_id",
    "SELECT event_id, CASE WHEN seen_at IS NOT NULL THEN date_trunc('day', seen_at)::TIMESTAMP"
    " + to_seconds(CAST(floor(" + unit_sql(draw_sql("public.visits.seen_at", "event_id::VARCHAR"))
    + " * 86400) AS INTEGER)) END AS seen_at FROM src",
)

_LOREM = wordlists.LOREM
_TEXT_DRAW = draw_sql("public.notes.text", "doc_id::VARCHAR")
_register(
    "mask_text",
    "SELECT doc_id, CASE WHEN doc_id % 13 = 0 THEN NULL ELSE text END AS text FROM {documents}",
    "public.notes", {"text": "text"}, "doc_id",
    f"SELECT doc_id, CASE WHEN text IS NOT NULL THEN substr(repeat('{_LOREM}',"
    f" CAST(ceil((length(text) + {_TEXT_DRAW} % {len(_LOREM)}) / {len(_LOREM)}.0) AS BIGINT)),"
    f" {_TEXT_DRAW} % {len(_LOREM)} + 1, length(text)) END AS text FROM src",
)

_register(
    "mask_string",
    "SELECT doc_id, lang, CASE WHEN doc_id % 13 = 0 THEN NULL WHEN doc_id % 17 = 0 THEN ''"
    " ELSE text END AS token FROM {documents}",
    "public.notes", {"token": "string"}, "doc_id",
    "SELECT doc_id, lang, CASE WHEN token IS NOT NULL THEN substr(array_to_string(["
    + digest_sql("public.notes.token", "doc_id::VARCHAR", "i")
    + " FOR i IN range(0, greatest(CAST(ceil(length(token) / 32.0) AS BIGINT), 1))], ''), 1, length(token))"
    " END AS token FROM src",
)

_first, _last, _rest = _fake_name("public.accounts.email", "c_custkey::VARCHAR")
_register(
    "mask_email",
    "SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN NULL"
    " ELSE lower(c_name) || '@corp.test' END AS email FROM {customer}",
    "public.accounts", {"email": "email"}, "c_custkey",
    f"SELECT c_custkey, CASE WHEN email IS NOT NULL THEN lower({_first}) || '.' || lower({_last})"
    f" || ({_rest} % 1000)::VARCHAR || '@' || {_pick(wordlists.MAIL_DOMAINS, _rest + ' // 1000')} END AS email FROM src",
)

_register(
    "mask_name",
    "SELECT p_partkey, CASE WHEN p_partkey % 10 = 0 THEN NULL WHEN p_partkey % 3 = 0"
    " THEN replace(p_name, ' ', '-') ELSE p_name END AS p_name FROM {part}",
    "public.part", {"p_name": "name"}, "p_partkey",
    f"SELECT p_partkey, {_name_sql('p_name', 'public.part.p_name', 'p_partkey::VARCHAR')} AS p_name FROM src",
)

_register(
    "mask_phone",
    "SELECT doc_id, CASE WHEN doc_id % 13 = 0 THEN NULL WHEN doc_id % 5 = 0"
    " THEN lang WHEN doc_id % 7 = 0 THEN '' ELSE text END AS phone FROM {documents}",
    "public.notes", {"phone": "phone"}, "doc_id",
    "SELECT doc_id, CASE WHEN phone IS NULL THEN NULL WHEN length(phone) < 5 THEN '****'"
    " ELSE substr(phone, 1, 2) || '****' || right(phone, 2) END AS phone FROM src",
)

_register(
    "mask_place",
    "SELECT o_orderkey, CASE WHEN o_orderkey % 8 = 0 THEN NULL ELSE o_orderpriority END AS city FROM {orders}",
    "public.trips", {"city": "place"}, "o_orderkey",
    f"SELECT o_orderkey, CASE WHEN city IS NOT NULL THEN"
    f" {_pick(wordlists.CITIES, draw_sql('public.trips.city', 'o_orderkey::VARCHAR'))} END AS city FROM src",
)

_register(
    "mask_url",
    "SELECT page_id, CASE WHEN page_id % 6 = 0 THEN NULL ELSE url END AS url FROM {pages}",
    "public.pages", {"url": "url"}, "page_id",
    "SELECT page_id, CASE WHEN url IS NOT NULL THEN 'https://example.invalid/' || substr("
    + digest_sql("public.pages.url", "page_id::VARCHAR") + ", 1, 8) END AS url FROM src",
)

_INTEGER_SOURCE = (
    "SELECT event_id, CASE WHEN event_id % 9 = 0 THEN NULL ELSE user_id END AS pulse,"
    " CAST(user_id AS int) AS anything, CAST(user_id AS smallint) AS signed FROM {events}"
)
# Ids that outgrow the narrow columns are cut to what these hold; the SQL never works the hidden values out.
_INTEGER_GIVEN = _INTEGER_SOURCE.replace(
    "CAST(user_id AS int)", "CAST(user_id % 2147483648 AS int)"
).replace("CAST(user_id AS smallint)", "CAST(user_id % 32768 AS smallint)")


def _integer_sql(column: str, low: float, high: float, kind: str) -> str:
    u = unit_sql(draw_sql(f"public.vitals.{column}", "event_id::VARCHAR"))
    return f"CAST(floor({u} * {high - low + 1!r}::DOUBLE) + {low!r}::DOUBLE AS {kind})"


_register(
    "mask_integer", _INTEGER_SOURCE, "public.vitals",
    {"pulse": {"kind": "integer", "range": "12-48"}, "anything": "integer",
     "signed": {"kind": "integer", "range": "-5-5"}}, "event_id",
    f"SELECT event_id, CASE WHEN pulse IS NOT NULL THEN"
    f" {_integer_sql('pulse', 12.0, 48.0, 'BIGINT')} END AS pulse,"
    f" {_integer_sql('anything', -2147483648.0, 2147483647.0, 'INTEGER')} AS anything,"
    f" {_integer_sql('signed', -5.0, 5.0, 'SMALLINT')} AS signed FROM src",
    given=_INTEGER_GIVEN,
)


def _float_sql(column: str, low: float, high: float) -> str:
    u = unit_sql(draw_sql(f"public.lab.{column}", "o_orderkey::VARCHAR"))
    return f"({u} * {high - low!r}::DOUBLE + {low!r}::DOUBLE)"


_register(
    "mask_float",
    "SELECT o_orderkey, CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE o_totalprice END AS ratio,"
    " o_totalprice AS gravity FROM {orders}",
    "public.lab", {"ratio": "float", "gravity": {"kind": "float", "range": "0.25-0.75"}}, "o_orderkey",
    f"SELECT o_orderkey, CASE WHEN ratio IS NOT NULL THEN {_float_sql('ratio', 0.0, 1.0)} END AS ratio,"
    f" {_float_sql('gravity', 0.25, 0.75)} AS gravity FROM src",
)

_register(
    "mask_money",
    "SELECT o_orderkey, CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE o_totalprice END AS paid,"
    " CAST(o_totalprice AS decimal(15,2)) AS exact FROM {orders}",
    "public.bills", {"paid": "money", "exact": {"kind": "money", "range": "-50-99.5"}}, "o_orderkey",
    f"SELECT o_orderkey, CASE WHEN paid IS NOT NULL THEN"
    f" {_money_sql('public.bills.paid', 'o_orderkey::VARCHAR', 0.0, 10000.0)} END AS paid,"
    f" {_money_sql('public.bills.exact', 'o_orderkey::VARCHAR', -50.0, 99.5)}::DECIMAL(15,2) AS exact FROM src",
)

_TYPED_SOURCE = (
    "SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN NULL ELSE text END AS body,"
    " CASE WHEN doc_id % 3 = 0 THEN NULL ELSE n_chars END AS n,"
    " '{{\"lang\": \"' || lang || '\"}}' AS extra, source FROM {documents}"
)
_register(
    "mask_zero", _TYPED_SOURCE, "public.docs", {"body": "zero", "n": "zero"}, "doc_id",
    "SELECT doc_id, CASE WHEN body IS NOT NULL THEN repeat('0', length(body)) END AS body,"
    " 0::BIGINT AS n, extra, source FROM src",
)
_register(
    "mask_empty", _TYPED_SOURCE, "public.docs", {"body": "empty", "n": "empty", "extra": "empty"}, "doc_id",
    "SELECT doc_id, '' AS body, 0::BIGINT AS n, '{}' AS extra, source FROM src",
    types={"extra": "jsonb"},
)
_register(
    "mask_nil", _TYPED_SOURCE, "public.docs", {"body": "nil", "n": "nil"}, "doc_id",
    "SELECT doc_id, NULL::VARCHAR AS body, NULL::BIGINT AS n, extra, source FROM src",
)
_register(
    "mask_default", _TYPED_SOURCE, "public.docs", {"body": "default", "n": "default"}, "doc_id",
    "SELECT doc_id, 'unset' AS body, 41::BIGINT + 1 AS n, extra, source FROM src",
    defaults={"body": "'unset'", "n": "41 + 1"},
)


def mask_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = table(spark, sf_dir, "documents").select(
        "doc_id", F.encode("text", "UTF-8").alias("raw"), F.split("text", " ").alias("words"),
    )
    out = masked(spark, source, "public.blobs", {"raw": "zero", "words": "empty"}, ("doc_id",))
    return out.select(
        "doc_id",
        F.octet_length("raw").cast("bigint").alias("raw_bytes"),
        F.sha2("raw", 256).alias("raw_digest"),
        F.size("words").cast("bigint").alias("words_left"),
    )


QUERIES["mask_bytes"] = mask_bytes
ORACLES["mask_bytes"] = """
SELECT doc_id, octet_length(encode(text))::BIGINT AS raw_bytes,
       sha256(unhex(repeat('00', octet_length(encode(text))::BIGINT))) AS raw_digest,
       0::BIGINT AS words_left
FROM documents"""

# --- one projection over a wide table, many kinds at once --------------------------


def masked_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return masked(
        spark, table(spark, sf_dir, "lineitem"), "public.lineitem",
        {
            "l_extendedprice": {"kind": "money", "range": "1-100000"},
            "l_discount": {"kind": "float", "range": "0-0.1"},
            "l_shipdate": "datetime",
            "l_quantity": {"kind": "integer", "range": "1-50"},
            "l_returnflag": "zero",
        },
        ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"),
    )


_LINE_KEY = "concat_ws('|', " + ", ".join(
    f"length({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR" for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")
) + ")"


def _line_unit(column: str) -> str:
    return unit_sql(draw_sql(f"public.lineitem.{column}", _LINE_KEY))


QUERIES["masked_lineitem"] = masked_lineitem
ORACLES["masked_lineitem"] = f"""
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber,
       (floor({_line_unit('l_quantity')} * 50.0::DOUBLE) + 1.0::DOUBLE)::DOUBLE AS l_quantity,
       {_money_sql('public.lineitem.l_extendedprice', _LINE_KEY, 1.0, 100000.0)} AS l_extendedprice,
       {_line_unit('l_discount')} * 0.1::DOUBLE + 0.0::DOUBLE AS l_discount,
       l_tax, repeat('0', length(l_returnflag)) AS l_returnflag, l_linestatus,
       date_trunc('day', l_shipdate)::TIMESTAMP
         + to_seconds(CAST(floor({_line_unit('l_shipdate')} * 86400) AS INTEGER)) AS l_shipdate
FROM lineitem"""

# --- manifests, plan and outcome over many generated documents ---------------------

MANIFESTS = """
SELECT p_partkey, p_brand,
  '{{"sources": {{"s": {{' ||
  CASE WHEN p_partkey % 19 = 0 THEN '' WHEN p_partkey % 23 = 0 THEN '"schema": 7, '
       ELSE '"schema": "public", ' END ||
  CASE WHEN p_partkey % 29 = 0 THEN '' ELSE '"name": "' ||
       CASE WHEN p_size % 3 = 0 THEN 'customer' WHEN p_size % 3 = 1 THEN 'orders' ELSE 'documents' END
       || '", ' END ||
  CASE WHEN p_partkey % 7 = 0 THEN '"meta": {{"masking": "truncate"}}, '
       WHEN p_partkey % 11 = 0 THEN '"config": {{"meta": {{"masking": {{"kind": "drop"}}}}}}, ' ELSE '' END ||
  '"columns": {{"' ||
  CASE p_size % 9 WHEN 0 THEN 'c_name' WHEN 1 THEN 'o_orderdate' WHEN 2 THEN 'text'
       WHEN 3 THEN 'c_acctbal' WHEN 4 THEN 'o_totalprice' WHEN 5 THEN 'n_chars'
       WHEN 6 THEN 'C_NAME' WHEN 7 THEN 'o_custkey' ELSE 'lang' END ||
  '": {{' ||
  CASE WHEN p_partkey % 5 = 0 THEN '"meta": {{"masking": ' ELSE '"config": {{"meta": {{"masking": ' END ||
  CASE WHEN p_partkey % 4 = 0 THEN '"' || p_kind || '"'
       WHEN p_partkey % 31 = 0 THEN '{{"range": "1-2"}}'
       WHEN p_partkey % 37 = 0 THEN 'null'
       ELSE '{{"kind": "' || p_kind || '", "range": "' ||
            CASE p_partkey % 6 WHEN 0 THEN '-8-8' WHEN 1 THEN '31-44' WHEN 2 THEN '0.25-0.75'
                 WHEN 3 THEN '1-x' WHEN 4 THEN '-10--5' ELSE '0-9e9' END || '"}}' END ||
  CASE WHEN p_partkey % 5 = 0 THEN '}}}}' ELSE '}}}}}}' END ||
  '}}}}}}}}' AS doc
FROM (SELECT *, CASE p_partkey % 13 WHEN 0 THEN 'name' WHEN 1 THEN 'text' WHEN 2 THEN 'zero'
       WHEN 3 THEN 'empty' WHEN 4 THEN 'nil' WHEN 5 THEN 'default' WHEN 6 THEN 'integer'
       WHEN 7 THEN 'money' WHEN 8 THEN 'datetime' WHEN 9 THEN 'date' WHEN 10 THEN 'sparkle'
       WHEN 11 THEN 'phone' ELSE 'float' END AS p_kind FROM {part}) p
"""


def _manifest_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flatten_manifests(derive(spark, sf_dir, MANIFESTS))


def manifest_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _manifest_rows(spark, sf_dir).select(
        "p_partkey", "schema", "table", "column", "kind",
        F.col("range.lo").alias("lo"), F.col("range.hi").alias("hi"),
    )


_NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
MANIFEST_ROWS_SQL = f"""
docs AS ({plain(MANIFESTS)}),
sources AS (
  SELECT p_partkey, p_brand, s.value AS node FROM docs, json_each(json_extract(doc, '$.sources')) s),
named AS (
  SELECT *, node->>'$.schema' AS schema, node->>'$.name' AS "table" FROM sources
  WHERE json_type(node, '$.schema') = 'VARCHAR' AND json_type(node, '$.name') = 'VARCHAR'),
nodes AS (
  SELECT p_partkey, p_brand, schema, "table", NULL AS "column",
         coalesce(json_extract(node, '$.config.meta.masking'), json_extract(node, '$.meta.masking')) AS mask
  FROM named
  UNION ALL
  SELECT p_partkey, p_brand, schema, "table", c.key,
         coalesce(json_extract(c.value, '$.config.meta.masking'), json_extract(c.value, '$.meta.masking'))
  FROM named, json_each(json_extract(node, '$.columns')) c),
kinds AS (
  SELECT *, CASE WHEN json_type(mask) = 'VARCHAR' THEN mask->>'$'
                 WHEN json_type(mask, '$.kind') = 'VARCHAR' THEN mask->>'$.kind' END AS kind,
         CASE WHEN json_type(mask) = 'OBJECT' THEN mask->>'$.range' END AS span FROM nodes),
bounds AS (
  SELECT *, regexp_extract(span, '^(.*)-([^-]*)$', 1) AS l, regexp_extract(span, '^(.*)-([^-]*)$', 2) AS h
  FROM kinds WHERE kind IS NOT NULL),
rows AS (
  SELECT p_partkey, p_brand, schema, "table", "column", kind,
         CASE WHEN "column" IS NOT NULL AND regexp_matches(l, '{_NUMBER}') AND regexp_matches(h, '{_NUMBER}')
              THEN l::DOUBLE END AS lo,
         CASE WHEN "column" IS NOT NULL AND regexp_matches(l, '{_NUMBER}') AND regexp_matches(h, '{_NUMBER}')
              THEN h::DOUBLE END AS hi
  FROM bounds)"""

QUERIES["manifest_flatten"] = manifest_flatten
ORACLES["manifest_flatten"] = (
    f'WITH {MANIFEST_ROWS_SQL} SELECT p_partkey, schema, "table", "column", kind, lo, hi FROM rows'
)

_PLAN_TABLES = ("customer", "orders", "documents")
_PLAN_DEFAULTS = {"o_totalprice": "0", "lang": "'en'"}
_NOT_NULL = ("c_name", "o_custkey")


def _plan_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = []
    for name in _PLAN_TABLES:
        df = table(spark, sf_dir, name)
        defaults = {c: d for c, d in _PLAN_DEFAULTS.items() if c in df.columns}
        rows += catalog_rows(df, "public", name, defaults=defaults, not_null=_NOT_NULL)
    return catalog_frame(spark, rows)


def mask_plan_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mask_plan(_manifest_rows(spark, sf_dir), _plan_catalog(spark, sf_dir))
    return plan.select("p_partkey", "table", "column", "kind", "data_type", "status")


def mask_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _manifest_rows(spark, sf_dir)
    return outcome_frame(mask_plan(rows, _plan_catalog(spark, sf_dir)), table_plan(rows), ["p_brand"])


PLAN_SQL = f"""
{MANIFEST_ROWS_SQL},
catalog AS (SELECT 'public' AS schema, * FROM (VALUES
  ('customer', 'c_custkey', 'bigint', true, NULL), ('customer', 'c_name', 'text', false, NULL),
  ('customer', 'c_nationkey', 'integer', true, NULL), ('customer', 'c_acctbal', 'double precision', true, NULL),
  ('customer', 'c_mktsegment', 'text', true, NULL),
  ('orders', 'o_orderkey', 'bigint', true, NULL), ('orders', 'o_custkey', 'bigint', false, NULL),
  ('orders', 'o_orderstatus', 'text', true, NULL), ('orders', 'o_totalprice', 'double precision', true, '0'),
  ('orders', 'o_orderdate', 'timestamp without time zone', true, NULL),
  ('orders', 'o_orderpriority', 'text', true, NULL),
  ('documents', 'doc_id', 'bigint', true, NULL), ('documents', 'text', 'text', true, NULL),
  ('documents', 'lang', 'text', true, '''en'''), ('documents', 'source', 'text', true, NULL),
  ('documents', 'n_chars', 'bigint', true, NULL)
 ) AS t("table", "column", data_type, nullable, dflt)),
fits AS (
  SELECT r.*, data_type, nullable, dflt,
         data_type IN ('bigint', 'integer', 'double precision') AS is_number, data_type = 'text' AS is_text,
         data_type LIKE 'timestamp%' AS is_time,
         coalesce(lo, -2147483648.0) AS low, coalesce(hi, 2147483647.0) AS high
  FROM rows r LEFT JOIN catalog c USING (schema, "table", "column") WHERE r."column" IS NOT NULL),
plan AS (
  SELECT *, CASE
    WHEN data_type IS NULL THEN 'missing_column'
    WHEN kind = 'sparkle' THEN 'unknown_kind'
    WHEN kind IN ('zero', 'empty') AND NOT (is_number OR is_text) THEN 'unsupported_type'
    WHEN kind = 'nil' AND NOT nullable THEN 'nil_not_nullable'
    WHEN kind = 'default' AND dflt IS NULL THEN 'no_default'
    WHEN kind IN ('name', 'text', 'phone') AND NOT is_text THEN 'type_mismatch'
    WHEN kind = 'date' AND NOT (is_time OR is_text) THEN 'type_mismatch'
    WHEN kind = 'datetime' AND NOT is_time THEN 'type_mismatch'
    WHEN kind IN ('integer', 'float', 'money') AND NOT (is_number OR is_text) THEN 'type_mismatch'
    WHEN kind = 'integer' AND (low < -2147483648.0 OR high > 2147483647.0) THEN 'out_of_range'
    WHEN kind IN ('float', 'money') AND data_type = 'integer'
         AND (lo < -2147483648.0 OR hi > 2147483647.0) THEN 'out_of_range'
    ELSE 'ok' END AS status
  FROM fits)"""

QUERIES["mask_plan_status"] = mask_plan_status
ORACLES["mask_plan_status"] = (
    f'WITH {PLAN_SQL} SELECT p_partkey, "table", "column", kind, data_type, status FROM plan'
)
QUERIES["mask_outcome"] = mask_outcome
ORACLES["mask_outcome"] = f"""
WITH {PLAN_SQL},
every AS (
  SELECT p_brand, 1 AS c, status <> 'ok' AS bad FROM plan
  UNION ALL SELECT p_brand, 0, kind <> 'truncate' FROM rows WHERE "column" IS NULL)
SELECT p_brand,
       count(*) FILTER (WHERE c = 1) AS columns_attempted, count(*) FILTER (WHERE c = 1 AND bad) AS columns_failed,
       count(*) FILTER (WHERE c = 0) AS tables_attempted, count(*) FILTER (WHERE c = 0 AND bad) AS tables_failed,
       CASE WHEN bool_or(bad) THEN 'partial' ELSE 'complete' END AS phase
FROM every GROUP BY p_brand"""

# --- ranges and versions -----------------------------------------------------------

RANGES = """
SELECT l_orderkey, l_partkey, l_linenumber,
  CASE l_partkey % 8
    WHEN 0 THEN CAST(l_linenumber AS string) || '-' || CAST(l_suppkey AS string)
    WHEN 1 THEN '-' || CAST(l_suppkey AS string) || '-' || CAST(l_linenumber AS string)
    WHEN 2 THEN CAST(l_suppkey AS string) || '.5-' || CAST(l_partkey AS string) || '.25'
    WHEN 3 THEN 'nope' WHEN 4 THEN CAST(l_partkey AS string)
    WHEN 5 THEN CAST(l_partkey AS string) || '-x' WHEN 6 THEN '-1--' || CAST(l_partkey AS string)
    ELSE ' ' || CAST(l_linenumber AS string) || '-9' END AS span
FROM {lineitem}"""


def mask_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = derive(spark, sf_dir, RANGES).withColumn("r", masks.parse_range(F.col("span")))
    return spans.select("l_orderkey", "l_partkey", "l_linenumber", "span", "r.lo", "r.hi")


QUERIES["mask_ranges"] = mask_ranges
ORACLES["mask_ranges"] = f"""
WITH src AS ({plain(RANGES)}),
cut AS (SELECT *, reverse(span) AS b FROM src),
parts AS (SELECT *, CASE WHEN strpos(b, '-') > 0 THEN reverse(substr(b, strpos(b, '-') + 1)) END AS l,
                 CASE WHEN strpos(b, '-') > 0 THEN reverse(substr(b, 1, strpos(b, '-') - 1)) END AS h FROM cut)
SELECT l_orderkey, l_partkey, l_linenumber, span,
       CASE WHEN regexp_matches(l, '{_NUMBER}') AND regexp_matches(h, '{_NUMBER}') THEN l::DOUBLE END AS lo,
       CASE WHEN regexp_matches(l, '{_NUMBER}') AND regexp_matches(h, '{_NUMBER}') THEN h::DOUBLE END AS hi
FROM parts"""

VERSIONS = """
SELECT l_orderkey, l_partkey, l_linenumber,
  CASE l_partkey % 7
    WHEN 0 THEN CAST(l_linenumber AS string) || '.' || CAST(l_suppkey AS string)
    WHEN 1 THEN CAST(l_linenumber AS string) || '.0' || CAST(l_suppkey AS string) || '.' || CAST(l_partkey AS string)
    WHEN 2 THEN 'v' || CAST(l_linenumber AS string) || '.x.' || CAST(l_partkey AS string)
    WHEN 3 THEN CAST(l_linenumber AS string) || '.' || CAST(l_partkey AS string) || '.0'
    WHEN 4 THEN CAST(l_linenumber AS string) || '.99999999999.' || CAST(l_partkey AS string)
    WHEN 5 THEN CAST(l_linenumber AS string) || '.1.2.' || CAST(l_partkey AS string)
    ELSE CAST(l_linenumber AS string) || '.' || CAST(l_suppkey AS string) || '.' || CAST(l_partkey AS string)
  END AS version
FROM {lineitem}"""


def manifest_base_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive(spark, sf_dir, VERSIONS).withColumn("base", base_version(F.col("version")))


QUERIES["manifest_base_version"] = manifest_base_version
ORACLES["manifest_base_version"] = f"""
WITH src AS ({plain(VERSIONS)}), parts AS (SELECT *, string_split(version, '.') AS p FROM src)
SELECT l_orderkey, l_partkey, l_linenumber, version,
       CASE WHEN len(p) = 3 AND TRY_CAST(p[2] AS UINTEGER) IS NOT NULL AND TRY_CAST(p[3] AS UINTEGER) > 0
            THEN p[1] || '.' || TRY_CAST(p[2] AS UINTEGER)::VARCHAR || '.0' END AS base
FROM parts"""

# --- truncation along references, audit, scrub, publish ----------------------------

REFERENCES = [("public.nation", "public.region"), ("public.customer", "public.nation"),
              ("public.orders", "public.customer"), ("public.lineitem", "public.orders")]


def truncate_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["region", "nation", "customer", "orders", "lineitem", "part"]
    tables = {f"public.{n}": table(spark, sf_dir, n) for n in names}
    manifest = manifest_from_text(spark, manifest_doc("public.customer", {}, "truncate"))
    result = mask_tables(spark, tables, manifest, Masking(SECRET), references=REFERENCES)
    counts = [
        result.tables[f"public.{n}"].agg(F.count("*").alias("rows_left")).select(F.lit(n).alias("name"), "rows_left")
        for n in names
    ]
    out = counts[0]
    for more in counts[1:]:
        out = out.unionByName(more)
    return out


QUERIES["truncate_cascade"] = truncate_cascade
ORACLES["truncate_cascade"] = """
WITH RECURSIVE edges(child, parent) AS (VALUES ('nation', 'region'), ('customer', 'nation'),
  ('orders', 'customer'), ('lineitem', 'orders')),
hit(name) AS (SELECT 'customer' UNION SELECT child FROM edges JOIN hit ON parent = name),
sizes(name, n) AS (SELECT 'region', count(*) FROM region UNION ALL SELECT 'nation', count(*) FROM nation
  UNION ALL SELECT 'customer', count(*) FROM customer UNION ALL SELECT 'orders', count(*) FROM orders
  UNION ALL SELECT 'lineitem', count(*) FROM lineitem UNION ALL SELECT 'part', count(*) FROM part)
SELECT name, CASE WHEN name IN (SELECT name FROM hit) THEN 0 ELSE n END AS rows_left FROM sizes"""

AUDIT_EXPECT = {
    "c_name": Expect(pattern=r"^[^\s]+$"),
    "c_acctbal": Expect(low=0.0, high=9000.0),
    "c_nationkey": Expect(low=0, high=24),
    "c_mktsegment": None,
}


def mask_audit_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mask_audit(
        table(spark, sf_dir, "customer"), masked_customer(spark, sf_dir), ["c_custkey"], AUDIT_EXPECT
    )


def _audit_line(column: str, pattern: str, out: str, masked_column: bool) -> str:
    kept = f"count(*) FILTER (WHERE o.{column} = m.{column})" if masked_column else "0"
    differs = "0" if masked_column else f"count(*) FILTER (WHERE o.{column} IS DISTINCT FROM m.{column})"
    return f"""SELECT '{column}' AS "column", count(o.c_custkey) AS rows_before, count(m.c_custkey) AS rows_after,
  count(*) FILTER (WHERE m.c_custkey IS NULL) AS unpaired_before, count(*) FILTER (WHERE o.c_custkey IS NULL) AS unpaired_after,
  floor(count(*) FILTER (WHERE o.{column} IS NOT NULL AND m.{column} IS NOT NULL) * 0.2::DOUBLE)::BIGINT AS kept_allowed,
  count(*) FILTER (WHERE (o.{column} IS NULL) <> (m.{column} IS NULL)) AS nulls_changed, {kept} AS kept_values,
  {pattern} AS pattern_misses, {out} AS out_of_range, {differs} AS differences
  FROM customer o FULL JOIN m ON o.c_custkey = m.c_custkey"""


QUERIES["mask_audit"] = mask_audit_customer
ORACLES["mask_audit"] = f"WITH m AS ({MASKED_CUSTOMER_SQL}) " + " UNION ALL ".join([
    _audit_line("c_name", r"count(*) FILTER (WHERE NOT regexp_matches(m.c_name, '^[^\s]+$'))", "0", True),
    _audit_line("c_acctbal", "0", "count(*) FILTER (WHERE m.c_acctbal < 0 OR m.c_acctbal > 9000)", True),
    _audit_line("c_nationkey", "0", "count(*) FILTER (WHERE m.c_nationkey < 0 OR m.c_nationkey > 24)", True),
    _audit_line("c_mktsegment", "0", "0", False),
])

FACTS = """
SELECT conv_id, turn, CASE WHEN turn % 5 = 4 THEN NULL
  WHEN turn % 3 = 0 THEN 'S1:' || md5(role) || ':' || replace(text, ':', ';')
  WHEN turn % 3 = 1 THEN 'S1:a:' || role || ':' || text ELSE text END AS value FROM {conversations}"""


def row_scrub(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scrub_rows(derive(spark, sf_dir, FACTS), "value")


QUERIES["row_scrub"] = row_scrub
ORACLES["row_scrub"] = f"""
WITH src AS ({plain(FACTS)})
SELECT * FROM src WHERE value IS NULL OR NOT regexp_matches(value, '^S1:[^:]*:[^:]*$')"""


def publish_masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mask, stage, publish and read back through the pointer."""
    root = fresh_path(spark, "published")
    manifest = manifest_from_text(spark, manifest_doc(CUSTOMER, CUSTOMER_MASKS))
    result = mask_tables(
        spark, {CUSTOMER: table(spark, sf_dir, "customer")}, manifest, Masking(SECRET, {CUSTOMER: ("c_custkey",)})
    )
    write_tables(result.tables, root, "run-1")
    publish(spark, root, "run-1", result.phase)
    return read_current(spark, root, CUSTOMER)


QUERIES["publish_masked"] = publish_masked
ORACLES["publish_masked"] = MASKED_CUSTOMER_SQL
