"""Registered queries for whole refreshes: versions, own kinds, audits, publishing, listings on disk."""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.masks import register_mask
from ..operators.audit import Expect, replay_audit
from ..plans.masking import Masking
from ..plans.refresh import CarrySpec, RefreshSpec, refresh
from ..session import fresh_path, local_frame
from ..sources.listing import read_listings, write_listings
from ..sources.manifest import ManifestSpec, resolve_manifest
from ..sources.publish import read_current
from .base import SECRET, derive, draw_sql, plain, table, unit_sql
from .masking import CUSTOMER, CUSTOMER_MASKS, MASKED_CUSTOMER_SQL, manifest_doc, masked, masked_customer
from .snapshots import LISTINGS, SNAPSHOTS_SQL

QUERIES, ORACLES = {}, {}


def _register(name: str, oracle: str):
    def keep(run):
        QUERIES[name], ORACLES[name] = run, oracle
        return run
    return keep


def _put_text(spark: SparkSession, folder: str, name: str, text: str) -> str:
    """Write one text as the only file of a folder named for it."""
    local_frame(spark, [(text,)], "value string").coalesce(1).write.text(f"{folder}/{name}")
    return folder


def _resolved(spark: SparkSession, sf_dir: str) -> tuple[str, DataFrame]:
    """A manifest kept for base versions only, asked for by the newest patch a table names."""
    folder = _put_text(spark, fresh_path(spark, "manifests"), "m-3.7.0", manifest_doc(CUSTOMER, CUSTOMER_MASKS))
    table(spark, sf_dir, "region").createOrReplaceTempView("freshet_versions")
    try:
        query = "SELECT concat('3.7.', max(r_regionkey)) FROM freshet_versions"
        return resolve_manifest(spark, ManifestSpec(f"{folder}/m-{{version}}", version_query=query, fallback_to_base=True))
    finally:
        spark.catalog.dropTempView("freshet_versions")


@_register("manifest_resolved", """
    SELECT '3.7.' || (SELECT max(r_regionkey) FROM region)::VARCHAR AS version, "table", "column", kind
    FROM (VALUES """ + ", ".join(
        f"('customer', '{c}', '{m if isinstance(m, str) else m['kind']}')" for c, m in CUSTOMER_MASKS.items()
    ) + """) m("table", "column", kind)""")
def manifest_resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    version, manifest = _resolved(spark, sf_dir)
    return manifest.select(F.lit(version).alias("version"), "table", "column", "kind")


@_register("mask_registered", """
    SELECT c_custkey, left(c_name, 2) || '#' || length(c_name)::VARCHAR AS c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer""")
def mask_registered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A kind of a user's own, registered like the built-in ones."""
    register_mask("shape", lambda ctx: F.concat(F.substring(ctx.col, 1, 2), F.lit("#"), F.length(ctx.col).cast("string")))
    return masked(spark, table(spark, sf_dir, "customer"), CUSTOMER, {"c_name": "shape"}, ("c_custkey",))


def _verdict(expected: DataFrame, copies: dict[str, DataFrame], keys: tuple[str, ...] = ()) -> DataFrame:
    """A line per copy: whether it is what its masks give."""
    verdicts = [
        replay_audit(expected, copy, keys).agg(F.min("agrees").alias("passed")).select(F.lit(name).alias("copy"), "passed")
        for name, copy in copies.items()
    ]
    for more in verdicts[1:]:
        verdicts[0] = verdicts[0].unionByName(more)
    return verdicts[0]


def _verdict_sql(expected: str, copies: dict[str, str]) -> str:
    """The same by bags: rows the copy lacks or has beyond the expected ones."""
    return " UNION ALL ".join(
        f"SELECT '{name}' AS copy, NOT EXISTS (FROM {expected} EXCEPT ALL FROM {copy}) AND NOT EXISTS (FROM {copy} EXCEPT ALL FROM {expected}) AS passed"
        for name, copy in copies.items())


@_register("mask_audit_verdict", f"""
    WITH m AS ({MASKED_CUSTOMER_SQL}), short AS (FROM m WHERE c_custkey % 2 = 0),
    own AS (SELECT {", ".join(("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"))} FROM customer)
    {_verdict_sql("m", {"masked": "m", "clear": "own", "short": "short"})}""")
def mask_audit_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on a masked table, on one left in the clear and on one that lacks rows."""
    customer, done = table(spark, sf_dir, "customer"), masked_customer(spark, sf_dir)
    copies = {"masked": done, "clear": customer, "short": done.where(F.col("c_custkey") % 2 == 0)}
    return _verdict(done, copies, ("c_custkey",))


RATINGS = "SELECT o_orderkey AS id, o_orderkey % 4 AS rating, o_totalprice AS fee, o_orderpriority AS note FROM {orders}"
RATING_MASKS = {"rating": {"kind": "integer", "range": "0-3"}, "fee": "zero", "note": "empty"}


@_register("mask_audit_narrow", f"""
    WITH src AS ({plain(RATINGS)}), m AS (
      SELECT id, floor({unit_sql(draw_sql("public.ratings.rating", "id::VARCHAR"))} * 4.0::DOUBLE)::BIGINT AS rating, 0.0::DOUBLE AS fee, '' AS note FROM src
    ), clear_fee AS (SELECT m.id, m.rating, s.fee, m.note FROM m JOIN src s USING (id)),
    clear_note AS (SELECT m.id, m.rating, m.fee, s.note FROM m JOIN src s USING (id)),
    one_row AS (SELECT id, CASE WHEN id = (SELECT max(id) FROM src) THEN 3 - rating ELSE rating END AS rating, fee, note FROM m)
    {_verdict_sql("m", {"masked": "m", "clear_fee": "clear_fee", "clear_note": "clear_note", "one_row": "one_row"})}""")
def mask_audit_narrow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A few-valued mask whose values often equal their originals passes; constants left in the clear don't."""
    src = derive(spark, sf_dir, RATINGS)
    done = masked(spark, src, "public.ratings", RATING_MASKS, ("id",))
    clear = src.select("id", F.col("fee").alias("old_fee"), F.col("note").alias("old_note"))
    both = done.join(clear, "id")
    last = src.agg(F.max("id").alias("last"))
    copies = {
        "masked": done,
        "clear_fee": both.select("id", "rating", F.col("old_fee").alias("fee"), "note"),
        "clear_note": both.select("id", "rating", "fee", F.col("old_note").alias("note")),
        "one_row": done.join(last, done["id"] == last["last"], "left").select(
            "id", F.when(F.col("last").isNotNull(), 3 - F.col("rating")).otherwise(F.col("rating")).alias("rating"), "fee", "note"),
    }
    return _verdict(done, copies, ("id",))


TALK = "SELECT turn, role, text FROM {conversations}"


@_register("mask_audit_without_key", f"""
    WITH src AS ({plain(TALK)}), m AS (SELECT turn, role, '' AS text FROM src), numbered AS (SELECT *, row_number() OVER (ORDER BY turn, role) AS n FROM m),
    dropped AS (SELECT turn, role, text FROM numbered WHERE n > 1),
    doubled AS (SELECT turn, role, text FROM numbered UNION ALL SELECT turn, role, text FROM numbered WHERE n = 1),
    swapped AS (SELECT turn, text AS role, role AS text FROM m)
    {_verdict_sql("m", {"masked": "m", "clear": "src", "dropped": "dropped", "doubled": "doubled", "swapped": "swapped"})}""")
def mask_audit_without_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table without a row key: one row dropped, doubled, in the clear or between columns shows."""
    src = derive(spark, sf_dir, TALK)
    done = masked(spark, src, "public.talk", {"text": "empty"}, ())
    one = done.orderBy("turn", "role").limit(1)
    copies = {
        "masked": done.repartition(3), "clear": src, "dropped": done.exceptAll(one), "doubled": done.unionByName(one),
        "swapped": done.select("turn", F.col("text").alias("role"), F.col("role").alias("text")),
    }
    return _verdict(done, copies)


NOTES = """
SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN 'S1:' || md5(role) || ':' || md5(text) ELSE text END AS value
FROM {conversations}"""


def _spec(spark: SparkSession, sf_dir: str, root: str, run_id: str, **more) -> RefreshSpec:
    return RefreshSpec(
        root, run_id, Masking(SECRET, {CUSTOMER: ("c_custkey",)}), _resolved(spark, sf_dir)[1],
        scrub={"public.notes": "value"}, carry=CarrySpec(["reporting"], {
            "reporting.by_segment": "SELECT c_mktsegment, count(*) AS customers FROM public.customer GROUP BY c_mktsegment"}),
        pre_sql={CUSTOMER: "SELECT * FROM public.customer WHERE c_custkey NOT IN (SELECT o_custkey FROM public.left_us)"},
        **more,
    )


def _tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    left_us = table(spark, sf_dir, "orders").where("o_orderkey % 50 = 0").select("o_custkey")
    return {
        CUSTOMER: table(spark, sf_dir, "customer"), "public.notes": derive(spark, sf_dir, NOTES),
        "public.left_us": left_us, "reporting.sizes": table(spark, sf_dir, "part").groupBy("p_size").count(),
    }


_KEPT_SQL = f"""
kept AS (SELECT * FROM ({MASKED_CUSTOMER_SQL}) m
         WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderkey % 50 = 0))"""


@_register("refresh_end_to_end", f"""
    WITH {_KEPT_SQL}
    SELECT 'customer' AS what, c_custkey::VARCHAR AS key, c_name AS value FROM kept
    UNION ALL SELECT 'notes', turn::VARCHAR, count(*)::VARCHAR FROM conversations WHERE turn % 3 <> 0 GROUP BY turn
    UNION ALL SELECT 'sizes', p_size::VARCHAR, count(*)::VARCHAR FROM part GROUP BY p_size
    UNION ALL SELECT 'by_segment', c_mktsegment, count(*)::VARCHAR FROM kept GROUP BY c_mktsegment""")
def refresh_end_to_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two refreshes, the second carrying the first one's reporting tables; what readers then see."""
    root, tables = fresh_path(spark, "refreshes"), _tables(spark, sf_dir)
    for run_id in ("run-1", "run-2"):
        done = refresh(spark, _spec(spark, sf_dir, root, run_id), tables)
        if not done.published:
            raise RuntimeError(f"{run_id}: {done}")
        tables = {n: df for n, df in tables.items() if not n.startswith("reporting.")}
    parts = {
        CUSTOMER: ("customer", F.col("c_custkey"), F.col("c_name")),
        "reporting.sizes": ("sizes", F.col("p_size"), F.col("count")),
        "reporting.by_segment": ("by_segment", F.col("c_mktsegment"), F.col("customers")),
    }
    def lines(df: DataFrame, what: str, key, value) -> DataFrame:
        return df.select(F.lit(what).alias("what"), key.cast("string").alias("key"), value.cast("string").alias("value"))

    out = lines(read_current(spark, root, "public.notes").groupBy("turn").count(), "notes", F.col("turn"), F.col("count"))
    for name, (what, key, value) in parts.items():
        out = out.unionByName(lines(read_current(spark, root, name), what, key, value))
    return out


@_register("publish_refused", f"""
    WITH {_KEPT_SQL} SELECT c_custkey, c_name FROM kept""")
def publish_refused(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second run whose audit fails is not published: readers keep the first one's rows."""
    root, tables = fresh_path(spark, "refused"), _tables(spark, sf_dir)
    refresh(spark, _spec(spark, sf_dir, root, "run-1"), tables)
    never = {CUSTOMER: {"c_name": Expect(pattern="^$")}}
    if refresh(spark, _spec(spark, sf_dir, root, "run-2", expect=never), tables).published:
        raise RuntimeError("a copy that fails its audit was published")
    return read_current(spark, root, CUSTOMER).select("c_custkey", "c_name")


@_register("listings_on_disk", f"""
    WITH {SNAPSHOTS_SQL} SELECT id, description, host, start_time, total_size FROM snaps""")
def listings_on_disk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listings written one to a file and read back as a folder."""
    path = fresh_path(spark, "listings")
    write_listings(derive(spark, sf_dir, LISTINGS), path)
    return read_listings(spark, path).select("id", "description", "host", "start_time", "total_size")
