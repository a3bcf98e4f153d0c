"""Masks: what each kind keeps and changes, and what happens to those that do not fit."""

import datetime as dt
import json

import oracle
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from freshet.cases.registry import all_oracles, all_queries
from freshet.functions.masks import parse_range, register_mask
from freshet.operators.audit import Expect, audit_passed, mask_audit, replay_audit
from freshet.operators.scrub import scrub_rows
from freshet.plans.masking import MaskError, Masking, mask_tables, referencing_closure
from freshet.sources.catalog import catalog_frame, catalog_rows
from freshet.sources.manifest import manifest_from_text

PEOPLE = "public.people"
SCHEMA = (
    "id bigint, email string, full_name string, dob date, seen timestamp_ntz, phone string, note string,"
    " stride int, tiny smallint, weight double, bill decimal(10,2), raw binary, tags array<string>,"
    " extra string, kept string"
)


@pytest.fixture(scope="module")
def people(spark):
    day = dt.date(1974, 9, 3)
    rows = [
        (i, f"u{i}@work.test", "Mira Quist" if i % 2 else "Mira", day, dt.datetime(2024, 3, 1, 4, 5, 6, 7),
         "+15550142839", "vaste mère " * i, 20, 1, 1.5, None, b"abc", ["x"], '{"a":1}', f"tag-{i}")
        for i in range(1, 30)
    ] + [(99,) + (None,) * 13 + ("tag-99",)]
    return spark.createDataFrame(rows, SCHEMA)


def manifest(spark, columns, table=None, name="people"):
    node = {"schema": "public", "name": name, "columns": {c: {"meta": {"masking": m}} for c, m in columns.items()}}
    if table:
        node["meta"] = {"masking": table}
    return manifest_from_text(spark, json.dumps({"sources": {"s": node}}))


def run(spark, people, columns, secret="s1", on_error="fail", **catalog):
    cat = catalog_frame(spark, catalog_rows(people, "public", "people", **catalog))
    settings = Masking(secret, {PEOPLE: ("id",)}, on_error)
    return mask_tables(spark, {PEOPLE: people}, manifest(spark, columns), settings, cat)


EVERY = {
    "email": "email", "full_name": "name", "dob": "date", "seen": "datetime", "phone": "phone", "note": "text",
    "stride": {"kind": "integer", "range": "12-48"}, "weight": {"kind": "float", "range": "-8-8"},
    "bill": "money",
}


def test_kinds_keep_what_they_promise(spark, people):
    result = run(spark, people, EVERY)
    assert result.phase == "complete" and result.outcome.columns_attempted == 9
    masked = result.tables[PEOPLE]
    assert masked.schema.simpleString() == people.schema.simpleString()
    both = people.alias("o").join(masked.alias("m"), "id").collect()
    for row in masked.where("id = 99").collect():
        assert all(row[c] is None for c in EVERY)
    for row in masked.where("id < 99").collect():
        old = people.where(F.col("id") == row.id).first() if row.id == 7 else None
        assert "@" in row.email and not row.email.endswith("work.test")
        assert (" " in row.full_name) == bool(row.id % 2)
        assert row.phone == "+1****39"
        assert 12 <= row.stride <= 48 and -8 <= row.weight < 8
        assert row.bill is None  # it was NULL
        assert len(row.note) == len("vaste mère ") * row.id and "vaste" not in row.note
        assert row.seen.date() == dt.date(2024, 3, 1) and row.seen.microsecond == 0
        assert dt.date(1900, 1, 1) <= row.dob <= dt.date(2026, 1, 1)
        assert row.kept == f"tag-{row.id}"
        assert old is None or old.dob != row.dob
    assert len(both) == 30


def test_same_secret_same_fakes(spark, people):
    def emails(secret):
        return [r.email for r in run(spark, people, {"email": "email"}, secret).tables[PEOPLE].orderBy("id").collect()]

    assert emails("s1") == emails("s1")
    assert emails("s1") != emails("s2")


def test_fakes_do_not_depend_on_partitioning(spark, people):
    one = run(spark, people.coalesce(1), EVERY).tables[PEOPLE]
    many = run(spark, people.repartition(7, "kept"), EVERY).tables[PEOPLE]
    assert one.exceptAll(many).count() == 0


def test_the_secret_never_reaches_a_plan(spark, people):
    masked = run(spark, people, EVERY, secret="top-secret-value").tables[PEOPLE]
    assert "top-secret-value" not in masked._jdf.queryExecution().toString()
    assert "top-secret" not in repr(Masking("top-secret-value"))


def test_masking_is_one_projection_without_a_shuffle(spark, sf_dir):
    lineitem = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    doc = {"sources": {"s": {"schema": "public", "name": "lineitem", "columns": {
        "l_quantity": {"meta": {"masking": "zero"}}, "l_shipdate": {"meta": {"masking": "datetime"}}}}}}
    settings = Masking("s", {"public.lineitem": ("l_orderkey", "l_linenumber")})
    masked = mask_tables(spark, {"public.lineitem": lineitem}, manifest_from_text(spark, json.dumps(doc)), settings)
    plan = masked.tables["public.lineitem"]._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and plan.count("Scan parquet") == 1
    narrow = masked.tables["public.lineitem"].select("l_tax")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<l_tax:double>" in narrow


def test_type_dispatched_kinds(spark, people):
    columns = {"note": "zero", "stride": "zero", "raw": "zero", "tags": "empty", "extra": "empty",
               "weight": "empty", "email": "nil", "phone": "default"}
    row = run(
        spark, people, columns, types={"extra": "jsonb"}, defaults={"phone": "concat('un', 'set')"},
    ).tables[PEOPLE].where("id = 3").first()
    assert row.note == "0" * 33 and row.stride == 0 and row.raw == b"\0\0\0"
    assert row.tags == [] and row.extra == "{}" and row.weight == 0.0 and row.email is None
    assert row.phone == "unset"
    nulls = run(spark, people, {"stride": "zero", "note": "zero", "raw": "zero", "email": "empty"})
    row = nulls.tables[PEOPLE].where("id = 99").first()
    # Numbers and emptied texts lose their NULL; repeated zeros have no length to go by.
    assert row.stride == 0 and row.email == "" and row.note is None and row.raw is None


BAD = {
    "email": ("integer", {"types": {"email": "uuid"}}, "type_mismatch"),
    "Email": ("email", {}, "missing_column"),
    "kept": ("sparkle", {}, "unknown_kind"),
    "dob": ("zero", {}, "unsupported_type"),
    "seen": ("empty", {}, "unsupported_type"),
    "note": ("nil", {"not_null": ("note",)}, "nil_not_nullable"),
    "phone": ("default", {}, "no_default"),
    "extra": ("default", {"defaults": {"extra": "nextval('x'::regclass)"}}, "no_default"),
    "raw": ("default", {"defaults": {"raw": "cast(uuid() AS binary)"}}, "not_repeatable"),
    "stride": ("email", {}, "type_mismatch"),
    "full_name": ("datetime", {}, "type_mismatch"),
    "tiny": ("integer", {}, "out_of_range"),
}


@pytest.mark.parametrize("column", sorted(BAD))
def test_masks_that_cannot_apply(spark, people, column):
    kind, catalog, status = BAD[column]
    columns = {column: kind, "weight": "float"}
    with pytest.raises(MaskError):
        run(spark, people, columns, **catalog)
    result = run(spark, people, columns, on_error="tolerate", **catalog)
    assert result.phase == "partial"
    assert result.outcome.columns_attempted == 2 and result.outcome.columns_failed == 1
    assert [f["status"] for f in result.failures] == [status]
    masked = result.tables[PEOPLE]
    if column in people.columns:  # the bad column stays, the good one is masked
        changed = people.join(masked.select("id", F.col("weight").alias("w"), F.col(column).alias("v")), "id")
        assert changed.where(~F.col(column).eqNullSafe(F.col("v"))).count() == 0
        assert changed.where(F.col("w") == F.col("weight")).count() == 0


def test_two_masks_on_one_column_apply_in_order(spark, people):
    doc = {"sources": {
        "a": {"schema": "public", "name": "people", "columns": {"full_name": {"meta": {"masking": "name"}}}},
        "b": {"schema": "public", "name": "people", "columns": {"full_name": {"meta": {"masking": "zero"}}}},
    }}
    settings = Masking("s", {PEOPLE: ("id",)})
    result = mask_tables(spark, {PEOPLE: people}, manifest_from_text(spark, json.dumps(doc)), settings)
    values = [r[0] for r in result.tables[PEOPLE].where("id < 99").select("full_name").collect()]
    assert set("".join(values)) == {"0"} and len({len(v) for v in values}) > 2  # lengths of the fakes


def test_user_kinds_join_the_registry(spark, people):
    register_mask("initial", lambda ctx: F.concat(F.substring(ctx.col, 1, 1), (ctx.draw() % 10).cast("string")))
    values = [r[0] for r in run(spark, people, {"kept": "initial"}).tables[PEOPLE].select("kept").collect()]
    assert all(len(v) == 2 and v[0] == "t" for v in values)


def test_kinds_must_be_repeatable(spark, people):
    register_mask("loose", lambda ctx: F.rand(), writes="number")
    result = run(spark, people, {"weight": "loose"}, on_error="tolerate")
    assert [f["status"] for f in result.failures] == ["not_repeatable"]
    assert result.tables[PEOPLE].where("weight <> 1.5").count() == 0


def test_no_row_key_falls_back_to_the_unmasked_columns(spark, people):
    settings = Masking("s")
    with pytest.warns(UserWarning, match="row key"):
        result = mask_tables(spark, {PEOPLE: people}, manifest(spark, {"email": "email"}), settings)
    assert result.tables[PEOPLE].select("email").distinct().count() > 20
    with pytest.raises(MaskError):
        mask_tables(spark, {"public.people": people.select("email")}, manifest(spark, {"email": "email"}), settings)


def test_truncation_cascades(spark, people):
    assert referencing_closure([("b", "a"), ("c", "b"), ("a", "c"), ("z", "y")], ["a"]) == {"a", "b", "c"}
    tables = {PEOPLE: people, "public.visits": people.select("id"), "public.other": people.select("id")}
    result = mask_tables(
        spark, tables, manifest(spark, {}, table="truncate"), Masking("s"),
        references=[("public.visits", PEOPLE)],
    )
    assert [result.tables[n].count() for n in tables] == [0, 0, 30]
    assert result.outcome.tables_attempted == 1 and result.phase == "complete"
    other = mask_tables(
        spark, tables, manifest(spark, {}, table="scramble"), Masking("s", on_error="tolerate")
    )
    assert other.outcome.tables_failed == 1 and other.phase == "partial"


@pytest.mark.parametrize("text, expected", [
    ("0.25-0.75", (0.25, 0.75)), ("31-44", (31.0, 44.0)), ("0-7.25", (0.0, 7.25)), ("-8-8", (-8.0, 8.0)),
    ("nope", None), ("1-x", None), ("1.2", None), ("-9--3", None), (" 1-2", None), ("1e2-+3e3", (100.0, 3000.0)),
    ("-inf-inf", (float("-inf"), float("inf"))), ("1d-2f", None), ("", None), ("-", None),
])
def test_ranges(spark, text, expected):
    got = spark.range(1).select(parse_range(F.lit(text)).alias("r")).first().r
    assert (got and tuple(got)) == expected


def test_audit_finds_what_went_wrong(spark, people):
    masked = run(spark, people, {"email": "email", "stride": {"kind": "integer", "range": "12-48"}}).tables[PEOPLE]
    expected = {"email": Expect(pattern="@"), "stride": Expect(low=12, high=48), "kept": None}
    assert audit_passed(mask_audit(people, masked, ["id"], expected))
    unmasked = {r["column"]: r for r in mask_audit(people, people, ["id"], expected).collect()}
    assert unmasked["email"].kept_values == 29
    assert not audit_passed(replay_audit(masked, people, ["id"]))  # the originals fit every pattern
    swapped = masked.withColumn("id", F.when(F.col("id") == 3, 1000).otherwise(F.col("id")))
    assert not audit_passed(mask_audit(people, swapped, ["id"], expected))  # as many rows, another key
    broken = masked.withColumn("kept", F.lit("x")).withColumn("email", F.lit("none")).where("id <> 3")
    report = {r["column"]: r for r in mask_audit(people, broken, ["id"], expected).collect()}
    assert report["kept"].differences == 29 and report["email"].pattern_misses == 29
    assert (report["email"].rows_before, report["email"].rows_after) == (30, 29)
    assert (report["email"].unpaired_before, report["email"].unpaired_after) == (1, 0)


def test_audit_says_how_many_values_may_be_kept(spark, people):
    expected = {"email": Expect(pattern="@"), "kept": None}
    report = {r["column"]: r for r in mask_audit(people, people, ["id"], expected).collect()}
    assert report["email"].kept_values == 29 and report["email"].kept_allowed == 5
    assert not audit_passed(mask_audit(people, people, ["id"], expected))  # the originals fit every pattern
    zeros = people.withColumn("stride", F.lit(0))
    assert audit_passed(mask_audit(zeros, zeros, ["id"], {"stride": Expect(kept_share=1.0)}))
    assert "AS kept_allowed" in all_oracles()["mask_audit"]


def test_values_a_decimal_cannot_hold_are_refused(spark, people):
    narrow = people.select("id", "kept", F.lit(1).cast("decimal(4,2)").alias("fee"))
    for mask in ("money", {"kind": "float", "range": "0-99.6"}, {"kind": "integer", "range": "0-100"}):
        result = run(spark, narrow, {"fee": mask}, on_error="tolerate")
        assert [f["status"] for f in result.failures] == ["out_of_range"] and result.phase == "partial"
    good = run(spark, narrow, {"fee": {"kind": "money", "range": "0-99.4"}})
    assert good.phase == "complete" and good.tables[PEOPLE].agg(F.max("fee")).first()[0] < 100


def test_defaults_that_fail_when_they_run_are_found_before(spark, people):
    result = run(spark, people, {"stride": "default"}, on_error="tolerate", defaults={"stride": "'abc'"})
    assert [f["status"] for f in result.failures] == ["default_fails"] and result.tables[PEOPLE].count() == 30
    with pytest.raises(MaskError):
        run(spark, people, {"stride": "default"}, defaults={"stride": "'abc'"})


def test_masks_of_tables_and_columns_that_are_not_there(spark, people):
    catalog = catalog_frame(spark, catalog_rows(people, "public", "people") + catalog_rows(people, "public", "absent"))
    doc = {"sources": {t: {"schema": "public", "name": t, "columns": {"email": {"meta": {"masking": "email"}}}} for t in ("people", "absent")}}
    def go(on_error, df=people):
        return mask_tables(spark, {PEOPLE: df}, manifest_from_text(spark, json.dumps(doc)), Masking("s", {PEOPLE: ("id",)}, on_error), catalog)

    result = go("tolerate")
    assert [(f["table"], f["status"]) for f in result.failures] == [("public.absent", "missing_table")]
    assert (result.phase, result.outcome.columns_attempted, result.outcome.columns_failed) == ("partial", 2, 1)
    with pytest.raises(MaskError) as raised:
        go("fail")
    assert len(raised.value.failures) == 1
    without = go("tolerate", people.drop("email"))
    assert sorted(f["status"] for f in without.failures) == ["missing_column", "missing_table"]


def test_composite_keys_do_not_share_fakes(spark):
    rows = [("a|b", "c"), ("a", "b|c"), (None, "x"), ("", "x")]
    df = spark.createDataFrame([(*r, "m") for r in rows], "p string, q string, email string")
    settings = Masking("s", {PEOPLE: ("p", "q")})
    found = mask_tables(spark, {PEOPLE: df}, manifest(spark, {"email": "email"}), settings).tables[PEOPLE]
    assert found.select("email").distinct().count() == 4


def test_scrub_keeps_nulls(spark):
    rows = [("a", "S1:q7Z=:Zm9v"), ("b", "plain"), ("c", None), ("d", "S1:a:b:c"), ("e", "xS1:a:b"), ("f", "S1::")]
    left = scrub_rows(spark.createDataFrame(rows, "key string, value string"), "value")
    assert sorted(r.key for r in left.collect()) == ["b", "c", "d", "e"]
    assert scrub_rows(None, "value") is None


def changed(report):
    return {r["column"] for r in report.collect() if not r["agrees"]}


def test_copies_are_held_against_their_masks(spark, people):
    masks = {"email": "email", "tiny": {"kind": "integer", "range": "0-1"}, "stride": "zero", "note": "empty", "dob": "nil"}
    masked = run(spark, people, masks).tables[PEOPLE]
    for keys in (["id"], []):
        assert audit_passed(replay_audit(masked, masked.repartition(5), keys))
        for name in ("email", "stride", "note", "dob"):  # constants too: what they must be is known
            clear = people.select("id", F.col(name).alias("_clear"))
            copy = masked.join(clear, "id").withColumn(name, F.col("_clear")).select(*masked.columns)
            assert changed(replay_audit(masked, copy, keys)) == ({name} if keys else {name, "*"})
        assert not audit_passed(replay_audit(masked, masked.where("id <> 3"), keys))
        assert not audit_passed(replay_audit(masked, masked.unionByName(masked.where("id = 3")), keys))
        assert changed(replay_audit(masked, masked.drop("note"), keys)) >= {"note"}
        assert changed(replay_audit(masked, masked.withColumn("tiny", F.col("tiny").cast("int")), keys)) >= {"tiny"}
    swapped = masked.withColumns({"extra": F.col("kept"), "kept": F.col("extra")})
    assert changed(replay_audit(masked, swapped)) == {"extra", "kept", "*"}


def test_audits_take_maps_nulls_and_empty_tables(spark):
    rows = [(1, {"a": 1}, None, [{"x": 1}]), (None, None, "v", None)]
    df = spark.createDataFrame(rows, "id int, m map<string,int>, s string, l array<map<string,int>>")
    for keys in (["id"], []):
        assert audit_passed(replay_audit(df, df, keys)) and audit_passed(replay_audit(df.limit(0), df.limit(0), keys))
        assert not audit_passed(replay_audit(df, df.limit(0), keys)) and not audit_passed(replay_audit(df.limit(0), df, keys))
        other = df.withColumn("m", F.create_map(F.lit("a"), F.lit(2)))
        assert "m" in changed(replay_audit(df, other, keys))


def test_wide_ids_do_not_break_the_narrow_columns(spark, tmp_path):
    """Ids of a larger table go beyond a smallint and an integer."""
    ids = [0, 32767, 32768, 90_000, 2**31 - 1, 2**31, 2**40 + 5]
    pq.write_table(pa.table({"event_id": range(len(ids)), "user_id": ids}), tmp_path / "events.parquet")
    masked = all_queries()["mask_integer"](spark, str(tmp_path))
    assert dict(masked.dtypes)["signed"] == "smallint" and masked.count() == len(ids)
    assert oracle.compare(masked, oracle.connect(tmp_path), all_oracles()["mask_integer"]) is None
