"""Carry-over and publishing: what the new copy holds, and who gets to see it when."""

import json
import time
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from freshet.operators.carry import carry_schemas, run_within, split_droppable
from freshet.operators.audit import Expect
from freshet.session import fresh_path
from freshet.plans.refresh import CarrySpec, RefreshSpec, refresh
from freshet.plans.masking import Masking
from freshet.sources.manifest import manifest_from_text
from freshet.sources.publish import (
    PublishRefused, _pointers, current_run, publish, read_current, read_staged, report_rows, stage_tables, write_tables,
    written_tables,
)


@pytest.fixture(scope="module")
def copies(spark):
    ids = spark.range(640).withColumn("data", F.lit("x"))
    previous = {
        "public.readings": ids, "notebook.entries": spark.range(55).withColumn("value", F.lit("v")),
        "catalogue.shelves": spark.range(12),
    }
    new = {"public.readings": ids, "catalogue.shelves": spark.range(3), "public.flag": spark.range(1)}
    return previous, new


def counts(tables):
    return {name: df.count() for name, df in tables.items()}


def test_tables_come_from_the_previous_copy(spark, copies):
    previous, new = copies
    done = carry_schemas(spark, new, previous, ["notebook", "catalogue", "gone"])
    assert done.phase == "complete" and done.skipped == ["gone"]
    assert counts(done.tables) == {
        "public.readings": 640, "public.flag": 1, "notebook.entries": 55, "catalogue.shelves": 12}


def test_views_are_built_again_or_counted(spark, copies):
    previous, new = copies
    views = {"reporting.all_v": "SELECT t.id FROM public.readings t JOIN catalogue.shelves i ON i.id = t.id",
             "reporting.bad_v": "SELECT renamed FROM public.readings", "other.v": "SELECT 1"}
    done = carry_schemas(spark, new, previous, ["reporting", "catalogue"], views)
    assert done.phase == "partial: 1 statement error(s)" and set(done.errors) == {"reporting.bad_v"}
    assert done.tables["reporting.all_v"].count() == 12 and "other.v" not in done.tables


@pytest.mark.parametrize("previous, schemas", [(None, ["a"]), ({}, []), ({}, ["missing"])])
def test_nothing_to_carry_is_complete(spark, copies, previous, schemas):
    done = carry_schemas(spark, copies[1], previous, schemas)
    assert done.phase == "complete" and set(done.tables) == set(copies[1])


def test_reserved_schemas_are_refused():
    assert split_droppable(["reporting", "public", "dbt", "pg_toast", "public_x"]) == (
        ["reporting", "dbt", "public_x"], ["public", "pg_toast"])


def test_a_budget_cuts_the_work_off(spark):
    slow = spark.range(0, 400, numPartitions=400).select(F.expr("reflect('java.lang.Thread', 'sleep', 100L)"))
    start = time.monotonic()
    assert run_within(spark, 1.0, lambda: slow.write.format("noop").mode("overwrite").save()) is False
    assert time.monotonic() - start < 8
    assert run_within(spark, 60, lambda: spark.range(5).count()) is True
    with pytest.raises(ZeroDivisionError):
        run_within(spark, 60, lambda: 1 / 0)


def test_publishing_moves_a_pointer(spark):
    root = fresh_path(spark, "pub")
    assert current_run(spark, root) is None
    with pytest.raises(LookupError):
        read_current(spark, root, "t")
    write_tables({"t": spark.range(3), "u": spark.range(1)}, root, "one")
    assert current_run(spark, root) is None  # staged is not published
    publish(spark, root, "one", "complete")
    write_tables({"t": spark.range(5)}, root, "two")
    for phase in ("failed: no manifest", "active", ""):
        with pytest.raises(PublishRefused):
            publish(spark, root, "two", phase)
    assert read_current(spark, root, "t").count() == 3  # the previous copy stays
    publish(spark, root, "two", "partial")
    assert current_run(spark, root) == "two" and read_current(spark, root, "t").count() == 5
    assert read_staged(spark, root, "one", "t").count() == 3
    with pytest.raises(FileExistsError):
        write_tables({"t": spark.range(9)}, root, "two")  # never over a written copy
    stage_tables({"half": spark.range(9)}, root, "two")  # staged and lost: no part of the run
    with pytest.raises(LookupError):
        read_current(spark, root, "half")
    write_tables({"half": spark.range(4)}, root, "two")  # a second attempt is not in its way
    assert read_current(spark, root, "half").count() == 4
    for i in range(14):
        publish(spark, root, "one" if i % 2 else "two", "complete")
    assert current_run(spark, root) == "one"


def test_publishers_at_the_same_time_get_numbers_of_their_own(spark):
    root = fresh_path(spark, "race")
    with ThreadPoolExecutor(8) as pool:
        list(pool.map(lambda i: publish(spark, root, f"run-{i}", "complete"), range(8)))
    assert len(_pointers(spark, root)) == 8


def test_reports_leave_absent_parts_out(spark):
    df = spark.createDataFrame([("r1", None, 5), ("r2", "boom", None)], "restore string, error string, seconds int")
    assert [json.loads(r.value) for r in report_rows(df).collect()] == [
        {"restore": "r1", "seconds": 5}, {"restore": "r2", "error": "boom"}]


MANIFEST = json.dumps({"sources": {"s": {"schema": "public", "name": "people", "columns": {
    "email": {"meta": {"masking": "email"}}, "gone": {"meta": {"masking": "email"}}}}}})


def test_refresh_end_to_end(spark):
    root = fresh_path(spark, "refresh")
    people = spark.range(20).select("id", F.concat(F.lit("p"), "id", F.lit("@corp.test")).alias("email"))
    secrets = spark.createDataFrame([("a", "S1:q7Z=:Zm9v"), ("b", "left alone")], "key string, value string")
    tables = {"public.people": people, "reporting.old": spark.range(1), "dbt.t": spark.range(2),
              "public.secrets": secrets, "public.left_us": spark.range(3)}
    manifest = manifest_from_text(spark, MANIFEST)
    spec = RefreshSpec(
        root, "run-1", Masking("s", {"public.people": ("id",)}, on_error="tolerate"), manifest,
        scrub={"public.secrets": "value"}, drop_schemas=["dbt", "public"], carry=CarrySpec(["reporting"]),
        pre_sql={"public.people": "SELECT * FROM public.people WHERE id NOT IN (SELECT id FROM public.left_us)"},
    )
    first = refresh(spark, spec, tables)
    assert (first.masking_phase, first.carry_phase, first.published) == ("partial", "complete", True)
    masked = read_current(spark, root, "public.people")
    assert masked.where("email like '%corp.test'").count() == 0 and masked.count() == 17
    assert [r.key for r in read_current(spark, root, "public.secrets").collect()] == ["b"]
    assert "dbt.t" not in written_tables(spark, root, "run-1")

    # A build adds a reporting table to the published copy; the next refresh carries it on.
    write_tables({"reporting.built": spark.range(7)}, root, "run-1")
    spec.run_id, spec.carry.views = "run-2", {"reporting.v": "SELECT id FROM public.people"}
    second = refresh(spark, spec, tables)
    assert second.carry_phase == "complete" and current_run(spark, root) == "run-2"
    assert read_current(spark, root, "reporting.built").count() == 7
    assert read_current(spark, root, "reporting.v").count() == 17

    spec.run_id, spec.masking = "run-3", Masking("s", {"public.people": ("id",)}, on_error="fail")
    third = refresh(spark, spec, tables)
    assert third.published is False and third.masking_phase.startswith("failed: ")
    assert current_run(spark, root) == "run-2"


def slow_rows(spark, tasks):
    """A row a task, each of which sleeps."""
    return spark.range(0, tasks, numPartitions=tasks).select("id", F.expr("reflect('java.lang.Thread', 'sleep', 100L)").alias("slept"))


def test_a_budget_cuts_the_carry_over_and_publishes_without_it(spark):
    root = fresh_path(spark, "budget")
    manifest = manifest_from_text(spark, MANIFEST)
    people = spark.range(20).select("id", F.concat(F.lit("p"), "id", F.lit("@corp.test")).alias("email"), F.lit("g@corp.test").alias("gone"))
    spec = RefreshSpec(root, "run-1", Masking("s", {"public.people": ("id",)}), manifest, carry=CarrySpec(["slow"]))
    assert refresh(spark, spec, {"public.people": people, "slow.t": spark.range(3)}).published
    spec.run_id = "run-2"
    spec.carry = CarrySpec(["slow"], {"slow.v": "SELECT * FROM public.wait"}, budget_seconds=2)
    start = time.monotonic()
    done = refresh(spark, spec, {"public.people": people, "public.wait": slow_rows(spark, 4)})
    assert done.carry_phase == "complete" and done.published  # the view over written rows is quick
    spec.run_id = "run-3"
    slow = refresh_with_slow_view(spark, spec, people)
    assert slow.published and slow.carry_phase == "timeout-skipped" and time.monotonic() - start < 60
    assert current_run(spark, root) == "run-3"
    assert not [n for n in written_tables(spark, root, "run-3") if n.startswith("slow.")]


def refresh_with_slow_view(spark, spec, people):
    spec.carry = CarrySpec(["slow"], {
        "slow.v": "SELECT a.id, reflect('java.lang.Thread', 'sleep', 20L) AS s FROM public.people a, public.people b, public.people c"},
        budget_seconds=2)
    return refresh(spark, spec, {"public.people": people})


def test_an_audit_that_fails_holds_the_copy_back(spark):
    root = fresh_path(spark, "audit")
    people = spark.range(50).select("id", F.concat(F.lit("p"), "id", F.lit("@corp.test")).alias("email"), F.lit("x@y.z").alias("gone"))
    spec = RefreshSpec(
        root, "run-1", Masking("s", {"public.people": ("id",)}), manifest_from_text(spark, MANIFEST),
        expect={"public.people": {"email": Expect(pattern="@nowhere$")}})
    done = refresh(spark, spec, {"public.people": people})
    assert not done.published and done.masking_phase == "failed: the audit refuses ['public.people']"
    assert current_run(spark, root) is None


def staged_otherwise(monkeypatch, change):
    """Stage ``public.people`` as something else than its masks give."""
    import freshet.plans.refresh as plan

    stage = plan.stage_tables
    monkeypatch.setattr(plan, "stage_tables", lambda tables, *a, **b: stage({n: change(df) if n == "public.people" else df for n, df in tables.items()}, *a, **b))


RATINGS = json.dumps({"sources": {"s": {"schema": "public", "name": "people", "columns": {
    "rating": {"meta": {"masking": {"kind": "integer", "range": "0-3"}}}, "fee": {"meta": {"masking": "zero"}}}}}})


def ratings(spark):
    return spark.range(400).select("id", (F.col("id") % 4).cast("int").alias("rating"), F.col("id").cast("double").alias("fee"))


@pytest.mark.parametrize("keys, audit", [(("id",), "rows"), (("id",), "bags"), ((), "rows")])
def test_the_gate_takes_narrow_masks_and_refuses_clear_constants(spark, monkeypatch, keys, audit):
    root, people = fresh_path(spark, "gate"), ratings(spark)
    manifest = manifest_from_text(spark, RATINGS)
    masking = Masking("s", {"public.people": keys} if keys else {})
    assert refresh(spark, RefreshSpec(root, "run-1", masking, manifest, audit=audit), {"public.people": people}).published
    changes = {
        "clear": lambda df: df.drop("fee").join(people.select("id", "fee"), "id").select(*df.columns),
        "dropped": lambda df: df.where("id <> 7"), "doubled": lambda df: df.unionByName(df.where("id = 7")),
    }
    for name, change in changes.items():
        with monkeypatch.context() as patch:
            staged_otherwise(patch, change)
            done = refresh(spark, RefreshSpec(root, f"run-{name}", masking, manifest, audit=audit), {"public.people": people})
        assert not done.published and set(done.refused) == {"public.people"}
        if name == "clear":
            assert "fee" in {line["column"] for line in done.refused["public.people"]}
    assert current_run(spark, root) == "run-1"


def test_emptied_tables_and_masked_keys_are_audited(spark, monkeypatch):
    root, people = fresh_path(spark, "emptied"), ratings(spark)
    doc = {"sources": {"s": {"schema": "public", "name": "people", "meta": {"masking": "truncate"}, "columns": {}}}}
    empty = manifest_from_text(spark, json.dumps(doc))
    assert refresh(spark, RefreshSpec(root, "run-1", Masking("s"), empty), {"public.people": people}).published
    with monkeypatch.context() as patch:
        staged_otherwise(patch, lambda df: people)
        assert not refresh(spark, RefreshSpec(root, "run-2", Masking("s"), empty), {"public.people": people}).published
    keyed = Masking("s", {"public.people": ("rating", "id")})  # a mask changes part of the key
    assert refresh(spark, RefreshSpec(root, "run-3", keyed, manifest_from_text(spark, RATINGS)), {"public.people": people}).published


def test_what_broke_a_refresh_off_is_kept(spark):
    spec = RefreshSpec(fresh_path(spark, "broken"), "run-1", Masking("s", {"public.people": ("id",)}), manifest_from_text(spark, RATINGS), pre_sql={"public.people": "SELECT nothing"})
    done = refresh(spark, spec, {"public.people": ratings(spark)})
    assert not done.published and isinstance(done.error, Exception)


def test_failures_while_writing_hold_the_copy_back(spark):
    root = fresh_path(spark, "late")
    people = spark.range(5).select("id", F.lit("a@b.c").alias("email"), F.expr("CAST(raise_error('disk') AS STRING)").alias("gone"), F.expr("if(id > 3, raise_error('late'), id)").alias("n"))
    spec = RefreshSpec(root, "run-1", Masking("s", {"public.people": ("id",)}), manifest_from_text(spark, MANIFEST))
    done = refresh(spark, spec, {"public.people": people})
    assert not done.published and done.masking_phase.startswith("failed: ")
    good = people.select("id", "email", F.lit("g@h.i").alias("gone"))
    assert refresh(spark, spec, {"public.people": good}).published  # the same run id, tried again


def test_views_over_views_in_any_order(spark, copies):
    previous, new = copies
    views = {"reporting.a": "SELECT id FROM reporting.b", "reporting.b": "SELECT id FROM catalogue.shelves",
             "reporting.c": "SELECT id FROM reporting.d", "reporting.d": "SELECT nothing FROM public.readings"}
    done = carry_schemas(spark, new, previous, ["reporting", "catalogue"], views)
    assert done.tables["reporting.a"].count() == 12 and set(done.errors) == {"reporting.c", "reporting.d"}
