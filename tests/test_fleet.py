"""Fleet state: running values against plain windows, streaks, gates and grading."""

import datetime as dt
import random

import pytest
from pyspark.sql import Window, functions as F

from freshet.functions import expressions as ex
from freshet.operators import access, fleet, stalls, verify
from freshet.operators.ordered import SEGMENT, cut, running

NOW = dt.datetime(2026, 5, 8, 12)


def ago(**delta):
    return NOW - dt.timedelta(**delta)


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of all rows on one key, the rest spread; some values missing."""
    rng = random.Random(7)
    rows, at = [], dt.datetime(2026, 1, 1)
    for seq in range(3000):
        at += dt.timedelta(minutes=rng.choice([1, 5, 200]))
        key = 0 if rng.random() < 0.34 else rng.randrange(1, 40)
        rows.append((key, at, seq, rng.randrange(5) if rng.random() < 0.7 else None, rng.random() < 0.3))
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "key int, at timestamp, seq bigint, v bigint, flag boolean").repartition(6)


@pytest.mark.parametrize("segments", [1, 7, 60, None])
def test_running_values_match_plain_windows(skewed, segments):
    v = F.col("v")
    pieces = cut(skewed, ["key"], ["at", "seq"], segments)
    got = running(pieces, ["key"], ["at", "seq"], {
        "total": ("sum", v), "peak": ("max", v), "newest": ("last", v), "earlier": ("previous", v),
        "row_before": ("previous", F.struct("v")),
    }).drop(SEGMENT)
    w = Window.partitionBy("key").orderBy("at", "seq")
    up_to, before = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    plain = skewed.select(
        "*", F.sum(v).over(up_to).alias("total"), F.max(v).over(up_to).alias("peak"),
        F.last(v, True).over(up_to).alias("newest"), F.last(v, True).over(before).alias("earlier"),
        F.lag(F.struct("v")).over(w).alias("row_before"),
    )
    assert got.count() == 3000
    assert got.exceptAll(plain).count() == 0 and plain.exceptAll(got).count() == 0


@pytest.mark.parametrize("at", ["burst", "equal"])
def test_segments_are_even_whatever_the_clock_does(spark, at):
    """One key with nearly all its rows within a minute, or at one instant."""
    second = {"burst": F.when(F.col("id") % 2000 == 0, F.col("id") * 500).otherwise(F.col("id") % 60), "equal": F.lit(5)}[at]
    rows = spark.range(0, 20_000, 1, 4).select(F.lit(1).alias("key"), F.timestamp_seconds(second).alias("at"), F.col("id").alias("seq"))
    sizes = [r["count"] for r in cut(rows, ["key"], ["at", "seq"], 10).groupBy(SEGMENT).count().collect()]
    assert len(sizes) == 10 and max(sizes) < 3 * 20_000 / 10


def test_several_passes_shuffle_the_rows_once(skewed):
    pieces = cut(skewed, ["key"], ["at", "seq"], 9)
    once = running(pieces, ["key"], ["at", "seq"], {"a": ("sum", F.col("v"))})
    twice = running(once, ["key"], ["at", "seq"], {"b": ("max", F.col("a"))})
    once.sparkSession.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = twice._jdf.queryExecution().executedPlan().toString()
    finally:
        once.sparkSession.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    by_segment = [line for line in plan.splitlines() if "Exchange hashpartitioning(key" in line and SEGMENT in line]
    # Per pass: rows or their pruned twin, the folded summaries, the carried values.
    assert len(by_segment) <= 8


@pytest.mark.parametrize("failures, delay", [(0, None), (1, 120), (2, 240), (3, 480), (4, 960), (5, 1920), (6, 3600), (7, 3600), (4_000_000, 3600)])
def test_backoff(spark, failures, delay):
    assert spark.range(1).select(fleet.backoff_seconds(F.lit(failures))).first()[0] == delay


def test_streaks(spark):
    outcomes = {"a": "FFSFF", "b": "SSS", "c": "FFF", "d": "FS"}
    rows = [(r, ago(days=30 - 2 * i), i, o == "S") for r, text in outcomes.items() for i, o in enumerate(text)]
    attempts = spark.createDataFrame(rows, "replica string, at timestamp, seq int, fine boolean")
    got = {}
    for r in fleet.failure_streaks(attempts, F.col("fine")).orderBy("replica", "seq").collect():
        got.setdefault(r.replica, []).append(r.streak)
    assert got == {"a": [1, 2, 0, 1, 2], "b": [0, 0, 0], "c": [1, 2, 3], "d": [1, 0]}
    now = {r.replica: (r.streak, r.backoff_s) for r in fleet.current_streaks(attempts, F.col("fine")).collect()}
    assert now == {"a": (2, 240), "b": (0, None), "c": (3, 480), "d": (0, None)}


REPLICA = ("replica string, current string, verified string, desired string, last_completed_at timestamp,"
           " next_scheduled_at timestamp, failures int, minimum_ttl_seconds bigint")
RESTORE = "replica string, restore string, snapshot string, phase string, seq int, created_at timestamp"


@pytest.mark.parametrize("replica, restore, reasons", [
    ((None, None, None, None, None, 0, None), None, ["never restored", "schedule due"]),
    ((None, None, None, None, "later", 0, None), None, ["never restored"]),
    ((None, None, None, None, "later", 2, None), None, []),
    ((None, None, None, None, "earlier", 2, None), None, ["never restored", "schedule due"]),
    ((None, "s1", None, None, "later", 0, None), None, []),
    (("x", None, None, "d1", "later", 0, None), None, ["current copy gone"]),
    (("x", None, "s2", "d1", "later", 0, None), ("s1", "Active"), ["newer snapshot desired"]),
    (("x", None, "s2", "d1", "later", 0, 86400 * 2), ("s1", "Active"), []),
    (("x", None, "s1", "d1", "later", 0, None), ("s1", "Active"), []),
    ((None, "s2", "s2", None, "later", 0, None), None, []),
    (("x", None, None, "d1", "earlier", 0, None), ("s1", "Active"), ["schedule due"]),
    (("x", None, None, "d1", "earlier", 0, 86400 * 2), ("s1", "Active"), []),
    (("x", None, None, "d1", None, 0, 86400 * 2), ("s1", "Active"), ["schedule due"]),
    ((None, None, None, None, None, 0, None), ("s1", "Migrating"), []),
    ((None, None, None, None, "later", 0, None), ("s1", "Failed"), ["never restored"]),
])
def test_refresh_due(spark, replica, restore, reasons):
    times = {"d1": ago(days=1), "later": NOW + dt.timedelta(hours=1), "earlier": ago(hours=1), None: None}
    current, verified, desired, completed, scheduled, failures, ttl = replica
    replicas = spark.createDataFrame(
        [("r", current, verified, desired, times[completed], times[scheduled], failures, ttl)], REPLICA)
    rows = [("r", "x", restore[0], restore[1], 1, NOW)] if restore else []
    row = fleet.refresh_due(replicas, spark.createDataFrame(rows, RESTORE), F.lit(NOW)).first()
    assert row.reasons == reasons and row.due == bool(reasons)


def test_removable(spark):
    schema = ("replica string, current string, last_completed_at timestamp, grace_seconds bigint, carries boolean,"
              " migration_phase string, redaction_phase string")
    done = ago(hours=1)
    replicas = spark.createDataFrame([
        ("ok", "c", done, 300, True, "timeout-skipped", "partial"), ("young", "c", ago(seconds=60), 300, False, None, None),
        ("moving", "c", done, 300, True, "active", None), ("unmoved", "c", done, 300, False, "active", None),
        ("masking", "c", done, 300, False, None, "active"), ("lost", "gone", done, 300, False, None, None),
        ("blank", None, done, 300, False, None, None),
    ], schema)
    rows = [(r, name, "s", phase, 1, at) for r in ("ok", "young", "moving", "unmoved", "masking", "lost", "blank")
            for name, phase, at in (("c", "Active", done), ("old", "Active", done), ("new", "Switching", done))]
    rows += [("ok", "f1", "s", "Failed", 1, ago(seconds=301)), ("ok", "f2", "s", "Failed", 1, ago(seconds=299)),
             ("ok", "f3", "s", "Failed", 1, None)]
    got = fleet.removable(replicas, spark.createDataFrame(rows, RESTORE), F.lit(NOW)).collect()
    assert {tuple(r) for r in got} == {("ok", "old", "superseded"), ("unmoved", "old", "superseded"), ("ok", "f1", "failed")}


def test_live_copies(spark):
    phases = {"a": ["Active", "Switching", None], "b": ["Active", "Failed", "Failed", "Ready"], "c": ["Failed"]}
    rows = [(r, f"{r}{i}", "s", p, i, NOW) for r, ps in phases.items() for i, p in enumerate(ps)]
    restores = spark.createDataFrame(rows, RESTORE)
    assert {r.replica: (r.live, r.blocked) for r in fleet.live_counts(restores).collect()} == {
        "a": (3, True), "b": (2, False), "c": (0, False)}
    assert {r.restore for r in fleet.blocking_copies(restores).collect()} == {"a0", "a1", "a2"}
    roles = {r.replica: (r.active, r.switching, r.in_progress) for r in fleet.roles(restores).collect()}
    assert roles == {"a": ("a0", "a1", None), "b": ("b0", None, "b3"), "c": (None, None, None)}


def test_spec_changes(spark):
    steps = [(1, False), (1, False), (2, False), (2, True), (2, False), (2, False), (3, True), (3, True), (3, False)]
    rows = [("k", ago(days=20 - i), i, g, d) for i, (g, d) in enumerate(steps)]
    events = spark.createDataFrame(rows, "replica string, at timestamp, seq int, generation bigint, deleted boolean")
    assert sorted(r.seq for r in fleet.spec_changes(events).collect()) == [0, 2, 4, 8]


def test_conditions_move_only_with_their_status(spark):
    steps = ["True", "True", "False", "False", "True"]
    rows = [("r", "T", ago(days=9 - i), i, s, f"why{i}") for i, s in enumerate(steps)]
    updates = spark.createDataFrame(rows, "replica string, type string, at timestamp, seq int, status string, reason string")
    got = fleet.condition_history(updates).orderBy("seq").collect()
    assert [r.last_transition_at for r in got] == [ago(days=d) for d in (9, 9, 7, 7, 5)]
    assert [r.reason for r in got] == [f"why{i}" for i in range(5)]


def test_watching_a_rebuild(spark):
    at = lambda minute: ago(hours=5) + dt.timedelta(minutes=minute)
    steps = [  # minute, ok, progress, expected (progress, changed at minute, verdict)
        (0, False, "x", None), (1, True, "a", ("a", 1, "Wait")), (2, True, "a", ("a", 1, "Wait")),
        (8, False, None, ("a", 1, "Wait")), (17, True, "a", ("a", 1, "Wait")), (26, True, "a", ("a", 1, "Wait")),
        (31, True, "a", ("a", 1, "Wait")), (32, False, "z", ("a", 1, "Stalled")), (33, True, "b", ("b", 33, "Wait")),
        (34, True, None, (None, 34, "NotReindexing")), (35, True, "b", ("b", 35, "Wait")),
        (45, True, "b", ("b", 35, "Wait")), (56, True, "b", ("b", 56, "Wait")), (67, False, "q", None), (68, True, "b", ("b", 68, "Wait")),
    ]
    rows = [("k", at(m), i, ok, p) for i, (m, ok, p, _) in enumerate(steps)]
    observed = spark.createDataFrame(rows, "restore string, at timestamp, seq int, ok boolean, progress string")
    want = {i: (e[0], at(e[1]), e[2]) for i, (_, _, _, e) in enumerate(steps) if e}
    for segments in (1, 4, 20):
        got = stalls.watch(observed, segments=segments).collect()
        assert {r.seq: (r.progress, r.changed_at, r.verdict) for r in got} == want


@pytest.mark.parametrize("elapsed, verdict, fails", [(100, "Stalled", None), (200, "Wait", None), (200, "Stalled", "no progress"),
                                                     (200, "NotReindexing", "budget 150s"), (200, None, "budget 150s")])
def test_past_budget(spark, elapsed, verdict, fails):
    got = spark.range(1).select(stalls.past_budget(F.lit(elapsed), F.lit(150), F.lit(verdict).cast("string"))).first()[0]
    assert (got is None) if fails is None else (fails in got)


@pytest.mark.parametrize("explicit, size, budget", [(None, 0, 1800), (None, 100 << 30, 2700), (None, None, 1800), (60, 100 << 30, 60)])
def test_readiness_budget(spark, explicit, size, budget):
    df = spark.createDataFrame([(explicit, size)], "e bigint, s bigint")
    assert df.select(ex.readiness_budget(F.col("e"), F.col("s"), 1800)).first()[0] == budget


@pytest.mark.parametrize("phase, reason", [("failed: no manifest", "no manifest"), ("failed:", ""), ("failed: a: b", "a: b"),
                                           ("complete", None), ("timeout-skipped", None), ("not failed: x", None)])
def test_failed_reasons(spark, phase, reason):
    assert spark.range(1).select(ex.failed_reason(F.lit(phase))).first()[0] == reason


def test_identity_tells_versions_apart_for_one_intent_only(spark):
    a, b, v1, v2 = ("00000000-0000-0000-0000-00000000000" + d for d in "1234")
    def name(intent, version):
        return spark.range(1).select(fleet.identity(F.lit("My Box"), F.lit(a), F.lit(b), F.lit(intent), F.lit(version).cast("string"))).first()[0]
    import hashlib, uuid
    digest = hashlib.sha256(uuid.UUID(a).bytes + uuid.UUID(b).bytes).hexdigest()[:8]
    assert name("verify", v1) == name("verify", v2) == name("reporting-schema", None) == f"my-box-{digest}"
    assert len({name("reporting-schema", v1), name("reporting-schema", v2), name("verify", v1)}) == 3


GOOD = "0f8fad5b-d9cb-469f-a165-70867728950e"


@pytest.mark.parametrize("own, parent, want, missing, recovered", [
    ((GOOD, GOOD, GOOD), (None, None, None), (GOOD, GOOD, GOOD), [], False),
    ((GOOD, None, GOOD), (None, GOOD, "junk"), (GOOD, GOOD, GOOD), [], True),
    ((None, None, None), (GOOD, GOOD, GOOD), (GOOD, GOOD, GOOD), [], True),
    (("bad", None, GOOD), (GOOD, GOOD, GOOD), ("bad", GOOD, GOOD), ["group"], False),
    ((None, None, None), (None, "bad", None), (None, "bad", None), ["group", "server", "declaration"], False),
])
def test_identity_recovery(spark, own, parent, want, missing, recovered):
    labels = "`group` string, server string, declaration string"
    replicas = spark.createDataFrame([("r", "p", *own)], f"replica string, parent string, {labels}")
    parents = spark.createDataFrame([("p", *parent)], f"parent string, {labels}")
    row = verify.recover_identity(replicas, parents).first()
    assert (row.group, row.server, row.declaration) == want
    assert row.missing == missing and row.recovered is recovered


def test_verdicts(spark):
    runs = spark.createDataFrame([("a", "success", None), ("b", "success", None), ("c", "failure", "lost"), ("d", "success", None)],
                                 "restore string, outcome string, error string")
    sizes = spark.createDataFrame([("a", "app", 1, 0), ("b", "postgres", 9, 0), ("c", "postgres", 9, 0)],
                                  "restore string, name string, bytes bigint, position int")
    got = {r.restore: (r.outcome, r.error) for r in verify.verdicts(runs, sizes).collect()}
    assert got == {"a": ("success", None), "b": ("failure", verify.NO_APPLICATION_DATABASE), "c": ("failure", "lost"), "d": ("success", None)}


BUILD = dict(settled=False, image="i", target_version="2", has_migration=True, failed_migration=None, group_own=GOOD,
             group_label=None, rank="demo", payload="x", registration_error=None, receipt=False, attempts=0)


@pytest.mark.parametrize("change, to_do, retry, built, error", [
    ({}, "build", False, True, None),
    ({"settled": True, "image": None}, "settled", False, None, None),
    ({"image": None, "target_version": None}, "no image", False, None, None),
    ({"target_version": None, "has_migration": False}, "no target", False, None, None),
    ({"failed_migration": "m"}, "unmigrated", False, None, None),
    ({"has_migration": False}, "unmigrated", False, None, None),
    ({"group_own": "junk"}, "no group", False, None, None),
    ({"group_own": None, "group_label": GOOD}, "build", False, True, None),
    ({"rank": ""}, "no rank", False, None, None),
    ({"rank": None}, "no rank", False, None, None),
    ({"registration_error": "refused"}, "build", False, False, "refused"),
    ({"payload": None}, "build", False, False, verify.NO_SCHEMA),
    ({"payload": None, "receipt": True, "attempts": 4}, "build", True, None, None),
    ({"payload": None, "receipt": True, "attempts": 5}, "build", False, False, verify.NO_SCHEMA),
])
def test_build_grading(spark, change, to_do, retry, built, error):
    schema = ("settled boolean, image string, target_version string, has_migration boolean, failed_migration string,"
              " group_own string, group_label string, rank string, payload string, registration_error string,"
              " receipt boolean, attempts int")
    row = verify.grade_builds(spark.createDataFrame([tuple({**BUILD, **change}.values())], schema)).first()
    assert (row.to_do, row.retry, row.built, row.build_error) == (to_do, retry, built, error)


def test_users(spark):
    df = spark.createDataFrame([("r", "main", " a ,b:x+y+x, a:z,main:q,,c: +, :x")], "replica string, main_user string, users string")
    users = access.clean_users(df.withColumn("users", access.parse_users(F.col("users"))))
    assert [(r.position, r.name, r.schemas) for r in users.orderBy("position").collect()] == [
        (0, "a", []), (1, "b", ["x", "y"]), (2, "c", [])]
    catalog = spark.createDataFrame([("r", "app", "x"), ("r", "template1", "x"), ("r", "template0", "x"), ("r", "app", "q")],
                                    "replica string, database string, schema string")
    grants = access.expand_grants(users, catalog).collect()
    assert len(grants) == 8 and {(g.database, g.user, g.schema) for g in grants} == {("app", "b", "x"), ("template1", "b", "x")}
