"""Streams end where their batch twins do, however the input was cut up."""

import datetime as dt
import json
import os
import time

import pytest
from pyspark.sql import functions as F

from freshet.operators import fleet, ordered, stalls
from freshet.session import fresh_path, shared_dir
from freshet.streaming import latest, progress
from freshet.streaming.base import read_files
from freshet.streaming.keyed import KeyedTable, keep_folded
from freshet.streaming.ordered import changes_state, run_changes, run_stalls, stalls_state

RUN = "0f8fad5bd9cb469fa16570867728950e"


@pytest.fixture(scope="module")
def events(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("at", F.col("ts").cast("timestamp"))


def cut(spark, df, parts, path=None):
    """Write a table in time order, one file per part, for one micro-batch each."""
    path = path or fresh_path(spark, "in")
    bounds = df.select(F.min("event_id"), F.max("event_id")).first()
    step = (bounds[1] - bounds[0]) // parts + 1
    for i in range(parts):
        low = bounds[0] + i * step
        part = df.where((F.col("event_id") >= low) & (F.col("event_id") < low + step)).drop("event_id")
        part.coalesce(1).write.mode("append").parquet(path)
        time.sleep(1.1)  # files are taken in the order of their whole-second age
    return path


def drain(spark, df, parts, build, path=None, sink=None, checkpoint=None):
    path = cut(spark, df, parts, path)
    stream = read_files(spark, path, df.drop("event_id").schema, files_per_trigger=1)
    sink, checkpoint = sink or fresh_path(spark, "out"), checkpoint or fresh_path(spark, "state")
    build(stream, sink, checkpoint).awaitTermination()
    return path, sink, checkpoint


def results(spark, sink):
    return spark.read.parquet(sink).drop("batch", "seen_at")


def same(a, b):
    return a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def change_rows(events):
    return events.select(
        "event_id", (F.col("user_id") % 5).alias("key"), "at", F.col("event_id").alias("seq"),
        (F.floor("value").cast("bigint") % 2).alias("generation"), (F.col("event_type") == "error").alias("deleted"))


def change_twin(rows):
    return fleet.spec_changes(rows, keys=["key"]).select("key", "at", "seq", "generation")


def watch_rows(events):
    step = F.concat(F.lit("step "), F.floor(F.col("event_id") / 40).cast("string"))
    return events.select(
        "event_id", (F.col("event_id") % 2).alias("key"), "at", F.col("event_id").alias("seq"),
        (F.col("event_type") != "error").alias("ok"), F.when(F.col("event_id") % 90 > 9, step).alias("progress"))


def watch_twin(rows):
    return stalls.watch(rows, keys=["key"]).select("key", "at", "seq", "progress", "changed_at", "verdict")


CASES = {
    "changes": (change_rows, change_twin, run_changes, changes_state),
    "stalls": (watch_rows, watch_twin, run_stalls, stalls_state),
}


@pytest.mark.parametrize("case", sorted(CASES))
def test_stateful_streams_match_their_twins(spark, events, case):
    rows_of, twin, build, _ = CASES[case]
    rows = rows_of(events)
    half = rows.agg(F.max("event_id")).first()[0] // 2
    first, second = rows.where(F.col("event_id") <= half), rows.where(F.col("event_id") > half)
    path, sink, checkpoint = drain(spark, first, 2, build)
    # Stopped and started again: state comes back from the checkpoint.
    drain(spark, second, 2, build, path, sink, checkpoint)
    assert same(results(spark, sink), twin(rows))


@pytest.mark.parametrize("case", sorted(CASES))
def test_streams_go_on_from_a_worked_off_backlog(spark, events, case):
    rows_of, twin, build, state_of = CASES[case]
    rows = rows_of(events)
    half = rows.agg(F.max("event_id")).first()[0] // 2
    backlog, live = rows.where(F.col("event_id") <= half), rows.where(F.col("event_id") > half)
    _, sink, _ = drain(spark, live, 2, lambda *s: build(*s, initial=state_of(backlog)))
    assert same(results(spark, sink).unionByName(twin(backlog)), twin(rows))


def run_rows(spark, build, rows, schema, batches):
    """Run a stream over rows given batch by batch; returns its results and its checkpoint."""
    path, sink, state = fresh_path(spark, "in"), fresh_path(spark, "out"), fresh_path(spark, "state")
    df = spark.createDataFrame(rows, schema)
    for batch in batches:
        df.limit(0).unionByName(spark.createDataFrame(batch, schema)).coalesce(1).write.mode("append").parquet(path)
        build(read_files(spark, path, df.schema), sink, state).awaitTermination()
    return sink, state


WATCHED = "key string, at timestamp, seq bigint, ok boolean, progress string"
NOON = dt.datetime(2024, 1, 1, 12)


def seen(minutes, seq, progress, ok=True, key="a"):
    return (key, NOON + dt.timedelta(minutes=minutes), seq, ok, progress)


def test_observations_a_day_late_count_when_they_arrive(spark):
    batches = [[seen(0, 1, "x"), seen(5, 2, "x")], [seen(-1440, 3, "y")], [seen(9, 4, "y")]]
    sink, _ = run_rows(spark, run_stalls, batches[0], WATCHED, batches)
    got = {r.seq: r for r in spark.read.parquet(sink).collect()}
    assert sorted(got) == [1, 2, 3, 4]
    at_five = NOON + dt.timedelta(minutes=5)
    assert got[3].at == NOON - dt.timedelta(days=1) and got[3].seen_at == at_five
    assert [got[i].changed_at for i in (2, 3, 4)] == [NOON, at_five, at_five]


def test_changes_a_day_late_count_when_they_arrive(spark):
    schema = "key string, at timestamp, seq bigint, generation bigint, deleted boolean"
    rows = [("a", NOON, 1, 1, False), ("a", NOON - dt.timedelta(days=1), 2, 2, False), ("a", NOON, 3, 2, False)]
    sink, _ = run_rows(spark, run_changes, rows, schema, [[r] for r in rows])
    assert sorted(r.seq for r in spark.read.parquet(sink).collect()) == [1, 2]


def test_a_stall_is_seen_across_batches(spark):
    batches = [[seen(9 * i, i, "x")] for i in range(5)] + [[seen(80, 9, "x"), seen(81, 10, None)]]
    sink, state = run_rows(spark, run_stalls, batches[0], WATCHED, batches)
    got = {r.seq: r.verdict for r in spark.read.parquet(sink).collect()}
    assert got == {0: "Wait", 1: "Wait", 2: "Wait", 3: "Wait", 4: "Stalled", 9: "Wait", 10: "NotReindexing"}


def lose(path):
    """Delete a file and its checksum beside it."""
    folder, name = os.path.split(path)
    for place in (path, f"{folder}/.{name}.crc"):
        if os.path.exists(place):
            os.remove(place)


def test_a_batch_run_again_changes_nothing(spark, events):
    rows = watch_rows(events)
    path, sink, state = drain(spark, rows, 2, run_stalls)
    before = results(spark, sink).collect()
    # Its results written and its version kept, but the stream's own commit lost.
    last = max(int(n) for n in os.listdir(f"{state}/commits") if n.isdigit())
    lose(f"{state}/commits/{last}")
    run_stalls(read_files(spark, path, rows.drop("event_id").schema, files_per_trigger=1), sink, state).awaitTermination()
    assert sorted(results(spark, sink).collect()) == sorted(before)
    # Nor where the attempt broke off before its version was in place.
    lose(f"{state}/commits/{last}")
    lose(f"{state}/carried/index/{last + 1:012d}.json")
    run_stalls(read_files(spark, path, rows.drop("event_id").schema, files_per_trigger=1), sink, state).awaitTermination()
    assert sorted(results(spark, sink).collect()) == sorted(before) and same(results(spark, sink), watch_twin(rows))


def test_one_key_with_all_rows_is_spread_over_tasks(spark, events):
    rows = watch_rows(events).withColumn("key", F.lit("a"))
    taken = {}

    def spy(df, keys, order, segments=None):
        dealt = ordered_cut(df, keys, order, segments)
        taken.update({r[ordered.SEGMENT]: r["count"] for r in dealt.groupBy(ordered.SEGMENT).count().collect()})
        return dealt

    ordered_cut, stalls.cut = stalls.cut, spy
    try:
        drain(spark, rows, 1, run_stalls)
    finally:
        stalls.cut = ordered_cut
    assert len(taken) == 8 and max(taken.values()) < 2 * sum(taken.values()) / 8


def test_no_work_of_past_batches_stays(spark, events):
    before = set(os.listdir(shared_dir(spark)))
    path, sink, state = drain(spark, watch_rows(events), 2, run_stalls)
    left = set(os.listdir(shared_dir(spark))) - before
    assert {os.path.basename(p) for p in (path, sink, state)} == left


PAIRS = "key bigint, v bigint"


def greatest(df):
    return df.groupBy("key").agg(F.max("v").alias("v"))


def on_disk(spark, path):
    return sum(spark.read.parquet(f"{path}/runs/{n}").count() for n in os.listdir(f"{path}/runs"))


def test_a_keyed_table_stays_near_its_live_keys(spark):
    path = fresh_path(spark, "keyed")
    kept = KeyedTable(spark, path, greatest)
    for number in range(15):
        kept.keep(number, spark.range(30).select((F.col("id") * 7 % 20 + number % 3).alias("key"), (F.col("id") + number).alias("v")))
        index = kept._index(number)
        rows = [n for _, n in index["runs"]]
        assert all(2 * sum(rows[i + 1:]) < rows[i] for i in range(len(rows) - 1)) and sum(rows) < 1.5 * 22 + 1
        assert len(kept.versions()) <= 3 and on_disk(spark, path) <= 3 * 33
    assert kept.read().count() == 22
    assert {r.key: r.v for r in kept.read().collect()}[0] == 20 + 12


def test_readers_find_whole_versions_and_a_batch_counts_once(spark):
    path = fresh_path(spark, "keyed")
    kept = KeyedTable(spark, path, greatest)
    with pytest.raises(LookupError):
        kept.read()
    batch = spark.createDataFrame([(1, 5), (2, 6)], PAIRS)
    assert kept.keep(0, batch)
    held = kept.read()
    batch.write.parquet(f"{path}/runs/half-a-merge")  # an attempt that broke off
    assert held.count() == 2 and not kept.keep(0, spark.createDataFrame([(1, 50)], PAIRS))
    assert kept.keep(1, spark.createDataFrame([(1, 7), (3, 1)], PAIRS))
    assert sorted(held.collect()) == [(1, 5), (2, 6)]  # a reader that had begun
    assert sorted(kept.read().collect()) == [(1, 7), (2, 6), (3, 1)]
    assert "half-a-merge" not in os.listdir(f"{path}/runs")
    with pytest.raises(ValueError, match="batches are numbered otherwise"):
        KeyedTable(spark, path, greatest, owner="another").keep(2, batch)


def test_cancelled_rows_leave_a_keyed_table(spark):
    def newest(df):
        return df.groupBy("key").agg(F.max_by(F.struct("live", "n"), F.col("n")).alias("s")).select("key", "s.*")

    kept = KeyedTable(spark, fresh_path(spark, "keyed"), newest, F.col("live"))
    schema = "key bigint, live boolean, n bigint"
    kept.keep(0, spark.createDataFrame([(k, True, 0) for k in range(9)], schema))
    kept.keep(1, spark.createDataFrame([(4, False, 1)], schema))
    assert kept.read().count() == 8 and kept.read(spark.createDataFrame([(4,), (5,)], "key bigint"), ["key"]).count() == 1
    kept.keep(2, spark.createDataFrame([(k, False, 2) for k in range(7)], schema))
    assert sorted(r.key for r in kept.read().collect()) == [7, 8] and [n for _, n in kept._index(2)["runs"]] == [2]


def sample(seen, **change):
    body = {"run_id": RUN, "type": "restore", **{c: seen * (i + 1) for i, c in enumerate(progress.COUNTERS)}}
    return json.dumps({**body, **change})


@pytest.mark.parametrize("body, kept", [
    (sample(5), True), (sample(5, extra=1), True), (sample(5, run_id="nope"), False), (sample(5, run_id=7), False),
    (sample(5, type=None), False), (sample(5, sent_raw_bytes=-1), False), (sample(5, sent_raw_bytes=1.5), False),
    (sample(5, sent_raw_bytes="5"), False), (sample(5, sent_raw_bytes=None), False), ("{}", False), ("", False),
    ("[1]", False), ("{oops", False), (sample(5, sent_raw_bytes=2**64), False), (sample(5, sent_raw_bytes=2**64 - 1), True),
])
def test_only_whole_samples_count(spark, body, kept):
    got = progress.parse_samples(spark.createDataFrame([(body,)], "body string")).collect()
    assert len(got) == kept
    if kept:
        assert got[0].sent_raw_bytes in (5, 2**63 - 1)


def test_totals_survive_lost_repeated_and_late_samples(spark, events):
    bodies = [sample(n) for n in (1, 9, 4, 9, 2)]
    start = events.agg(F.min("at")).first()[0]
    rows = spark.createDataFrame([(i, start, b) for i, b in enumerate(bodies)], "event_id bigint, at timestamp, body string")
    path = cut(spark, rows, 3)
    samples = progress.parse_samples(read_files(spark, path, rows.drop("event_id").schema, files_per_trigger=1))
    sink, state = fresh_path(spark, "out"), fresh_path(spark, "state")
    keep_folded(samples, sink, progress.totals, state).awaitTermination()
    total = KeyedTable(spark, sink, progress.totals).read().collect()
    assert [(r.sent_raw_bytes, r.received_payload_bytes) for r in total] == [(9, 36)]


def test_a_sample_a_day_late_still_counts(spark, events):
    start = events.agg(F.min("at")).first()[0]
    rows = spark.createDataFrame(
        [(0, start, sample(1)), (1, start + dt.timedelta(days=2), sample(2)), (2, start + dt.timedelta(days=1), sample(7))],
        "event_id bigint, at timestamp, body string")
    samples = progress.parse_samples(read_files(spark, cut(spark, rows, 3), rows.drop("event_id").schema, files_per_trigger=1))
    sink = fresh_path(spark, "out")
    keep_folded(samples, sink, progress.totals, fresh_path(spark, "state")).awaitTermination()
    assert [r.sent_raw_bytes for r in KeyedTable(spark, sink, progress.totals).read().collect()] == [7]


def test_keys_of_any_type(spark, events):
    rows = change_rows(events).withColumns({"site": F.concat(F.lit("s"), F.col("key") % 2), "day": F.to_date("at")})
    named = rows.drop("key")
    twin = fleet.spec_changes(named, keys=["site", "day"]).select("site", "day", "at", "seq", "generation")
    _, sink, _ = drain(spark, named, 2, lambda *s: run_changes(*s, keys=["site", "day"]))
    assert same(results(spark, sink), twin)


def test_latest_payload_wins_and_ages_out(spark, events):
    rows = events.select(
        "event_id", (F.col("user_id") % 7).alias("key"), "at", F.col("event_id").alias("seq"), F.col("props").alias("payload"))
    end = rows.agg(F.max("at")).first()[0]
    path = cut(spark, rows, 3)
    stream = read_files(spark, path, rows.drop("event_id").schema, files_per_trigger=1)
    sink, state = fresh_path(spark, "out"), fresh_path(spark, "state")
    keep_folded(stream, sink, latest.newest, state).awaitTermination()
    kept = KeyedTable(spark, sink, latest.newest).read()
    for seconds in (3600, 1_000_000):
        twin = latest.held(rows, F.lit(end), seconds)
        assert same(latest.held(kept, F.lit(end), seconds), twin)
    assert latest.held(rows, F.lit(end), 0).count() == 0
