"""Migration results, error lines and job logs."""

import datetime as dt
import hashlib
import json

import pytest
from pyspark.sql import functions as F

from freshet.operators import logs, migrations

RUN = "restore string, started_at timestamp, job_failed boolean, bytes_after bigint, log_tail string"
BATCH = ("restore string, batch bigint, logged_at timestamp, direction string, migrations array<string>,"
         " batch_duration_ms bigint, stats string")
DAY = [dt.datetime(2026, 1, d) for d in range(1, 10)]


def result(spark, stats, names=("1-a", "2-b"), duration=None, failed=False, after=2000, tail=None):
    runs = spark.createDataFrame([("r", DAY[0], failed, after, tail)], RUN)
    text = None if stats is None else json.dumps(stats)
    batches = spark.createDataFrame([("r", 1, DAY[1], "up", list(names), duration, text)], BATCH)
    return migrations.migration_results(runs, batches).first()


DURATIONS = {"durationMsPerMigration": {"1-a": 400_000, "2-b": 12_500}}


def test_timings_are_cut_off_one_by_one(spark):
    whole = result(spark, DURATIONS, duration=415_000)
    assert [(t.name, t.elapsed_seconds) for t in whole.timings] == [("1-a", 400), ("2-b", 12)]
    assert whole.elapsed_seconds == 415
    assert result(spark, DURATIONS).elapsed_seconds == 412
    swapped = result(spark, DURATIONS, names=("2-b", "1-a", "3-c"))
    assert [(t.name, t.elapsed_seconds) for t in swapped.timings] == [("2-b", 12), ("1-a", 400), ("3-c", 0)]
    odd = result(spark, {"durationMsPerMigration": {"1-a": "9000", "2-b": 9000.5}})
    assert odd.elapsed_seconds == 0
    assert result(spark, None).elapsed_seconds == 0


ODD_STATS = [
    ('{"durationMsPerMigration": {"1-a": 9000, "1-a": 3000}}', [9, 0]), ("{'durationMsPerMigration': {'2-b': 2000}}", [0, 2]),
    ('{"durationMsPerMigration": {"1-a": 7000}} more', [7, 0]), ('{"durationMsPerMigration": [1]}', [0, 0]), ("[]", [0, 0]), ("{", [0, 0]),
]


def test_names_of_migrations_do_not_fill_the_shared_table_of_field_names(spark):
    """Statistics are read as variants; what a variant refuses is read as before."""
    rows = [("r", i, DAY[1], "up", ["1-a", "2-b"], None, text) for i, (text, _) in enumerate(ODD_STATS)]
    timed = migrations.migration_timings(spark.createDataFrame(rows, BATCH))
    assert "parseJson" in timed._jdf.queryExecution().executedPlan().toString()
    found = {(r.batch, r.position): r.elapsed_seconds for r in timed.collect()}
    assert [[found[i, 0], found[i, 1]] for i in range(len(rows))] == [seconds for _, seconds in ODD_STATS]


def test_errors_are_read_from_variants(spark):
    texts = ['{"error": {"code": "1", "message": 5, "hint": "h"}}', '{"error": {"code": "1", "code": "2"}}', '{"error": 5}', "{'error': {'name': 'n'}}"]
    rows = [("r", i, DAY[1], "up", [], None, text) for i, text in enumerate(texts)]
    lines = migrations.error_lines(spark.createDataFrame(rows, BATCH))
    assert "parseJson" in lines._jdf.queryExecution().executedPlan().toString()
    assert [r.error for r in sorted(lines.collect(), key=lambda r: r.batch)] == ["1 HINT: h", "1", None, "n"]


@pytest.mark.parametrize("size, before", [
    (1500, 1500), ("1500", 1500), (-1, 2000), ("-1", 2000), ("lots", 2000), (None, 2000), (0, 0), ("", 2000), ({}, 2000)])
def test_sizes(spark, size, before):
    assert result(spark, {"preSnapshot": {"databaseSizeBytes": size}}).bytes_before == before


def test_failures_are_named(spark):
    assert result(spark, {"failedMigration": "2-b"}, failed=True).failed_migration == "2-b"
    assert result(spark, {"failedMigration": 7}, failed=True).failed_migration == "unknown"
    assert result(spark, {"failedMigration": "2-b"}).failed_migration is None


def test_runs_without_a_batch_keep_a_row(spark):
    runs = spark.createDataFrame([("a", DAY[0], True, 5, "tail"), ("b", DAY[0], False, 6, None)], RUN)
    got = {r.restore: r for r in migrations.migration_results(runs, spark.createDataFrame([], BATCH)).collect()}
    assert (got["a"].elapsed_seconds, got["a"].failed_migration, got["a"].error) == (0, "unknown", "tail")
    assert (got["a"].bytes_before, got["a"].bytes_after, got["a"].timings) == (5, 5, [])
    assert got["b"].failed_migration is None and got["b"].error is None


def test_only_a_newer_up_batch_counts(spark):
    runs = spark.createDataFrame([(r, DAY[3], False, 1, None) for r in "abc"], RUN)
    rows = [("a", 1, DAY[1], "up"), ("a", 2, DAY[2], "up"), ("a", 3, DAY[4], "up"), ("a", 4, DAY[5], "down"),
            ("a", 5, DAY[4], "up"), ("b", 6, DAY[2], "up"), ("c", 7, DAY[6], "up")]
    batches = spark.createDataFrame([r + ([], None, None) for r in rows], BATCH)
    base = migrations.baselines(batches, runs)
    assert {r.restore: r.baseline for r in base.collect()} == {"a": DAY[2], "b": DAY[2], "c": None}
    newest = {r.restore: r.batch for r in migrations.newest_batches(batches, base).collect()}
    assert newest == {"a": 5, "c": 7}
    assert {r.restore: r.batch for r in migrations.run_batches(batches, runs).collect()} == newest


def test_runs_tell_their_batches_without_baselines(spark):
    """All orders of three batches and a run's start, ties and a missing start included."""
    days, rows, runs = range(3), [], []
    for one in days:
        for two in days:
            for three in days:
                for start in [*days, None]:
                    for ups in range(8):
                        name = f"{one}{two}{three}{start}{ups}"
                        runs.append((name, None if start is None else DAY[start], False, 1, None))
                        rows += [(name, n, DAY[day], "up" if ups >> n & 1 else "down", [], None, None)
                                 for n, day in enumerate((one, two, three))]
    batches, runs = spark.createDataFrame(rows, BATCH), spark.createDataFrame(runs, RUN)
    plain = migrations.newest_batches(batches, migrations.baselines(batches, runs))
    assert sorted(map(tuple, migrations.run_batches(batches, runs).select("restore", "batch").collect())) == sorted(
        map(tuple, plain.select("restore", "batch").collect()))


@pytest.mark.parametrize("error, line", [
    ({"code": "23503", "message": "violates", "detail": 'Key (id)=(1) is not in "p".', "table": "bookings",
      "column": "room_id", "constraint": "fk"},
     '23503: violates [bookings.room_id, fk] DETAIL: Key (id)=(1) is not in "p".'),
    ({"name": "LookupFailed", "message": "no relation"}, "LookupFailed: no relation"),
    ({"code": " ", "name": "N"}, "N"),
    ({"message": " m ", "hint": "try"}, "m HINT: try"),
    ({"column": "c"}, "[c]"),
    ({"constraint": "k", "detail": "d"}, "[k] DETAIL: d"),
    ({"message": 5}, None), ({}, None), ("text", None), (None, None),
])
def test_error_lines(spark, error, line):
    assert result(spark, {"error": error}, failed=True).error == line
    assert result(spark, {"error": error}, failed=True, tail="log").error == (line or "log")


def tail(spark, *texts):
    df = spark.createDataFrame(list(enumerate(texts)), "job bigint, log string")
    whole = {r.job: r.log_tail for r in logs.log_tail(df).collect()}
    lines = df.select("job", F.posexplode(logs.log_lines(F.col("log"))).alias("line_no", "line"))
    by_line = {r.job: r.log_tail for r in logs.log_tail_lines(lines).collect()}
    for job, text in by_line.items():
        assert text == whole[job]
    return [whole[i] for i in range(len(texts))]


def test_log_tails(spark):
    short = "step two\nerror: violates \"fk\"\nDETAIL:  Key\n"
    many = "\n".join(f"applying {i}" for i in range(100))
    wide = "\n".join(f"applying {i} {'x' * 200}" for i in range(60))
    headed = "info: go\n  error: DatabaseError [X]: index does not exist\n" + "\n".join(f"sql {i} {'x' * 80}" for i in range(60))
    model = "Database Error in model m (a.sql)\n" + "\n".join(f"line {i} {'y' * 80}" for i in range(200))
    in_tail = "step one\nError: burst\nat y\n"
    umlauts = "\n".join("ü" * 150 for _ in range(30))
    long_head = "Error: " + "é" * 600 + "\n" + "\n".join("z" * 60 for _ in range(60))
    crlf = "one\r\ntwo\r\n"
    middle = "fine\nthis Error: is in the middle\n" + "\n".join(f"l{i}" for i in range(50))
    nothing = "NoError: here\nxDatabaseError\n" + "\n".join(f"l{i}" for i in range(50))
    got = tail(spark, short, many, wide, headed, model, in_tail, "", umlauts, long_head, crlf, middle, nothing)
    assert got[0] == short.rstrip("\n")
    assert got[1].startswith("applying 60") and got[1].endswith("applying 99") and len(got[1].splitlines()) == 40
    assert len(got[2].encode()) == 2000 and got[2].endswith("xxx")
    assert got[3].startswith("error: DatabaseError [X]: index does not exist\n…\n") and "sql 59" in got[3]
    assert len(got[3].encode()) <= 2000
    assert got[4].startswith("Database Error in model m (a.sql)\n…\n")
    assert got[5] == "step one\nError: burst\nat y"
    assert got[6] == ""
    assert len(got[7].encode()) <= 2000 and set(got[7]) == {"ü", "\n"}
    head = got[8].split("\n…\n")[0]
    assert head.startswith("Error: éé") and 498 <= len(head.encode()) <= 500
    assert got[9] == "one\ntwo"
    assert got[10].startswith("this Error: is in the middle\n…\nl10")
    assert got[11].startswith("l10")


def redacted(spark, text, secrets):
    return spark.createDataFrame([(text,)], "t string").select(logs.redact(F.col("t"), secrets)).first()[0]


def test_secrets_are_masked_in_every_form(spark):
    log = "go postgresql://user:k@y.1@host\nretry user:k%40y.1@host\nthen k%40y%2E1\nDETAIL: kept"
    out = redacted(spark, log, ["k@y.1", ""])
    assert "k@y" not in out and "k%40" not in out and out.count("[redacted]") == 3 and "DETAIL: kept" in out
    assert redacted(spark, log, None) is None
    assert redacted(spark, "\x1b[31mred\x1b[0m\t\x1b]0;title\x07ok\n", []) == "redok\n"
    long = "é" * 40_000 + "k@y.1" + "x" * 65_534
    assert redacted(spark, long, ["k@y.1"]) == "é" * 40_000 + "[redacted]" + "x" * 65_534  # no part is left at any cut
    end = spark.createDataFrame([(long,)], "t string").select(logs.redact(F.col("t"), ["k@y.1"], last_bytes=65_536)).first()[0]
    assert end == "d]" + "x" * 65_534


def one_by_one(text, secrets):
    """Secrets replaced one after the other, the longest first."""
    forms = {form for secret in secrets if secret for form in logs.encoded_forms(secret)}
    for form in sorted(forms, key=lambda form: (-len(form), form)):
        text = text.replace(form, logs.REDACTED)
    return text


@pytest.mark.parametrize("secrets", [
    ["ab", "abc", "abcd", "ba"], ["a.c", "a|c", "(a)", "a\\Q"], ["é", "éé", "\U0001F511"], ["x y", "x+y", "x\ny", "$1"], ["A", "%41"], []])
def test_secrets_in_one_pass(spark, secrets):
    text = "abcd abc ab ba | a.c abc a|c (a) a\\Q | ééé \U0001F511 | x y x+y x%20y x%2By x\ny $1 | A %41 B"
    assert redacted(spark, text, secrets) == one_by_one(text, secrets)


def test_the_secret_further_left_is_blotted(spark):
    assert redacted(spark, "xabcdx", ["ab", "bcd"]) == "x[redacted]cdx"


def test_ten_thousand_secrets(spark):
    secrets = [hashlib.sha256(str(i).encode()).hexdigest()[:20] + "/" + str(i) for i in range(10_000)]
    text = " ".join(s for i, s in enumerate(secrets) if i % 100 == 0) + " kept " + secrets[7][:-2]
    expected = " ".join([logs.REDACTED] * 100) + " kept " + secrets[7][:-2]
    df = spark.range(50).select(F.lit(text).alias("t"))
    out = df.select(logs.redact(F.col("t"), secrets).alias("t")).distinct().collect()
    assert [r.t for r in out] == [expected]
