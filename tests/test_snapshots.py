"""Listings, filters and the choice of a snapshot."""

import fnmatch
import random

import pytest
from pyspark.sql import functions as F

from freshet.functions.expressions import quantity_bytes, slug, unix_path
from freshet.functions.globs import glob_match, glob_start
from freshet.operators.snapshots import (
    SnapshotFilter, application_database, count_matches, file_filters, filter_classes, filter_table, latest_snapshot,
    match_filter_table, match_filters,
    named_snapshot, not_covered, storage_plan,
)
from freshet.sources.listing import FOLDERS, parse_listings, read_listings, write_listings


@pytest.mark.parametrize("pattern, value, matches", [
    ("suva-prod-*", "suva-prod-01", True), ("suva-prod-*", "suva-prod-", True), ("suva-prod-*", "suva-dev-01", False),
    ("no?a", "nora", True), ("no?a", "noa", False), ("no?a", "norra", False),
    ("whole", "whole", True), ("whole", "wholes", False), ("whole", "a-whole", False),
    ("*.corp.test", "db.corp.test", True), ("*.corp.test", "dbxcorp.test", False),
    ("c+d", "c+d", True), ("c+d", "ccd", False), ("/D/*", "/D/a/b", True), ("*", "", True), ("?", "/", True),
    ("[abc]x", "bx", True), ("[!abc]x", "bx", False), ("[!abc]x", "dx", True), ("[a-c]x", "cx", True),
    ("[]x]y", "]y", True), ("{a,b}*", "bzz", True), ("{a,b}*", "czz", False), ("\\*", "*", True), ("\\*", "x", False),
    ("[oops", "[oops", False), ("{oops", "{oops", False), ("oops}", "oops}", False), ("[z-a]", "b", False),
    ("a,b", "a,b", True), ("A*", "abc", False), ("a*", "a\nb", True), ("a", "a\n", False), ("$^", "$^", True),
])
def test_globs(spark, pattern, value, matches):
    assert spark.range(1).select(glob_match(F.lit(value), pattern)).first()[0] is matches


@pytest.mark.parametrize("pattern, start", [
    ("ab*", "ab"), ("a?b", "a"), ("*a", ""), ("", ""), ("\\*x[ab]", "*x"), ("a,b{c,d}", "a,b"), ("whole", "whole"), ("a[", "a"), ("a\\", "a")])
def test_what_a_glob_begins_with(pattern, start):
    assert glob_start(pattern) == start


@pytest.mark.parametrize("path, unix", [
    ("E:\\Nightly", "/E/Nightly"), ("c:\\a\\b\\c d", "/c/a/b/c d"), ("E:/Nightly", "/E/Nightly"),
    ("/srv/pg", "/srv/pg"), ("pg/main", "pg/main"), ("é:\\x", "é:/x"), ("", ""),
])
def test_unix_paths(spark, path, unix):
    assert spark.range(1).select(unix_path(F.lit(path))).first()[0] == unix


@pytest.mark.parametrize("text, expected", [
    ("Suva Prod", "suva-prod"), ("--a--", "a"), ("", "replica"), ("!!!", "replica"), ("É", "replica"),
    ("a" * 60, "a" * 50), ("a" * 49 + " b", "a" * 49),
])
def test_slugs(spark, text, expected):
    assert spark.range(1).select(slug(F.lit(text))).first()[0] == expected


def parsed(spark, *raws):
    return parse_listings(spark.createDataFrame([(f"r{i}", raw) for i, raw in enumerate(raws)], "repository string, raw string"))


def test_listings(spark, tmp_path):
    got = parsed(
        spark,
        'Connected.\n[{"id":"a","startTime":"t","tags":{"tag:x":"1"},"source":{"host":"h","path":"E:\\\\Nightly"},"stats":{"totalSize":5}},{"id":"b"}]\nbye',
        "no json here", "", "a ] before [", "[]",
    ).orderBy("position").collect()
    assert [(r.repository, r.id, r.host, r.start_time, r.total_size) for r in got] == [
        ("r0", "a", "h", "t", 5), ("r0", "b", "", "", 0)]
    for bad in ("[{oops}]", '[{"description":"no id"}]'):
        with pytest.raises(Exception):
            parsed(spark, bad).collect()
    (tmp_path / "one.txt").write_text('log\n[{"id":"k"}]')
    assert read_listings(spark, str(tmp_path)).first().id == "k"


def test_listings_are_files_in_a_fixed_number_of_folders(spark, tmp_path):
    count = 4 * FOLDERS
    texts = spark.range(count, numPartitions=3).selectExpr("concat('log\n[{\"id\":\"k', id, '\"}]') AS raw")
    write_listings(texts, f"{tmp_path}/listed")
    assert len(list((tmp_path / "listed").rglob("*.txt"))) == count
    assert len([p for p in (tmp_path / "listed").iterdir() if p.is_dir()]) <= FOLDERS
    found = read_listings(spark, f"{tmp_path}/listed")
    assert {r.id for r in found.collect()} == {f"k{i}" for i in range(count)}
    assert found.select("repository").distinct().count() == count
    write_listings(texts.limit(0), f"{tmp_path}/none")
    assert read_listings(spark, f"{tmp_path}/none").count() == 0


def test_equal_filters_are_met_once(spark):
    """A count of matches makes no row per pair: equal filters are one class."""
    listing = spark.range(300).selectExpr(
        "'r' AS repository", "concat('s', id) AS id", "concat('h', id % 3) AS host", "'' AS description", "'/' AS path",
        "map('env', 'prod', 'n', CAST(id % 2 AS string)) AS tags")
    specs = spark.range(400).selectExpr(
        "concat('f', id) AS replica", "'r' AS repository", "IF(id % 4 = 0, map('n', '1', 'env', 'prod'), IF(id % 4 = 1, map('env', 'prod', 'n', '1'), NULL)) AS required",
        "IF(id % 5 = 0, 'h1', NULL) AS host_re", "CAST(NULL AS string) AS description_re", "CAST(NULL AS string) AS path_re")
    assert filter_classes(specs).count() == 4
    pairs = match_filter_table(listing, specs).groupBy("repository", "id").agg(
        F.count("*").alias("replicas"), F.min("replica").alias("first_replica"))
    assert sorted(count_matches(listing, specs).collect()) == sorted(pairs.collect())


@pytest.fixture(scope="module")
def snapshots(spark):
    rows = [
        ("r1", 0, "s0", "daily", "suva-prod-1", "E:\\Nightly", {"tag:env": "prod"}, "2024-01-01T00:00:00Z", 10),
        ("r1", 1, "s1", "daily", "suva-prod-2", "/data", {"env": "prod", "x": "1"}, "2024-01-03T00:00:00Z", 20),
        ("r1", 2, "s2", "adhoc", "suva-dev-1", "/data", {"env": "dev"}, "2024-01-03T00:00:00Z", 30),
        ("r2", 0, "s3", "daily", "nauru", "/data", {}, "2024-01-03T01:00:00+02:00", 40),
    ]
    return spark.createDataFrame(
        rows, "repository string, position int, id string, description string, host string, path string,"
        " tags map<string,string>, start_time string, total_size bigint")


FILTERS = [
    SnapshotFilter("all", "r1"), SnapshotFilter("prod", "r1", tags={"env": "prod"}), SnapshotFilter("win", "r1", path="/E/*"),
    SnapshotFilter("suva", "r1", host="suva-*", description="daily"), SnapshotFilter("r2", "r2"),
    SnapshotFilter("none", "r1", tags={"env": "prod", "y": "2"}), SnapshotFilter("bad", "r1", host="[x"),
]


def hits(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.replica, set()).add(r.id)
    return out


def test_filters(spark, snapshots):
    assert hits(match_filters(snapshots, FILTERS)) == {
        "all": {"s0", "s1", "s2"}, "prod": {"s0", "s1"}, "win": {"s0"}, "suva": {"s0", "s1"}, "r2": {"s3"}}


@pytest.mark.parametrize("count", [1, 200, 201])
def test_any_number_of_filters_gives_the_same_rows(spark, count):
    rows = [("r1", "a.example"), ("r1", "a.example\n"), ("r2", "a.example")]
    listing = spark.createDataFrame(rows, "repository string, host string").selectExpr(
        "*", "'' AS description", "'/' AS path", "map('k', 'v') AS tags")
    matched = match_filters(listing, [SnapshotFilter(f"m{i}", "r1", host="*.exampl[e]") for i in range(count)])
    assert [r.host for r in matched.collect()] == ["a.example"] * count


def plain_matches(snapshots, filters):
    """Every filter against every snapshot, one by one."""
    def globbed(pattern, value):
        return pattern is None or fnmatch.fnmatchcase(value, pattern)

    return sorted(
        (f.replica, s["id"]) for f in filters for s in snapshots
        if f.repository == s["repository"] and globbed(f.host, s["host"]) and globbed(f.description, s["description"])
        and globbed(f.path, s["path"])
        and all(s["tags"].get(k) == v or s["tags"].get("tag:" + k) == v for k, v in (f.tags or {}).items()))


def test_filed_filters_meet_all_they_match(spark):
    draw = random.Random(5)

    def text(letters, most):
        return "".join(draw.choice(letters) for _ in range(draw.randrange(most + 1)))

    def tags():
        return {draw.choice(["env", "tag:env", "tag:tag:env", "x"]): draw.choice(["1", "2"]) for _ in range(draw.randrange(3))}

    snapshots = [{"repository": draw.choice("rs"), "id": str(i), "host": text("ab", 6), "description": text("ab", 3),
                  "path": "/" + text("ab/", 4), "tags": tags()} for i in range(150)]
    filters = [SnapshotFilter(f"f{i}", draw.choice("rst"), tags=draw.choice([None, tags()]),
                              **{kind: draw.choice([None, None, text("ab*?", 6)]) for kind in ("host", "description")},
                              path=draw.choice([None, "/" + text("ab*", 3)])) for i in range(400)]
    filters += filters[:3]  # repeated filters stay repeated
    df = spark.createDataFrame(
        [tuple(s.values()) for s in snapshots],
        "repository string, id string, host string, description string, path string, tags map<string,string>")
    got = match_filters(df, filters)
    assert got.columns == ["replica", *df.columns]
    rows = sorted((r.replica, r.id) for r in got.collect())
    assert rows == plain_matches(snapshots, filters) and len(rows) > 1000

    # The same filters in a table, with and without the texts that globs begin with.
    filed = filter_table(spark, filters)
    starts = spark.createDataFrame(
        [(f.replica, *(None if g is None else glob_start(g) for g in (f.host, f.description, f.path))) for f in filters],
        "replica string, host_start string, description_start string, path_start string").distinct()
    table = filed.drop("_kind", "_size", "_token")
    for specs in (table, table.join(starts, "replica")):
        assert sorted((r.replica, r.id) for r in match_filter_table(df, specs).collect()) == rows
    again = file_filters(table.join(starts, "replica")).select("replica", "_kind", "_size", "_token")
    assert sorted(again.collect()) == sorted(filed.select(*again.columns).collect())


def test_many_filters_of_one_repository_are_not_paired_with_all_snapshots(spark):
    """Ten thousand filters, all of one tag: each snapshot meets those of its host's beginning alone."""
    filters = [SnapshotFilter(f"f{i}", "r", tags={"env": "prod"}, host=f"{i:05d}-*") for i in range(10_000)]
    df = spark.range(20_000).selectExpr(
        "'r' AS repository", "id", "lpad(id % 10000, 5, '0') || '-x' AS host", "'' AS description", "'/' AS path",
        "map('env', 'prod') AS tags")
    matched = match_filters(df, filters)
    filed = filter_table(spark, filters)
    assert {r["_kind"] for r in filed.select("_kind").distinct().collect()} == {"host"}
    most = filed.groupBy("_token").count().agg(F.max("count")).first()[0]
    assert most == 10  # of four characters, the longest length that is filed: 20,000 x 10 pairs, not 20,000 x 10,000
    assert matched.count() == 20_000


def test_filters_of_nothing_and_odd_rows(spark, snapshots):
    assert match_filters(snapshots, []).count() == 0
    odd = spark.createDataFrame(
        [("r1", None, None, None, None, None), (None, "h", "d", "/p", {}, 1)],
        "repository string, host string, description string, path string, tags map<string,string>, _asked int")
    names = ["all", "host", "tag"]
    specs = [SnapshotFilter("all", "r1"), SnapshotFilter("host", "r1", host="*"), SnapshotFilter("tag", "r1", tags={"a": "b"})]
    assert [r.replica for r in match_filters(odd.drop("_asked"), specs).collect()] == names[:1]


def test_latest(spark, snapshots):
    matched = match_filters(snapshots, FILTERS)
    by_text = {r.replica: r.id for r in latest_snapshot(matched).collect()}
    # Text order: the offset makes 01:00+02:00 the later text, though the earlier instant.
    assert by_text == {"all": "s2", "prod": "s1", "win": "s0", "suva": "s1", "r2": "s3"}
    by_time = {r.replica: r.id for r in latest_snapshot(matched, by="timestamp").collect()}
    assert by_time["all"] == "s2"  # s1 and s2 tie, the later of the listing wins


def test_named(spark, snapshots):
    wanted = spark.createDataFrame(
        [("a", "r1", "s1"), ("b", "r1", "s3"), ("c", "r1", None)], "replica string, repository string, desired string")
    got = {r.replica: (r.total_size, r.reason) for r in named_snapshot(wanted, snapshots).collect()}
    missing = (None, "desired snapshot missing")
    assert got == {"a": (20, None), "b": missing, "c": missing}


def test_covered(spark):
    candidates = spark.createDataFrame(
        [("a", "s1", None), ("b", "s1", "s1"), ("c", "s1", "s0"), ("d", "s1", None), ("e", "s1", None)],
        "replica string, snapshot string, verified string")
    restores = spark.createDataFrame(
        [("c", "s1", "Failed"), ("d", "s1", None), ("e", "s1", "Ready"), ("a", "s2", "Active")],
        "replica string, snapshot string, phase string")
    assert sorted(r.replica for r in not_covered(candidates, restores).collect()) == ["a", "c"]


@pytest.mark.parametrize("size, writes, delta, floor, maximum, expected, error", [
    (100 << 30, False, None, None, "2Ti", 110 * (1 << 30), None),
    (100 << 30, True, None, None, "2Ti", 115 * (1 << 30), None),
    (100 << 30, True, 30 << 30, None, "2Ti", 135 * (1 << 30), None),
    (100 << 30, False, None, "200Gi", "2Ti", 200 * (1 << 30), None),
    (100 << 30, False, None, "200Gi", "150Gi", 150 * (1 << 30), None),
    (100 << 30, False, None, None, "100Gi", None, "storage limit exceeded"),
    (3 << 40, False, None, None, "nonsense", None, "storage limit exceeded"),
    (1 << 30, False, None, "junk", "2Ti", 1.1 * (1 << 30), None),
])
def test_storage(spark, size, writes, delta, floor, maximum, expected, error):
    df = spark.createDataFrame(
        [(size, writes, delta, floor, maximum)],
        "total_size bigint, writes boolean, delta bigint, floor_size string, maximum_size string")
    row = storage_plan(df).first()
    assert row.storage_error == error
    assert (row.storage_bytes is None) if expected is None else abs(float(row.storage_bytes) - expected) < 1


@pytest.mark.parametrize("text, expected", [
    ("1Ki", 1024), ("2Ti", 2 << 40), ("1.5G", 1_500_000_000), ("42", 42), (".5k", 500), ("1Zi", None), ("x", None), ("", None)])
def test_quantities(spark, text, expected):
    got = spark.range(1).select(quantity_bytes(F.lit(text))).first()[0]
    assert (got if got is None else float(got)) == expected


def test_application_database(spark):
    rows = [("a", "postgres", 900, 0), ("a", "x", 5, 1), ("a", "y", 5, 2), ("b", "template1", 9, 0), ("c", "z", 0, 0)]
    got = application_database(spark.createDataFrame(rows, "restore string, name string, bytes bigint, position int"))
    assert {r.restore: r.database for r in got.collect()} == {"a": "y", "b": None, "c": "z"}
