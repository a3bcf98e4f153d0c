"""Which snapshot each replica should be refreshed from, and how much room it needs."""

from __future__ import annotations

from collections import Counter
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.expressions import GIB, SYSTEM_DATABASES, quantity_bytes, unix_path
from ..functions.globs import glob_regex, glob_start
from ..session import local_frame

_MATCHES_NOTHING = r"(?!)"


@dataclass(frozen=True)
class SnapshotFilter:
    """One replica's filter of its repository's listing. A part left out lets everything through."""

    replica: str
    repository: str
    tags: Mapping[str, str] | None = None
    host: str | None = None
    description: str | None = None
    path: str | None = None


def tags_match(tags: Column, required: Mapping[str, str] | None) -> Column:
    """Every required pair, under its bare key or the ``tag:`` one."""
    pairs = [
        F.coalesce(tags[key] == value, F.lit(False)) | F.coalesce(tags["tag:" + key] == value, F.lit(False))
        for key, value in (required or {}).items()
    ]
    return reduce(lambda a, b: a & b, pairs, F.lit(True))


def match_filters(snapshots: DataFrame, specs: Sequence[SnapshotFilter]) -> DataFrame:
    """Each replica's matching snapshots, as (replica, snapshot) rows, however many filters there are."""
    return match_filter_table(snapshots, filter_table(snapshots.sparkSession, specs))


def filter_table(spark: SparkSession, specs: Sequence[SnapshotFilter]) -> DataFrame:
    """Filters as rows, their globs as regular expressions, filed as :func:`file_filters` does."""
    def regex(pattern: str | None) -> str | None:
        return None if pattern is None else glob_regex(pattern) or _MATCHES_NOTHING

    def places(s: SnapshotFilter) -> list[tuple[str, int, str]]:
        starts = {kind: glob_start(getattr(s, kind) or "") for kind in _TEXTS}
        sizes = {kind: max(n for n in _SIZES if n <= len(start)) for kind, start in starts.items() if start}
        return [("tag", 0, f"tag\0{k}\0{v}") for k, v in (s.tags or {}).items()] + [
            (kind, n, f"{kind}\0{n}\0{starts[kind][:n]}") for kind, n in sizes.items()]

    sharing = Counter((s.repository, place[2]) for s in specs for place in places(s))
    rows = []
    for s in specs:
        best = min(places(s), key=lambda p, s=s: (sharing[s.repository, p[2]], -len(p[2]), p[2]), default=("", 0, ""))
        rows.append((s.replica, s.repository, dict(s.tags or {}), *(regex(getattr(s, kind)) for kind in _TEXTS), *best))
    return local_frame(
        spark, rows,
        "replica string, repository string, required map<string,string>,"
        " host_re string, description_re string, path_re string, _kind string, _size int, _token string",
    )


#: Lengths of beginnings by which filters are filed.
_SIZES = [1 << i for i in range(13)]

_TEXTS = ("host", "description", "path")


def _token(kind: Column, *parts: Column) -> Column:
    return F.concat_ws("\0", kind, *parts)


def file_filters(specs: DataFrame) -> DataFrame:
    """Filters with ``_kind``, ``_size`` and ``_token``: the one thing a snapshot must have to meet each.

    A filter could stand under any of its required tags, or the beginning of a text. It goes
    under what fewest other filters of its repository ask for, or, asking for nothing of the
    kind, under the empty token, which every snapshot has.
    """
    def place(kind: str, size: Column, token: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), size.alias("size"), token.alias("token"))

    tags = F.transform(F.map_entries("required"), lambda e: place("tag", F.lit(0), _token(F.lit("tag"), e["key"], e["value"])))
    starts = []
    for kind in _TEXTS:
        if f"{kind}_start" in specs.columns:
            start = F.col(f"{kind}_start")
            size = F.array_max(F.array(*(F.when(F.char_length(start) >= n, n) for n in _SIZES)))
            starts.append(place(kind, size, _token(F.lit(kind), size.cast("string"), F.left(start, size))))
    asked = F.array_distinct(F.filter(
        F.concat(F.coalesce(tags, F.array()), F.array(*starts)) if starts else F.coalesce(tags, F.array()),
        lambda p: p["size"].isNotNull()))
    numbered = specs.withColumn("_filter", F.monotonically_increasing_id())
    places = numbered.select("*", F.explode_outer(asked).alias("_place"))
    sharing = places.where(F.col("_place").isNotNull()).groupBy("repository", F.col("_place.token").alias("_token")).agg(
        F.count("*").alias("_sharing"))
    counted = places.withColumn("_token", F.col("_place.token")).join(sharing, ["repository", "_token"], "left")
    best = F.min_by("_place", F.struct("_sharing", -F.char_length("_token"), "_token"))
    chosen = counted.groupBy("_filter").agg(
        best.alias("_place"), *(F.first(c).alias(c) for c in specs.columns))
    return chosen.select(
        *specs.columns, F.coalesce("_place.kind", F.lit("")).alias("_kind"),
        F.coalesce("_place.size", F.lit(0)).alias("_size"), F.coalesce("_place.token", F.lit("")).alias("_token"))


def _tokens(asked: str) -> Column:
    """What a snapshot has of the kinds of things that filters of its repository are filed under."""
    tags = F.array_distinct(F.flatten(F.transform(F.map_entries("tags"), lambda e: F.filter(F.array(
        _token(F.lit("tag"), e["key"], e["value"]),
        F.when(e["key"].startswith("tag:"), _token(F.lit("tag"), F.substring(e["key"], 5, 1 << 30), e["value"])),
    ), lambda t: t.isNotNull()))))

    def start(ask: Column) -> Column:
        text = (F.when(ask["_kind"] == "host", F.col("host")).when(ask["_kind"] == "description", F.col("description"))
                .when(ask["_kind"] == "path", unix_path(F.col("path"))))
        token = _token(ask["_kind"], ask["_size"].cast("string"), F.left(text, ask["_size"]))
        return F.when(F.char_length(text) >= ask["_size"], F.array(token))

    return F.flatten(F.filter(F.transform(F.col(asked), lambda ask: F.when(ask["_kind"] == "", F.array(F.lit("")))
                                          .when(ask["_kind"] == "tag", tags).otherwise(start(ask))), lambda t: t.isNotNull()))


def match_filter_table(snapshots: DataFrame, specs: DataFrame) -> DataFrame:
    """The same for filters in a table.

    A snapshot meets only those filters of its repository that are filed under something it
    has, and under one thing each, so a repository with very many filters does not pair all
    with all. ``host_start``, ``description_start`` and ``path_start`` are optional: literal
    texts that what the regular expression matches begins with.
    """
    return _met(snapshots, specs, ["replica"])


def filter_classes(specs: DataFrame) -> DataFrame:
    """Filters that ask for the same things as one row: how many ``replicas`` and the ``first_replica``."""
    asked = [c for c in specs.columns if c not in ("replica", "required")]
    entries = specs.withColumn("_required", F.array_sort(F.map_entries("required")))
    classes = entries.groupBy(*asked, "_required").agg(
        F.count("*").alias("replicas"), F.min("replica").alias("first_replica"))
    return classes.withColumn("required", F.map_from_entries("_required")).drop("_required")


def count_matches(snapshots: DataFrame, specs: DataFrame, keys: Sequence[str] = ("repository", "id")) -> DataFrame:
    """How many replicas each snapshot matches, and the first of them, without a row per pair.

    A snapshot meets each class of equal filters once, so that very many replicas that ask
    for the same cost no more than one.
    """
    matched = _met(snapshots, filter_classes(specs), ["replicas", "first_replica"])
    return matched.groupBy(*keys).agg(F.sum("replicas").alias("replicas"), F.min("first_replica").alias("first_replica"))


def _met(snapshots: DataFrame, specs: DataFrame, kept: Sequence[str]) -> DataFrame:
    """Snapshots beside the ``kept`` columns of the filters they match."""
    def passes(value: Column, regex: str) -> Column:
        return F.col(regex).isNull() | F.regexp_like(value, F.col(regex))

    tags = F.col("tags")
    required = F.forall(
        F.map_entries("required"),
        lambda e: F.coalesce(F.try_element_at(tags, e["key"]) == e["value"], F.lit(False))
        | F.coalesce(F.try_element_at(tags, F.concat(F.lit("tag:"), e["key"])) == e["value"], F.lit(False)),
    )
    filed = specs if "_token" in specs.columns else file_filters(specs)
    asked = filed.groupBy("repository").agg(F.collect_set(F.struct("_kind", "_size")).alias("_asked"))
    met = snapshots.join(asked, "repository").select(*snapshots.columns, F.explode(_tokens("_asked")).alias("_token"))
    return (
        met.join(filed, ["repository", "_token"])
        .where(
            required
            & passes(F.col("host"), "host_re")
            & passes(F.col("description"), "description_re")
            & passes(unix_path(F.col("path")), "path_re")
        )
        .select(*kept, *snapshots.columns)
    )


def latest_snapshot(
    matched: DataFrame, keys: Sequence[str] = ("replica",),
    position: Sequence[str] = ("position",), by: str = "text",
) -> DataFrame:
    """Each key's snapshot of the greatest start time, the later one on a tie.

    Start times compare as text, as they are written; ``by='timestamp'``
    compares the instants instead, for listings that mix offsets. The maximum
    is folded before the shuffle, so a key with most of the rows costs no more.
    """
    start = F.col("start_time") if by == "text" else F.to_timestamp("start_time")
    rest = [c for c in matched.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct(start, *position))
    return matched.groupBy(*keys).agg(best.alias("s")).select(*keys, "s.*")


def named_snapshot(replicas: DataFrame, snapshots: DataFrame) -> DataFrame:
    """The snapshot each replica asks for by id, or the reason there is none.

    ``replicas`` has ``replica, repository, desired``; of snapshots sharing an
    id the first of the listing counts.
    """
    first = snapshots.groupBy("repository", "id").agg(
        F.min_by(F.struct("start_time", "total_size"), "position").alias("s")
    )
    wanted = replicas.join(
        first.select("repository", F.col("id").alias("desired"), "s"), ["repository", "desired"], "left"
    )
    return wanted.select(
        "replica", "repository", "desired",
        F.col("s.start_time").alias("start_time"),
        F.col("s.total_size").alias("total_size"),
        F.when(F.col("s").isNull(), "desired snapshot missing").alias("reason"),
    )


def not_covered(candidates: DataFrame, restores: DataFrame) -> DataFrame:
    """Candidates ``(replica, snapshot, verified)`` no restore is on yet.

    A snapshot is covered if it is the verified one, or any restore that has not
    failed carries it. Restores are reduced to one row per snapshot in the map
    tasks, so a snapshot restored very often weighs no more than any other.
    """
    live = restores.where(F.col("phase").isNull() | (F.col("phase") != "Failed"))
    fresh = candidates.where(~F.col("verified").eqNullSafe(F.col("snapshot")))
    return fresh.join(live.select("replica", "snapshot").distinct(), ["replica", "snapshot"], "left_anti")


def storage_plan(
    df: DataFrame, size: str = "total_size", writes: str = "writes", delta: str = "delta",
    floor: str = "floor_size", maximum: str = "maximum_size",
) -> DataFrame:
    """Adds ``storage_bytes`` and ``storage_error`` for a snapshot's volume.

    A tenth more than the snapshot; or, if something is written into the copy,
    the larger of a tenth and the last measured growth, and 5 Gi. Over the
    maximum is an error. The floor raises the size, never beyond the maximum.
    ``floor`` and ``maximum`` are quantity texts; a bad maximum means 2 Ti.
    """
    snapshot = F.col(size).cast("decimal(20,0)")
    tenth = (snapshot * F.lit("0.1").cast("decimal(2,1)")).cast("decimal(30,1)")
    overhead = F.greatest(tenth, F.coalesce(F.col(delta).cast("decimal(30,1)"), F.lit(0).cast("decimal(30,1)")))
    five_gib = F.lit(5 * GIB).cast("decimal(20,0)")
    computed = F.when(F.col(writes), snapshot + overhead + five_gib).otherwise(snapshot + tenth)
    limit = F.coalesce(quantity_bytes(F.col(maximum)), F.lit(2 << 40).cast("decimal(38,3)"))
    chosen = F.least(F.greatest(computed, quantity_bytes(F.col(floor))), limit)
    over = computed > limit
    return df.withColumns({
        "storage_bytes": F.when(~over, chosen).cast("decimal(30,1)"),
        "storage_error": F.when(over, "storage limit exceeded"),
    })


def application_database(sizes: DataFrame, keys: Sequence[str] = ("restore",)) -> DataFrame:
    """The largest database of each restore that holds application data, or NULL.

    ``sizes`` has ``name, bytes, position``; of equals the later one counts.
    """
    own = ~F.col("name").isin(SYSTEM_DATABASES)
    largest = F.max_by(F.when(own, F.col("name")), F.when(own, F.struct("bytes", "position")))
    return sizes.groupBy(*keys).agg(largest.alias("database"))
