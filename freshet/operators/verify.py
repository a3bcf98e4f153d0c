"""Verifying runs: verdicts, what a report says about them, and build grading."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.expressions import uuid_text
from .fleet import PER_VERSION_INTENT
from .snapshots import application_database

# Fixed values.
NO_APPLICATION_DATABASE = "restore contains no application database"
UNCONNECTABLE = "template0"
NO_SCHEMA = "the build produced no schema"
BUILD_ATTEMPTS = 5
MIGRATION_INTENT = "upgrade"
IDENTITY_LABELS = ["group", "server", "declaration"]


def verdicts(runs: DataFrame, sizes: DataFrame) -> DataFrame:
    """A success that restored no application data is a failure.

    ``runs`` has ``restore, outcome, error``; ``sizes`` has ``restore, name,
    bytes, position``. A restore with no sizes at all is left as it is.
    """
    databases = application_database(sizes).withColumn("_sized", F.lit(True))
    joined = runs.join(databases, "restore", "left")
    empty = (F.col("outcome") == "success") & F.col("_sized").isNotNull() & F.col("database").isNull()
    return joined.select(
        "restore",
        F.when(empty, "failure").otherwise(F.col("outcome")).alias("outcome"),
        F.when(empty, NO_APPLICATION_DATABASE).otherwise(F.col("error")).alias("error"),
    )


def health_details(runs: DataFrame, sizes: DataFrame | None = None) -> DataFrame:
    """The free-form part of a report as JSON, NULL when nothing was gathered.

    ``runs`` has ``restore, restore_duration_sec, fixes`` (JSON text),
    ``build`` (a struct, NULL without a build); ``sizes`` has ``restore, name,
    bytes, position``, and where it is left out neither sizes nor fixes were
    gathered. The template nothing can connect to is no database of a restore.
    One map per restore holds one entry per database name, which is as many as
    one server has; repeats are folded before the shuffle.
    """
    joined = runs.withColumn("sizes", F.lit(None).cast("map<string,bigint>"))
    if sizes is not None:
        named = sizes.where(F.col("name") != UNCONNECTABLE).groupBy("restore", "name").agg(F.max_by("bytes", "position").alias("bytes"))
        per_restore = named.groupBy("restore").agg(
            F.map_from_entries(F.sort_array(F.collect_list(F.struct("name", "bytes")))).alias("sizes")
        )
        joined = runs.drop("sizes").join(per_restore, "restore", "left")
    gathered = F.col("sizes").isNotNull()
    details = F.struct(
        "restore_duration_sec",
        F.col("sizes"),
        F.when(gathered, F.coalesce(F.try_parse_json("fixes"), F.parse_json(F.lit("{}")))).alias("fixes"),
        F.col("build").alias("schema_build"),
    )
    text = F.to_json(details)
    return joined.select("restore", F.when(text != "{}", text).alias("health_details"))


def recover_identity(replicas: DataFrame, parents: DataFrame, labels: Sequence[str] = IDENTITY_LABELS) -> DataFrame:
    """Identity labels of each replica, gaps filled from its parent's.

    The parent is asked only if a label is absent or no UUID, and fills only
    labels that are absent: a bad value of the replica's own stays and counts
    as missing. ``missing`` lists what no report can be made without.
    """
    filled = parents.select("parent", *[F.col(name).alias(f"_{name}") for name in labels])
    joined = replicas.join(filled, "parent", "left")
    own_good = F.lit(True)
    for name in labels:
        own_good = own_good & F.coalesce(uuid_text(F.col(name)), F.lit(False))
    values = {
        name: F.when(own_good, F.col(name)).otherwise(F.coalesce(F.col(name), F.col(f"_{name}")))
        for name in labels
    }
    merged = joined.withColumn("_own_good", own_good).withColumns({f"_v_{n}": v for n, v in values.items()})
    missing = F.array_compact(F.array(*[
        F.when(~F.coalesce(uuid_text(F.col(f"_v_{n}")), F.lit(False)), F.lit(n)) for n in labels
    ]))
    return merged.select(
        "replica",
        *[F.col(f"_v_{n}").alias(n) for n in labels],
        missing.alias("missing"),
        (~F.col("_own_good") & (F.size(missing) == 0)).alias("recovered"),
    )


def intent_blocks(runs: DataFrame) -> DataFrame:
    """Adds the blocks an intent may report: ``migration_block`` and ``build_block``.

    ``runs`` has ``intent, target_version, target_version_id, migration`` and
    ``build`` (structs, NULL when there is no result). A migration is reported
    under its intent only, with a target id other systems can join on.
    """
    target_ok = F.coalesce(uuid_text(F.col("target_version_id")), F.lit(False))
    migration = F.when(
        (F.col("intent") == MIGRATION_INTENT) & F.col("migration").isNotNull() & target_ok,
        F.struct(F.lower("target_version_id").alias("target_version_id"), "migration"),
    )
    build = F.when(
        (F.col("intent") == PER_VERSION_INTENT) & F.col("build").isNotNull(),
        F.struct(
            "build", "target_version",
            F.when(target_ok, F.lower("target_version_id")).alias("target_version_id"),
        ),
    )
    return runs.withColumns({"migration_block": migration, "build_block": build})


def build_to_do() -> Column:
    """Why a run builds nothing, the first reason that holds; ``build`` if none does.

    Reads ``settled, image, target_version, has_migration, failed_migration,
    group_own, group_label, rank``.
    """
    group = F.coalesce(uuid_text(F.col("group_own")), F.lit(False)) | F.coalesce(
        uuid_text(F.col("group_label")), F.lit(False)
    )
    migrated = F.col("has_migration") & F.col("failed_migration").isNull()
    return (
        F.when(F.col("settled"), "settled")
        .when(F.col("image").isNull(), "no image")
        .when(F.col("target_version").isNull(), "no target")
        .when(~F.coalesce(migrated, F.lit(False)), "unmigrated")
        .when(~group, "no group")
        .when(F.coalesce(F.col("rank") == "", F.lit(True)), "no rank")
        .otherwise("build")
    )


def grade_builds(runs: DataFrame) -> DataFrame:
    """Adds what became of each run's build.

    Also reads ``payload`` (the schema posted back, NULL if none came),
    ``registration_error``, ``receipt`` and ``attempts``. A build is built only
    if a payload came and nothing went wrong registering it; its size is kept
    either way. Without a payload it is tried again while attempts are left and
    a receipt says there was one.
    """
    building = F.col("to_do") == "build"
    came = F.col("payload").isNotNull()
    again = building & ~came & F.col("receipt") & (F.col("attempts") < BUILD_ATTEMPTS)
    graded = building & ~again
    return runs.withColumn("to_do", build_to_do()).withColumns({
        "retry": again,
        "built": F.when(graded, came & F.col("registration_error").isNull()),
        "build_error": F.when(graded, F.coalesce("registration_error", F.when(~came, NO_SCHEMA))),
        "schema_bytes": F.when(graded, F.octet_length("payload").cast("bigint")),
    })


def build_reasons(runs: DataFrame) -> DataFrame:
    """How many runs there are per reason not to build."""
    return runs.select(build_to_do().alias("to_do")).groupBy("to_do").agg(F.count("*").alias("runs"))
