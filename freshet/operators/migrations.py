"""What migrations did to each restored copy, read from its migration log.

A batch row holds ``restore, batch, logged_at, direction, migrations`` (names in
order), ``batch_duration_ms`` and ``stats`` (JSON text). A run row holds
``restore``, whether its job failed, and the size after it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.expressions import trimmed

UNKNOWN = "unknown"


def baselines(batches: DataFrame, runs: DataFrame) -> DataFrame:
    """The newest batch each copy held before its run, NULL if it held none."""
    starts = runs.select("restore", "started_at")
    earlier = batches.select("restore", "logged_at").join(starts, "restore").where("logged_at < started_at")
    newest = earlier.groupBy("restore").agg(F.max("logged_at").alias("baseline"))
    return starts.select("restore").join(newest, "restore", "left")


def newest_ups(batches: DataFrame) -> DataFrame:
    """The newest ``up`` batch of each copy, folded in the map tasks.

    The batch id decides between batches logged at one instant.
    """
    rest = [c for c in batches.columns if c != "restore"]
    newest = F.max_by(F.struct(*rest), F.struct("logged_at", "batch"))
    return batches.where(F.col("direction") == "up").groupBy("restore").agg(newest.alias("b")).select("restore", "b.*")


def newest_batches(batches: DataFrame, base: DataFrame) -> DataFrame:
    """The newest ``up`` batch after each copy's baseline, if there is one.

    ``base`` has ``restore, baseline``. Only the newest of all can be the one sought, so it
    is folded first and compared with the baseline afterwards.
    """
    after = F.col("baseline").isNull() | (F.col("logged_at") > F.col("baseline"))
    return newest_ups(batches).join(base, "restore").where(after).drop("baseline")


def run_batches(batches: DataFrame, runs: DataFrame) -> DataFrame:
    """The same from the runs themselves, without working their baselines out.

    A batch logged before its run began is itself no later than the baseline, and one logged
    since then is later than it. So the newest ``up`` batch is the one sought where the run
    had begun by then, or has no start and thus no baseline; each table is read once.
    """
    began = F.col("started_at").isNull() | (F.col("logged_at") >= F.col("started_at"))
    return newest_ups(batches).join(runs.select("restore", "started_at"), "restore").where(began).drop("started_at")


#: Parts of a batch's statistics; values keep their JSON type until they are read.
STATS_PARTS = {
    "durationMsPerMigration": "map<string,variant>",
    "preSnapshot": "struct<databaseSizeBytes:variant>",
    "failedMigration": "variant",
    "error": "map<string,variant>",
}
ERROR_FIELDS = ["code", "name", "message", "table", "column", "constraint", "detail", "hint"]
TIMINGS = "array<struct<name:string,elapsed_seconds:bigint>>"


def _whole(value: Column) -> Column:
    """A JSON whole number; any other JSON value is none."""
    return F.when(F.schema_of_variant(value) == "BIGINT", F.try_variant_get(value, "$", "bigint"))


def _string(value: Column) -> Column:
    return F.when(F.schema_of_variant(value) == "STRING", F.try_variant_get(value, "$", "string"))


def _parsed(batches: DataFrame, *parts: str) -> DataFrame:
    """Batches with the wanted parts of ``stats`` in ``_stats``, a column of its own so it is parsed once.

    ``from_json`` keeps every field name it meets in a table that all tasks of an executor share, and
    here migrations name the fields: texts are read as variants, several times as fast, and only
    those a variant refuses (a name given twice, single quotes) as before.
    """
    schema = "struct<" + ", ".join(f"{part}: {STATS_PARTS[part]}" for part in parts or STATS_PARTS) + ">"
    read = F.try_variant_get(F.try_parse_json("stats"), "$", schema)
    return batches.withColumn("_stats", F.coalesce(read, F.from_json("stats", schema)))


def timings(migrations: Column, took: Column) -> Column:
    """Whole seconds of each migration in batch order, every one cut off by itself."""
    def seconds(name: Column) -> Column:
        return F.call_function("div", F.coalesce(_whole(F.try_element_at(took, name)), F.lit(0)), F.lit(1000))

    return F.transform(
        migrations, lambda name: F.struct(name.alias("name"), seconds(name).alias("elapsed_seconds"))
    )


def migration_timings(batches: DataFrame) -> DataFrame:
    """One row per migration of each batch, numbered in batch order."""
    took = _parsed(batches, "durationMsPerMigration").select(
        "restore", "batch", F.col("_stats.durationMsPerMigration").alias("_took"),
        F.posexplode("migrations").alias("position", "name"),
    )
    milliseconds = F.coalesce(_whole(F.try_element_at("_took", F.col("name"))), F.lit(0))
    return took.select(
        "restore", "batch", "position", "name",
        F.call_function("div", milliseconds, F.lit(1000)).alias("elapsed_seconds"),
    )


def bytes_before(size: Column) -> Column:
    """The size recorded before a batch ran; unreadable and negative sizes are unknown."""
    text = _string(size)
    known = F.coalesce(_whole(size), F.when(text.rlike(r"^[+-]?[0-9]+\z"), text.try_cast("bigint")))
    return F.when(known >= 0, known)


def _error_fields(df: DataFrame, error: str) -> DataFrame:
    """The fields of a structured error as trimmed texts, blanks left out."""
    given = df.withColumns({f"_e_{name}": F.try_element_at(error, F.lit(name)) for name in ERROR_FIELDS})
    texts = given.withColumns({f"_e_{name}": trimmed(_string(F.col(f"_e_{name}"))) for name in ERROR_FIELDS})
    return texts.withColumns({f"_e_{name}": F.nullif(F.col(f"_e_{name}"), F.lit("")) for name in ERROR_FIELDS})


def _error_line() -> Column:
    """A structured error on one line, NULL if there is none."""
    def field(name: str) -> Column:
        return F.col(f"_e_{name}")

    def joined(separator: str, *parts: Column) -> Column:
        return F.nullif(F.concat_ws(separator, *parts), F.lit(""))

    head = joined(": ", F.coalesce(field("code"), field("name")), field("message"))
    where = joined(", ", joined(".", field("table"), field("column")), field("constraint"))
    return joined(
        " ",
        head,
        F.concat(F.lit("["), where, F.lit("]")),
        F.concat(F.lit("DETAIL: "), field("detail")),
        F.concat(F.lit("HINT: "), field("hint")),
    )


def error_lines(batches: DataFrame) -> DataFrame:
    """``(restore, batch, error)``: what each batch recorded going wrong."""
    return _error_fields(_parsed(batches, "error"), "_stats.error").select("restore", "batch", _error_line().alias("error"))


def migration_results(runs: DataFrame, batches: DataFrame) -> DataFrame:
    """One result per run; a run whose job wrote no batch keeps a row.

    ``runs`` has ``restore, job_failed, bytes_after`` and optionally
    ``log_tail``; ``batches`` has at most one (the newest) batch per restore.
    """
    newest = batches.select("restore", "batch_duration_ms", "stats", "migrations", F.lit(True).alias("_found"))
    failed = F.col("job_failed")
    joined = _parsed(runs.join(newest, "restore", "left")).withColumns({
        "_took": F.col("_stats.durationMsPerMigration"),
        "_error": F.when(failed, F.col("_stats.error")),
    })
    read = _error_fields(joined, "_error").withColumn(
        "timings", F.coalesce(timings(F.col("migrations"), F.col("_took")), F.array().cast(TIMINGS))
    )
    summed = F.aggregate("timings", F.lit(0).cast("bigint"), lambda total, t: total + t["elapsed_seconds"])
    tail = F.nullif(F.col("log_tail"), F.lit("")) if "log_tail" in runs.columns else F.lit(None).cast("string")
    named = _string(F.col("_stats.failedMigration"))
    return read.select(
        "restore",
        F.coalesce("_found", F.lit(False)).alias("has_batch"),
        F.coalesce(F.call_function("div", F.col("batch_duration_ms"), F.lit(1000)), summed).alias("elapsed_seconds"),
        F.when(failed, F.coalesce(named, F.lit(UNKNOWN))).alias("failed_migration"),
        F.when(failed, F.coalesce(_error_line(), tail)).alias("error"),
        F.coalesce(bytes_before(F.col("_stats.preSnapshot.databaseSizeBytes")), F.col("bytes_after")).alias("bytes_before"),
        "bytes_after",
        "timings",
    )


def growth(results: DataFrame, top: int | None = None) -> DataFrame:
    """How much each run grew its copy, largest first if only the top is asked for."""
    grown = results.select("restore", (F.col("bytes_after") - F.col("bytes_before")).alias("growth_bytes"))
    return grown if top is None else grown.orderBy(F.desc("growth_bytes"), "restore").limit(top)
