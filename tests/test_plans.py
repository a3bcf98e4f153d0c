"""Plans: what is shuffled, what is split, and what never happens."""

import pytest
from pyspark.sql import functions as F

from freshet.cases.registry import all_queries
from freshet.operators import migrations
from freshet.operators.logs import log_tail_lines
from freshet.session import configure

ROWWISE = [
    "masked_lineitem", "mask_text", "mask_string", "row_scrub", "log_tail", "log_redact", "log_redact_many", "listing_parse",
    "storage_plan", "migration_timings", "migration_error_line", "build_grades", "access_users",
]
BATCH = sorted(n for n in all_queries() if not n.endswith("_stream"))


def executed(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("name", ROWWISE)
def test_rowwise_work_is_not_shuffled(spark, sf_dir, name):
    plan = executed(all_queries()[name](spark, sf_dir))
    assert "Exchange" not in plan and "Python" not in plan


@pytest.mark.parametrize("name", BATCH)
def test_no_cross_joins_and_no_python(spark, sf_dir, no_broadcast, name):
    plan = executed(all_queries()[name](spark, sf_dir))
    for unwanted in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython", "ExistingRDD"):
        assert unwanted not in plan


def test_log_lines_are_limited_before_the_shuffle(spark):
    lines = spark.range(1000).select((F.col("id") % 3).alias("job"), F.col("id").alias("line_no"), F.lit("x").alias("line"))
    assert executed(log_tail_lines(lines)).count("WindowGroupLimit") == 2


def test_a_migration_audit_deals_each_table_once(spark, sf_dir, no_broadcast):
    plan = executed(all_queries()["migration_newest_batch"](spark, sf_dir))
    initial = plan.split("== Initial Plan ==")[-1]
    assert initial.count("FileScan parquet") == 2 and initial.count("Exchange hashpartitioning") == 2


def test_a_hot_restore_is_split(spark, no_broadcast):
    """A third of all batches on one restore: its join runs in several tasks."""
    configure(spark)
    settings = {
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "128k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    }
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        hot = F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 9973)
        at = F.timestamp_seconds(F.col("id") % 100_000)
        batches = spark.range(0, 600_000, 1, 8).select(hot.alias("restore"), at.alias("logged_at"))
        runs = spark.range(9973).select(F.col("id").alias("restore"), F.timestamp_seconds(F.lit(50_000)).alias("started_at"))
        base = migrations.baselines(batches, runs)
        rows = base.collect()
        assert len(rows) == 9973 and max(r.baseline.timestamp() for r in rows if r.baseline) == 49_999
        assert "skew=true" in executed(base)
    finally:
        for key in settings:
            spark.conf.unset(key)
