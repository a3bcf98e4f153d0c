"""Running values over ordered rows, for keys of any size.

A plain window sorts all rows of a key in one task. Here rows are first dealt by a
sampled range partitioning on key and order, so every partition holds an even share
of the rows whatever the clock does: bursts and equal times are split like anything
else. A partition's rows of a key are a segment. Each segment is scanned on its own,
one summary row per segment carries the rest forward, and only summaries of a key
ever meet.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import fresh_path

SEGMENT = "_segment"


def cut(df: DataFrame, keys: Sequence[str], order: Sequence[str], segments: int | None = None) -> DataFrame:
    """Add the segment of each row, to be dropped after the last running value.

    ``order`` must be unique within a key. The dealt rows are written to the shared
    folder, so the sampled borders are drawn once and every later pass, and every task
    that runs again, sees the same segments.
    """
    spark = df.sparkSession
    count = segments or int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(count, *keys, *order).withColumn(SEGMENT, F.spark_partition_id())
    path = fresh_path(spark, "segments")
    dealt.write.parquet(path)
    return spark.read.schema(dealt.schema).parquet(path)


def running(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], values: Mapping[str, tuple[str, Column]]
) -> DataFrame:
    """Add running values per key, in ``order``, to rows :func:`cut` into segments.

    ``values`` maps a new column to ``(how, expression)``: ``sum`` and ``max``
    up to the row, ``last`` non-NULL up to the row, or the ``previous`` non-NULL
    before it. Keys and order must not be NULL, and ``order`` must be unique
    within a key.
    """
    inside = Window.partitionBy(*keys, SEGMENT).orderBy(*order)
    up_to = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy(*keys).orderBy(SEGMENT).rowsBetween(Window.unboundedPreceding, -1)

    local, totals, carried, merged = {}, [], {}, {}
    for name, (how, value) in values.items():
        here, total, carry = f"_here_{name}", f"_total_{name}", f"_carry_{name}"
        mine, past = F.col(here), F.col(carry)
        if how == "sum":
            local[here] = F.sum(value).over(up_to)
            totals.append(F.sum(value).alias(total))
            carried[carry] = F.sum(total).over(earlier)
            merged[name] = F.when(mine.isNotNull() | past.isNotNull(),
                                  F.coalesce(mine, F.lit(0)) + F.coalesce(past, F.lit(0)))
        elif how == "max":
            local[here] = F.max(value).over(up_to)
            totals.append(F.max(value).alias(total))
            carried[carry] = F.max(total).over(earlier)
            merged[name] = F.greatest(mine, past)
        elif how in ("last", "previous"):
            local[here] = F.last(value, ignorenulls=True).over(up_to if how == "last" else before)
            totals.append(F.max_by(value, F.when(value.isNotNull(), F.struct(*order))).alias(total))
            carried[carry] = F.last(total, ignorenulls=True).over(earlier)
            merged[name] = F.coalesce(mine, past)
        else:
            raise ValueError(f"unknown running value {how!r}")

    rows = df.withColumns(local)
    summaries = df.groupBy(*keys, SEGMENT).agg(*totals)
    carries = summaries.select(*keys, SEGMENT, *[c.alias(name) for name, c in carried.items()])
    joined = rows.join(carries, [*keys, SEGMENT], "left")
    return joined.select(*df.columns, *[c.alias(name) for name, c in merged.items()])
