"""Traffic totals of running restores, from cumulative progress samples.

Counters only ever grow, so the greatest one seen is the total: lost, late and
repeated samples cost resolution, never accuracy.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.expressions import uuid_text

# Fields of a sample.
COUNTERS = ["sent_raw_bytes", "sent_payload_bytes", "received_raw_bytes", "received_payload_bytes"]
BIGGEST = (1 << 63) - 1
BIGGEST_UNSIGNED = (1 << 64) - 1


#: A sample parsed once; counters stay text until they are checked.
SAMPLE_SCHEMA = "run_id string, type string, " + ", ".join(f"{c} string" for c in COUNTERS)

#: A counter, or neither of the texts, written as the wrong kind of JSON value.
_WRONG_KIND = r'"(?:' + "|".join(COUNTERS) + r')"\s*:\s*"|"(?:run_id|type)"\s*:\s*[^"\s]'


def _counter(name: str) -> Column:
    """An unsigned counter, held at the largest bigint; NULL if it is no whole number."""
    number = F.when(F.col(name).rlike(r"^[0-9]+\z"), F.col(name).try_cast("decimal(38,0)"))
    fits = number <= F.lit(str(BIGGEST_UNSIGNED)).cast("decimal(20,0)")
    return F.when(fits, F.least(number, F.lit(BIGGEST).cast("decimal(38,0)")).cast("bigint"))


def parse_samples(raw: DataFrame, body: str = "body") -> DataFrame:
    """Well-formed samples of a table or stream of JSON texts; others are dropped."""
    kept = [c for c in raw.columns if c != body]
    plausible = raw.where(~F.col(body).rlike(_WRONG_KIND))
    # inline() keeps the checks below above the parsed rows: pushed under it, each would parse again.
    parsed = plausible.select(*kept, F.inline(F.array(F.from_json(body, SAMPLE_SCHEMA))))
    read = parsed.select(
        *kept, F.lower("run_id").alias("run_id"), "type", *[_counter(c).alias(c) for c in COUNTERS]
    )
    return read.where(uuid_text(F.col("run_id"))).dropna(subset=["type", *COUNTERS])


def totals(samples: DataFrame) -> DataFrame:
    """Totals per run and type.

    A maximum of maxima is the maximum, so this is also the fold a stream of samples is kept
    by (:func:`.keyed.keep_folded`): right however late a sample comes.
    """
    return samples.groupBy("run_id", "type").agg(*[F.max(c).alias(c) for c in COUNTERS])


def rates(samples: DataFrame, at: str = "at", window: str = "1 hour") -> DataFrame:
    """Bytes each run moved per window: its total then, less the total before.

    Only one row per run and window reaches the ordered step.
    """
    per_window = samples.groupBy("run_id", "type", F.window(at, window).alias("w")).agg(
        *[F.max(c).alias(c) for c in COUNTERS]
    )
    before = Window.partitionBy("run_id", "type").orderBy("w.start").rowsBetween(Window.unboundedPreceding, -1)
    return per_window.select(
        "run_id", "type", F.col("w.start").alias("window_start"),
        *[
            F.greatest(F.col(c) - F.coalesce(F.max(c).over(before), F.lit(0)), F.lit(0)).alias(c)
            for c in COUNTERS
        ],
    )
