"""The newest payload per key, out of date past an age."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def newest(payloads: DataFrame, key: str = "key", at: str = "at", seq: str = "seq") -> DataFrame:
    """The newest payload per key: the last write wins, decided by ``(at, seq)``.

    It folds tables, and is what a stream is kept by (:func:`.keyed.keep_folded`).
    """
    best = F.max_by(F.struct(F.col(at), F.col(seq), "payload"), F.struct(F.col(at), F.col(seq)))
    return payloads.groupBy(key).agg(best.alias("n")).select(
        key, F.col(f"n.{at}").alias(at), F.col(f"n.{seq}").alias(seq), "n.payload")


def held(payloads: DataFrame, as_of: Column, max_age_seconds: int = 3600, key: str = "key", at: str = "at", seq: str = "seq") -> DataFrame:
    """What a reader finds per key: the newest payload, unless it is too old by then."""
    age = F.unix_micros(as_of) - F.unix_micros(F.col(at).cast("timestamp"))
    return newest(payloads, key, at, seq).where(age < F.lit(max_age_seconds * 1_000_000))
