"""Helpers the operators of this folder share."""

from __future__ import annotations

import os
import zlib

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import fresh_path

#: A word: a run of anything but ASCII white space (fixed by the contract).
WORD = r"[^\x20\x09-\x0D]+"

#: Rows handed to a Python worker at once. Documents are a few kB, some hundreds;
#: this bounds a batch to a few MB where the default would hold tens.
BATCH_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bound what a Python worker holds of long rows at once."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


#: Tables written to the shared folder and not yet released, by application: path, and name if they have one.
_WRITTEN: dict[str, list[tuple[str, str | None]]] = {}


def _note(spark: SparkSession, path: str, name: str | None = None) -> None:
    _WRITTEN.setdefault(spark.sparkContext.applicationId, []).append((path, name))


def written(spark: SparkSession) -> list[tuple[str, str | None]]:
    """Tables written and not released so far, to be handed to :func:`release`."""
    return list(_WRITTEN.get(spark.sparkContext.applicationId, []))


def release(spark: SparkSession, tables: list[tuple[str, str | None]]) -> None:
    """Remove intermediate tables, once everything computed from them is written elsewhere."""
    for path, name in tables:
        if name:
            spark.sql(f"DROP TABLE IF EXISTS `{name}`")
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    left = _WRITTEN.get(spark.sparkContext.applicationId, [])
    left[:] = [t for t in left if t not in tables]


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write a table to the shared folder and read it back.

    It cuts the lineage, and what is read twice is computed once. Any executor can
    read it after another is lost.
    """
    spark = df.sparkSession
    path = fresh_path(spark, label)
    _note(spark, path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def stored_by(df: DataFrame, key: str, label: str) -> DataFrame:
    """``stored``, dealt into buckets by a key: joins on it find the rows where they lie."""
    spark = df.sparkSession
    path = fresh_path(spark, label)
    name = os.path.basename(path).replace("-", "_")
    _note(spark, path, name)
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    writer = df.repartition(buckets, key).write.format("parquet").bucketBy(buckets, key)
    writer.option("path", path).saveAsTable(name)
    return spark.table(name)


def held_out(doc_id: Column, parts: int, part: int) -> Column:
    """Whether crc32 of the id's text leaves ``part`` modulo ``parts``; a null id does not."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % parts == part, F.lit(False))


def crc_of(ids: np.ndarray) -> int:
    """Unsigned crc32 of ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(ids.astype("<u4").tobytes())


def clean_vectors(df: DataFrame, key: str, vector: str, zeros: bool) -> DataFrame:
    """Rows with a usable vector: ``row`` (a number of its own), ``id`` and ``v`` as doubles.

    Null keys, null or empty vectors and vectors with a null or non-finite component are
    left out, and all-zero ones unless ``zeros``.
    """
    v = F.col(vector).cast("array<double>")
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    kept = df.select(F.col(key).cast("long").alias("id"), v.alias("v"), good.alias("_good")).where(
        F.col("id").isNotNull() & F.col("_good") & (F.size("v") > 0)
    )
    if not zeros:
        kept = kept.where(F.exists("v", lambda x: x != 0))
    return kept.select(F.monotonically_increasing_id().alias("row"), "id", "v")
