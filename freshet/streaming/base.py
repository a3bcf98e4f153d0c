"""Reading the package's streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_files(
    spark: SparkSession, path: str, schema, bytes_per_trigger: int = 1 << 30,
    files_per_trigger: int | None = None, **options,
) -> DataFrame:
    """A parquet folder as a stream, so many bytes (or files, if named) at a time.

    The limit bounds a micro-batch.
    """
    reader = spark.readStream.schema(schema).options(**options)
    if files_per_trigger is not None:
        return reader.option("maxFilesPerTrigger", files_per_trigger).parquet(path)
    return reader.option("maxBytesPerTrigger", bytes_per_trigger).parquet(path)

