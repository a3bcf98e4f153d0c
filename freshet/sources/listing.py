"""Snapshot listings: one JSON array per repository, with log lines around it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

SNAPSHOT_SCHEMA = (
    "array<struct<id:string,description:string,"
    "source:struct<host:string,userName:string,path:string>,"
    "tags:map<string,string>,startTime:string,stats:struct<totalSize:bigint>>>"
)


def listing_array(raw: Column) -> Column:
    """The text from the first ``[`` to the last ``]``; an empty array if there is none."""
    found = F.regexp_extract(raw, r"(?s)(\[.*\])", 1)
    return F.when(found == "", "[]").otherwise(found)


def parse_listings(df: DataFrame, raw: str = "raw") -> DataFrame:
    """One row per snapshot of every listing; malformed JSON fails the query.

    Only ``id`` must be there. ``position`` is the place in its array, which
    decides between snapshots of the same start time.
    """
    kept = [c for c in df.columns if c != raw]
    parsed = F.from_json(listing_array(F.col(raw)), SNAPSHOT_SCHEMA, {"mode": "FAILFAST"})
    rows = df.select(*kept, F.posexplode(parsed).alias("position", "s"))
    missing = F.raise_error(F.lit("a snapshot in the listing has no id"))
    blank = F.lit("")
    return rows.select(
        *kept,
        "position",
        F.coalesce(F.col("s.id"), missing).alias("id"),
        F.coalesce(F.col("s.description"), blank).alias("description"),
        F.coalesce(F.col("s.source.host"), blank).alias("host"),
        F.coalesce(F.col("s.source.userName"), blank).alias("user_name"),
        F.coalesce(F.col("s.source.path"), blank).alias("path"),
        F.coalesce(F.col("s.tags"), F.create_map().cast("map<string,string>")).alias("tags"),
        F.coalesce(F.col("s.startTime"), blank).alias("start_time"),
        F.coalesce(F.col("s.stats.totalSize"), F.lit(0)).alias("total_size"),
    )


#: Folders that listings are dealt to. Each is written and put in its place by one task.
FOLDERS = 64

#: Local disks alone: no checksum file beside each listing, which costs as much as the listing itself.
_PLAIN_FILES = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true"}


def write_listings(df: DataFrame, path: str, raw: str = "raw") -> None:
    """Every row's listing as a file of its own.

    The folders number the same however many listings there are, so that neither putting them
    in place nor finding them again takes the driver a step per listing.
    """
    dealt = df.select(F.col(raw).alias("value")).repartition(FOLDERS).withColumn("folder", F.spark_partition_id())
    dealt.write.partitionBy("folder").options(maxRecordsPerFile=1, **_PLAIN_FILES).text(path)


def read_listings(spark: SparkSession, path: str) -> DataFrame:
    """Listings of a folder, one file per repository; the file names the repository."""
    files = spark.read.text(path, wholetext=True)
    return parse_listings(
        files.select(F.col("_metadata.file_path").alias("repository"), F.col("value").alias("raw"))
    )
