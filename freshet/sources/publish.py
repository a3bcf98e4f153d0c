"""Sinks: staged table copies, the pointer readers follow, and run reports.

A copy is written whole under its own run folder and never over a live path. A table
counts only once the run's index names its folder, and the index is written after all of
them are, so what a lost or cut-off attempt left behind is never read. Publishing creates
one new small pointer file, exclusively: readers see the old copy or the new one and
nothing between, and of two publishers with the same number one starts over.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping
from concurrent.futures import ThreadPoolExecutor

from py4j.protocol import Py4JJavaError
from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import exists, file_system, local_frame

PUBLISHABLE = ("complete", "partial")

#: Pointer files kept, the newest ones.
KEPT_POINTERS = 10


class PublishRefused(RuntimeError):
    """The copy may not replace the one readers use."""


def stage_tables(tables: Mapping[str, DataFrame], root: str, run_id: str, threads: int = 4) -> dict[str, str]:
    """Write a run's tables, a few at a time so small ones do not queue behind big ones.

    Each goes into a folder of its own attempt; nothing can read them before they are indexed.
    """
    if not tables:
        return {}
    spark = next(iter(tables.values())).sparkSession
    taken = set(written_tables(spark, root, run_id)) & set(tables)
    if taken:
        raise FileExistsError(f"run {run_id} has written {sorted(taken)} already")

    def write(name: str, df: DataFrame) -> str:
        path = f"{root}/staging/{run_id}/{name}/{uuid.uuid4().hex}"
        df.write.parquet(path)
        return path

    with ThreadPoolExecutor(threads) as pool:
        # Threads that inherit the caller's job tags, so that a budget can cut them off.
        pending = {n: pool.submit(inheritable_thread_target(spark)(write), n, df) for n, df in tables.items()}
        return {name: future.result() for name, future in pending.items()}


def index_tables(spark: SparkSession, paths: Mapping[str, str], root: str, run_id: str) -> None:
    """Make staged tables part of a run."""
    if paths:
        index = local_frame(spark, sorted(paths.items()), "name string, path string")
        index.coalesce(1).write.mode("append").parquet(f"{root}/tables/{run_id}")


def write_tables(tables: Mapping[str, DataFrame], root: str, run_id: str, threads: int = 4) -> dict[str, str]:
    """Stage and index tables; returns their folders."""
    paths = stage_tables(tables, root, run_id, threads)
    if paths:
        index_tables(next(iter(tables.values())).sparkSession, paths, root, run_id)
    return paths


def written_tables(spark: SparkSession, root: str, run_id: str) -> dict[str, str]:
    """Folders of the tables a run has written, by name, from its index."""
    path = f"{root}/tables/{run_id}"
    if not exists(spark, path):
        return {}
    rows = spark.read.schema("name string, path string").parquet(path).orderBy("name").collect()
    return {r["name"]: r["path"] for r in rows}


def read_staged(spark: SparkSession, root: str, run_id: str, table: str) -> DataFrame:
    """A table of a run, published or not."""
    paths = written_tables(spark, root, run_id)
    if table not in paths:
        raise LookupError(f"run {run_id} has no table {table}")
    return spark.read.parquet(paths[table])


def _pointers(spark: SparkSession, root: str) -> list[int]:
    """Numbers of the pointer files, ascending."""
    system, folder = file_system(spark, f"{root}/current")
    if not system.exists(folder):
        return []
    names = [status.getPath().getName() for status in system.listStatus(folder)]
    return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())


def _pointer_path(root: str, number: int) -> str:
    return f"{root}/current/{number:012d}.json"


def current_run(spark: SparkSession, root: str) -> str | None:
    """The run readers are on: what the newest pointer file names."""
    numbers = _pointers(spark, root)
    if not numbers:
        return None
    return json.loads(spark.read.text(_pointer_path(root, numbers[-1]), wholetext=True).first()[0])["run_id"]


def publish(spark: SparkSession, root: str, run_id: str, phase: str) -> None:
    """Point readers at a staged run, if its phase allows it.

    The next pointer file is created only if nobody has, which HDFS and local file systems
    do in one step; whoever comes second takes the number after it.
    """
    if phase not in PUBLISHABLE:
        raise PublishRefused(f"run {run_id} is {phase!r}; the previous copy stays")
    line = json.dumps({"run_id": run_id, "phase": phase}).encode()
    while True:
        numbers = _pointers(spark, root)
        system, place = file_system(spark, _pointer_path(root, (numbers or [0])[-1] + 1))
        try:
            stream = system.create(place, False)
        except Py4JJavaError as err:
            if "Exist" not in err.java_exception.getClass().getSimpleName():
                raise
            continue
        stream.write(line)
        stream.close()
        break
    for number in numbers[:1 - KEPT_POINTERS] if KEPT_POINTERS > 1 else numbers:
        system.delete(file_system(spark, _pointer_path(root, number))[1], False)


def read_current(spark: SparkSession, root: str, table: str) -> DataFrame:
    """A table of the published copy."""
    run_id = current_run(spark, root)
    if run_id is None:
        raise LookupError(f"nothing is published under {root}")
    return read_staged(spark, root, run_id, table)


def read_jdbc(
    spark: SparkSession, url: str, table: str, key: str, low: int, high: int, parts: int, **options: str
) -> DataFrame:
    """A source table read in parallel key ranges (the driver jar must be on the classpath)."""
    reader = spark.read.format("jdbc").options(
        url=url, dbtable=table, partitionColumn=key,
        lowerBound=str(low), upperBound=str(high), numPartitions=str(parts), **options,
    )
    return reader.load()


def report_rows(df: DataFrame) -> DataFrame:
    """One JSON document per row; absent parts are left out of it."""
    return df.select(F.to_json(F.struct(*[F.col(c) for c in df.columns])).alias("value"))


def write_reports(df: DataFrame, path: str) -> None:
    report_rows(df).write.mode("append").text(path)
