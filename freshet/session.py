"""Session settings and the few cluster-level helpers every module shares."""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from contextvars import ContextVar

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: What every job of this package relies on. Nothing here is sized for one
#: machine: partition counts stay with the cluster's own configuration.
REQUIRED_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a hot key's join even where an aggregate follows on the same key: the
    # aggregate then starts in the split tasks, and only its partial results meet.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}


#: Folders callers have named for sessions whose settings name none, by application.
_NAMED_DIRS: dict[str, str] = {}


def configure(spark: SparkSession) -> SparkSession:
    """Pin the session options the results depend on."""
    for key, value in REQUIRED_CONF.items():
        spark.conf.set(key, value)
    return spark


def local_session(folder: str, app: str = "freshet", cores: str = "8", memory: str = "8g") -> SparkSession:
    """A single-JVM session for tests and the bench, with ``folder`` as its shared folder."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.checkpoint.dir", folder)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in REQUIRED_CONF.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def named_dir(spark: SparkSession) -> str | None:
    """The shared folder the session's settings or its caller name, if any."""
    context = spark.sparkContext
    setting = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    return setting or _NAMED_DIRS.get(context.applicationId)


def name_shared_dir(spark: SparkSession, path: str) -> None:
    """Name the shared folder of a session whose ``spark.checkpoint.dir`` is unset."""
    if not named_dir(spark):
        _NAMED_DIRS[spark.sparkContext.applicationId] = path


def shared_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``.

    Written tables and stream checkpoints go under it, so that any executor can
    read them back after another one is lost. The library never makes one up: a
    session without the setting has to name a folder with ``name_shared_dir``.
    """
    named = named_dir(spark)
    if not named:
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    return named.rstrip("/")


#: Paths handed out inside a :func:`scratch` block.
_SCRATCH: ContextVar[list[str] | None] = ContextVar("scratch", default=None)


def fresh_path(spark: SparkSession, label: str) -> str:
    """A path under the shared folder that no earlier run has used."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    if (noted := _SCRATCH.get()) is not None:
        noted.append(path)
    return path


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Remove what was written to fresh paths inside, for work whose results lie elsewhere."""
    noted: list[str] = []
    token = _SCRATCH.set(noted)
    try:
        yield
    finally:
        _SCRATCH.reset(token)
        for path in noted:
            remove(spark, path)


def file_system(spark: SparkSession, path: str):
    """Spark's own client of the file system a path names, and the path for it."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def remove(spark: SparkSession, path: str) -> None:
    """Delete a file or folder, if it is there."""
    system, place = file_system(spark, path)
    system.delete(place, True)


def read_text(spark: SparkSession, path: str) -> str:
    """A small text file, such as an index."""
    system, place = file_system(spark, path)
    stream = system.open(place)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def local_frame(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    """A driver-made table: settings, specs and the like, never data.

    It goes in as an Arrow table, so Spark keeps it as a local relation of known
    size and decides by itself whether that size may be broadcast.
    """
    struct = T.StructType.fromDDL(schema)
    arrow = to_arrow_schema(struct)
    columns = list(zip(*rows)) or [()] * len(struct.fields)
    table = pa.table(
        [pa.array(list(values), field.type) for values, field in zip(columns, arrow)], schema=arrow
    )
    return spark.createDataFrame(table, struct)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, on whichever file system it names.

    Spark's own binary file source lists it, so no file-system client is needed.
    """
    try:
        spark.read.format("binaryFile").load(path).select("path").limit(1).collect()
        return True
    except Exception as err:  # the analysis error class differs by file system
        if "PATH_NOT_FOUND" in str(err) or "FileNotFound" in str(err):
            return False
        raise
