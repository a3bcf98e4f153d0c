"""How registered queries read the driver's tables.

An input is one SQL text both Spark and the checking engine accept, with tables
in braces. It only shapes the given tables into the operator's input; what the
operator does is written separately on either side.
"""

from __future__ import annotations

from string import Formatter

from pyspark.sql import DataFrame, SparkSession

SECRET = "not-a-real-secret"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _names(sql: str) -> set[str]:
    return {name for _, name, _, _ in Formatter().parse(sql) if name}


def derive(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """Run an input text over the given tables."""
    return spark.sql(sql, **{name: table(spark, sf_dir, name) for name in _names(sql)})


def plain(sql: str) -> str:
    """The same text for an engine that knows the tables by name."""
    return sql.format(**{name: name for name in _names(sql)})


def draw_sql(column: str, key: str, number: str | int = 0, secret: str = SECRET) -> str:
    """A keyed draw of ``schema.table.column``, in the checking engine's SQL."""
    digest = digest_sql(column, key, number, secret)
    return f"('0x' || substr({digest}, 1, 13))::BIGINT"


def digest_sql(column: str, key: str, number: str | int = 0, secret: str = SECRET) -> str:
    return f"md5(concat_ws('|', sha256('{secret}|{column}'), {key}, ({number})::VARCHAR))"


def unit_sql(draw: str) -> str:
    return f"(({draw})::DOUBLE / 4503599627370496.0::DOUBLE)"


def list_sql(words: list[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"
