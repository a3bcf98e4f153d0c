"""Table catalogues: type, nullability and default of every column a mask may name."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession, types as T

from ..session import local_frame

CATALOG_SCHEMA = (
    "schema string, table string, column string, data_type string,"
    " is_nullable boolean, column_default string, whole_digits int"
)

# Names the source database gives to the types Spark reads.
_TYPE_NAMES = {
    T.ByteType: "smallint",
    T.ShortType: "smallint",
    T.IntegerType: "integer",
    T.LongType: "bigint",
    T.FloatType: "real",
    T.DoubleType: "double precision",
    T.DecimalType: "numeric",
    T.StringType: "text",
    T.VarcharType: "character varying",
    T.CharType: "character",
    T.BinaryType: "bytea",
    T.ArrayType: "ARRAY",
    T.DateType: "date",
    T.TimestampNTZType: "timestamp without time zone",
    T.TimestampType: "timestamp with time zone",
    T.BooleanType: "boolean",
    T.VariantType: "jsonb",
    T.DayTimeIntervalType: "interval",
}


def type_name(dtype: T.DataType) -> str:
    return _TYPE_NAMES.get(type(dtype), "USER-DEFINED")


def catalog_rows(
    df: DataFrame,
    schema: str,
    table: str,
    types: Mapping[str, str] | None = None,
    defaults: Mapping[str, str] | None = None,
    not_null: tuple[str, ...] = (),
) -> list[tuple]:
    """Catalogue rows of one table. ``types`` names what Spark's type cannot tell, such as json.

    ``whole_digits`` is what a decimal holds before its point; NULL where nothing bounds it.
    """
    types, defaults = types or {}, defaults or {}
    return [
        (
            schema, table, field.name,
            types.get(field.name, type_name(field.dataType)),
            field.nullable and field.name not in not_null,
            defaults.get(field.name),
            field.dataType.precision - field.dataType.scale if isinstance(field.dataType, T.DecimalType) else None,
        )
        for field in df.schema.fields
    ]


def catalog_frame(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    return local_frame(spark, rows, CATALOG_SCHEMA)
