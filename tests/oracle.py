"""Compare a registered query with its SQL over the same tables."""

from __future__ import annotations

import datetime as dt
import decimal
import glob
import math
import os


def connect(sf_dir):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def plain(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, (int, float, decimal.Decimal)):
        if isinstance(value, float) and math.isnan(value):
            return "nan"
        return float(value) if not isinstance(value, int) or abs(value) < 2**53 else value
    if isinstance(value, (dt.datetime,)):
        return value.replace(tzinfo=None)
    if isinstance(value, (bytes, bytearray)):
        return bytes(value)
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


FAMILIES = {
    "tinyint": "int", "smallint": "int", "integer": "int", "int": "int", "bigint": "int", "hugeint": "int",
    "double": "double", "float": "double", "string": "text", "varchar": "text", "boolean": "bool",
    "date": "date", "timestamp": "timestamp", "timestamp_ntz": "timestamp", "timestamp_ns": "timestamp",
}


def family(type_name):
    name = type_name.lower()
    if name.startswith("decimal"):
        return "decimal"
    return FAMILIES.get(name, name)


def compare(spark_df, con, sql):
    """None if equal, else a short description of the first difference."""
    columns = sorted(spark_df.columns)
    relation = con.sql(sql)
    if sorted(relation.columns) != columns:
        return f"columns {columns} vs {sorted(relation.columns)}"
    spark_types = {n: family(t) for n, t in spark_df.dtypes}
    sql_types = {n: family(str(t)) for n, t in zip(relation.columns, relation.types)}
    wrong = {c: (spark_types[c], sql_types[c]) for c in columns if spark_types[c] != sql_types[c]}
    picked = ", ".join('"' + c + '"' for c in columns)
    right = [tuple(plain(v) for v in row) for row in con.sql(f"SELECT {picked} FROM ({sql})").fetchall()]
    left = [tuple(plain(v) for v in row) for row in spark_df.select(*[f"`{c}`" for c in columns]).collect()]
    if len(left) != len(right):
        return f"{len(left)} rows vs {len(right)}"

    def order(row):
        return tuple((v is None, str(type(v)), str(v)) for v in row)

    for a, b in zip(sorted(left, key=order), sorted(right, key=order)):
        if a != b:
            return f"first difference in {columns}:\n  spark {str(a)[:700]}\n  sql   {str(b)[:700]}"
    if wrong:
        return f"types {wrong}"
    return None
