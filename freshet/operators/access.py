"""Who may read what: grants to expand, and objects still open to everyone."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.expressions import comma_list, trimmed

# Fixed values.
READ_PRIVILEGES = [
    "usage on schema", "select on tables", "select on sequences", "default select on tables",
]
RELATION_KINDS = ["r", "v", "m", "S", "f", "p"]
SYSTEM_SCHEMAS = ["pg_catalog", "information_schema"]
DEFAULT_ACL_KINDS = {"r": "tables", "S": "sequences", "f": "functions", "T": "types", "n": "schemas"}


def parse_users(text: Column) -> Column:
    """``name`` and ``name:schema+schema`` items of a comma list, as structs."""
    def user(item: Column) -> Column:
        has = item.contains(":")
        name = F.when(has, trimmed(F.substring_index(item, ":", 1))).otherwise(item)
        rest = F.when(has, F.regexp_replace(item, r"(?s)^[^:]*:", "")).otherwise(F.lit(""))
        return F.struct(name.alias("name"), F.array_distinct(comma_list(rest, "+")).alias("schemas"))

    return F.transform(comma_list(text), user)


def clean_users(replicas: DataFrame, users: str = "users", main_user: str = "main_user", keys: Sequence[str] = ("replica",)) -> DataFrame:
    """One row per extra user: trimmed, no blank or main user, the first of each name.

    A user list is one replica's setting, so picking first names works on the
    array itself and shuffles nothing.
    """
    tidy = F.transform(
        F.col(users),
        lambda u: F.struct(
            trimmed(u["name"]).alias("name"),
            F.array_distinct(F.filter(F.transform(u["schemas"], trimmed), lambda s: s != "")).alias("schemas"),
        ),
    )
    kept = replicas.withColumn(
        "_users", F.filter(tidy, lambda u: (u["name"] != "") & ~u["name"].eqNullSafe(F.col(main_user)))
    ).withColumn("_names", F.transform("_users", lambda u: u["name"]))
    firsts = F.filter(
        F.col("_users"), lambda u, at: F.array_position(F.col("_names"), u["name"]) == at.cast("bigint") + 1
    )
    return kept.select(*keys, F.posexplode(firsts).alias("position", "u")).select(
        *keys, "position", "u.name", "u.schemas"
    )


def expand_grants(users: DataFrame, catalog: DataFrame, keys: Sequence[str] = ("replica",)) -> DataFrame:
    """Grants per database, user, schema and privilege, where the schema exists.

    ``catalog`` has ``(…keys, database, schema)`` of connectable databases.
    """
    wanted = users.select(*keys, F.col("name").alias("user"), F.explode("schemas").alias("schema"))
    there = catalog.where(F.col("database") != "template0").select(*keys, "database", "schema").distinct()
    granted = wanted.join(there, [*keys, "schema"])
    return granted.select(
        *keys, "database", "user", "schema",
        F.explode(F.array(*[F.lit(p) for p in READ_PRIVILEGES])).alias("privilege"),
    )


def _own_schema(schema: Column) -> Column:
    return ~schema.isin(SYSTEM_SCHEMAS) & ~schema.startswith("pg_toast") & ~schema.startswith("pg_temp")


def public_exposure(
    schemas: DataFrame, relations: DataFrame, routines: DataFrame, defaults: DataFrame
) -> DataFrame:
    """What is still open to everyone: ``kind, schema, name`` rows.

    Inputs are exported catalogues, each with ``is_public``: schemas
    ``(schema)``, relations ``(schema, name, relkind)``, routines ``(schema,
    name, prokind)`` and default privileges ``(owner, schema, objtype)``.
    """
    open_schemas = schemas.where(F.col("is_public") & _own_schema(F.col("schema"))).select(
        F.lit("schema").alias("kind"), "schema", F.col("schema").alias("name")
    )
    open_relations = relations.where(
        F.col("is_public") & F.col("relkind").isin(RELATION_KINDS) & _own_schema(F.col("schema"))
    ).select(F.lit("relation").alias("kind"), "schema", "name")
    open_routines = routines.where(F.col("is_public") & ~F.col("schema").isin(SYSTEM_SCHEMAS)).select(
        F.when(F.col("prokind") == "p", "procedure").otherwise("function").alias("kind"), "schema", "name"
    )
    words = F.create_map(*[F.lit(x) for pair in DEFAULT_ACL_KINDS.items() for x in pair])
    open_defaults = defaults.where(
        F.col("is_public") & F.col("objtype").isin(list(DEFAULT_ACL_KINDS))
    ).select(
        F.lit("default privilege").alias("kind"), "schema",
        F.concat(F.col("owner"), F.lit(" on "), words[F.col("objtype")]).alias("name"),
    )
    return open_schemas.unionByName(open_relations).unionByName(open_routines).unionByName(open_defaults)
