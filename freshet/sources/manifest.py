"""Mask manifests: JSON documents that say which columns and tables to hide, and how."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.expressions import base_version
from ..functions.masks import parse_range
from ..session import exists, local_frame

VERSION_PLACEHOLDER = "{version}"


def _is_text(value: F.Column) -> F.Column:
    return F.schema_of_variant(value) == "STRING"


def _member(value: F.Column, path: str) -> F.Column:
    return F.try_variant_get(value, path, "variant")


def _text(value: F.Column) -> F.Column:
    """A JSON string as text; any other JSON value is none."""
    return F.when(_is_text(value), F.variant_get(value, "$", "string"))


def _masking(node: F.Column) -> F.Column:
    return F.coalesce(
        _member(node, "$.config.meta.masking"), _member(node, "$.meta.masking")
    )


def _kind(masking: F.Column) -> F.Column:
    return F.coalesce(_text(masking), _text(_member(masking, "$.kind")))


def _members(node: F.Column, path: str) -> F.Column:
    """The members of a JSON object as an array, in the order of their names; none for other values."""
    return F.map_entries(F.try_variant_get(node, path, "map<string,variant>"))


def flatten_manifests(manifests: DataFrame, doc: str = "doc") -> DataFrame:
    """Column and table masks of many manifests, one row each.

    Adds ``schema, table, column, kind, range, seq``; ``column`` is NULL for a
    table mask, and ``seq`` gives the order masks apply in within one manifest.
    All other input columns ride along. Each manifest is read once, where it is.
    """
    kept = [c for c in manifests.columns if c != doc]
    sources = manifests.select(
        *kept, F.posexplode(_members(F.parse_json(F.col(doc)), "$.sources")).alias("_at", "_source")
    )
    named = sources.select(
        *kept, "_at", F.col("_source.value").alias("_node"),
        _text(_member(F.col("_source.value"), "$.schema")).alias("schema"),
        _text(_member(F.col("_source.value"), "$.name")).alias("table"),
    ).where(F.col("schema").isNotNull() & F.col("table").isNotNull())

    own = F.struct(
        F.lit(None).cast("string").alias("column"), F.lit(-1).alias("_place"), _masking(F.col("_node")).alias("_mask")
    )
    columns = F.transform(
        _members(F.col("_node"), "$.columns"),
        lambda e, at: F.struct(e["key"].alias("column"), at.alias("_place"), _masking(e["value"]).alias("_mask")),
    )
    entries = F.when(columns.isNull(), F.array(own)).otherwise(F.concat(F.array(own), columns))
    masks = named.select(*kept, "schema", "table", "_at", F.inline(entries))
    return masks.select(
        *kept, "schema", "table", "column",
        _kind(F.col("_mask")).alias("kind"),
        F.when(
            F.col("column").isNotNull(), parse_range(_text(_member(F.col("_mask"), "$.range")))
        ).alias("range"),
        F.struct(F.col("_at").alias("source"), F.col("_place").alias("column")).alias("seq"),
    ).where(F.col("kind").isNotNull())


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """The masks of one manifest file."""
    return flatten_manifests(spark.read.text(path, wholetext=True).withColumnRenamed("value", "doc"))


def manifest_from_text(spark: SparkSession, text: str) -> DataFrame:
    return flatten_manifests(local_frame(spark, [(text,)], "doc string"))


@dataclass(frozen=True)
class ManifestSpec:
    """Where a manifest lives. Pin ``version`` or ask for it with ``version_query``."""

    path: str
    version: str | None = None
    version_query: str | None = None
    fallback_to_base: bool = False

    def check(self) -> None:
        templated = VERSION_PLACEHOLDER in self.path
        versioned = self.version is not None or self.version_query is not None
        if self.version is not None and self.version_query is not None:
            raise ValueError("give a version or a version query, not both")
        if templated and not versioned:
            raise ValueError(f"the path has {VERSION_PLACEHOLDER} but no version is given")
        if versioned and not templated:
            raise ValueError(f"a version is given but the path has no {VERSION_PLACEHOLDER}")


def resolve_version(spark: SparkSession, spec: ManifestSpec) -> str | None:
    """The pinned version, or the first column of the first row of the query."""
    if spec.version is not None or spec.version_query is None:
        return spec.version
    row = spark.sql(spec.version_query).first()
    if row is None:
        raise LookupError("the version query returned no rows")
    if len(row) == 0 or row[0] is None:
        raise LookupError("the version query returned no value")
    return str(row[0])


def resolve_manifest(spark: SparkSession, spec: ManifestSpec) -> tuple[str | None, DataFrame]:
    """Version and masks of a spec; a patched version may fall back to its base."""
    spec.check()
    version = resolve_version(spark, spec)
    path = spec.path if version is None else spec.path.replace(VERSION_PLACEHOLDER, version)
    if version is not None and spec.fallback_to_base and not exists(spark, path):
        base = spark.range(1).select(base_version(F.lit(version))).first()[0]
        if base is not None:
            path = spec.path.replace(VERSION_PLACEHOLDER, base)
    return version, read_manifest(spark, path)
