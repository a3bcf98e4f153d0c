"""Scalar column expressions shared by the operators. No Python runs per row."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

# Fixed values.
KNOWN_RANKS = ["production", "clone", "demo", "test", "dev"]
RESERVED_SCHEMAS = ["public", "information_schema"]
SYSTEM_DATABASES = ["postgres", "template0", "template1"]
PATH_SAFE_VERSION = r"^[A-Za-z0-9][A-Za-z0-9.+-]*$"
UUID_TEXT = (
    r"^(?:[0-9a-fA-F]{32}"
    r"|[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12})$"
)
BINARY_UNITS = {
    "Ki": 1 << 10, "Mi": 1 << 20, "Gi": 1 << 30, "Ti": 1 << 40, "Pi": 1 << 50, "Ei": 1 << 60,
}
DECIMAL_UNITS = {
    "k": 10**3, "M": 10**6, "G": 10**9, "T": 10**12, "P": 10**15, "E": 10**18,
}
WHITE_SPACE = (
    " \t\n\x0b\x0c\r\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
FAILED_PHASE = r"(?s)^failed:(.*)$"

GIB = 1 << 30
U32_MAX = (1 << 32) - 1


def unix_path(path: Column) -> Column:
    """``D:\\Full`` to ``/D/Full``; Unix paths as they are."""
    slashed = F.replace(path, F.lit("\\"), F.lit("/"))
    return F.regexp_replace(slashed, r"^([A-Za-z]):", "/$1")


def slug(text: Column) -> Column:
    """A label-safe name: ASCII letters and digits, runs of the rest as one ``-``."""
    dashed = F.regexp_replace(text, r"[^A-Za-z0-9]+", "-")
    lowered = F.lower(F.regexp_replace(dashed, r"^-+|-+$", ""))
    named = F.when(lowered == "", F.lit("replica")).otherwise(lowered)
    return F.regexp_replace(F.substring(named, 1, 50), r"-+$", "")


def base_version(version: Column) -> Column:
    """``major.minor.0`` of a patched version; NULL when there is none to go back to."""
    def number(position: int) -> Column:
        digits = F.regexp_extract(version, r"^[^.]*\.\+?(\d+)\.\+?(\d+)$", position)
        # A run of digits too long even for decimal(38) casts to NULL: it is over u32 as well.
        value = digits.try_cast("decimal(38,0)")
        return F.when(value <= U32_MAX, value.cast("bigint"))

    minor, patch = number(1), number(2)
    major = F.substring_index(version, ".", 1)
    return F.when(
        minor.isNotNull() & (patch != 0),
        F.concat(major, F.lit("."), minor.cast("string"), F.lit(".0")),
    )


def safe_version(version: Column) -> Column:
    """Whether a version text may stand in a path."""
    return version.rlike(PATH_SAFE_VERSION) & ~version.contains("\n")


def known_rank(rank: Column) -> Column:
    return rank.isin(KNOWN_RANKS)


def droppable_schema(schema: Column) -> Column:
    """Whether a schema may be dropped at all."""
    return ~schema.isin(RESERVED_SCHEMAS) & ~schema.startswith("pg_")


def quote_name(name: Column) -> Column:
    """Back-tick quoting, the form Spark reads identifiers in."""
    return F.concat(F.lit("`"), F.replace(name, F.lit("`"), F.lit("``")), F.lit("`"))


def quote_identifier(name: str) -> str:
    """Driver-side twin of :func:`quote_name` for building select lists."""
    return "`" + name.replace("`", "``") + "`"


def trimmed(text: Column) -> Column:
    """Trim every kind of white space, not only blanks."""
    return F.btrim(text, F.lit(WHITE_SPACE))


def comma_list(text: Column, separator: str = ",") -> Column:
    """Items of a separated list, trimmed, blanks left out."""
    items = F.transform(F.split(text, "\\Q" + separator + "\\E"), trimmed)
    return F.filter(items, lambda item: item != "")


def quantity_bytes(text: Column) -> Column:
    """Bytes of a quantity text such as ``2Ti``, ``1.5G`` or ``1024``; NULL if it is none."""
    number = F.regexp_extract(text, r"^([+-]?\d+(?:\.\d*)?|[+-]?\.\d+)([A-Za-z]*)$", 1)
    suffix = F.regexp_extract(text, r"^([+-]?\d+(?:\.\d*)?|[+-]?\.\d+)([A-Za-z]*)$", 2)
    factors = {"": 1, **DECIMAL_UNITS, **BINARY_UNITS}
    factor = reduce(
        lambda chain, unit: chain.when(suffix == unit, F.lit(factors[unit]).cast("decimal(19,0)")),
        list(factors)[1:],
        F.when(suffix == "", F.lit(1).cast("decimal(19,0)")),
    )
    return (number.try_cast("decimal(18,3)") * factor).cast("decimal(38,3)")


def ceil_units(size: Column, unit: str) -> Column:
    """Whole units that hold a number of bytes."""
    return F.ceil(size / F.lit(BINARY_UNITS[unit]).cast("decimal(19,0)")).cast("bigint")


def readiness_budget(explicit: Column, snapshot_bytes: Column, default_seconds: int) -> Column:
    """Seconds a copy may take to become ready: 900 more per 100 GiB, unless set outright."""
    extra = F.floor(snapshot_bytes / F.lit(100.0 * GIB) * F.lit(900.0)).cast("bigint")
    derived = F.lit(default_seconds).cast("bigint") + F.coalesce(extra, F.lit(0))
    return F.coalesce(
        explicit.cast("bigint"), F.greatest(derived, F.lit(default_seconds).cast("bigint"))
    )


def uuid_text(text: Column) -> Column:
    """Whether a text is a UUID, with or without its hyphens."""
    return text.rlike(UUID_TEXT)


def failed_reason(phase: Column) -> Column:
    """The reason of a ``failed: …`` phase, NULL for every other phase."""
    return F.when(phase.startswith("failed:"), trimmed(F.regexp_extract(phase, FAILED_PHASE, 1)))


def seconds_between(start: Column, end: Column, as_of: Column) -> Column:
    """Whole seconds from start to end, or to ``as_of`` while it runs; never negative."""
    finish = F.coalesce(end, as_of)
    # unix_micros keeps the fraction, so 1.9 s counts as 1 and not as 2.
    elapsed = F.call_function("div", F.unix_micros(finish) - F.unix_micros(start), F.lit(1_000_000))
    return F.greatest(elapsed, F.lit(0).cast("bigint"))


def tail_bytes(text: Column, keep: Column | int) -> Column:
    """At most the last ``keep`` bytes, moved on to the next character border."""
    keep = F.lit(keep) if isinstance(keep, int) else keep
    raw = F.encode(text, "UTF-8")
    cut = F.hex(F.substring(raw, F.octet_length(text) - keep + 1, keep))
    whole = F.unhex(F.regexp_replace(cut, r"^(?:[89AB][0-9A-F])+", ""))
    return F.when(F.octet_length(text) <= keep, text).otherwise(
        F.when(keep <= 0, F.lit("")).otherwise(F.decode(whole, "UTF-8"))
    )


def head_bytes(text: Column, keep: int) -> Column:
    """At most the first ``keep`` bytes, moved back to the last character border."""
    raw = F.encode(text, "UTF-8")
    cut = F.hex(F.substring(raw, 1, keep))
    after = F.hex(F.substring(raw, keep + 1, 1))
    # A continuation byte right behind the cut means the last character was split.
    split = after.rlike("^[89AB]")
    whole = F.when(split, F.regexp_replace(cut, r"[C-F][0-9A-F](?:[89AB][0-9A-F])*$", "")).otherwise(cut)
    return F.when(F.octet_length(text) <= keep, text).otherwise(F.decode(F.unhex(whole), "UTF-8"))
