"""Mask kinds as column expressions, and the registry users add their own to.

A kind is built from the column it hides, what the catalogue knows about it and
keyed draws. Every kind is a plain expression: a masked table is one projection
over its scan, inside whole-stage code, with no shuffle and no Python.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, functions as F, types as T

from . import draws, wordlists

# Type names of the source database, by what a mask may write.
NUMERIC_TYPES = [
    "smallint", "integer", "bigint", "real", "double precision", "numeric", "decimal",
]
TEXT_TYPES = ["character varying", "character", "text", "citext"]
BINARY_TYPES = ["bytea"]
JSON_TYPES = ["json", "jsonb"]
ARRAY_TYPE = "ARRAY"
TIME_TYPES = ["date", "timestamp without time zone", "timestamp with time zone"]

# Ranges a kind draws from when the manifest gives none.
DEFAULT_RANGES = {
    "integer": (-2147483648.0, 2147483647.0),
    "float": (0.0, 1.0),
    "money": (0.0, 10000.0),
}

# Largest magnitude a whole-number column holds.
WHOLE_LIMITS = {"smallint": 2**15, "integer": 2**31, "bigint": 2**63}

EPOCH_DATE = dt.date(1900, 1, 1)


@dataclass(frozen=True)
class MaskContext:
    """What a kind may use to hide one column."""

    col: Column
    dtype: T.DataType
    data_type: str
    key: str
    row: Column
    range: tuple[float, float] | None = None
    default: str | None = None
    as_of: dt.date = dt.date(2026, 1, 1)
    staged: draws.Staged = field(default_factory=draws.Staged)

    def draw(self, number: int = 0) -> Column:
        """Draw ``number`` of the row for this column, computed once however often it is used."""
        return self.staged.column(
            ("draw", self.key, number), lambda: draws.draw(self.key, self.row, number)
        )

    def bounds(self, kind: str) -> tuple[float, float]:
        return self.range or DEFAULT_RANGES[kind]

    @property
    def family(self) -> str:
        return type_family(self.data_type)


@dataclass(frozen=True)
class MaskKind:
    """A registered kind: its expression, what it writes, and how it treats NULL."""

    name: str
    build: Callable[[MaskContext], Column]
    writes: str = "text"
    keeps_null: bool = True


def type_family(data_type: str) -> str:
    if data_type in NUMERIC_TYPES:
        return "numeric"
    if data_type in TEXT_TYPES:
        return "text"
    return "binary" if data_type in BINARY_TYPES else "other"


#: What each kind writes can be assigned to these column types only.
ASSIGNABLE = {
    "text": TEXT_TYPES,
    "date": TIME_TYPES + TEXT_TYPES,
    "time": TIME_TYPES,
    "whole": NUMERIC_TYPES + TEXT_TYPES,
    "number": NUMERIC_TYPES + TEXT_TYPES,
    "any": None,
}

_KINDS: dict[str, MaskKind] = {}


def register_mask(
    name: str,
    build: Callable[[MaskContext], Column],
    writes: str = "text",
    keeps_null: bool = True,
) -> None:
    """Add a mask kind, or replace one. ``build`` must return a column expression."""
    if writes not in ASSIGNABLE:
        raise ValueError(f"writes must be one of {sorted(ASSIGNABLE)}")
    _KINDS[name] = MaskKind(name, build, writes, keeps_null)


def mask_kinds() -> dict[str, MaskKind]:
    return dict(_KINDS)


def _date(ctx: MaskContext) -> Column:
    days = (ctx.as_of - EPOCH_DATE).days + 1
    return F.date_add(F.lit(EPOCH_DATE), (ctx.draw() % days).cast("int"))


def _datetime(ctx: MaskContext) -> Column:
    second = F.floor(draws.unit(ctx.draw()) * 86400).cast("int")
    zero = F.lit(0)
    day = F.date_trunc("day", ctx.col)
    if isinstance(ctx.dtype, T.TimestampNTZType):
        # date_trunc answers in the session zone; keep the wall-clock type.
        day = F.date_trunc("day", ctx.col).cast("timestamp_ntz")
    return day + F.make_dt_interval(zero, zero, zero, second.cast("decimal(18,6)"))


def _text(ctx: MaskContext) -> Column:
    lorem = wordlists.LOREM
    length = F.char_length(ctx.col)
    offset = (ctx.draw() % len(lorem)).cast("int")
    copies = F.ceil((length + offset) / F.lit(len(lorem))).cast("int")
    return F.substring(F.repeat(F.lit(lorem), copies), offset + 1, length)


def _string(ctx: MaskContext) -> Column:
    length = F.char_length(ctx.col)
    last = F.greatest(F.ceil(length / F.lit(32)).cast("int") - 1, F.lit(0))
    blocks = F.transform(F.sequence(F.lit(0), last), lambda i: draws.digest(ctx.key, ctx.row, i))
    return F.substring(F.array_join(blocks, ""), F.lit(1), length)


def _first_and_last(ctx: MaskContext) -> tuple[Column, Column, Column]:
    n = ctx.draw()
    rest = draws.part(n, len(wordlists.FIRST_NAMES))
    return (
        draws.pick(wordlists.FIRST_NAMES, n),
        draws.pick(wordlists.LAST_NAMES, rest),
        draws.part(rest, len(wordlists.LAST_NAMES)),
    )


def _email(ctx: MaskContext) -> Column:
    first, last, rest = _first_and_last(ctx)
    return F.concat(
        F.lower(first), F.lit("."), F.lower(last), (rest % 1000).cast("string"), F.lit("@"),
        draws.pick(wordlists.MAIL_DOMAINS, draws.part(rest, 1000)),
    )


def _name(ctx: MaskContext) -> Column:
    first, last, _ = _first_and_last(ctx)
    return F.when(ctx.col.contains(" "), F.concat_ws(" ", first, last)).otherwise(first)


def _phone(ctx: MaskContext) -> Column:
    # Two characters from either end of a text under five would show all of it.
    partial = F.concat(F.substring(ctx.col, 1, 2), F.lit("****"), F.right(ctx.col, F.lit(2)))
    return F.when(F.char_length(ctx.col) < 5, F.lit("****")).otherwise(partial)


def _place(ctx: MaskContext) -> Column:
    return draws.pick(wordlists.CITIES, ctx.draw())


def _url(ctx: MaskContext) -> Column:
    tail = F.substring(draws.digest(ctx.key, ctx.row), 1, 8)
    return F.concat(F.lit("https://example.invalid/"), tail)


def _integer(ctx: MaskContext) -> Column:
    low, high = ctx.bounds("integer")
    return (F.floor(draws.unit(ctx.draw()) * F.lit(high - low + 1)) + F.lit(low)).cast("bigint")


def _spread(ctx: MaskContext, kind: str) -> Column:
    low, high = ctx.bounds(kind)
    return draws.unit(ctx.draw()) * F.lit(high - low) + F.lit(low)


def _money(ctx: MaskContext) -> Column:
    return F.round(_spread(ctx, "money").cast("decimal(38,10)"), 2)


def _zero(ctx: MaskContext) -> Column:
    if ctx.family == "binary":
        return F.unhex(F.repeat(F.lit("00"), F.octet_length(ctx.col)))
    if ctx.family == "text":
        return F.repeat(F.lit("0"), F.char_length(ctx.col))
    return F.lit(0)


def _empty(ctx: MaskContext) -> Column:
    if ctx.family == "numeric":
        return F.lit(0)
    if ctx.family == "binary":
        return F.unhex(F.lit(""))
    if ctx.data_type in JSON_TYPES:
        blank = F.lit("{}")
        return F.parse_json(blank) if isinstance(ctx.dtype, T.VariantType) else blank
    if ctx.data_type == ARRAY_TYPE:
        return F.array()
    return F.lit("")


register_mask("date", _date, "date")
register_mask("datetime", _datetime, "time")
register_mask("text", _text)
register_mask("string", _string)
register_mask("email", _email)
register_mask("name", _name)
register_mask("phone", _phone)
register_mask("place", _place)
register_mask("url", _url)
register_mask("integer", _integer, "whole")
register_mask("float", lambda ctx: _spread(ctx, "float"), "number")
register_mask("money", _money, "number")
register_mask("zero", _zero, "any", keeps_null=False)
register_mask("empty", _empty, "any", keeps_null=False)
register_mask("nil", lambda ctx: F.lit(None), "any", keeps_null=False)
register_mask("default", lambda ctx: F.expr(ctx.default), "any", keeps_null=False)


def _assign(value: Column, writes: str, dtype: T.DataType) -> Column:
    """Store a mask's value in the column's own type, the way an UPDATE would."""
    whole = isinstance(dtype, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))
    if writes == "number" and whole:
        # Assignment rounds half away from zero; a plain cast would truncate.
        value = F.round(value.cast("decimal(38,10)"), 0)
    if isinstance(dtype, (T.VarcharType, T.CharType)):
        return value.cast("string")
    return value.cast(dtype)


def mask_expression(kind: str, ctx: MaskContext) -> Column:
    """The value a kind puts in a column, typed as the column."""
    entry = _KINDS[kind]
    value = _assign(entry.build(ctx), entry.writes, ctx.dtype)
    if entry.keeps_null:
        value = F.when(ctx.col.isNotNull(), value)
    return value


def chain(kinds: list[tuple[str, tuple[float, float] | None]], ctx: MaskContext) -> Column:
    """Several masks on one column, each over what the one before it left."""
    for kind, bounds in kinds:
        ctx = replace(ctx, col=mask_expression(kind, replace(ctx, range=bounds)))
    return ctx.col


def parse_range(text: Column) -> Column:
    """``low-high`` split at the last hyphen, as a struct; NULL when it is no range."""
    def bound(position: int) -> Column:
        piece = F.regexp_extract(text, r"(?s)^(.*)-([^-]*)$", position)
        number = r"^[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?$"
        special = r"(?i)^[+-]?(?:inf|infinity|nan)$"
        spelled = F.regexp_replace(F.lower(piece), r"^([+-]?)inf$", "$1infinity")
        spelled = F.regexp_replace(spelled, r"^[+-]?nan$", "nan")
        return F.when(piece.rlike(number) | piece.rlike(special), spelled.try_cast("double"))

    low, high = bound(1), bound(2)
    return F.when(
        low.isNotNull() & high.isNotNull(), F.struct(low.alias("lo"), high.alias("hi"))
    )
