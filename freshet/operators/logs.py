"""Job logs: secrets masked, and the part worth keeping picked out.

Logs come as one text per job, or as a table of numbered lines. Over texts
everything is a column expression, so nothing is shuffled; over lines only what
can be in the tail ever leaves a task.
"""

from __future__ import annotations

from collections.abc import Sequence
from urllib.parse import quote

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.expressions import head_bytes, tail_bytes, trimmed
from ..functions.globs import any_of

# Fixed values.
REDACTED = "[redacted]"
KEEP_LINES = 40
MAX_BYTES = 2000
MAX_HEADLINE_BYTES = 500
ERROR_MARKERS = [
    "Error:",
    "ERROR:",
    "error:",
    "Error [",
    "DatabaseError",
    "SequelizeDatabaseError",
    "Database Error in",
    "Compilation Error in",
    "Runtime Error in",
    "Failure in model",
]

#: Terminal sequences: CSI, OSC, the other strings, two-character escapes, and
#: the control characters other than line breaks.
ANSI = (
    r"\x1b\[[0-?]*[ -/]*[@-~]"
    r"|\x1b\][^\x07\x1b]*(?:\x07|\x1b\\)"
    r"|\x1b[PX^_][^\x1b]*\x1b\\"
    r"|\x1b[ -/]*[0-~]"
    r"|[\x00-\x09\x0b-\x1f]"
)


def encoded_forms(secret: str) -> list[str]:
    """A secret as it is and in the two ways a URL carries it, without repeats."""
    strict = "".join(
        chr(b) if chr(b).isascii() and chr(b).isalnum() else f"%{b:02X}" for b in secret.encode()
    )
    return list(dict.fromkeys([secret, strict, quote(secret, safe="-._~")]))


def redact(log: Column, secrets: Sequence[str] | None, last_bytes: int | None = None) -> Column:
    """A whole log, plain, with every secret blotted out in one pass, however many there are.

    Of secrets that begin at one place the longest is taken; of two that overlap, the one
    further left. ``last_bytes`` keeps only the end of it, cut after masking, so that no part
    of a secret is left over. Secrets that could not be read (None) withhold the log altogether.
    """
    if secrets is None:
        return F.lit(None).cast("string")
    found = any_of(form for secret in secrets if secret for form in encoded_forms(secret))
    plain = F.regexp_replace(log, ANSI, "")
    if found is not None:
        plain = F.regexp_replace(plain, found, REDACTED)
    return plain if last_bytes is None else tail_bytes(plain, last_bytes)


_MARKER = "(?:" + "|".join("\\Q" + m + "\\E" for m in ERROR_MARKERS) + ")"

#: A line with a marker at its start or after a blank; only ``\n`` ends a line.
ERROR_LINE = r"(?dmU)^(?:[^\S\n]*|.*? )" + _MARKER + ".*$"


def is_error_line(line: Column) -> Column:
    """Whether a line names an error: a marker at its start or after a blank."""
    return line.rlike(ERROR_LINE)


def log_lines(log: Column) -> Column:
    """Lines of a text: no empty one after a last line break."""
    return F.when(log == "", F.array().cast("array<string>")).otherwise(F.split(_body(log), "\n"))


def _body(log: Column) -> Column:
    return F.regexp_replace(F.replace(log, F.lit("\r\n"), F.lit("\n")), r"\n\z", "")


def _fit(df: DataFrame, kept: Sequence[str], tail: str, first: str, outside: str, name: str) -> DataFrame:
    """A tail within its bytes, behind the first error if it does not show that itself.

    Every step is a column of its own, so that no text is searched twice.
    """
    gap = F.lit("\n…\n")
    headline = F.col("_headline")
    steps = df.select(
        *kept, F.col(tail).alias("_tail"),
        F.when(F.col(outside), head_bytes(trimmed(F.col(first)), MAX_HEADLINE_BYTES)).alias("_headline"),
    )
    budget = F.when(headline.isNull(), F.lit(MAX_BYTES)).otherwise(
        MAX_BYTES - F.octet_length(headline) - F.octet_length(gap)
    )
    steps = steps.select(*kept, headline, tail_bytes(F.col("_tail"), budget).alias("_kept"))
    ends = F.col("_kept")
    fitted = F.when(headline.isNull() | ends.contains(headline), ends).otherwise(F.concat(headline, gap, ends))
    return steps.select(*kept, fitted.alias(name))


def log_tail(df: DataFrame, log: str = "log", name: str = "log_tail") -> DataFrame:
    """Replace a log by its last 40 lines in at most 2000 bytes, the first error ahead of them.

    Works on each text where it is: no lines are exploded and nothing is shuffled.
    """
    kept = [c for c in df.columns if c not in (log, name)]
    body = df.select(*kept, _body(F.col(log)).alias("_body"))
    ends = body.withColumn("_tail", F.substring_index("_body", "\n", -KEEP_LINES))
    before = F.left(F.col("_body"), F.char_length("_body") - F.char_length("_tail"))
    found = ends.select(
        *kept, "_tail",
        F.regexp_extract("_body", ERROR_LINE, 0).alias("_first"),
        before.rlike(ERROR_LINE).alias("_earlier"),
    )
    outside = (F.col("_first") != "") & (F.col("_earlier") | (F.octet_length("_tail") > MAX_BYTES))
    return _fit(found.withColumn("_outside", outside), kept, "_tail", "_first", "_outside", name)


def log_tail_lines(
    lines: DataFrame, keys: Sequence[str] = ("job",), number: str = "line_no", text: str = "line"
) -> DataFrame:
    """The same over a table of numbered lines, as ``(…keys, log_tail)``.

    The row number limit is applied in every map task before the shuffle, so a
    job with most of the lines still sends 40 per task; the first error is
    folded the same way.
    """
    at, line = F.col(number), F.col(text)
    last = Window.partitionBy(*keys).orderBy(at.desc())
    ends = lines.withColumn("_from_end", F.row_number().over(last)).where(F.col("_from_end") <= KEEP_LINES)
    tails = ends.groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.struct(at.alias("at"), line.alias("line")))).alias("_lines")
    ).select(
        *keys,
        F.get("_lines", F.lit(0))["at"].alias("_start"),
        F.array_join(F.transform("_lines", lambda e: e["line"]), "\n").alias("_tail"),
    )
    firsts = lines.where(is_error_line(line)).groupBy(*keys).agg(
        F.min(F.struct(at.alias("at"), line.alias("line"))).alias("_error")
    )
    joined = tails.join(firsts, list(keys), "left")
    outside = F.col("_error").isNotNull() & (
        (F.col("_error.at") < F.col("_start")) | (F.octet_length("_tail") > MAX_BYTES)
    )
    staged = joined.select(*keys, "_tail", F.col("_error.line").alias("_first"), outside.alias("_outside"))
    return _fit(staged, keys, "_tail", "_first", "_outside", name="log_tail")
