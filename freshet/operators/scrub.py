"""Row scrub: drop rows whose value could only be read with a key the copy has not."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

# Fixed value: how an encrypted value is written.
ENCRYPTED_VALUE = r"^S1:[^:]*:[^:]*$"


def scrub_rows(df: DataFrame | None, column: str, pattern: str = ENCRYPTED_VALUE) -> DataFrame | None:
    """Rows whose ``column`` does not match; NULL values stay. No table, nothing to do."""
    if df is None:
        return None
    return df.where(F.coalesce(~F.col(column).rlike(pattern), F.lit(True)))
