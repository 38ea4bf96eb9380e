"""Is the wanted column there, and if not, which ones come close?"""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..functions.report import local_rows


def check_target(df: DataFrame, target: str) -> DataFrame:
    """``(column, is_match, is_suggestion)`` from the header alone."""
    wanted = target.strip()
    found = wanted in df.columns
    rows = [
        (c, c == wanted, not found and wanted.lower() in c.lower())
        for c in df.columns
    ]
    return local_rows(df, rows, "column string, is_match boolean, is_suggestion boolean")
