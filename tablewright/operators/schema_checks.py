"""Schema report: names, empty, constant and high-cardinality columns, mixed spellings."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.report import local_rows
from ..functions.schema import col, flat_columns, numeric_columns, temporal_columns, text_columns
from ..functions.statistics import Statistics
from ..functions.text import lexical_kind

HIGH_CARDINALITY = 0.8
REPORT_SCHEMA = (
    "check string, severity string, column string, metric string, value double, threshold double"
)


def duplicate_names(df: DataFrame) -> list[str]:
    """Names used more than once; Spark resolves names without regard to case."""
    counts = Counter(c.lower() for c in df.columns)
    return sorted(n for n, k in counts.items() if k > 1)


def want_schema(stats: Statistics) -> None:
    """What :func:`schema_findings` reads."""
    texts = text_columns(stats.df)
    stats.want_presence()
    for c in flat_columns(stats.df):
        stats.want(f"same:{c}", F.coalesce(F.min(col(c)) == F.max(col(c)), F.lit(True)))
    stats.want_values(texts)
    stats.want_marks({c: lexical_kind(col(c)) for c in texts})


def schema_findings(stats: Statistics) -> list[tuple]:
    """Empty, constant and high-cardinality columns, mixed spellings, and what the schema holds."""
    df, total = stats.df, stats.rows
    texts = text_columns(df)
    rows: list[tuple] = []
    for c in df.columns:
        if stats.missing(c) == total:
            rows.append(("all_missing", "error", c, "missing_count", float(total), None))
    for c in flat_columns(df):
        present = stats[f"present:{c}"]
        if present == 0 or stats[f"same:{c}"]:
            rows.append(("constant", "warning", c, "n_distinct", float(present > 0), 1.0))
    for c in texts:
        if total and stats.distinct(c) / total > HIGH_CARDINALITY:
            rows.append(("high_cardinality", "warning", c, "n_distinct", float(stats.distinct(c)), HIGH_CARDINALITY))
        if stats.marked[c].distinct > 1:
            rows.append(("mixed_values", "warning", c, "kinds", float(stats.marked[c].distinct), 1.0))
    kinds = {"total": df.columns, "numeric": numeric_columns(df), "categorical": texts, "datetime": temporal_columns(df)}
    return rows + [("schema_info", "info", None, f"{k}_columns", float(len(v)), None) for k, v in kinds.items()]


def schema_report(df: DataFrame) -> DataFrame:
    """``(check, severity, column, metric, value, threshold)`` rows.

    One aggregate gives the missing counts and the constants; only text columns are
    shuffled, for their distinct counts and spellings.  The report itself is
    bounded by the number of columns.
    """
    twice = duplicate_names(df)
    if twice:
        return local_rows(df, [("duplicate_names", "error", n, "occurrences", None, None) for n in twice], REPORT_SCHEMA)
    stats = Statistics(df)
    want_schema(stats)
    return local_rows(df, schema_findings(stats.collect()), REPORT_SCHEMA)
