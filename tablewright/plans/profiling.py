"""The profile: shape, gaps, cardinality, numbers, categories, target and health."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.report import local_rows, settled
from ..functions.schema import flat_columns, numeric_columns
from ..functions.statistics import Statistics, half_up
from ..operators.frequency import duplicate_rows, most_least_frequent, top_values, value_frequencies
from ..operators.missing import missing_overall
from ..operators.numeric import numeric_report, want_numbers
from ..operators.target import target_analysis, target_warnings, want_target
from ..operators.typing import ColumnType, infer_types, types_by_class, want_types

PROFILE_SCHEMA = "section string, column string, metric string, value double, detail string"
# Where a health warning starts, and what each one costs.
CRITICAL_ROWS, FEW_ROWS = 100, 1000
CRITICAL_MISSING_PCT, MODERATE_MISSING_PCT = 30.0, 10.0
DUPLICATE_PCT = 5.0
WARNING_COST = 10


@dataclass
class Profile:
    report: DataFrame
    warnings: list[str]
    health_score: int


def _spread(df: DataFrame, section: str, metrics: list[str], column: str | None = "column") -> DataFrame:
    """Turn a wide report into ``(section, column, metric, value, detail)`` rows."""
    name = F.lit(None).cast("string") if column is None else F.col(column)
    cells = F.array(
        *[
            F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value"))
            for m in metrics
        ]
    )
    return df.select(
        F.lit(section).alias("section"), name.alias("column"), F.inline(cells)
    ).withColumn("detail", F.lit(None).cast("string"))


def health_warnings(
    rows: int,
    columns: int,
    missing_pct: float,
    duplicate_pct: float,
    has_target: bool,
    target_warnings: list[str],
) -> list[str]:
    out = []
    if rows < CRITICAL_ROWS:
        out.append("critical_few_rows")
    elif rows < FEW_ROWS:
        out.append("few_rows")
    if missing_pct > CRITICAL_MISSING_PCT:
        out.append("critical_missing")
    elif missing_pct > MODERATE_MISSING_PCT:
        out.append("moderate_missing")
    if duplicate_pct > DUPLICATE_PCT:
        out.append("duplicates")
    if columns - (1 if has_target else 0) > rows:
        out.append("more_features_than_rows")
    return out + target_warnings


def health_score(df: DataFrame, target: str | None = None) -> DataFrame:
    """``(rows, missing_pct, duplicate_pct, n_warnings, health_score)`` in one row."""
    gaps = missing_overall(df).first()
    twice = duplicate_rows(df).first()
    marks = []
    known = target is not None and target in df.columns
    if known:
        stats = Statistics(df)
        want_target(stats, target)
        marks = target_warnings(stats.collect(), target)
    found = health_warnings(
        twice["n_rows"],
        len(df.columns),
        gaps["total_missing_pct"],
        twice["duplicate_pct"],
        target is not None,
        marks,
    )
    score = max(0, 100 - WARNING_COST * len(found))
    rows = [
        (twice["n_rows"], gaps["total_missing_pct"], twice["duplicate_pct"], len(found), score)
    ]
    return local_rows(
        df,
        rows,
        "rows bigint, missing_pct double, duplicate_pct double, n_warnings bigint,"
        " health_score bigint",
    )


def _categories(df: DataFrame, names: list[str]) -> list[tuple]:
    """The most and least frequent values of each column: one shuffle of values, whose counts are kept for both reads."""
    counted = value_frequencies(df, names).persist()
    try:
        out = []
        for r in most_least_frequent(df, names, counted).collect():
            for end in ("most_frequent", "least_frequent"):
                out.append(("category", r["column"], end, float(r[f"{end}_count"]), r[end]))
        for r in top_values(df, names, frequencies=counted).collect():
            out.append(("category", r["column"], f"top_{r['position']}", float(r["n"]), r["value"]))
        return out
    finally:
        counted.unpersist()


def profile(
    df: DataFrame, target: str | None = None, types: list[ColumnType] | None = None
) -> Profile:
    """Describe every column and the table.

    Types, gaps, numbers and sketches come from one aggregate; distinct counts and the
    target's balance from one shuffle of values; then the quantiles are finished, categories
    are counted as text, and whole rows are shuffled once for duplicates.  Persist the
    input where it is not a plain scan.
    """
    known = target is not None and target in df.columns
    flat, numbers = flat_columns(df), numeric_columns(df)
    stats = Statistics(df)
    stats.want_presence()
    stats.want_values(flat)
    want_numbers(stats, numbers)
    if types is None:
        want_types(stats, df.columns)
    if known:
        want_target(stats, target)
    stats.collect()
    types = types if types is not None else infer_types(df, stats=stats)
    by_class = types_by_class(types)
    rows, width = stats.rows, len(df.columns)
    total = sum(stats.missing(c) for c in df.columns)
    missing_pct = half_up(total * 100.0 / (rows * width), 2) if rows and width else 0.0
    twice = duplicate_rows(df).first()
    facts: list[tuple] = [
        ("table", None, "rows", float(rows), None),
        ("table", None, "columns", float(width), None),
        ("table", None, "missing_count", float(total), None),
        ("table", None, "missing_pct", missing_pct, None),
        ("table", None, "duplicates", float(twice["duplicates"]), None),
        ("table", None, "duplicate_pct", twice["duplicate_pct"], None),
    ]
    facts += [("types", None, k, float(len(v)), None) for k, v in by_class.items()]
    facts += [("schema", t.column, "physical_type", None, t.physical_type) for t in types]
    for c in df.columns:
        share = half_up(stats.missing(c) * 100.0 / rows, 2) if rows else None
        facts += [("missing", c, "missing_count", float(stats.missing(c)), None), ("missing", c, "missing_pct", share, None)]
    for c in flat:
        n = stats.distinct(c)
        ratio = half_up(n / rows, 4) if rows else None
        facts += [("cardinality", c, "n_distinct", float(n), None), ("cardinality", c, "ratio", ratio, None)]
    if by_class["categorical"]:
        facts += _categories(df, by_class["categorical"])
    parts = []
    if by_class["numeric"]:
        found = settled(numeric_report(df, by_class["numeric"], stats=stats))
        health = ["zeros", "negatives", "infinites", "iqr"]
        form = ["skewness", "kurtosis"]
        other = {"column", "lowest", "highest", *health, *form}
        parts.append(_spread(found, "numeric", [c for c in found.columns if c not in other]))
        parts.append(_spread(found, "health", health))
        parts.append(_spread(found, "shape", form))
    marks: list[str] = []
    if known:
        judged = target_analysis(df, target, stats)
        marks = target_warnings(stats, target)
        parts.append(
            judged.select(
                F.lit("target").alias("section"),
                F.lit(target).alias("column"),
                "metric",
                "value",
                "detail",
            )
        )
    found_warnings = health_warnings(rows, width, missing_pct, twice["duplicate_pct"], target is not None, marks)
    score = max(0, 100 - WARNING_COST * len(found_warnings))
    facts += [("warning", None, w, None, None) for w in found_warnings]
    facts.append(("table", None, "health_score", float(score), None))
    report = local_rows(df, facts, PROFILE_SCHEMA)
    for p in parts:
        report = report.unionByName(p)
    return Profile(report, found_warnings, score)
