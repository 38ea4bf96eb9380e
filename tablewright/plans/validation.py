"""The validation suite: schema, missing data, outliers and target checks in one report."""

from __future__ import annotations

import math
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.numeric import as_double, pairwise_correlation
from ..functions.quantiles import interpolate
from ..functions.report import local_rows
from ..functions.schema import fields, is_numeric, is_text, numeric_columns, temporal_columns
from ..functions.statistics import Statistics, half_up
from ..operators import missing, outliers, target
from ..operators.schema_checks import REPORT_SCHEMA, duplicate_names, schema_findings, want_schema

VERY_SMALL_ROWS = 100
SMALL_ROWS = 1000


class DataValidationError(Exception):
    """Raised when validation fails and the caller asked for that to stop the run."""


@dataclass(frozen=True)
class ValidationConfig:
    column_max_missing_pct: float = missing.COLUMN_MAX_MISSING_PCT
    row_max_missing_pct: float = missing.ROW_MAX_MISSING_PCT
    outlier_method: str = "iqr"
    outlier_threshold: float = outliers.DEFAULT_THRESHOLD
    fail_on_warnings: bool = False

    @classmethod
    def merged(cls, given: dict[str, Any] | ValidationConfig | None) -> ValidationConfig:
        """Defaults with the given keys on top; nested missing thresholds allowed."""
        if given is None:
            return cls()
        if isinstance(given, cls):
            return given
        flat = dict(given)
        flat.update(flat.pop("missing_thresholds", None) or {})
        return replace(cls(), **flat)


@dataclass
class Validation:
    """``report`` has one row per finding; ``status`` is PASS or FAIL."""

    status: str
    report: DataFrame
    errors: list[str] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)

    def status_row(self) -> DataFrame:
        rows = [(self.status, len(self.errors), len(self.warnings))]
        return local_rows(self.report, rows, "status string, errors bigint, warnings bigint")

    def raise_on_failure(self) -> None:
        if self.status == "FAIL":
            raise DataValidationError("; ".join(self.errors))


def size_warnings(rows: int, columns: int, has_target: bool) -> list[tuple]:
    out = []
    if rows < VERY_SMALL_ROWS:
        out.append(("very_small", "warning", None, "n_rows", float(rows), float(VERY_SMALL_ROWS)))
    elif rows < SMALL_ROWS:
        out.append(("small", "warning", None, "n_rows", float(rows), float(SMALL_ROWS)))
    features = columns - (1 if has_target else 0)
    if features > rows:
        out.append(
            ("more_features_than_rows", "warning", None, "n_features", float(features), float(rows))
        )
    return out


def _quantile(points: list[tuple[float, int]], p: float) -> float:
    """Linear interpolation between the ranks of counted values, given in order."""
    place = (sum(n for _, n in points) - 1) * p

    def at(rank: int) -> float:
        for x, n in points:
            if rank < n:
                return x
            rank -= n
        return points[-1][0]

    return interpolate(place, at(math.floor(place)), at(math.ceil(place)))


def _row_shares(stats: Statistics) -> list[tuple[float, int]]:
    """Rows by their share of missing cells, in percent: no more entries than columns plus one."""
    width = max(len(stats.df.columns), 1)
    return sorted((cells * 100.0 / width, n) for cells, n in stats.histogram.items())


def missing_findings(stats: Statistics, config: ValidationConfig) -> list[tuple]:
    """Missing-data findings, statistics included: columns, rows, and columns that miss together."""
    rows, names = stats.rows, stats.df.columns
    share = {c: half_up(stats.missing(c) * 100.0 / rows, 2) if rows else None for c in names}
    out: list[tuple] = []
    limit = config.column_max_missing_pct
    for c, p in share.items():
        if p is not None and p > limit:
            out.append(("column_missing", "error", c, "missing_pct", p, limit))
    shares = _row_shares(stats)
    over = sum(n for x, n in shares if x > config.row_max_missing_pct)
    if rows and over * 100.0 / rows > missing.ROWS_OVER_LIMIT_PCT:
        out.append(
            ("row_missing", "warning", None, "rows_over_pct", half_up(over * 100.0 / rows, 6), missing.ROWS_OVER_LIMIT_PCT)
        )
    for a, b, r in missing.pair_correlations(stats):
        out.append(("missing_together", "warning", f"{a},{b}", "correlation", half_up(r, 6), missing.CO_MISSING_CORRELATION))

    def info(column, metric, value):
        out.append(("missing_stats", "info", column, metric, half_up(value, 6), None))

    total = sum(stats.missing(c) for c in names)
    for c, p in share.items():
        info(c, "missing_pct", p)
    info(None, "total_missing", total)
    info(None, "total_missing_pct", half_up(total * 100.0 / (rows * len(names)), 2) if rows and names else 0.0)
    info(None, "columns_with_missing", sum(1 for p in share.values() if p))
    info(None, "rows_with_missing", sum(n for x, n in shares if x > 0))
    first, second = sum(n * x for x, n in shares), sum(n * x * x for x, n in shares)
    spread = math.sqrt(max((second - first * (first / rows)) / (rows - 1), 0.0)) if rows > 1 else None
    info(None, "row_missing_mean", first / rows if rows else None)
    info(None, "row_missing_std", spread)
    for name, p in (("min", 0.0), ("p25", 0.25), ("p50", 0.5), ("p75", 0.75), ("max", 1.0)):
        info(None, f"row_missing_{name}", _quantile(shares, p) if rows else None)
    return out


def want_leakage(stats: Statistics, name: str) -> None:
    """Correlations of all numbers with a numeric target."""
    if is_numeric(stats.types[name]):
        for c in numeric_columns(stats.df):
            if c != name:
                stats.want(f"with_target:{c}", pairwise_correlation(as_double(c), as_double(name)))


def target_findings(stats: Statistics, name: str) -> list[tuple]:
    """Columns that give the target away, and how its classes are balanced."""
    out: list[tuple] = []
    for c in numeric_columns(stats.df):
        r = stats.get(f"with_target:{c}")
        if r is not None and abs(r) > target.LEAKAGE_CORRELATION:
            out.append(("high_correlation", "warning", c, "correlation", half_up(abs(r), 6), target.LEAKAGE_CORRELATION))
    for c in fields(stats.df, lambda d: isinstance(d, (T.LongType, T.DoubleType))):
        if c != name and stats.rows and stats.distinct(c) / stats.rows > target.ID_RATIO:
            ratio = half_up(stats.distinct(c) / stats.rows, 6)
            out.append(("id_like", "warning", c, "unique_ratio", ratio, target.ID_RATIO))
    out += [("datetime", "warning", c, None, None, None) for c in temporal_columns(stats.df)]
    if is_text(stats.types[name]) or stats.distinct(name) <= target.MAX_CLASSES:
        b = target.balance_of(stats.counted[name], stats.rows)
        uneven, rare = ("warning" if b[k] else "info" for k in ("is_imbalanced", "has_rare_class"))
        out.append(("class_imbalance", uneven, name, "imbalance_ratio", b["imbalance_ratio"], target.SEVERE_IMBALANCE))
        out.append(("rare_class", rare, name, "smallest_pct", b["smallest_pct"], target.RARE_CLASS_PCT))
    return out


def class_findings(df: DataFrame, name: str, rows: int) -> DataFrame:
    """Two findings a class, its rows and their share; they stay distributed, as a text may have any number of classes."""

    def one(metric, value):
        return F.struct(
            F.lit("class_share").alias("check"), F.lit("info").alias("severity"), F.lit(name).alias("column"),
            F.concat(F.lit(f"{metric}:"), F.col("class")).alias("metric"), F.col(value).cast("double").alias("value"),
            F.lit(None).cast("double").alias("threshold"),
        )

    return target.class_distribution(df, name, rows).select(F.inline(F.array(one("rows", "n"), one("pct", "pct"))))


def validate(
    df: DataFrame, target_column: str | None = None, config: Any = None
) -> Validation:
    """Run all checks.  Errors always fail; warnings do when the config says so.

    The checks say first what they want to know; one aggregate, one run that counts values
    and the two that finish the quantiles answer all of them, and one more counts outliers.
    """
    cfg = ValidationConfig.merged(config)
    twice = duplicate_names(df)
    if twice:  # no column of these names can be told from the other
        rows = [("duplicate_names", "error", n, "occurrences", None, None) for n in twice]
        return _judged(df, rows, cfg, None)
    known = target_column is not None and target_column in df.columns
    stats = Statistics(df)
    want_schema(stats)
    stats.want_patterns()
    # Distinct counts are wanted of text, of possible keys, and of the target.
    stats.want_values(fields(df, lambda d: isinstance(d, (T.LongType, T.DoubleType))))
    outliers.want_outliers(stats, cfg.outlier_method, numeric_columns(df))
    if known:
        stats.want_values([target_column])
        want_leakage(stats, target_column)
    stats.collect()
    rows = schema_findings(stats) + missing_findings(stats, cfg)
    flagged = outliers.outlier_report(df, cfg.outlier_method, cfg.outlier_threshold, stats=stats)
    for r in flagged.collect():
        rows.append(("outliers", "info", r["column"], "outliers", float(r["outliers"]), cfg.outlier_threshold))
        rows.append(("outliers", "info", r["column"], "outlier_pct", r["outlier_pct"], cfg.outlier_threshold))
    classes = None
    if known:
        rows += target_findings(stats, target_column)
        if is_text(stats.types[target_column]) or stats.distinct(target_column) <= target.MAX_CLASSES:
            classes = class_findings(df, target_column, stats.rows)
    elif target_column is not None:
        rows.append(("target_absent", "warning", target_column, None, None, None))
    rows += size_warnings(stats.rows, len(df.columns), target_column is not None)
    return _judged(df, rows, cfg, classes)


def _judged(df: DataFrame, rows: list[tuple], cfg: ValidationConfig, classes: DataFrame | None) -> Validation:
    """Findings are bounded by columns and checks: plain rows, beside those of the classes."""
    report = local_rows(df, rows, REPORT_SCHEMA)
    if classes is not None:
        report = report.unionByName(classes)
    errors = sorted(_line(r) for r in rows if r[1] == "error")
    warnings = sorted(_line(r) for r in rows if r[1] == "warning")
    failed = bool(errors) or (cfg.fail_on_warnings and bool(warnings))
    if failed and not errors:
        errors = ["warnings are set to fail the run"]
    return Validation("FAIL" if failed else "PASS", report, errors, warnings)


def _line(r: tuple) -> str:
    check, _, column, metric, value, _ = r
    where = f" {column}" if column else ""
    what = f" {metric}={value:g}" if value is not None else ""
    return f"{check}:{where}{what}"
