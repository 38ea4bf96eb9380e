"""Outliers by interquartile range, z-score or median deviation; flagged, never removed."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import as_double, pct
from ..functions.report import per_column
from ..functions.schema import col, numeric_columns
from ..functions.statistics import Statistics
from .numeric import deviations_from_median

METHODS = ("iqr", "zscore", "mad")
DEFAULT_THRESHOLD = 1.5
MIN_VALUES = 10
# Fixed value: scales a median deviation to a standard deviation.
MAD_SCALE = 0.6745


@dataclass(frozen=True)
class OutlierRule:
    """A fitted rule per column; one small entry per column."""

    method: str
    threshold: float
    bounds: dict[str, tuple]

    def test(self, name: str) -> Column:
        """True where the column's value is an outlier; NULL-safe."""
        x = as_double(name)
        if name not in self.bounds:
            return F.lit(False)
        a, b = self.bounds[name]
        if self.method == "iqr":
            hit = (x < F.lit(a)) | (x > F.lit(b))
        elif self.method == "zscore" and b is None:
            return F.lit(False)
        elif self.method == "zscore":
            hit = F.abs((x - F.lit(a)) / F.lit(b)) > F.lit(self.threshold)
        elif b == 0:
            hit = x != F.lit(a)  # any distance over a zero deviation is infinite
        else:
            hit = F.abs(F.lit(MAD_SCALE) * (x - F.lit(a)) / F.lit(b)) > F.lit(self.threshold)
        return F.coalesce(hit, F.lit(False))


def want_outliers(stats: Statistics, method: str, columns: Sequence[str]) -> None:
    """What the rule of a method reads, and no more."""
    if method not in METHODS:
        return
    stats.want_presence(columns)
    if method == "zscore":
        for c in columns:
            stats.want(f"mean:{c}", F.avg(as_double(c)))
            stats.want(f"std:{c}", F.stddev_samp(as_double(c)))
    else:
        stats.want_quantiles(columns, (0.25, 0.75) if method == "iqr" else (0.5,))


def fit_outlier_rule(
    df: DataFrame,
    method: str = "iqr",
    threshold: float = DEFAULT_THRESHOLD,
    columns: Sequence[str] | None = None,
    stats: Statistics | None = None,
) -> OutlierRule:
    """Measure the bounds; columns with fewer than ten values get none."""
    names = list(columns) if columns is not None else numeric_columns(df)
    if method not in METHODS or not names:
        return OutlierRule(method, threshold, {})
    if stats is None:
        stats = Statistics(df)
        want_outliers(stats, method, names)
        stats.collect()
    kept = [c for c in names if stats[f"present:{c}"] >= MIN_VALUES]
    bounds: dict[str, tuple] = {}
    if method == "iqr":
        for c, q in stats.quantiles(kept, (0.25, 0.75)).items():
            spread = q[0.75] - q[0.25]
            bounds[c] = (q[0.25] - threshold * spread, q[0.75] + threshold * spread)
    elif method == "zscore":
        for c in kept:
            centre, spread = stats[f"mean:{c}"], stats[f"std:{c}"]
            # no spread, or none that infinities leave: nothing is an outlier
            usable = spread and math.isfinite(spread) and math.isfinite(centre)
            bounds[c] = (centre, spread) if usable else (0.0, None)
    else:
        centre = {c: q[0.5] for c, q in stats.quantiles(kept, (0.5,)).items()}
        spread = deviations_from_median(df, kept, centre)
        bounds = {c: (centre[c], spread[c]) for c in kept}
    return OutlierRule(method, threshold, bounds)


def outlier_report(
    df: DataFrame,
    method: str = "iqr",
    threshold: float = DEFAULT_THRESHOLD,
    columns: Sequence[str] | None = None,
    stats: Statistics | None = None,
) -> DataFrame:
    """``(column, method, outliers, outlier_pct)``; the share is of non-null values."""
    rule = fit_outlier_rule(df, method, threshold, columns, stats)
    return per_column(
        df,
        list(rule.bounds),
        lambda c: {"n": F.count(col(c)), "hits": F.count_if(rule.test(c))},
        lambda c, m: {
            "method": F.lit(method),
            "outliers": m["hits"],
            "outlier_pct": pct(m["hits"], m["n"]),
        },
        "column string, method string, outliers bigint, outlier_pct double",
    )


def outlier_total(report: DataFrame) -> DataFrame:
    """``(total_outliers, columns_checked)`` for the audit."""
    return report.agg(
        F.coalesce(F.sum("outliers"), F.lit(0)).alias("total_outliers"),
        F.count("*").alias("columns_checked"),
    )


def flag_outliers(
    df: DataFrame,
    key: Sequence[str],
    method: str = "iqr",
    threshold: float = DEFAULT_THRESHOLD,
    columns: Sequence[str] | None = None,
) -> DataFrame:
    """One row per row and numeric column: ``(*key, column, value, is_outlier)``."""
    rule = fit_outlier_rule(df, method, threshold, columns)
    names = list(rule.bounds)
    cells = F.array(
        *[
            F.struct(
                F.lit(c).alias("column"),
                as_double(c).alias("value"),
                rule.test(c).alias("is_outlier"),
            )
            for c in names
        ]
    )
    return df.select(*[col(k) for k in key], F.inline(cells)).filter("value IS NOT NULL")
