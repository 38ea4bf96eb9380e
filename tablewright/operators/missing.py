"""Missing-data counts, thresholds and patterns."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import pct
from ..functions.report import local_rows, per_column
from ..functions.schema import col
from ..functions.statistics import Statistics

COLUMN_MAX_MISSING_PCT = 50.0
ROW_MAX_MISSING_PCT = 80.0
ROWS_OVER_LIMIT_PCT = 10.0
CO_MISSING_CORRELATION = 0.8


def missing_by_column(df: DataFrame) -> DataFrame:
    """``(column, n_rows, missing_count, missing_pct)`` from one aggregate."""
    return per_column(
        df,
        df.columns,
        lambda c: {"_rows": F.count(F.lit(1)), "present": F.count(col(c))},
        lambda c, m: {
            "n_rows": m["_rows"],
            "missing_count": m["_rows"] - m["present"],
            "missing_pct": pct(m["_rows"] - m["present"], m["_rows"]),
        },
    )


def missing_overall(df: DataFrame, by_column: DataFrame | None = None) -> DataFrame:
    """Missing cells over the whole table and the columns that have any."""
    cells = F.sum("n_rows")
    return (missing_by_column(df) if by_column is None else by_column).agg(
        F.max("n_rows").alias("n_rows"),
        F.count("*").alias("n_columns"),
        F.sum("missing_count").alias("total_missing"),
        F.coalesce(F.round(F.try_divide(F.sum("missing_count") * 100.0, cells), 2), F.lit(0.0)).alias(
            "total_missing_pct"
        ),
        F.count_if(F.col("missing_pct") > 0).alias("columns_with_missing"),
    )


def missing_over_threshold(df: DataFrame, limit: float = COLUMN_MAX_MISSING_PCT) -> DataFrame:
    """Columns whose rounded missing share is above the limit."""
    return missing_by_column(df).filter(F.col("missing_pct") > limit)


def cells_missing(df: DataFrame) -> Column:
    """How many cells of a row are missing."""
    return sum((col(c).isNull().cast("int") for c in df.columns), F.lit(0))


def row_histogram(df: DataFrame) -> DataFrame:
    """Rows per number of missing cells: never more rows than columns plus one."""
    share = F.col("cells") * F.lit(100.0) / F.lit(max(len(df.columns), 1))
    return (
        df.select(cells_missing(df).alias("cells"))
        .groupBy("cells")
        .agg(F.count("*").alias("n"))
        .select(share.alias("x"), "n")
    )


def row_missing_distribution(df: DataFrame, histogram: DataFrame | None = None) -> DataFrame:
    """Describe the per-row missing share; computed from the small histogram."""
    n, x = F.col("n").cast("double"), F.col("x")
    total, first, second = F.sum(n), F.sum(n * x), F.sum(n * x * x)
    variance = F.try_divide(second - first * F.try_divide(first, total), total - 1)
    quartiles = F.percentile(x, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), F.col("n"))
    return (
        (row_histogram(df) if histogram is None else histogram)
        .agg(
            F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"),
            F.coalesce(F.sum(F.when(x > 0, F.col("n"))), F.lit(0)).alias("rows_with_missing"),
            F.try_divide(first, total).alias("mean"),
            F.sqrt(F.greatest(variance, F.lit(0.0))).alias("std"),
            F.min(x).alias("min"),
            quartiles.alias("q"),
            F.max(x).alias("max"),
        )
        .select(
            "n_rows",
            "rows_with_missing",
            "mean",
            "std",
            "min",
            F.col("q")[0].alias("p25"),
            F.col("q")[1].alias("p50"),
            F.col("q")[2].alias("p75"),
            "max",
        )
    )


def row_missing_check(
    df: DataFrame,
    row_limit: float = ROW_MAX_MISSING_PCT,
    rows_limit: float = ROWS_OVER_LIMIT_PCT,
    histogram: DataFrame | None = None,
) -> DataFrame:
    """Warn when too many rows are mostly missing."""
    over = F.coalesce(F.sum(F.when(F.col("x") > row_limit, F.col("n"))), F.lit(0))
    share = F.try_divide(over * F.lit(100.0), F.sum("n"))
    return (
        (row_histogram(df) if histogram is None else histogram)
        .agg(over.alias("rows_over"), share.alias("share"))
        .select(
            "rows_over",
            F.round("share", 6).alias("rows_over_pct"),
            F.coalesce(F.col("share") > rows_limit, F.lit(False)).alias("is_warning"),
        )
    )


def pair_correlations(stats: Statistics, threshold: float = CO_MISSING_CORRELATION) -> list[tuple[str, str, float]]:
    """``(column_a, column_b, r)`` above the threshold, from patterns that are counted already."""
    n = float(stats.rows)
    partly = [(c, float(stats.missing(c))) for c in stats.df.columns if 0 < stats.missing(c) < n]
    out = []
    for i, (a, sa) in enumerate(partly):
        for b, sb in partly[i + 1 :]:
            spread = math.sqrt(sa * (n - sa)) * math.sqrt(sb * (n - sb))
            r = (n * stats.together.get((a, b), 0) - sa * sb) / spread
            if abs(r) > threshold:
                out.append((a, b, r))
    return out


def co_missing_correlation(
    df: DataFrame, threshold: float = CO_MISSING_CORRELATION, stats: Statistics | None = None
) -> DataFrame:
    """Column pairs whose null indicators correlate: ``(column_a, column_b, correlation)``.

    Only columns that are partly missing can correlate.  Their gaps make a pattern for
    each row; equal patterns are counted map-side, and a pattern counts once for every
    pair of its gaps.  So the work for pairs follows the patterns that occur, not the rows,
    and no matrix is built of all columns.
    """
    if stats is None:
        stats = Statistics(df)
        stats.want_patterns()
        stats.collect()
    return local_rows(df, pair_correlations(stats, threshold), "column_a string, column_b string, correlation double")
