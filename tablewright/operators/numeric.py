"""Numeric statistics: describe, health, shape, spread and correlation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.numeric import (
    as_double,
    pairwise_correlation,
    sample_kurtosis,
    sample_skewness,
    signless,
    mean_of,
)
from ..functions.quantiles import exact_quantiles
from ..functions.report import local_rows, per_column
from ..functions.schema import col, numeric_columns
from ..functions.statistics import Statistics

# The tails and quartiles a profile shows.
PROFILE_PROBS = (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99)
QUARTILES = (0.25, 0.5, 0.75)
# Beyond this many columns all pairs go through the distributed matrix.
PAIR_AGGREGATE_COLUMNS = 12


def _names(df: DataFrame, columns: Sequence[str] | None) -> list[str]:
    return list(columns) if columns is not None else numeric_columns(df)


def _label(p: float) -> str:
    return f"p{round(p * 100):02d}" if p < 0.1 else f"p{round(p * 100)}"


SECTIONS = ("describe", "health", "shape")


def _measures(df: DataFrame, c: str, sections: Sequence[str]) -> dict[str, Column]:
    x = as_double(c)
    out = {"min": F.min(x), "max": F.max(x)}
    if "describe" in sections:
        out |= {"count": F.count(col(c)), "mean": mean_of(df, c), "std": F.stddev_samp(x)}
    if "health" in sections:
        out |= {
            "zeros": F.count_if(col(c) == 0),
            "negatives": F.count_if(col(c) < 0),
            "infinites": F.count_if(F.abs(x) == float("inf")),
        }
    if "shape" in sections:
        out |= {"skewness": sample_skewness(x), "kurtosis": sample_kurtosis(x)}
    return out


def want_numbers(
    stats: Statistics,
    columns: Sequence[str],
    sections: Sequence[str] = SECTIONS,
    probs: Sequence[float] = PROFILE_PROBS,
) -> None:
    """What :func:`numeric_report` reads."""
    stats.want_quantiles(columns, [*(probs if "describe" in sections else []), 0.25, 0.75])
    for c in columns:
        for k, e in _measures(stats.df, c, sections).items():
            stats.want(f"number:{k}:{c}", e)


def numeric_report(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    sections: Sequence[str] = SECTIONS,
    probs: Sequence[float] = PROFILE_PROBS,
    digits: int = 4,
    stats: Statistics | None = None,
) -> DataFrame:
    """The wanted sections for each column: one quantile run and one aggregate.

    describe: count, mean, std, min, quantiles, max.  health: zeros, negatives,
    infinites and the interquartile range.  shape: skewness and kurtosis.
    ``stats``: the answers of ``want_numbers``, where other checks have asked along.
    """
    names = _names(df, columns)
    wanted = list(probs) if "describe" in sections else []
    if "health" in sections:
        wanted += [0.25, 0.75]
    found = exact_quantiles(df, names, wanted) if stats is None else stats.quantiles(names, wanted)
    wide = None
    if stats is not None and names:
        known = stats.one_row(
            {f"m{i}_{k}": f"number:{k}:{c}" for i, c in enumerate(names) for k in _measures(df, c, sections)}
        )
        schema = T.StructType([T.StructField(a, t) for a, t, _ in known])
        wide = local_rows(df, [tuple(v for _, _, v in known)], schema)

    def measures(c):
        return _measures(df, c, sections)

    def shape(c, m):
        q, out = found[c], {}
        if "describe" in sections:
            points = {_label(p): F.round(F.lit(q[p]).cast("double"), digits) for p in probs}
            low, high = F.round(m["min"], digits), F.round(m["max"], digits)
            out |= {"count": m["count"], "mean": F.round(m["mean"], digits)}
            out |= {"std": F.round(m["std"], digits), "min": low, **points, "max": high}
        if "health" in sections:
            iqr = None if q[0.25] is None else q[0.75] - q[0.25]
            out |= {k: m[k] for k in ("zeros", "negatives", "infinites")}
            out |= {"lowest": m["min"], "highest": m["max"]}
            out["iqr"] = F.round(F.lit(iqr).cast("double"), 6)
        if "shape" in sections:
            out["skewness"] = signless(F.round(m["skewness"], 6))
            out["kurtosis"] = signless(F.round(m["kurtosis"], 6))
        return out

    return per_column(df, names, measures, shape, "column string, count bigint", wide)


def describe(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    probs: Sequence[float] = PROFILE_PROBS,
    digits: int = 4,
) -> DataFrame:
    """Count, mean, sample deviation, min, quantiles and max per column."""
    return numeric_report(df, columns, ("describe",), probs, digits)


def numeric_health(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Zeros, negatives, infinities, range and interquartile range per column."""
    return numeric_report(df, columns, ("health",)).withColumnsRenamed(
        {"lowest": "min", "highest": "max"}
    )


def skew_kurtosis(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Bias-corrected skewness and excess kurtosis per column."""
    return numeric_report(df, columns, ("shape",))


def medians(df: DataFrame, columns: Sequence[str]) -> dict[str, float | None]:
    return {c: q[0.5] for c, q in exact_quantiles(df, columns, (0.5,)).items()}


def deviations_from_median(
    df: DataFrame, columns: Sequence[str], centre: dict[str, float | None]
) -> dict[str, float | None]:
    """Median of the absolute deviations from the median, per column."""
    spread = df.select(
        *[F.abs(as_double(c) - F.lit(centre[c]).cast("double")).alias(c) for c in columns]
    )
    return medians(spread, columns)


def median_mad(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``(column, median, mad)``, both exact."""
    names = _names(df, columns)
    centre = medians(df, names)
    mad = deviations_from_median(df, names, centre)
    return local_rows(
        df, [(c, centre[c], mad[c]) for c in names], "column string, median double, mad double"
    )


def correlation_matrix(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Pearson r of all column pairs: ``(column_a, column_b, correlation)``.

    Over the rows where both are present.  Few columns: every pair in one
    aggregate; many columns: sums of products over blocks of rows.
    """
    names = _names(df, columns)
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]
    if not pairs:
        return local_rows(df, [], "column_a string, column_b string, correlation double")
    if len(names) > PAIR_AGGREGATE_COLUMNS:
        return _gram_correlations(df, names)
    wide = df.agg(
        *[
            pairwise_correlation(as_double(a), as_double(b)).alias(f"r{k}")
            for k, (a, b) in enumerate(pairs)
        ]
    )
    return wide.select(
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(a).alias("column_a"),
                        F.lit(b).alias("column_b"),
                        signless(F.round(F.col(f"r{k}"), 6)).alias("correlation"),
                    )
                    for k, (a, b) in enumerate(pairs)
                ]
            )
        )
    )


def _gram_correlations(df: DataFrame, names: list[str]) -> DataFrame:
    """All pairs of many columns from sums over blocks of rows.

    A task adds up, for every pair, the products of the rows where both are present:
    a few matrix products a block.  Each gives one row a pair, which are then added.
    Values are shifted by their column's mean first, so that no digits are lost.
    """
    doubles = df.select(*[as_double(c).alias(f"c{i}") for i, c in enumerate(names)])
    finite = [F.when(F.abs(F.col(f"c{i}")) < float("inf"), F.col(f"c{i}")) for i in range(len(names))]
    means = [m or 0.0 for m in doubles.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(finite)]).first()]

    def sums(batches):
        import numpy as np
        import pyarrow as pa

        size = len(means)
        i, j = np.triu_indices(size, 1)
        total = np.zeros((6, len(i)))
        with np.errstate(all="ignore"):
            for batch in batches:
                x = np.column_stack([batch.column(k).to_numpy(zero_copy_only=False).astype(float) for k in range(size)])
                here = ~np.isnan(x)
                x = np.where(here, x - np.array(means), 0.0)
                here = here.astype(float)
                for k, m in enumerate((here.T @ here, x.T @ here, here.T @ x, (x * x).T @ here, here.T @ (x * x), x.T @ x)):
                    total[k] += m[i, j]
        yield pa.RecordBatch.from_arrays(
            [pa.array(i, pa.int32()), pa.array(j, pa.int32()), *[pa.array(t) for t in total]],
            names=["i", "j", "n", "x", "y", "xx", "yy", "xy"],
        )

    parts = doubles.mapInArrow(sums, "i int, j int, n double, x double, y double, xx double, yy double, xy double")
    added = parts.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in ("n", "x", "y", "xx", "yy", "xy")])
    n = F.nullif("n", F.lit(0.0))
    vx, vy = F.col("xx") - F.try_divide(F.col("x") * F.col("x"), n), F.col("yy") - F.try_divide(F.col("y") * F.col("y"), n)
    top = F.col("xy") - F.try_divide(F.col("x") * F.col("y"), n)
    # what rounding leaves of a constant is no variance
    spread = F.when((vx > F.col("xx") * 1e-13) & (vy > F.col("yy") * 1e-13), F.sqrt(vx) * F.sqrt(vy))
    r = F.try_divide(top, spread)
    known = F.array(*[F.lit(c) for c in names])
    return added.select(
        F.element_at(known, F.col("i") + 1).alias("column_a"),
        F.element_at(known, F.col("j") + 1).alias("column_b"),
        signless(F.round(F.when(~F.isnan(r), r), 6)).alias("correlation"),
    )
