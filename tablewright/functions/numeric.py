"""Numeric expressions whose edge cases differ from the built-in ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .schema import col, is_floating, is_integral


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN counts as missing everywhere, so turn it into NULL once, on ingest."""
    floats = {f.name for f in df.schema.fields if is_floating(f.dataType)}
    if not floats:
        return df
    return df.select(
        *[
            (F.when(~F.isnan(col(c)), col(c)) if c in floats else col(c)).alias(c)
            for c in df.columns
        ]
    )


def as_double(name: str) -> Column:
    return col(name).cast(T.DoubleType())


def pct(part: Column, whole: Column, digits: int = 2) -> Column:
    """``part / whole * 100`` rounded; NULL for an empty table."""
    return F.round(F.try_divide(part * F.lit(100.0), whole), digits)


def sample_skewness(c: Column) -> Column:
    """Bias-corrected skewness G1: needs three values, 0 for a constant."""
    n = F.count(c).cast("double")
    g1 = F.skewness(c)
    corrected = g1 * F.sqrt(n * (n - 1)) / F.nullif(n - 2, F.lit(0.0))
    return F.when(n < 3, None).when(F.min(c) == F.max(c), 0.0).otherwise(corrected)


def sample_kurtosis(c: Column) -> Column:
    """Bias-corrected excess kurtosis G2: needs four values, 0 for a constant."""
    n = F.count(c).cast("double")
    g2 = F.kurtosis(c)
    denominator = F.nullif((n - 2) * (n - 3), F.lit(0.0))
    corrected = (n - 1) / denominator * ((n + 1) * g2 + 6)
    return F.when(n < 4, None).when(F.min(c) == F.max(c), 0.0).otherwise(corrected)


def pairwise_correlation(x: Column, y: Column) -> Column:
    """Pearson r over the rows where both are present; NULL without variance or with infinities.

    ``corr`` raises on a zero-variance side under ANSI rules, hence the guarded
    quotient of covariance and deviations.
    """
    xs = F.when(y.isNotNull(), x)
    ys = F.when(x.isNotNull(), y)
    r = F.try_divide(F.covar_samp(x, y), F.stddev_samp(xs) * F.stddev_samp(ys))
    return F.when(~F.isnan(r), r)


def mean_of(df: DataFrame, name: str) -> Column:
    """The plain mean; whole numbers are added exactly, in any order."""
    c = col(name)
    if is_integral(df.schema[name].dataType):
        return F.try_divide(F.sum(c.cast("decimal(20,0)")).cast("double"), F.count(c))
    return F.avg(as_double(name))


def signless(c: Column) -> Column:
    """-0.0 becomes 0.0, so that rounded results compare equal across engines."""
    return c + F.lit(0.0)
