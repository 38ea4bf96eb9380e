"""Value frequencies and distinct counts for many columns in one shuffle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.report import local_rows, per_column
from ..functions.schema import col, flat_columns, is_floating, is_integral, text_columns
from ..functions.statistics import short_text

TOP_VALUES = 5


def value_frequencies(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``(column, value, n)`` for every distinct non-null value, as text.

    Rows are counted map-side before the one exchange on ``(column, value)``, so a
    value holding a third of the table sends one row per input task.
    """
    names = list(columns) if columns is not None else text_columns(df)
    if not names:
        return local_rows(df, [], "column string, value string, n bigint")
    floats = {f.name for f in df.schema.fields if is_floating(f.dataType)}
    # 0.0 and -0.0 are one value
    texts = [((col(c) + F.lit(0.0)) if c in floats else col(c)).cast("string").alias(c) for c in names]
    long = df.unpivot([], texts, "column", "value")
    return long.filter("value IS NOT NULL").groupBy("column", "value").agg(F.count("*").alias("n"))


def _family(dtype: T.DataType) -> str:
    if is_integral(dtype):
        return "bigint"
    if is_floating(dtype):
        return "double"
    if isinstance(dtype, (T.TimestampNTZType, T.DateType)):
        return "timestamp_ntz"
    if isinstance(dtype, T.TimestampType):
        return "timestamp"
    return "string"


def distinct_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``(column, n_distinct)``, exact, NULLs not counted.

    Columns of the same storage family are unpivoted together and keep their own
    type: grouping ``(column, value)`` beats several ``count(distinct)`` in one
    aggregate, which widens every row to all columns.
    """
    names = list(columns) if columns is not None else flat_columns(df)
    types = {f.name: f.dataType for f in df.schema.fields}
    families: dict[str, list[str]] = {}
    for c in names:
        families.setdefault(_family(types[c]), []).append(c)
    out = local_rows(df, [(c, 0) for c in names], "column string, n_distinct bigint")
    for family, members in families.items():
        casts = [(short_text(col(c).cast(family)) if family == "string" else col(c).cast(family)).alias(c) for c in members]
        distinct = (
            df.unpivot([], casts, "column", "value")
            .filter("value IS NOT NULL")
            .groupBy("column", "value")
            .agg(F.lit(1).alias("one"))
        )
        out = out.union(distinct.groupBy("column").agg(F.count("*").alias("n_distinct")))
    return out.groupBy("column").agg(F.sum("n_distinct").alias("n_distinct"))


def distinct_lookup(df: DataFrame, columns: Sequence[str]) -> dict[str, int]:
    """The same as a dictionary: one entry per column, so always small."""
    if not columns:
        return {}
    return {r["column"]: r["n_distinct"] for r in distinct_counts(df, columns).collect()}


def at_most_distinct(df: DataFrame, column: str, limit: int) -> bool:
    """Whether a column has ``limit`` distinct values at most.

    A sketch far above the limit settles it without grouping a long column by
    value; near or below the limit the values are few and counted exactly.
    """
    estimate = df.agg(F.approx_count_distinct(col(column), 0.02).alias("n")).first()["n"]
    if estimate > 2 * limit + 20:
        return False
    return distinct_lookup(df, [column]).get(column, 0) <= limit


def cardinality(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``(column, n_distinct, ratio)`` with the ratio to all rows at 4 digits."""
    total = df.agg(F.count("*").alias("rows")).scalar()
    return distinct_counts(df, columns).select(
        "column",
        "n_distinct",
        F.round(F.try_divide(F.col("n_distinct").cast("double"), total), 4).alias("ratio"),
    )


def constant_columns(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``(column, n_distinct)`` of columns with at most one distinct value.

    A column is constant when its least and its greatest value are the same, so
    this needs no distinct count: one aggregate, no shuffle of values.
    """
    names = list(columns) if columns is not None else flat_columns(df)
    return per_column(
        df,
        names,
        lambda c: {
            "n": F.count(col(c)),
            "same": F.coalesce(F.min(col(c)) == F.max(col(c)), F.lit(True)),
        },
        lambda c, m: {
            "n_distinct": F.when(m["n"] == 0, 0).when(m["same"], 1).otherwise(2).cast("bigint")
        },
        "column string, n_distinct bigint",
    ).filter("n_distinct <= 1")


def high_cardinality(df: DataFrame, threshold: float = 0.8) -> DataFrame:
    """Text columns whose distinct values exceed a share of the rows."""
    total = df.agg(F.count("*").alias("rows")).scalar()
    ratio = F.try_divide(F.col("n_distinct").cast("double"), total)
    return (
        distinct_counts(df, text_columns(df))
        .filter(ratio > F.lit(threshold))
        .select("column", "n_distinct", F.round(ratio, 4).alias("ratio"))
    )


def _most_first() -> Column:
    return F.struct((-F.col("n")).alias("neg"), F.col("value"))


def most_least_frequent(
    df: DataFrame, columns: Sequence[str] | None = None, frequencies: DataFrame | None = None
) -> DataFrame:
    """Most and least frequent value per column; the smallest value wins a tie."""
    by_count = F.struct("n", "value")
    return (
        (value_frequencies(df, columns) if frequencies is None else frequencies)
        .groupBy("column")
        .agg(
            F.count("*").alias("unique_values"),
            F.min_by("value", _most_first()).alias("most_frequent"),
            F.max("n").alias("most_frequent_count"),
            F.min_by("value", by_count).alias("least_frequent"),
            F.min("n").alias("least_frequent_count"),
        )
    )


def modes(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(column, mode)`` as text; the smallest value wins a tie."""
    return (
        value_frequencies(df, columns)
        .groupBy("column")
        .agg(F.min_by("value", _most_first()).alias("mode"))
    )


def top_values(
    df: DataFrame, columns: Sequence[str] | None = None, k: int = TOP_VALUES, frequencies: DataFrame | None = None
) -> DataFrame:
    """The ``k`` most frequent values per column.

    Spark keeps only ``k`` rows per column and task before the exchange (window
    group limit), so a column of distinct values never reaches one task whole.
    """
    ranked = Window.partitionBy("column").orderBy(F.desc("n"), F.asc("value"))
    return (
        (value_frequencies(df, columns) if frequencies is None else frequencies)
        .withColumn("position", F.row_number().over(ranked))
        .filter(F.col("position") <= k)
    )


def duplicate_rows(df: DataFrame) -> DataFrame:
    """``(n_rows, n_distinct_rows, duplicates, duplicate_pct)`` over whole rows."""
    names = flat_columns(df)
    nested = [c for c in df.columns if c not in names]
    keyed = df.select(
        *[col(c).alias(f"k{i}") for i, c in enumerate(names)],
        *[F.to_json(F.struct(col(c))).alias(f"j{i}") for i, c in enumerate(nested)],
    )
    groups = keyed.groupBy(*keyed.columns).agg(F.count("*").alias("n"))
    counted = groups.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.count("*").alias("n_distinct_rows")
    )
    extra = F.col("n_rows") - F.col("n_distinct_rows")
    return counted.select(
        "n_rows",
        "n_distinct_rows",
        extra.alias("duplicates"),
        F.coalesce(F.round(F.try_divide(extra * 100.0, F.col("n_rows")), 2), F.lit(0.0)).alias(
            "duplicate_pct"
        ),
    )
