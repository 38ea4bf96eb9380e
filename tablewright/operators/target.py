"""Checks of the column to be predicted: leakage, balance, kind of task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.numeric import as_double, pairwise_correlation, pct, signless
from ..functions.report import local_rows, per_column
from ..functions.schema import col, is_integral, is_numeric, is_text, temporal_columns
from ..functions.statistics import Counted, Statistics, half_up
from .frequency import at_most_distinct, distinct_counts, distinct_lookup

LEAKAGE_CORRELATION = 0.95
ID_RATIO = 0.9
MAX_CLASSES = 20
SEVERE_IMBALANCE = 10.0
MODERATE_IMBALANCE = 5.0
RARE_CLASS_PCT = 1.0


def _dtype(df: DataFrame, name: str) -> T.DataType:
    return next(f.dataType for f in df.schema.fields if f.name == name)


def target_correlations(df: DataFrame, target: str) -> DataFrame:
    """``(column, correlation)``: absolute r of each numeric column with the target."""
    schema = "column string, correlation double"
    if target not in df.columns or not is_numeric(_dtype(df, target)):
        return local_rows(df, [], schema)
    names = [f.name for f in df.schema.fields if is_numeric(f.dataType) and f.name != target]
    return per_column(
        df,
        names,
        lambda c: {"correlation": pairwise_correlation(as_double(c), as_double(target))},
        lambda c, m: {"correlation": signless(F.abs(m["correlation"]))},
        schema,
    )


def id_like_columns(
    df: DataFrame, target: str | None = None, distinct: dict[str, int] | None = None
) -> DataFrame:
    """64-bit columns where nearly every row has its own value.

    ``distinct`` takes counts that are known already.
    """
    names = [
        f.name
        for f in df.schema.fields
        if isinstance(f.dataType, (T.LongType, T.DoubleType)) and f.name != target
    ]
    total = df.agg(F.count("*").alias("rows")).scalar()
    ratio = F.try_divide(F.col("n_distinct").cast("double"), total)
    if distinct is None:
        counts = distinct_counts(df, names)
    else:
        counts = local_rows(df, [(c, distinct[c]) for c in names], "column string, n_distinct bigint")
    return (
        counts.filter(ratio > ID_RATIO)
        .select("column", F.round(ratio, 6).alias("unique_ratio"))
    )


def target_leakage(
    df: DataFrame, target: str, distinct: dict[str, int] | None = None
) -> DataFrame:
    """``(check, column, value)`` rows: correlated, id-like and time columns."""
    if target not in df.columns:
        return local_rows(df, [], "check string, column string, value double")
    correlated = (
        target_correlations(df, target)
        .filter(F.col("correlation") > LEAKAGE_CORRELATION)
        .select(
            F.lit("high_correlation").alias("check"),
            "column",
            F.round("correlation", 6).alias("value"),
        )
    )
    ids = id_like_columns(df, target, distinct).select(
        F.lit("id_like").alias("check"), "column", F.col("unique_ratio").alias("value")
    )
    times = local_rows(
        df,
        [("datetime", c, None) for c in temporal_columns(df)],
        "check string, column string, value double",
    )
    return correlated.unionByName(ids).unionByName(times)


def class_distribution(df: DataFrame, target: str, rows: int | None = None) -> DataFrame:
    """``(class, n, pct)``: shares are of all rows, missing targets included."""
    total = df.agg(F.count("*").alias("rows")).scalar() if rows is None else F.lit(rows)
    return (
        df.filter(col(target).isNotNull())
        .groupBy(col(target).cast("string").alias("class"))
        .agg(F.count("*").alias("n"))
        .select("class", "n", pct(F.col("n"), total).alias("pct"))
    )


def class_balance(df: DataFrame, target: str) -> DataFrame:
    """One row: classes, imbalance ratio and the two warnings it can raise."""
    total = df.agg(F.count("*").alias("rows")).scalar()
    several = F.col("n_classes") > 1
    return (
        df.filter(col(target).isNotNull())
        .groupBy(col(target).cast("string").alias("class"))
        .agg(F.count("*").alias("n"))
        .agg(
            F.count("*").alias("n_classes"),
            F.max("n").alias("largest"),
            F.min("n").alias("smallest"),
        )
        .select(
            "n_classes",
            F.when(several, F.round(F.col("largest") / F.col("smallest"), 6))
            .otherwise(1.0)
            .alias("imbalance_ratio"),
            (several & (F.col("largest") / F.col("smallest") > SEVERE_IMBALANCE)).alias(
                "is_imbalanced"
            ),
            (several & (F.col("smallest") * 100.0 / total < RARE_CLASS_PCT)).alias("has_rare_class"),
            F.round(F.try_divide(F.col("smallest") * 100.0, total), 2).alias("smallest_pct"),
        )
    )


def detect_task(df: DataFrame, target: str | None) -> str:
    """classification for few whole-number, text or boolean classes, else regression."""
    if not target or target not in df.columns:
        return "unsupervised"
    dtype = _dtype(df, target)
    if task_of(dtype, 0) == "regression":
        return "regression"
    return "classification" if at_most_distinct(df, target, MAX_CLASSES) else "regression"


def task_of(dtype: T.DataType, n_distinct: int) -> str:
    whole = is_integral(dtype) or is_text(dtype) or isinstance(dtype, T.BooleanType)
    return "classification" if n_distinct <= MAX_CLASSES and whole else "regression"


def task_detection(df: DataFrame) -> DataFrame:
    """``(column, n_distinct, task)``: the task each column would set as a target."""
    types = {f.name: f.dataType for f in df.schema.fields}
    counts = distinct_counts(df)
    task = F.lit("regression")
    whole = [c for c in types if task_of(types[c], 0) == "classification"]
    task = F.when(
        F.col("column").isin(whole) & (F.col("n_distinct") <= MAX_CLASSES), "classification"
    ).otherwise(task)
    return counts.select("column", "n_distinct", task.alias("task"))


def balance_of(counted: Counted, rows: int) -> dict:
    """The row of :func:`class_balance`, from classes that are counted already."""
    several = counted.distinct > 1
    ratio = counted.most / counted.least if several else 1.0
    low = counted.least * 100.0 / rows if counted.distinct and rows else None
    return {
        "n_classes": counted.distinct,
        "imbalance_ratio": half_up(ratio, 6),
        "is_imbalanced": several and ratio > SEVERE_IMBALANCE,
        "has_rare_class": several and low < RARE_CLASS_PCT,
        "smallest_pct": half_up(low, 2),
    }


def want_target(stats: Statistics, target: str) -> None:
    """What :func:`target_analysis` reads."""
    from .numeric import QUARTILES, want_numbers

    stats.want_presence([target])
    stats.want_values([target])
    if is_numeric(stats.types[target]):
        want_numbers(stats, [target], ("describe",), QUARTILES)


def _holds_classes(stats: Statistics, target: str) -> bool:
    return is_text(stats.types[target]) or stats.distinct(target) <= MAX_CLASSES


def target_warnings(stats: Statistics, target: str) -> list[str]:
    """What is wrong with the target."""
    out = ["missing_target"] if stats.missing(target) else []
    if not _holds_classes(stats, target):
        return out + (["constant_target"] if stats.distinct(target) <= 1 else [])
    balance = balance_of(stats.counted[target], stats.rows)
    if balance["n_classes"] > 1:
        if balance["imbalance_ratio"] > SEVERE_IMBALANCE:
            out.append("severe_imbalance")
        elif balance["imbalance_ratio"] > MODERATE_IMBALANCE:
            out.append("moderate_imbalance")
        if balance["has_rare_class"]:
            out.append("rare_class")
    return out


def target_analysis(df: DataFrame, target: str, stats: Statistics | None = None) -> DataFrame:
    """``(metric, value, detail)`` rows about the target, warnings included."""
    dtype = _dtype(df, target)
    if stats is None:
        stats = Statistics(df)
        want_target(stats, target)
        stats.collect()
    missing, unique = stats.missing(target), stats.distinct(target)
    classes = _holds_classes(stats, target)
    out: list[tuple[str, float | None, str | None]] = [
        ("missing_count", float(missing), None),
        ("unique_values", float(unique), None),
        ("task_type", None, "classification" if classes else "regression"),
    ]
    out += [("warning", None, w) for w in target_warnings(stats, target)]
    schema = "metric string, value double, detail string"
    if not classes:
        from .numeric import QUARTILES, numeric_report

        if not is_numeric(dtype):
            return local_rows(df, out, schema)
        found = numeric_report(df, [target], ("describe",), QUARTILES, stats=stats)
        names = [c for c in found.columns if c != "column"]
        spread = found.unpivot(
            [], [F.col(c).cast("double").alias(c) for c in names], "metric", "value"
        )
        return local_rows(df, out, schema).unionByName(
            spread.withColumn("detail", F.lit(None).cast("string"))
        )
    # Text targets may have any number of classes: the counts stay distributed.
    balance = balance_of(stats.counted[target], stats.rows)
    if balance["n_classes"] > 1:
        out.append(("imbalance_ratio", balance["imbalance_ratio"], None))
    shares = class_distribution(df, target, stats.rows)
    # one run for both figures of a class
    figures = F.array(
        F.struct(F.lit("class_count").alias("metric"), F.col("n").cast("double").alias("value"), F.col("class").alias("detail")),
        F.struct(F.lit("class_pct").alias("metric"), F.col("pct").alias("value"), F.col("class").alias("detail")),
    )
    return local_rows(df, out, schema).unionByName(shares.select(F.inline(figures)))
