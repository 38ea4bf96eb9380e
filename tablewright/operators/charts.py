"""The series behind each chart: small, ready to draw, computed on Spark."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.numeric import as_double, mean_of
from ..functions.quantiles import exact_quantiles
from ..functions.report import local_rows
from ..functions.schema import col, numeric_columns, temporal_columns, text_columns
from .evaluation import confusion_matrix

# Chart families, chart names and the order they are listed in.
FAMILIES = (
    "kpi",
    "comparison",
    "composition",
    "trend",
    "relationship",
    "distribution",
    "clustering",
    "model",
)
KPI_CHARTS = ("KPI Card",)
TARGET_DISTRIBUTION_CHARTS = ("Histogram", "Box Plot")
COMPARISON_CHARTS = ("Bar Chart", "Grouped Bar", "Stacked Bar", "Column Chart")
COMPOSITION_CHARTS = ("Pie Chart", "Donut Chart", "Treemap")
TREND_CHARTS = ("Line Chart", "Area Chart", "Stacked Area")
RELATIONSHIP_CHARTS = ("Scatter Plot", "Bubble Chart", "Correlation Heatmap")
PREDICTION_CHARTS = ("Actual vs Predicted", "Model Comparison Bar Chart")
CLASS_CHARTS = ("Confusion Matrix",)
CLUSTER_CHARTS = ("PCA Scatter", "Cluster Plot")

HISTOGRAM_BINS = 20
SAMPLE_POINTS = 1000
GRAINS = ("day", "week", "month", "quarter", "year")


def recommend(df: DataFrame, target: str | None, task: str | None = None) -> DataFrame:
    """``(family, position, chart)`` from the schema alone: no job."""
    numbers, words, times = numeric_columns(df), text_columns(df), temporal_columns(df)
    on_number = target is not None and target in numbers
    picks: list[tuple[str, tuple[str, ...]]] = []
    if on_number:
        picks += [("kpi", KPI_CHARTS), ("distribution", TARGET_DISTRIBUTION_CHARTS)]
        if words:
            picks += [("comparison", COMPARISON_CHARTS), ("composition", COMPOSITION_CHARTS)]
        if times:
            picks.append(("trend", TREND_CHARTS))
    elif numbers:
        picks.append(("distribution", TARGET_DISTRIBUTION_CHARTS[:1]))
    if len(numbers) >= 2:
        picks.append(("relationship", RELATIONSHIP_CHARTS))
    if task in ("regression", "classification"):
        picks.append(("model", PREDICTION_CHARTS + (CLASS_CHARTS if task == "classification" else ())))
    elif task == "unsupervised":
        picks.append(("clustering", CLUSTER_CHARTS))
    chosen = dict(picks)
    rows = [(f, i + 1, c) for f in FAMILIES for i, c in enumerate(chosen.get(f, ()))]
    return local_rows(df, rows, "family string, position int, chart string")


def kpi_card(df: DataFrame, target: str) -> DataFrame:
    """One row: count, sum, mean, min, median and max of the target."""
    x = as_double(target)
    middle = exact_quantiles(df, [target], (0.5,))[target][0.5]
    return df.agg(
        F.count(col(target)).alias("count"),
        F.round(F.sum(x), 2).alias("total"),
        mean_of(df, target).alias("mean"),
        F.min(x).alias("min"),
        F.round(F.lit(middle).cast("double"), 4).alias("median"),
        F.max(x).alias("max"),
    )


def histogram(df: DataFrame, column: str, bins: int = HISTOGRAM_BINS) -> DataFrame:
    """``(bin, low, high, n)`` of equal width over the finite values; the last bin holds the maximum.

    Infinities, if any, are counted in bins of their own: -1 below, ``bins`` above.
    """
    x = as_double(column)
    endless = F.abs(x) == float("inf")
    ends = df.agg(
        F.min(F.when(~endless, x)).alias("lo"),
        F.max(F.when(~endless, x)).alias("hi"),
        F.max(F.when(endless, -x)).alias("below"),
        F.max(F.when(endless, x)).alias("above"),
    ).first()
    infinite = float("inf")
    outside = [(-1, -infinite, -infinite)] if ends["below"] == infinite else []
    outside += [(bins, infinite, infinite)] if ends["above"] == infinite else []
    if ends["lo"] is None and not outside:
        return local_rows(df, [], "bin int, low double, high double, n bigint")
    lo = ends["lo"] or 0.0
    width = ((ends["hi"] or 0.0) - lo) / bins or 1.0
    place = F.least(F.floor((x - F.lit(lo)) / F.lit(width)), F.lit(bins - 1)).cast("int")
    place = F.when(endless, F.when(x < 0, -1).otherwise(bins)).otherwise(place)
    counted = (
        df.filter(col(column).isNotNull())
        .groupBy(place.alias("bin"))
        .agg(F.count("*").alias("n"))
    )
    axis = local_rows(
        df, [*([(i, lo + i * width, lo + (i + 1) * width) for i in range(bins)] if ends["lo"] is not None else []), *outside], "bin int, low double, high double"
    )
    return axis.join(F.broadcast(counted), "bin", "left").select(  # at most ``bins`` rows
        "bin",
        F.round("low", 6).alias("low"),
        F.round("high", 6).alias("high"),
        F.coalesce("n", F.lit(0)).cast("long").alias("n"),
    )


def box_plot(df: DataFrame, columns: Sequence[str], threshold: float = 1.5) -> DataFrame:
    """Quartiles, whiskers (furthest values inside the fences) and points beyond."""
    from ..functions.report import per_column

    found = exact_quantiles(df, columns, (0.25, 0.5, 0.75))

    def measures(c):
        q, x = found[c], as_double(c)
        if q[0.25] is None:
            return {"low": F.min(x), "high": F.max(x), "beyond": F.count(x)}
        step = threshold * (q[0.75] - q[0.25])
        inside = x.between(F.lit(q[0.25] - step), F.lit(q[0.75] + step))
        return {
            "low": F.min(F.when(inside, x)),
            "high": F.max(F.when(inside, x)),
            "beyond": F.count_if(~inside),
        }

    def shape(c, m):
        q = found[c]
        return {
            "low_whisker": m["low"],
            "q1": F.round(F.lit(q[0.25]).cast("double"), 6),
            "median": F.round(F.lit(q[0.5]).cast("double"), 6),
            "q3": F.round(F.lit(q[0.75]).cast("double"), 6),
            "high_whisker": m["high"],
            "beyond": m["beyond"],
        }

    return per_column(df, list(columns), measures, shape, "column string")


def category_comparison(df: DataFrame, target: str, by: Sequence[str]) -> DataFrame:
    """Count, sum and mean of the target per category (or pair of categories)."""
    x = as_double(target)
    return df.groupBy(*[col(c) for c in by]).agg(
        F.count(col(target)).alias("n"),
        F.round(F.sum(x), 2).alias("total"),
        mean_of(df, target).alias("mean"),
    )


def composition_share(df: DataFrame, target: str, by: str) -> DataFrame:
    """``(category, total, share)``: each category's part of the whole target."""
    whole = df.agg(F.sum(as_double(target)).alias("whole")).scalar()
    return (
        df.groupBy(col(by).cast("string").alias("category"))
        .agg(F.sum(as_double(target)).alias("part"))
        .select(
            "category",
            F.round("part", 2).alias("total"),
            F.round(F.try_divide(F.col("part"), whole), 6).alias("share"),
        )
    )


def trend_series(df: DataFrame, time: str, target: str, grain: str = "month", window: int = 3) -> DataFrame:
    """Per period: count, sum, mean, moving mean of the sum, change on the last period.

    The data is grouped by period first, map-side; the window then runs over the
    periods alone, whose number is bounded by the calendar.  Decimals are added as
    decimals and become doubles at the end, so that no figure depends on the order.
    """
    if grain not in GRAINS:
        raise ValueError(f"Unknown grain: {grain}")
    exact = isinstance(df.schema[target].dataType, T.DecimalType)
    period = F.date_trunc(grain, col(time)).cast("date")
    total = F.sum(col(target) if exact else as_double(target))
    n = F.count(col(target))
    mean = F.try_divide(total.cast("double"), n) if exact else mean_of(df, target)
    periods = df.filter(col(time).isNotNull()).groupBy(period.alias("period")).agg(n.alias("n"), total.alias("s"), mean.alias("m"))
    in_time = Window.orderBy("period")
    last = in_time.rowsBetween(1 - window, 0)
    moving = F.try_divide(F.sum("s").over(last).cast("double"), F.count("s").over(last)) if exact else F.round(F.avg("s").over(last), 4)
    change = F.col("s") - F.lag("s").over(in_time)
    return periods.select(
        F.date_format("period", "yyyy-MM-dd").alias("period"),
        "n",
        (F.col("s").cast("double") if exact else F.round("s", 2)).alias("total"),
        F.col("m").alias("mean"),
        moving.alias("moving_mean"),
        (change.cast("double") if exact else F.round(change, 2)).alias("change"),
    )


def point_sample(df: DataFrame, key: str, columns: Sequence[str], n: int = SAMPLE_POINTS) -> DataFrame:
    """``n`` points for a scatter chart: those with the smallest key hash."""
    h = F.md5(col(key).cast("string"))
    return df.select(col(key), *[col(c) for c in columns]).orderBy(h, col(key)).limit(n)


def actual_vs_predicted(df: DataFrame, key: str, label: str, prediction: str, n: int = SAMPLE_POINTS) -> DataFrame:
    """``(series, key, x, y)``: sampled pairs and the two ends of the ideal line."""
    pairs = point_sample(df, key, [label, prediction], n).select(
        F.lit("points").alias("series"),
        col(key).cast("string").alias("key"),
        as_double(label).alias("x"),
        as_double(prediction).alias("y"),
    )
    ends = df.agg(F.min(as_double(label)).alias("lo"), F.max(as_double(label)).alias("hi"))
    line = ends.select(
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit("ideal").alias("series"),
                        F.lit(k).alias("key"),
                        F.col(k).alias("x"),
                        F.col(k).alias("y"),
                    )
                    for k in ("lo", "hi")
                ]
            )
        )
    )
    return pairs.unionByName(line)


def model_comparison(board: DataFrame) -> DataFrame:
    """``(place, model, primary_metric, score, spread)`` of the models that ran."""
    if not board.take(1):
        raise ValueError("The leaderboard is empty")
    return board.filter("score IS NOT NULL").select(
        "place", "model", "primary_metric", "score", F.col("cv_std_f1").alias("spread")
    )


def confusion_series(df: DataFrame, label: str, prediction: str) -> DataFrame:
    return confusion_matrix(df, label, prediction)


def cluster_scatter(df: DataFrame, key: str, features: str, label: str, n: int = SAMPLE_POINTS) -> DataFrame:
    """``(key, pc1, pc2, cluster)``: two principal components of centred features.

    The components are fitted on all rows; the largest loading of each is made
    positive, so the picture does not flip between runs.
    """
    from pyspark.ml.feature import PCA, StandardScaler
    from pyspark.ml.functions import vector_to_array

    if len(df.limit(2).collect()) < 2:
        raise ValueError("A cluster chart needs at least two rows")
    centred = (
        StandardScaler(inputCol=features, outputCol="__c", withMean=True, withStd=False).fit(df).transform(df)
    )
    model = PCA(k=2, inputCol="__c", outputCol="__p").fit(centred)
    loadings = model.pc.toArray()
    signs = [1.0 if loadings[abs(loadings[:, j]).argmax(), j] >= 0 else -1.0 for j in range(2)]
    sample = centred.orderBy(F.md5(col(key).cast("string")), col(key)).limit(n)
    xy = vector_to_array("__p")
    return model.transform(sample).select(
        col(key).cast("string").alias("key"),
        (xy[0] * signs[0]).alias("pc1"),
        (xy[1] * signs[1]).alias("pc2"),
        col(label).cast("string").alias("cluster"),
    )
