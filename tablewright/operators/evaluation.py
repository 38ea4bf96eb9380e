"""Scores of predictions: regression, classification, confusion, silhouette."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.numeric import signless
from ..functions.report import local_rows
from ..functions.schema import col

# Up to this many numbers the other side of a distance job is broadcast (32 MB).
BROADCAST_CELLS = 4_000_000
BLOCK_ROWS = 4096
#: Distances held at once, and pairs whose differences are.
TILE, PAIRS = 2_000_000, 65_536
#: Below this share of the norms a squared distance is worked out from differences.
CANCELLED = 1e-6


def regression_metrics(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """``(rmse, mae, r2)`` in one pass; the total spread uses mergeable moments."""
    y, p = col(label).cast("double"), col(prediction).cast("double")
    both = df.select(y.alias("y"), p.alias("p")).filter("y IS NOT NULL AND p IS NOT NULL")
    e = F.col("y") - F.col("p")
    sst = F.var_pop("y") * F.count("y")
    return both.agg(
        F.sqrt(F.avg(e * e)).alias("rmse"),
        F.avg(F.abs(e)).alias("mae"),
        (F.lit(1.0) - F.try_divide(F.sum(e * e), sst)).alias("r2"),
    )


def confusion_counts(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """``(actual, predicted, n)`` for the pairs that occur."""
    return (
        df.filter(col(label).isNotNull() & col(prediction).isNotNull())
        .groupBy(
            col(label).cast("string").alias("actual"),
            col(prediction).cast("string").alias("predicted"),
        )
        .agg(F.count("*").alias("n"))
    )


def confusion_matrix(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """``(actual, predicted, n)``: the pairs that occur, for any number of labels; ``n`` sums to the rows."""
    return confusion_counts(df, label, prediction)


def class_scores(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """``(class, support, precision, recall, f1)``; zero where a ratio is undefined."""
    return _class_scores(confusion_counts(df, label, prediction))


def _class_scores(counts: DataFrame) -> DataFrame:
    hit = F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(F.lit(0))
    zero = F.lit(0).cast("long")
    views = F.array(
        F.struct(F.col("actual").alias("class"), F.col("n").alias("support"), zero.alias("claimed"), hit.alias("tp")),
        F.struct(F.col("predicted").alias("class"), zero.alias("support"), F.col("n").alias("claimed"), zero.alias("tp")),
    )
    sums = (
        counts.select(F.inline(views))
        .groupBy("class")
        .agg(F.sum("support").alias("support"), F.sum("claimed").alias("claimed"), F.sum("tp").alias("tp"))
    )
    precision = F.coalesce(F.try_divide(F.col("tp"), F.col("claimed")), F.lit(0.0))
    recall = F.coalesce(F.try_divide(F.col("tp"), F.col("support")), F.lit(0.0))
    f1 = F.coalesce(F.try_divide(F.lit(2.0) * F.col("tp"), F.col("claimed") + F.col("support")), F.lit(0.0))
    return sums.select(
        "class",
        "support",
        "tp",
        precision.alias("precision"),
        recall.alias("recall"),
        f1.alias("f1"),
    )


def classification_metrics(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """``(accuracy, precision, recall, f1)``, the last three weighted by support."""
    per_class = class_scores(df, label, prediction)
    n = F.sum("support")

    def weighted(c):
        return F.try_divide(F.sum(F.col(c) * F.col("support")), n)

    return per_class.agg(
        F.try_divide(F.sum("tp"), n).alias("accuracy"),
        weighted("precision").alias("precision"),
        weighted("recall").alias("recall"),
        weighted("f1").alias("f1"),
    )


# --- silhouette -------------------------------------------------------------------


def silhouette_squared(df: DataFrame, features: str, label: str) -> float:
    """Mean silhouette on squared Euclidean distance: linear in rows, for any size."""
    from pyspark.ml.evaluation import ClusteringEvaluator

    judge = ClusteringEvaluator(
        featuresCol=features, predictionCol=label, metricName="silhouette", distanceMeasure="squaredEuclidean"
    )
    return float(judge.evaluate(df))


def silhouette_euclidean(
    df: DataFrame,
    key: str,
    features: str,
    label: str,
    broadcast_cells: int = BROADCAST_CELLS,
    block_rows: int | None = None,
) -> DataFrame:
    """``(rows, silhouette)`` on Euclidean distance, exact.

    Every row needs its summed distance to each cluster, which is quadratic by
    nature.  A small table is broadcast whole (its size is checked first); a
    larger one is cut into blocks, and each pair of blocks is one bounded task
    group that returns sums per row and cluster, never the pairs.
    """
    points = df.select(
        col(key).alias("id"),
        col(label).cast("string").alias("label"),
        col(features).cast(T.ArrayType(T.DoubleType())).alias("x"),
    ).filter("x IS NOT NULL AND label IS NOT NULL")
    head = points.agg(F.count("*").alias("n"), F.max(F.size("x")).alias("d")).first()
    rows, dim = head["n"], head["d"] or 1
    if rows * dim <= broadcast_cells:
        sums = _sums_against_broadcast(points)
    else:
        # the larger the blocks, the fewer copies of a row are shuffled: a quarter of what may be broadcast
        block_rows = block_rows or max(BLOCK_ROWS, broadcast_cells // (4 * dim))
        sums = _sums_by_blocks(points, max(1, math.ceil(rows / block_rows)))
    counts = points.groupBy("label").agg(F.count("*").alias("size")).collect()
    sizes = F.create_map(*[F.lit(v) for r in counts for v in (r["label"], r["size"])])
    own = F.col("other") == F.col("label")
    size = sizes[F.col("other")].cast("double")
    mean = F.when(own, F.try_divide(F.col("s"), size - 1)).otherwise(F.try_divide(F.col("s"), size))
    per_row = (
        sums.groupBy("id", "label", "other")
        .agg(F.sum("s").alias("s"))
        .select("id", "label", own.alias("own"), mean.alias("mean"))
        .groupBy("id", "label")
        .agg(
            F.max(F.when(F.col("own"), F.col("mean"))).alias("a"),
            F.min(F.when(~F.col("own"), F.col("mean"))).alias("b"),
        )
    )
    # A row alone in its cluster scores zero.
    score = F.coalesce(
        F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b")), F.lit(0.0)
    )
    score = F.when(F.col("a").isNull(), 0.0).otherwise(score)
    return per_row.agg(
        F.count("*").alias("rows"), signless(F.avg(score)).alias("silhouette")
    )


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Distances of all rows: one product of matrices, and differences where it cancels.

    Both sides are shifted to the middle of ``y`` first.  Where a squared distance is small
    beside the norms, little of the product's precision is left; those few pairs are worked
    out from their differences, some at a time.
    """
    middle = y.mean(axis=0)
    x, y = x - middle, y - middle
    nx, ny = (x * x).sum(axis=1), (y * y).sum(axis=1)
    scale = nx[:, None] + ny[None, :]
    far = scale - 2.0 * (x @ y.T)
    r, c = np.nonzero(far <= CANCELLED * scale)
    for a in range(0, len(r), PAIRS):
        gap = x[r[a : a + PAIRS]] - y[c[a : a + PAIRS]]
        far[r[a : a + PAIRS], c[a : a + PAIRS]] = (gap * gap).sum(axis=1)
    return np.sqrt(far, out=far)


def _cluster_sums(x: np.ndarray, others, names) -> np.ndarray:
    """Summed distance of every row of ``x`` to each cluster of ``others``.

    Rows of a cluster stand together, so that a tile's sums are sums of its columns; a tile
    holds TILE distances, whatever the number of dimensions and clusters.
    """
    out = np.zeros((len(x), len(names)))
    if not len(others) or not len(x):
        return out
    codes = {name: i for i, name in enumerate(names)}
    which = np.array([codes[n] for n in others["label"]])
    order = np.argsort(which, kind="stable")
    which = which[order]
    matrix = np.asarray(others["x"].tolist(), dtype=float)[order]
    step = max(1, TILE // BLOCK_ROWS)
    for at in range(0, len(matrix), BLOCK_ROWS):
        part, own = matrix[at : at + BLOCK_ROWS], which[at : at + BLOCK_ROWS]
        begin = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
        for start in range(0, len(x), step):
            far = _distances(x[start : start + step], part)
            out[start : start + step, own[begin]] += np.add.reduceat(far, begin, axis=1)
    return out


def _long_sums(rows, sums, names):
    import pandas as pd

    return pd.DataFrame(
        {
            "id": [i for i in rows["id"] for _ in names],
            "label": [v for v in rows["label"] for _ in names],
            "other": list(names) * len(rows),
            "s": sums.ravel(),
        }
    )


def _sums_schema(points: DataFrame) -> T.StructType:
    return T.StructType(
        [
            T.StructField("id", points.schema["id"].dataType),
            T.StructField("label", T.StringType()),
            T.StructField("other", T.StringType()),
            T.StructField("s", T.DoubleType()),
        ]
    )


def _sums_against_broadcast(points: DataFrame) -> DataFrame:
    whole = points.select("label", "x").toPandas()
    shared = points.sparkSession.sparkContext.broadcast(whole)
    names = sorted(whole["label"].unique())

    def sums(batches):
        others = shared.value
        for rows in batches:
            if len(rows):
                x = np.asarray(rows["x"].tolist(), dtype=float)
                yield _long_sums(rows, _cluster_sums(x, others, names), names)

    return points.mapInPandas(sums, _sums_schema(points))


def _sums_by_blocks(points: DataFrame, blocks: int) -> DataFrame:
    every = F.sequence(F.lit(0), F.lit(blocks - 1))
    placed = points.withColumn("b", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
    probes = placed.withColumnRenamed("b", "i").withColumn("j", F.explode(every))
    bases = placed.select("label", "x", F.col("b").alias("j")).withColumn("i", F.explode(every))

    def sums(rows, others):
        import pandas as pd

        if not len(rows) or not len(others):
            return pd.DataFrame({"id": [], "label": [], "other": [], "s": []})
        names = sorted(others["label"].unique())
        x = np.asarray(rows["x"].tolist(), dtype=float)
        return _long_sums(rows, _cluster_sums(x, others, names), names)

    return (
        probes.groupBy("i", "j").cogroup(bases.groupBy("i", "j")).applyInPandas(sums, _sums_schema(points))
    )
