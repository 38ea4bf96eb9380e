"""Fold scores from sums equal fits that are made one by one."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from tablewright.operators import folds
from tablewright.operators.splitting import assign_folds


def table_of(spark, rows=400, shift=1e6):
    return spark.range(rows).select(
        "id",
        array_to_vector(F.array(F.sin("id") + shift, F.cos(F.col("id") * 2), (F.col("id") % 7).cast("double"), F.lit(3.0))).alias("x"),
        (F.sin("id") * 4 - (F.col("id") % 7) + F.cos(F.col("id") * 5) + 2 * shift).alias("y"),
    )


def plain_fit(x, y, l1, l2):
    """Proximal steps, slow and sure."""
    xm, ym = x.mean(axis=0), y.mean()
    a, t, b = x - xm, y - ym, np.zeros(x.shape[1])
    step = 1 / (np.linalg.norm(a, 2) ** 2 / len(y) + l2 + 1e-12)
    for _ in range(20_000):
        b = b - step * (a.T @ (a @ b - t) / len(y) + l2 * b)
        b = np.sign(b) * np.maximum(np.abs(b) - step * l1, 0)
    return b, ym - xm @ b


@pytest.mark.parametrize("parts", [1, 7])
def test_scores_equal_fits_one_by_one(spark, parts):
    df = table_of(spark).repartition(parts)
    got = {(r["model"], r["fold"]): r for r in folds.cross_validate_linear(df, "x", "y", ["id"]).collect()}
    rows = assign_folds(df, None, ["id"]).toPandas()
    x, y, f = np.array([v.toArray() for v in rows["x"]]), rows["y"].to_numpy(), rows["fold"].to_numpy()
    assert len(got) == 20
    for (name, fold), r in got.items():
        l1, l2, divided = folds.LINEAR_FAMILY[name]
        train, held = f != fold, f == fold
        share = train.sum() if divided else 1
        b, c = plain_fit(x[train], y[train], l1 / share, l2 / share)
        e = y[held] - x[held] @ b - c
        assert r["rows"] == held.sum()
        assert r["rmse"] == pytest.approx(np.sqrt((e**2).mean()), rel=1e-4)
        assert r["r2"] == pytest.approx(1 - (e**2).sum() / ((y[held] - y[held].mean()) ** 2).sum(), abs=1e-4)


def test_odd_tables(spark):
    df = table_of(spark, 3)
    assert folds.cross_validate_linear(df.limit(0), "x", "y", ["id"]).collect() == []
    assert folds.cross_validate_linear(df.limit(1), "x", "y", ["id"]).collect() == []
    few = folds.cross_validate_linear(df, "x", "y", ["id"], ["linear"]).collect()
    assert [(r["rows"], r["r2"]) for r in few] == [(1, None)] * 3
    gaps = df.unionByName(df.withColumns({"id": F.col("id") + 10, "y": F.lit(None).cast("double")}))
    assert folds.cross_validate_linear(gaps, "x", "y", ["id"], ["linear"]).agg(F.sum("rows")).first()[0] == 3
    with pytest.raises(ValueError):
        folds.cross_validate_linear(df, "x", "y", ["id"], ["knn"])


def test_the_number_of_jobs_does_not_grow_with_folds(spark):
    context = spark.sparkContext
    counts = []
    for k in (2, 10):
        context.setJobGroup(f"folds-{k}", "")
        folds.cross_validate_linear(table_of(spark), "x", "y", ["id"], folds=k).collect()
        counts.append(len(context.statusTracker().getJobIdsForGroup(f"folds-{k}")))
    assert counts[0] == counts[1]
