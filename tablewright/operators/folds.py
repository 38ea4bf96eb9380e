"""Fold scores of the linear family from sums: all folds are fitted and scored by one pass over the rows.

A linear fit needs no more of its rows than their number and the sums of products of
features and label.  Those sums, kept apart by fold, add up to every training set (all
folds but one) and also give the squared error on the fold left out.  So five folds of
four models cost one pass, where fitting them one by one reads the rows some hundred times.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.report import local_rows
from .splitting import FOLDS, SEED, assign_folds

#: Penalties of the models: (l1, l2, whether they are divided by the number of rows).
LINEAR_FAMILY = {"linear": (0.0, 0.0, False), "ridge": (0.0, 1.0, True), "lasso": (1.0, 0.0, False), "elastic_net": (0.5, 0.5, False)}
#: Features whose sums of products fit the driver: a square of this many doubles, for each fold.
MOST_FEATURES = 2_000
ROUNDS, ENOUGH = 10_000, 1e-12
SCORE_SCHEMA = "model string, fold int, rows long, rmse double, r2 double"


def fold_sums(marked: DataFrame, features: str, label: str, centre: np.ndarray) -> dict[int, np.ndarray]:
    """Per fold the sums of products of (1, features, label), shifted by ``centre`` so that little is cancelled.

    A task adds up products of its rows by fold and returns a square each; the squares
    are added row by row, so that no task holds more than a few of them.
    """
    size = len(centre)

    def partial(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            if not len(batch):
                continue
            fold = batch.column("fold").to_numpy()
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(len(batch), -1)
            z = np.column_stack([np.ones(len(batch)), x, batch.column("y").to_numpy()])
            z[:, 1:] -= centre[1:]
            for f in np.unique(fold).tolist():
                part = z[fold == f]
                sums[f] = sums.get(f, 0.0) + part.T @ part
        for f, s in sums.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([f] * size, pa.int32()), pa.array(range(size), pa.int32()), pa.array(list(s), pa.list_(pa.float64()))],
                names=["fold", "place", "products"],
            )

    rows = marked.select("fold", vector_to_array(features).alias("x"), F.col(label).cast("double").alias("y"))
    found = rows.mapInArrow(partial, "fold int, place int, products array<double>")
    total = (
        found.select("fold", "place", F.posexplode("products").alias("other", "v"))
        .groupBy("fold", "place", "other")
        .agg(F.sum("v").alias("v"))
        .groupBy("fold", "place")
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("other", "v"))), lambda r: r["v"]).alias("products"))
    )
    out: dict[int, np.ndarray] = {}
    for r in total.collect():
        out.setdefault(r["fold"], np.zeros((size, size)))[r["place"]] = r["products"]
    return out


def solve(sums: np.ndarray, l1: float, l2: float) -> tuple[np.ndarray, float]:
    """Coefficients and intercept (of shifted data) that minimise the mean squared error / 2 + l1 |b| + l2 b^2 / 2."""
    n = sums[0, 0]
    mean = sums[0, 1:] / n
    moments = sums[1:, 1:] / n - np.outer(mean, mean)
    xx, xy = moments[:-1, :-1], moments[:-1, -1]
    if not l1:
        b = np.linalg.lstsq(xx + l2 * np.eye(len(xx)), xy, rcond=1e-12)[0]
    else:
        b = np.zeros(len(xx))
        width = np.diag(xx) + l2
        for _ in range(ROUNDS):
            before = b.copy()
            for j in range(len(b)):
                if width[j] > 0:
                    rest = xy[j] - xx[j] @ b + xx[j, j] * b[j]
                    b[j] = np.sign(rest) * max(abs(rest) - l1, 0.0) / width[j]
            if np.abs(b - before).max(initial=0.0) <= ENOUGH * max(1.0, np.abs(b).max(initial=0.0)):
                break
    return b, float(mean[-1] - mean[:-1] @ b)


def score(sums: np.ndarray, b: np.ndarray, intercept: float) -> tuple[int, float | None, float | None]:
    """(rows, rmse, r2) of a fit on the rows that the sums were made of; r2 is NULL without spread."""
    n = sums[0, 0]
    w = np.concatenate([[-intercept], -b, [1.0]])
    error = max(float(w @ sums @ w), 0.0)
    spread = float(sums[-1, -1] - sums[0, -1] ** 2 / n)
    return int(n), float(np.sqrt(error / n)), (1 - error / spread if spread > 0 else None)


def cross_validate_linear(
    df: DataFrame,
    features: str,
    label: str,
    key: Sequence[str],
    models: Sequence[str] = tuple(LINEAR_FAMILY),
    folds: int = FOLDS,
    seed: int = SEED,
) -> DataFrame:
    """``(model, fold, rows, rmse, r2)``: every model's score on every fold that it was not fitted on.

    ``features`` is a vector column.  Rows without label or features take no part.  A fold
    without rows, or whose training rows are none, has no score.  Folds follow the hash of
    ``key``, as everywhere.
    """
    unknown = [m for m in models if m not in LINEAR_FAMILY]
    if unknown:
        raise ValueError(f"Not linear: {unknown}")
    held = df.filter(F.col(features).isNotNull() & F.col(label).isNotNull())
    x = vector_to_array(features)
    first = held.select(F.size(x).alias("n")).first()
    if first is None:
        return local_rows(df, [], SCORE_SCHEMA)
    if first["n"] > MOST_FEATURES:
        raise ValueError(f"Sums of products of {first['n']} features do not fit the driver; at most {MOST_FEATURES}")
    from pyspark.ml.stat import Summarizer

    means = held.agg(Summarizer.mean(F.col(features)).alias("x"), F.avg(F.col(label).cast("double")).alias("y")).first()
    centre = np.concatenate([[0.0], means["x"].toArray(), [means["y"]]])
    sums = fold_sums(assign_folds(held, None, key, folds, seed), features, label, centre)
    whole = sum(sums.values())
    rows = []
    for name in models:
        l1, l2, divided = LINEAR_FAMILY[name]
        for fold, own in sorted(sums.items()):
            training = whole - own
            if training[0, 0] < 1:
                continue
            share = training[0, 0] if divided else 1.0
            rows.append((name, fold, *score(own, *solve(training, l1 / share, l2 / share))))
    return local_rows(df, rows, SCORE_SCHEMA)
