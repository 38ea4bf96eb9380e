"""Fit the models of a task on prepared features and rank them."""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark import inheritable_thread_target
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.report import local_rows
from ..functions.schema import col
from ..session import spread, tasks_for
from . import neighbours
from .estimators import FOREST, LARGE_ONLY, NEIGHBOURS, FitContext, model_order, registry, usable_value
from .evaluation import classification_metrics, regression_metrics, silhouette_squared
from .features import BROADCAST_ROWS
from .splitting import FOLDS, SEED, assign_folds
from .target import detect_task

SMALL_TRAINING, CV_MINIMUM, CLUSTER_MINIMUM = 100, 10, 50
TINY_TABLE, SMALL_TABLE = 50, 100
TOP_IMPORTANCES, TOP_PERMUTATION, PERMUTATION_REPEATS = 20, 10, 10
SAMPLE_PREDICTIONS = 20
# Cells of a sample that shows where a column's bins lie; bins and bits of a key that orders rows.
SHOWN_CELLS, KEY_BINS, KEY_BITS = 1_000_000, 32, 62
METRICS = ("rmse", "mae", "r2", "accuracy", "precision", "recall", "f1", "cv_mean_f1", "cv_std_f1", "silhouette")
LEADERBOARD_SCHEMA = (
    "model string, model_order int, primary_metric string, score double, "
    + ", ".join(f"{m} double" for m in METRICS)
    + ", error string"
)


@dataclass
class Matrix:
    """Rows as ``(key, features, label, target, split)``; ``names`` label the vector."""

    df: DataFrame
    names: list[str]
    task: str
    classes: list[str] = field(default_factory=list)
    key: str = "__key"
    keyed: bool = True  # False: the key is a digest of the row, shared by its copies

    def part(self, split: str) -> DataFrame:
        return self.df.filter(F.col("split") == split)


@dataclass
class NeighbourModel:
    """k-NN as a model: the training rows are the model."""

    train: DataFrame
    matrix: Matrix

    def transform(self, df: DataFrame) -> DataFrame:
        n = len(self.matrix.names)

        def spread(part, *extra):
            x = vector_to_array("features")
            return part.select(F.col(self.matrix.key), *extra, *[x[i].alias(f"x{i}") for i in range(n)])

        vote = neighbours.knn_classify if self.matrix.task == "classification" else neighbours.knn_regress
        rows = spread(df)
        found = vote(
            spread(self.train, F.col("label")),
            rows if self.matrix.keyed else rows.dropDuplicates([self.matrix.key]),
            [f"x{i}" for i in range(n)],
            self.matrix.key,
            "label",
        )
        return df.join(found, self.matrix.key, "left")


@dataclass
class Trained:
    task: str
    leaderboard: DataFrame
    best_name: str | None
    models: dict[str, Any]
    matrix: Matrix
    warnings: list[str]
    fold_scores: DataFrame | None = None  # (model, fold, score) of models that were cross-validated

    def release(self) -> None:
        """Free the persisted matrix once no more rows are scored."""
        self.matrix.df.unpersist()

    @property
    def best(self) -> Any:
        return self.models.get(self.best_name) if self.best_name else None


def build_matrix(
    data: DataFrame,
    features: Sequence[str],
    target: str | None,
    key: str | None = None,
    task: str | None = None,
) -> Matrix:
    """Pack feature columns into a vector, or take a ``features`` vector as it is, and code the target.

    Classes are coded by a table that is joined to the rows; their names come to the
    driver as a model holds one entry a class.
    """
    vector = "features" in data.columns and isinstance(data.schema["features"].dataType, VectorUDT)
    safe = [f"__x{i}" for i in range(len(features))]
    identity = (
        col(key)
        if key
        else F.md5(F.to_json(F.struct(*[vector_to_array(c) if vector and c == "features" else col(c) for c in data.columns])))
    )
    split = col("split") if "split" in data.columns else F.lit("train")
    if target is None:
        task, classes, label = "unsupervised", [], F.lit(0.0)
        named = F.lit(None).cast("string")
    else:
        task = task or detect_task(data, target)
        named = col(target).cast("string")
        if task == "classification":
            found = data.select(named.alias("c")).filter("c IS NOT NULL").distinct()
            classes = sorted(r["c"] for r in found.collect())  # a model holds one entry a class
            codes = [(c, float(k)) for k, c in enumerate(classes)]
            book = local_rows(data, codes, "__class string, __label double")
            data = data.join(F.broadcast(book) if len(codes) <= BROADCAST_ROWS else book, named == F.col("__class"), "left")
            label = F.col("__label")
        else:
            classes, label = [], col(target).cast("double")
    wide = data.select(
        identity.alias("__key"),
        *([col("features")] if vector else [col(c).cast("double").alias(s) for c, s in zip(features, safe)]),
        label.alias("label"),
        named.alias("target"),
        split.alias("split"),
    )
    packed = wide if vector else VectorAssembler(inputCols=safe, outputCol="features", handleInvalid="error").transform(wide)
    kept = packed.select("__key", "features", "label", "target", "split")
    if target is not None:
        kept = kept.filter("label IS NOT NULL")
    return Matrix(kept, list(features), task, classes, keyed=key is not None)


def fit_context(train: DataFrame, matrix: Matrix) -> FitContext:
    """Rows, label deviation and mean feature variance from one aggregate over the vectors."""
    n = len(matrix.names)
    row = train.agg(
        F.count("*").alias("n"),
        F.stddev_samp("label").alias("s"),
        Summarizer.metrics("mean", "normL2").summary(F.col("features")).alias("x"),
    ).first()
    if not row["n"]:
        return FitContext(0, n, len(matrix.classes))
    mean = sum(row["x"]["mean"]) / max(n, 1)
    squares = sum(v * v for v in row["x"]["normL2"]) / row["n"]
    variance = squares / max(n, 1) - mean * mean
    return FitContext(row["n"], n, len(matrix.classes), row["s"] or 1.0, max(variance, 1e-12))


def training_rows(matrix: Matrix) -> DataFrame:
    """The training rows, dealt over the cores by their number and persisted."""
    train = matrix.part("train")
    return spread(train, train.count()).persist()


def _key_bits(shown: Any) -> list[tuple[int, Any, int]]:
    """``(column, cuts, shift)`` of each bit of a key, the most telling bits of all columns first."""
    import numpy as np

    columns = []
    for j in range(shown.shape[1]):
        cuts = np.unique(np.quantile(shown[:, j], np.arange(1, KEY_BINS) / KEY_BINS, method="lower"))
        values = np.unique(shown[:, j])
        if len(values) < 2:
            continue
        if len(values) <= KEY_BINS:
            cuts = values[:-1]
        share = np.bincount(np.searchsorted(cuts, shown[:, j])) / len(shown)
        share = share[share > 0]
        columns.append((-float(-(share * np.log2(share)).sum()), j, cuts, len(cuts).bit_length()))
    columns.sort(key=lambda c: c[:2])
    bits = [(j, cuts, width - 1 - k) for k in range(KEY_BINS) for _, j, cuts, width in columns if k < width]
    return bits[:KEY_BITS]


def near_rows(train: DataFrame, rows: int) -> DataFrame:
    """All rows of ``train``, those with like features next to each other inside each partition.

    A forest looks up the node of each row in each tree, level by level: like rows take the same
    ways, which then are in the cache.  Bins of the columns, from a sample, are interleaved to a
    key, and partitions are sorted by it.  Few rows (one task) stay as they are.
    """
    import numpy as np

    spark = train.sparkSession
    if tasks_for(spark, rows) < 2:
        return train
    kept = train.select("features", "label")
    width = kept.select(F.size(vector_to_array("features"))).first()[0]
    most = max(100, SHOWN_CELLS // max(1, width))
    shown = kept.sample(min(1.0, most / rows), SEED).select(vector_to_array("features").alias("x")).limit(2 * most).collect()
    bits = _key_bits(np.array([r["x"] for r in shown], dtype=float)) if len(shown) > 1 else []
    if not bits:
        return train
    used = sorted({j for j, _, _ in bits})
    place = {j: i for i, j in enumerate(used)}

    @F.pandas_udf("long")
    def key(x):
        import pandas as pd

        cells = np.asarray(x.tolist(), dtype=float).reshape(len(x), len(used))
        bins = {j: np.searchsorted(cuts, cells[:, place[j]]) for j, cuts, shift in bits if shift == len(cuts).bit_length() - 1}
        out = np.zeros(len(x), dtype=np.int64)
        for j, _, shift in bits:
            out = (out << 1) | ((bins[j] >> shift) & 1)
        return pd.Series(out)

    x = vector_to_array("features")
    return kept.withColumn("k", key(F.array(*[x[j] for j in used]))).sortWithinPartitions("k").drop("k")


def fit_one(name: str, matrix: Matrix, train: DataFrame, context: FitContext) -> Any:
    if name == NEIGHBOURS:
        return NeighbourModel(train, matrix)
    model = registry(matrix.task)[name](context)
    if name == FOREST:
        near = near_rows(train, context.rows)
        held = near if near is train else near.persist()
        try:
            return model.fit(held)
        finally:
            if held is not train:
                held.unpersist()
    return model.fit(train)


def score_one(matrix: Matrix, predicted: DataFrame) -> dict[str, float]:
    measure = classification_metrics if matrix.task == "classification" else regression_metrics
    return measure(predicted, "label", "prediction").first().asDict()


def primary(task: str, metrics: dict[str, float]) -> tuple[str, float]:
    if task == "regression":
        return "r2", metrics["r2"]
    if task == "classification":
        if "cv_mean_f1" in metrics:
            return "f1_cv", metrics["cv_mean_f1"]
        return "f1", metrics["f1"]
    return "silhouette", metrics["silhouette"]


def cross_validate(
    name: str, matrix: Matrix, train: DataFrame, context: FitContext, folds: int = FOLDS
) -> list[float]:
    """Weighted F1 of each held-out fold; folds are balanced per class."""
    marked = assign_folds(train, "label", [matrix.key], folds, SEED).persist()
    scores = []
    try:
        for k in range(folds):
            model = fit_one(name, matrix, marked.filter(F.col("fold") != k), context)
            held = model.transform(marked.filter(F.col("fold") == k))
            scores.append(score_one(matrix, held)["f1"])
    finally:
        marked.unpersist()
    return scores


def size_notes(rows: int, train_rows: int, task: str) -> list[str]:
    out = []
    if rows < TINY_TABLE:
        out.append("tiny_table")
    elif rows < SMALL_TABLE:
        out.append("small_table")
    if task == "classification" and train_rows < SMALL_TRAINING:
        out.append("simple_models_only")
    return out


def train_models(
    matrix: Matrix, names: Sequence[str] | None = None, parallelism: int = 2
) -> Trained:
    """Fit every model of the task, score it, and rank; a failing one is noted.

    Each fit is distributed; independent fits share the cluster from a few
    driver threads.  The matrix is dealt over the cores by its rows, as a pass costs far
    more than its bytes tell, and persisted for the passes the fits make.
    """
    rows = matrix.df.count()
    held = spread(matrix.df, rows).persist()
    matrix = replace(matrix, df=held)
    train, test = matrix.part("train"), matrix.part("test")
    if matrix.task == "unsupervised":
        train = test = held
        if rows < CLUSTER_MINIMUM:
            held.unpersist()
            raise ValueError(f"Clustering needs at least {CLUSTER_MINIMUM} rows, got {rows}")
    context = fit_context(train, matrix)
    order = model_order(matrix.task)
    chosen = [n for n in order if names is None or n in names]
    small = matrix.task == "classification" and context.rows < SMALL_TRAINING
    if small:
        chosen = [n for n in chosen if n not in LARGE_ONLY]

    folds: dict[str, list[float]] = {}

    def run(name: str):
        try:
            if small and context.rows >= CV_MINIMUM:
                scores = cross_validate(name, matrix, train, context, min(FOLDS, context.rows))
                folds[name] = scores
                mean = sum(scores) / len(scores)
                spread = (sum((s - mean) ** 2 for s in scores) / len(scores)) ** 0.5
                model = fit_one(name, matrix, train, context)
                metrics = {"cv_mean_f1": mean, "cv_std_f1": spread}
            else:
                model = fit_one(name, matrix, train, context)
                if matrix.task == "unsupervised":
                    metrics = {"silhouette": silhouette_squared(model.transform(held), "features", "prediction")}
                else:
                    metrics = score_one(matrix, model.transform(test))
            return name, model, metrics, None
        except Exception as error:  # a model that fails must not lose the others
            return name, None, {}, f"{type(error).__name__}: {error}"

    with ThreadPoolExecutor(max_workers=max(1, parallelism)) as pool:
        results = list(pool.map(inheritable_thread_target(held.sparkSession)(run), chosen))
    rows_out, models = [], {}
    for name, model, metrics, error in results:
        if model is not None:
            models[name] = model
        metric, score = primary(matrix.task, metrics) if metrics else (None, None)
        rows_out.append(
            (name, order.index(name), metric, score if usable_value(score) else None,
             *[metrics.get(m) for m in METRICS], error)
        )
    board = local_rows(held, rows_out, LEADERBOARD_SCHEMA)
    ranked = rank_models(board)
    first = ranked.filter("score IS NOT NULL").orderBy("place").first()
    return Trained(
        matrix.task,
        ranked,
        first["model"] if first else None,
        models,
        matrix,
        size_notes(rows, context.rows, matrix.task),
        local_rows(held, [(n, k, s) for n in sorted(folds) for k, s in enumerate(folds[n])], "model string, fold int, score double"),
    )


def rank_models(board: DataFrame) -> DataFrame:
    """Add ``place``: by score, the earlier-listed model first among equals."""
    from pyspark.sql import Window

    # One row per model: the window never holds more than the registry.
    ranked = Window.orderBy(F.desc_nulls_last("score"), F.asc("model_order"))
    return board.withColumn("place", F.row_number().over(ranked))


def best_model(board: DataFrame) -> DataFrame:
    """``(model, score)`` of the winner; the first listed of equals wins."""
    rank = F.struct((-F.col("score")).alias("neg"), F.col("model_order"))
    scored = board.filter("score IS NOT NULL")
    return scored.agg(F.min_by("model", rank).alias("model"), F.max("score").alias("score"))


def score_batch(trained_model: Any, matrix: Matrix, rows: DataFrame | None = None) -> DataFrame:
    """``(__key, target, prediction[, predicted_class])`` for the given rows."""
    out = trained_model.transform(matrix.part("test") if rows is None else rows)
    kept = [F.col(matrix.key), F.col("target"), F.col("prediction").cast("double").alias("prediction")]
    if matrix.classes:
        names = F.array(*[F.lit(c) for c in matrix.classes])
        place = F.col("prediction").cast("int") + 1
        kept.append(F.try_element_at(names, place).alias("predicted_class"))
    if "probability" in out.columns:
        kept.append(F.array_max(vector_to_array("probability")).alias("probability"))
    return out.select(*kept)


def prediction_sample(scored: DataFrame, key: str, n: int = SAMPLE_PREDICTIONS) -> DataFrame:
    return scored.orderBy(key).limit(n)


def feature_importance(model: Any, names: Sequence[str], top: int | None = TOP_IMPORTANCES):
    """``[(feature, importance)]`` of a tree model, largest first; None without them."""
    stages = getattr(model, "stages", None)
    last = stages[-1] if stages else model
    if hasattr(last, "featureImportances"):
        weights = last.featureImportances.toArray()
    elif hasattr(last, "models") and all(hasattr(m, "featureImportances") for m in last.models):
        parts = [m.featureImportances.toArray() for m in last.models]
        weights = sum(parts) / len(parts)
    else:
        return None
    pairs = sorted(zip(names, (float(w) for w in weights)), key=lambda p: (-p[1], p[0]))
    return pairs if top is None else pairs[:top]


def importance_table(df: DataFrame, model: Any, names: Sequence[str], top: int | None = TOP_IMPORTANCES) -> DataFrame:
    pairs = feature_importance(model, names, top) or []
    rows = [(i + 1, n, w) for i, (n, w) in enumerate(pairs)]
    return local_rows(df, rows, "place int, feature string, importance double")


def permutation_importance(
    model: Any,
    matrix: Matrix,
    rows: DataFrame | None = None,
    repeats: int = PERMUTATION_REPEATS,
    top: int = TOP_PERMUTATION,
    bucket_rows: int = 50_000,
) -> DataFrame:
    """``(feature, importance)``: mean accuracy (or r2) lost when a column is shuffled.

    Rows fall into random buckets of bounded size; inside a bucket each row takes
    the column of the row after it in random order.  That permutes every column,
    needs one shuffle per repeat, and serves all features at once.
    """
    from pyspark.ml.functions import array_to_vector
    from pyspark.sql import Window

    test = matrix.part("test") if rows is None else rows
    n, size = test.count(), len(matrix.names)
    test = spread(test, n).persist()
    buckets = max(1, n // bucket_rows)
    base = _score(model.transform(test), matrix.task).first()["score"]
    drops = None
    for r in range(repeats):
        # Copies of a row must spread too, so the draw is per row, not per key.
        marked = test.withColumns({"o": F.rand(SEED + r), "x": vector_to_array("features")})
        marked = marked.withColumn("b", F.floor(F.rand(SEED - 1 - r) * buckets))
        in_bucket = Window.partitionBy("b").orderBy("o")
        whole = in_bucket.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        paired = marked.withColumn(
            "other", F.coalesce(F.lead("x").over(in_bucket), F.first("x").over(whole))
        )
        swapped = paired.withColumn("f", F.explode(F.sequence(F.lit(0), F.lit(size - 1))))
        one = F.transform(
            "x", lambda v, i: F.when(i == F.col("f"), F.element_at("other", i + 1)).otherwise(v)
        )
        variants = swapped.withColumn("features", array_to_vector(one)).select(
            F.concat_ws("/", F.col(matrix.key).cast("string"), "f").alias(matrix.key),
            "features",
            "label",
            "target",
            "f",
        )
        part = _score(model.transform(variants), matrix.task, "f")
        drops = part if drops is None else drops.unionByName(part)
    labels = F.array(*[F.lit(c) for c in matrix.names])
    out = (
        drops.groupBy("f")
        .agg(F.avg(F.lit(base) - F.col("score")).alias("importance"))
        .select(F.element_at(labels, F.col("f") + 1).alias("feature"), "importance")
        .orderBy(F.desc("importance"), "feature")
        .limit(top)
    )
    result = local_rows(
        test, [tuple(r) for r in out.collect()], "feature string, importance double"
    )
    test.unpersist()
    return result


def _score(predicted: DataFrame, task: str, *keys: str) -> DataFrame:
    if task == "classification":
        score = F.avg((F.col("label") == F.col("prediction")).cast("double"))
    else:
        e = F.col("label") - F.col("prediction")
        score = F.lit(1.0) - F.try_divide(F.sum(e * e), F.var_pop("label") * F.count("label"))
    return predicted.groupBy(*keys).agg(score.alias("score"))
