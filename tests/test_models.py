"""Scores, neighbours, silhouettes and fitted models against brute force."""

import tempfile

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from tablewright.catalog.base import table
from tablewright.operators import charts, estimators, evaluation, neighbours, training
from tablewright.operators.estimators import FitContext
from tablewright.operators.features import prepare
from tablewright.plans.sinks import load_model, save_model


def learnable(spark, n=400, classes=0, seed=5):
    rng = np.random.default_rng(seed)
    x = rng.normal(0, 1, (n, 3))
    y = 2 * x[:, 0] - 1.5 * x[:, 1] + rng.normal(0, 0.1, n)
    frame = pd.DataFrame(x, columns=["a", "b", "c"])
    frame["id"] = range(n)
    frame["y"] = pd.qcut(y, classes, labels=[f"k{i}" for i in range(classes)]).astype(str) if classes else y
    return spark.createDataFrame(frame)


def matrix_of(spark, classes=0, n=400):
    df = learnable(spark, n, classes)
    ready = prepare(df, "y", key=["id"])
    return training.build_matrix(ready.data, ready.feature_names, "y", "id")


def brute_neighbours(train, test, features, k):
    out = {}
    a, b = train[features].to_numpy(float), test[features].to_numpy(float)
    for i, x in zip(test["id"], b):
        far = ((a - x) ** 2).sum(axis=1)
        out[i] = [int(v) for v in train["id"].to_numpy()[np.lexsort((train["id"], far))[:k]]]
    return out


@pytest.mark.parametrize("shape", ["spread", "crowded", "tiny"])
def test_cells_give_the_same_neighbours_as_brute_force(spark, shape):
    rng = np.random.default_rng(7)
    n = 4 if shape == "tiny" else 1500
    x = rng.normal(0, 1, (n, 3))
    if shape == "crowded":
        x[: n // 3] = 0.5  # a third of all rows sit on one point
        x = np.round(x, 1)
    train = pd.DataFrame(x, columns=["a", "b", "c"])
    train["id"], train["y"] = rng.permutation(n), rng.integers(0, 3, n)
    test = pd.DataFrame(rng.normal(0, 1.2, (200, 3)), columns=["a", "b", "c"])
    test.loc[:60, ["a", "b", "c"]] = 0.5
    test["id"] = range(200)
    want = brute_neighbours(train, test, ["a", "b", "c"], 5)
    sides = spark.createDataFrame(train), spark.createDataFrame(test)
    for options in ({}, {"broadcast_cells": 0, "chunk_rows": 100}):
        found = neighbours.nearest(*sides, ["a", "b", "c"], "id", "y", 5, **options).toPandas()
        got = {i: g.sort_values(["distance2", "neighbour"])["neighbour"].tolist() for i, g in found.groupby("id")}
        assert got == want


def test_vote_ties_take_the_smallest_label(spark):
    train = spark.createDataFrame([(1, 0.0, "b"), (2, 0.0, "a"), (3, 9.0, "c")], "id long, x double, y string")
    test = spark.createDataFrame([(7, 0.0)], "id long, x double")
    assert neighbours.knn_classify(train, test, ["x"], "id", "y", 2).first()["prediction"] == "a"


def brute_silhouette(x, labels):
    far = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    scores = []
    for i, own in enumerate(labels):
        same = labels == own
        if same.sum() == 1:
            scores.append(0.0)
            continue
        a = far[i, same].sum() / (same.sum() - 1)
        b = min(far[i, labels == o].mean() for o in set(labels) if o != own)
        scores.append((b - a) / max(a, b))
    return float(np.mean(scores))


def test_silhouette_both_ways(spark):
    rng = np.random.default_rng(8)
    x = np.vstack([rng.normal(c, 1, (60, 4)) for c in (0, 3, 6)] + [np.full((1, 4), 30.0)])
    labels = np.array(["a"] * 60 + ["b"] * 60 + ["c"] * 60 + ["lonely"])
    df = spark.createDataFrame([(i, r.tolist(), v) for i, (r, v) in enumerate(zip(x, labels.tolist()))], "id long, x array<double>, l string")
    want = brute_silhouette(x, labels)
    for options in ({}, {"broadcast_cells": 0, "block_rows": 40}):
        row = evaluation.silhouette_euclidean(df, "id", "x", "l", **options).first()
        assert row["rows"] == 181
        assert row["silhouette"] == pytest.approx(want)


def test_scores_by_hand(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("c", "a")], "y string, p string")
    row = evaluation.classification_metrics(df, "y", "p").first()
    assert row["accuracy"] == pytest.approx(0.5)
    assert row["precision"] == pytest.approx((0.5 * 2 + 0.5 * 1 + 0) / 4)
    assert row["recall"] == pytest.approx(0.5)
    assert row["f1"] == pytest.approx((0.5 * 2 + 2 / 3 * 1 + 0) / 4)
    grid = evaluation.confusion_matrix(df, "y", "p")
    assert grid.count() == 4 and grid.agg(F.sum("n")).first()[0] == 4


def test_scores_agree_with_the_library(spark, folder):
    from pyspark.ml.evaluation import MulticlassClassificationEvaluator

    df = table(spark, folder, "labels").select(F.col("quality").cast("double").alias("y"), F.col("toxic").cast("double").alias("p"))
    ours = evaluation.classification_metrics(df, "y", "p").first()
    for ours_name, theirs in (("accuracy", "accuracy"), ("precision", "weightedPrecision"), ("recall", "weightedRecall"), ("f1", "f1")):
        judge = MulticlassClassificationEvaluator(labelCol="y", predictionCol="p", metricName=theirs)
        assert ours[ours_name] == pytest.approx(judge.evaluate(df))


def coordinate_descent(x, y, l1, l2, rounds=3000):
    """min 1/(2n)|y - xb - c|^2 + l1|b| + l2/2 |b|^2"""
    n = len(y)
    xc, yc = x - x.mean(axis=0), y - y.mean()
    b = np.zeros(x.shape[1])
    for _ in range(rounds):
        for j in range(len(b)):
            rest = yc - xc @ b + xc[:, j] * b[j]
            rho = xc[:, j] @ rest / n
            b[j] = np.sign(rho) * max(abs(rho) - l1, 0) / (xc[:, j] @ xc[:, j] / n + l2)
    return b


@pytest.mark.parametrize(
    "name,l1,l2", [("linear", 0, 0), ("ridge", 0, "1/n"), ("lasso", 1, 0), ("elastic_net", 0.5, 0.5)]
)
def test_penalties_match_their_definition(spark, name, l1, l2):
    m = matrix_of(spark)
    train = m.part("train")
    model = training.fit_one(name, m, train, training.fit_context(train, m))
    rows = train.select("features", "label").collect()
    x, y = np.array([r[0].toArray() for r in rows]), np.array([r[1] for r in rows])
    want = coordinate_descent(x, y, l1, 1 / len(y) if l2 == "1/n" else l2)
    order = [m.names.index(n) for n in m.names]
    assert np.allclose(model.coefficients.toArray()[order], want, atol=1e-4)


def test_logistic_matches_newton(spark):
    m = matrix_of(spark, 2)
    train = m.part("train")
    model = training.fit_one("logistic", m, train, training.fit_context(train, m))
    rows = train.select("features", "label").collect()
    x = np.column_stack([np.array([r[0].toArray() for r in rows]), np.ones(len(rows))])
    y = np.array([r[1] for r in rows])
    b, mask = np.zeros(x.shape[1]), np.append(np.ones(x.shape[1] - 1), 0.0)
    for _ in range(60):
        p = 1 / (1 + np.exp(-x @ b))
        b -= np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + np.diag(mask), x.T @ (p - y) + mask * b)
    assert np.allclose(model.coefficients.toArray(), b[:-1], atol=2e-3)
    assert model.intercept == pytest.approx(b[-1], abs=2e-3)


def test_leaderboard_ranks_and_learns(spark):
    done = training.train_models(matrix_of(spark), ["linear", "knn", "decision_tree", "rbf_regression"])
    board = done.leaderboard.orderBy("place").collect()
    assert [r["model"] for r in board][0] == "linear" == done.best_name
    assert all(r["error"] is None for r in board)
    assert [r["score"] for r in board] == sorted((r["score"] for r in board), reverse=True)
    assert board[0]["r2"] > 0.99


def test_classes_and_importances(spark):
    m = matrix_of(spark, 3)
    done = training.train_models(m, ["logistic", "random_forest", "knn"])
    assert done.task == "classification"
    assert done.leaderboard.agg(F.min("f1")).first()[0] > 0.7
    forest = done.models["random_forest"]
    full = training.feature_importance(forest, m.names, None)
    assert sum(w for _, w in full) == pytest.approx(1)
    assert {n for n, _ in full[:2]} == {"num__a", "num__b"}
    shaken = training.permutation_importance(done.models["logistic"], done.matrix, repeats=3, bucket_rows=20)
    assert {r["feature"] for r in shaken.orderBy(F.desc("importance")).limit(2).collect()} == {"num__a", "num__b"}
    scored = training.score_batch(done.models["logistic"], done.matrix)
    assert scored.filter("predicted_class IN ('k0', 'k1', 'k2')").count() == m.part("test").count()
    assert scored.agg(F.min("probability")).first()[0] >= 1 / 3 - 1e-9
    assert training.prediction_sample(scored, "__key").count() == 20


def test_few_rows_are_cross_validated(spark):
    done = training.train_models(matrix_of(spark, 2, n=90), ["logistic", "mlp", "gradient_boosting"])
    rows = done.leaderboard.collect()
    assert [r["model"] for r in rows] == ["logistic"]
    assert rows[0]["primary_metric"] == "f1_cv" and rows[0]["cv_std_f1"] >= 0
    assert "simple_models_only" in done.warnings and "small_table" in done.warnings


def test_clusters_need_fifty_rows(spark):
    def points(n):
        df = spark.range(n).select(
            F.col("id").alias("__key"),
            array_to_vector(F.array((F.col("id") % 3).cast("double") * 50, F.rand(1))).alias("features"),
            F.lit(0.0).alias("label"), F.lit(None).cast("string").alias("target"), F.lit("train").alias("split"),
        )
        return training.Matrix(df, ["x", "y"], "unsupervised")

    with pytest.raises(ValueError):
        training.train_models(points(49))
    done = training.train_models(points(150))
    assert done.leaderboard.first()["silhouette"] > 0.99
    plot = charts.cluster_scatter(done.best.transform(points(150).df), "__key", "features", "prediction")
    assert plot.count() == 150 and abs(plot.agg(F.avg("pc1")).first()[0]) < 1e-6


def test_failing_model_is_noted(spark, monkeypatch):
    real = training.fit_one

    def broken(name, *rest):
        if name == "ridge":
            raise RuntimeError("no")
        return real(name, *rest)

    monkeypatch.setattr(training, "fit_one", broken)
    rows = {r["model"]: r for r in training.train_models(matrix_of(spark), ["linear", "ridge"]).leaderboard.collect()}
    assert rows["ridge"]["error"] == "RuntimeError: no" and rows["linear"]["place"] == 1


def test_first_of_equals_wins(spark):
    board = spark.createDataFrame([("b", 1, 0.5), ("a", 0, 0.5), ("c", 2, 0.1)], "model string, model_order int, score double")
    assert training.best_model(board).first()["model"] == "a"
    assert training.rank_models(board).orderBy("place").first()["model"] == "a"


@pytest.mark.parametrize("name", ["linear", "knn", "rbf_regression"])
def test_saved_models_score_the_same(spark, name):
    m = matrix_of(spark)
    train = m.part("train")
    model = training.fit_one(name, m, train, training.fit_context(train, m))
    path = save_model(model, m, name, tempfile.mkdtemp(prefix="run-", dir="/tmp") + "/model")
    again, facts = load_model(spark, path)
    assert facts["model_name"] == name and facts["feature_names"] == m.names
    a = {r["__key"]: r["prediction"] for r in training.score_batch(model, m).collect()}
    b = {r["__key"]: r["prediction"] for r in training.score_batch(again, m).collect()}
    assert a == pytest.approx(b)


@pytest.mark.parametrize("family", [estimators.REGRESSION, estimators.CLASSIFICATION])
def test_tree_depth_is_the_same_for_any_number_of_rows(family):
    for name in ("decision_tree", "random_forest"):
        depths = {family[name](FitContext(rows, 3, 2)).getMaxDepth() for rows in (100, 20_000, 20_001, 10**9)}
        assert depths == {estimators.TREE_DEPTH}


@pytest.mark.parametrize("labels", [1000, 1001])
def test_confusion_pairs_have_one_shape(spark, labels):
    df = spark.range(labels).select(F.col("id").cast("string").alias("y"), F.col("id").cast("string").alias("p"))
    assert evaluation.confusion_matrix(df, "y", "p").count() == labels


def test_a_gap_in_the_features_is_no_lost_row(spark):
    df = spark.createDataFrame([(1.0, 2.0), (None, 3.0)], "x double, y double")
    with pytest.raises(Exception, match="(?i)null"):
        training.build_matrix(df, ["x"], "y").part("train").select("features").collect()


def test_neighbour_model_on_copied_rows_without_a_key(spark):
    df = learnable(spark, 200, 2).drop("id")
    twice = df.unionAll(df)
    ready = prepare(twice, "y")
    m = training.build_matrix(ready.data, ready.feature_names, "y")
    assert not m.keyed
    scored = training.score_batch(training.fit_one("knn", m, m.part("train"), None), m)
    assert scored.count() == m.part("test").count()


def test_rows_are_dealt_over_the_cores_before_they_are_fitted(spark, monkeypatch):
    """A matrix from one split of a file, of more rows than a task is worth."""
    monkeypatch.setattr("tablewright.session.TASK_ROWS", 20)
    m = matrix_of(spark)
    m = training.replace(m, df=m.df.coalesce(1))
    parts, real = [], training.fit_one
    monkeypatch.setattr(training, "fit_one", lambda name, x, train, c: parts.append(train.rdd.getNumPartitions()) or real(name, x, train, c))
    rows = m.df.count()
    done = training.train_models(m, ["linear"])
    assert parts == [min(8, rows // 20)] and parts[0] > 1
    assert training.training_rows(m).rdd.getNumPartitions() > 1
    done.release()


def test_one_against_the_rest_stores_no_copy_of_all_classes(spark, monkeypatch):
    from pyspark.ml.classification import LinearSVC, OneVsRest
    from pyspark.ml.linalg import Vectors

    from tablewright.operators.estimators import CLASSIFICATION, FitContext, OneVsRestUncached

    assert isinstance(CLASSIFICATION["rbf_svc"](FitContext(10, 2, 3)).getStages()[-1], OneVsRestUncached)
    df = spark.createDataFrame([(float(i % 3), Vectors.dense([i % 3 + i / 90, i % 7])) for i in range(60)], ["label", "features"])
    plain = OneVsRest(classifier=LinearSVC(maxIter=5)).fit(df)
    kept = []
    monkeypatch.setattr(type(df), "persist", lambda self, *level: kept.append(self) or self)
    lean = OneVsRestUncached(classifier=LinearSVC(maxIter=5)).fit(df)
    assert not kept
    assert [m.coefficients.toArray().tolist() for m in lean.models] == [m.coefficients.toArray().tolist() for m in plain.models]


def wide_steps(spark, classes):
    m = matrix_of(spark, classes)
    train = m.part("train").persist()
    name = "rbf_svc" if classes else "rbf_regression"
    return m, train, estimators.registry(m.task)[name](training.fit_context(train, m))


def test_kernel_classes_are_fitted_without_lifted_rows(spark, monkeypatch):
    """The weights of the library, from passes over the plain rows that all classes share."""
    from pyspark.ml import Pipeline

    from tablewright.operators import lifted

    m, train, steps = wide_steps(spark, 3)
    rounds = 20
    steps.getStages()[-1].getClassifier().setMaxIter(rounds)
    passes, stored = [], []
    summed, packed = lifted._summed, lifted.packed_rows
    monkeypatch.setattr(lifted, "_summed", lambda *a: passes.append(1) or summed(*a))
    monkeypatch.setattr(lifted, "packed_rows", lambda *a: stored.append(packed(*a)) or stored[-1])
    model = steps.fit(train)
    cells = sum(len(b[3]) for b in stored[0].collect())
    assert cells <= train.count() * len(m.names)
    assert len(passes) <= 1.5 * rounds
    plain = Pipeline(stages=steps.getStages()).fit(train)
    for ours, theirs in zip(model.stages[-1].models, plain.stages[-1].models, strict=True):
        assert ours.coefficients.toArray() == pytest.approx(theirs.coefficients.toArray(), rel=1e-6, abs=1e-9)
        assert ours.intercept == pytest.approx(theirs.intercept, rel=1e-6, abs=1e-9)
    a = {r["__key"]: (r["prediction"], r["rawPrediction"].toArray()) for r in model.transform(m.part("test")).collect()}
    b = {r["__key"]: (r["prediction"], r["rawPrediction"].toArray()) for r in plain.transform(m.part("test")).collect()}
    assert a.keys() == b.keys() and all(a[k][0] == b[k][0] and np.allclose(a[k][1], b[k][1]) for k in b)
    train.unpersist()


def test_packed_rows_keep_every_number(spark):
    from pyspark.ml.linalg import Vectors

    from tablewright.operators import lifted

    rows = [(float(i % 3), Vectors.sparse(40, {i % 40: i + 0.5}) if i % 2 else Vectors.dense([i * 1.5] * 40)) for i in range(101)]
    for part in (rows, [r for i, r in enumerate(rows) if i % 2]):
        want = sorted((y, x.toArray().tolist()) for y, x in part)
        got = []
        for y, shape, at, values in lifted.packed_rows(spark.createDataFrame(part, ["label", "features"]), "label", "features").collect():
            cells = np.zeros(shape)
            cells.ravel()[slice(None) if at is None else at] = values
            got += zip(y.tolist(), cells.tolist())
        assert sorted(got) == want
    with pytest.raises(Exception, match="finite"):
        lifted.packed_rows(spark.createDataFrame([(0.0, Vectors.dense([float("nan")]))], ["label", "features"]), "label", "features").collect()


@pytest.mark.parametrize("shape", ["smooth", "spikes", "equal"])
def test_huber_kernel_is_fitted_without_lifted_rows(spark, monkeypatch, shape):
    """Coefficients, intercept and scale of the library, from passes over the plain rows."""
    from pyspark.ml import Pipeline

    from tablewright.operators import lifted

    m, train, steps = wide_steps(spark, 0)
    if shape != "smooth":
        spiky = F.when(F.col("__key") % 9 == 0, F.col("label") * 1e4).otherwise(F.col("label") * 100)
        train = train.withColumn("label", F.lit(7.5) if shape == "equal" else spiky).persist()
    passes, summed = [], lifted._summed
    monkeypatch.setattr(lifted, "_summed", lambda *a: passes.append(1) or summed(*a))
    model = steps.fit(train)
    assert bool(passes) == (shape != "equal")
    plain = Pipeline(stages=steps.getStages()).fit(train)
    ours, theirs = model.stages[-1], plain.stages[-1]
    assert ours.coefficients.toArray() == pytest.approx(theirs.coefficients.toArray(), rel=1e-4, abs=1e-6)
    assert ours.intercept == pytest.approx(theirs.intercept, rel=1e-4, abs=1e-6)
    assert ours.scale == pytest.approx(theirs.scale, rel=1e-4)
    a = {r["__key"]: r["prediction"] for r in model.transform(m.part("test")).collect()}
    b = {r["__key"]: r["prediction"] for r in plain.transform(m.part("test")).collect()}
    assert a == pytest.approx(b, rel=1e-4, abs=1e-6)
    train.unpersist()


def test_forests_are_fitted_on_like_rows_side_by_side(spark, monkeypatch):
    """Every row once, in its partition, sorted so that neighbours share their bins; few rows as they are."""
    monkeypatch.setattr("tablewright.session.TASK_ROWS", 100)
    rng = np.random.default_rng(4)
    frame = pd.DataFrame({"a": rng.permutation(800) * 1.0, "b": rng.normal(0, 1, 800).round(1), "c": rng.integers(0, 2, 800) * 1.0, "e": 1.0})
    x = array_to_vector(F.array("a", "b", "c", "e"))
    train = spark.createDataFrame(frame).select(x.alias("features"), F.col("c").alias("label"), F.lit("k").alias("__key")).repartition(3).persist()
    near = training.near_rows(train, 800)

    def parts(df):
        return df.rdd.glom().map(lambda p: [tuple(r["features"].toArray().tolist()) for r in p]).collect()

    def apart(rows):
        return sum(abs(p[0] - q[0]) / 800 + abs(p[1] - q[1]) / 6 + abs(p[2] - q[2]) for part in rows for p, q in zip(part, part[1:]))

    before, after = parts(train), parts(near)
    assert [sorted(p) for p in before] == [sorted(p) for p in after]
    assert apart(after) < 0.4 * apart(before)
    assert training.near_rows(train, 150) is train
    fitted = []
    monkeypatch.setattr(training, "near_rows", lambda df, rows: fitted.append(rows) or near)
    m = training.Matrix(train, ["a", "b", "c", "e"], "classification", ["0", "1"])
    model = training.fit_one("random_forest", m, train, FitContext(800, 4, 2))
    assert fitted == [800] and model.featureImportances.size == 4
    train.unpersist()
