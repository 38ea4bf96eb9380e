"""The models that can be ranked, each as a Spark ML estimator or a Spark job."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark import keyword_only
from pyspark.ml import Estimator, Pipeline, Transformer
from pyspark.ml.classification import (
    DecisionTreeClassifier,
    GBTClassifier,
    LinearSVC,
    LogisticRegression,
    MultilayerPerceptronClassifier,
    OneVsRest,
    OneVsRestModel,
    RandomForestClassifier,
)
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol, HasOutputCol
from pyspark.ml.regression import (
    DecisionTreeRegressor,
    GBTRegressor,
    LinearRegression,
    RandomForestRegressor,
)
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import functions as F

from .lifted import LiftedPipeline

SEED = 42
# A tree grown to purity has as many nodes as rows and lives on the driver; trees
# and forests stop at this depth, whatever the number of rows.
TREE_DEPTH = 12
RBF_FEATURES = 256


@dataclass(frozen=True)
class FitContext:
    """What an estimator may depend on: all of it measured on the training rows."""

    rows: int
    features: int
    classes: int = 0
    label_std: float = 1.0
    feature_variance: float = 1.0


class RandomFourierFeatures(
    Transformer, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable
):
    """cos(xW + b): inner products of the output approximate a Gaussian kernel.

    W and b are drawn from the seed, so the saved stage is a handful of numbers.
    """

    gamma = Param(Params._dummy(), "gamma", "kernel width", TypeConverters.toFloat)
    size = Param(Params._dummy(), "size", "input features", TypeConverters.toInt)
    width = Param(Params._dummy(), "width", "output features", TypeConverters.toInt)
    seed = Param(Params._dummy(), "seed", "random seed", TypeConverters.toInt)

    @keyword_only
    def __init__(self, inputCol=None, outputCol=None, gamma=1.0, size=1, width=RBF_FEATURES, seed=SEED):
        super().__init__()
        self._setDefault(gamma=1.0, size=1, width=RBF_FEATURES, seed=SEED)
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def draw(self):
        """W and b."""
        import numpy as np

        gamma, size = self.getOrDefault("gamma"), self.getOrDefault("size")
        width, draw = self.getOrDefault("width"), np.random.default_rng(self.getOrDefault("seed"))
        return draw.normal(0.0, np.sqrt(2.0 * gamma), (size, width)), draw.uniform(0.0, 2.0 * np.pi, width)

    def _transform(self, dataset):
        from pyspark.sql.functions import pandas_udf

        width = self.getOrDefault("width")
        w, b = self.draw()

        @pandas_udf("array<double>")
        def project(x):
            import numpy as np
            import pandas as pd

            z = np.sqrt(2.0 / width) * np.cos(np.asarray(x.tolist(), dtype=float) @ w + b)
            return pd.Series(list(z))

        wide = project(vector_to_array(F.col(self.getInputCol())))
        return dataset.withColumn(self.getOutputCol(), array_to_vector(wide))


class OneVsRestUncached(OneVsRest):
    """One against the rest without a stored copy of the rows for all classes.

    The classifier stores its own blocks of rows while a class is fitted, so wide rows
    are stored once, not twice.
    """

    def _fit(self, dataset):
        label, features = self.getLabelCol(), self.getFeaturesCol()
        classifier = self.getClassifier()
        rows = dataset.select(label, features)
        models = []
        for k in range(int(rows.agg(F.max(label)).first()[0]) + 1):
            marked = rows.withColumn(f"mc2b${k}", (F.col(label) == float(k)).cast("double"))
            columns = {classifier.labelCol: f"mc2b${k}", classifier.featuresCol: features, classifier.predictionCol: self.getPredictionCol()}
            models.append(classifier.fit(marked, columns))
        return self._copyValues(OneVsRestModel(models=models))


def _rbf(c: FitContext, last: Estimator) -> Pipeline:
    gamma = 1.0 / (max(c.features, 1) * max(c.feature_variance, 1e-12))
    lift = RandomFourierFeatures(inputCol="features", outputCol="lifted", gamma=gamma, size=c.features)
    return LiftedPipeline(stages=[lift, last])


def _elastic(c: FitContext, l1: float, l2: float) -> LinearRegression:
    """Penalties per row in the usual least-squares scaling.

    Spark scales its L2 term by the label's deviation, hence the factor.
    """
    a1, a2 = l1, l2 * c.label_std
    return LinearRegression(
        regParam=a1 + a2,
        elasticNetParam=a1 / (a1 + a2),
        standardization=False,
        solver="l-bfgs",
        maxIter=1000,
        tol=1e-9,
    )


def _boosted(kind, rounds, depth, bins, step, classes=0):
    booster = kind(maxIter=rounds, maxDepth=depth, maxBins=bins, stepSize=step, seed=SEED)
    return OneVsRest(classifier=booster) if classes > 2 else booster


Builder = Callable[[FitContext], Estimator]

REGRESSION: dict[str, Builder] = {
    "linear": lambda c: LinearRegression(regParam=0.0),
    "ridge": lambda c: _elastic(c, 0.0, 1.0 / max(c.rows, 1)),
    "lasso": lambda c: _elastic(c, 1.0, 0.0),
    "elastic_net": lambda c: _elastic(c, 0.5, 0.5),
    "decision_tree": lambda c: DecisionTreeRegressor(maxDepth=TREE_DEPTH, seed=SEED),
    "random_forest": lambda c: RandomForestRegressor(
        numTrees=100, maxDepth=TREE_DEPTH, seed=SEED
    ),
    "gradient_boosting": lambda c: _boosted(GBTRegressor, 100, 3, 32, 0.1),
    "rbf_regression": lambda c: _rbf(
        c, LinearRegression(featuresCol="lifted", loss="huber", regParam=1.0 / max(c.rows, 1), maxIter=100)
    ),
    "gbt_deep": lambda c: _boosted(GBTRegressor, 200, 6, 256, 0.3),
    "gbt_31leaf": lambda c: _boosted(GBTRegressor, 100, 5, 255, 0.1),
}

CLASSIFICATION: dict[str, Builder] = {
    "logistic": lambda c: LogisticRegression(
        maxIter=500, regParam=1.0 / max(c.rows, 1), standardization=False, family="auto"
    ),
    "decision_tree": lambda c: DecisionTreeClassifier(maxDepth=TREE_DEPTH, seed=SEED),
    "random_forest": lambda c: RandomForestClassifier(
        numTrees=100, maxDepth=TREE_DEPTH, seed=SEED
    ),
    "gradient_boosting": lambda c: _boosted(GBTClassifier, 100, 3, 32, 0.1, c.classes),
    "rbf_svc": lambda c: _rbf(
        c,
        OneVsRestUncached(
            featuresCol="lifted",
            classifier=LinearSVC(featuresCol="lifted", maxIter=100, regParam=1.0 / max(c.rows, 1)),
        ),
    ),
    "mlp": lambda c: MultilayerPerceptronClassifier(
        layers=[c.features, 100, c.classes], maxIter=500, seed=SEED
    ),
    "gbt_deep": lambda c: _boosted(GBTClassifier, 200, 6, 256, 0.3, c.classes),
    "gbt_31leaf": lambda c: _boosted(GBTClassifier, 100, 5, 255, 0.1, c.classes),
}

CLUSTERING: dict[str, Builder] = {"kmeans": lambda c: KMeans(k=3, seed=SEED)}

# k-NN has no estimator: it is a join, run by the leaderboard directly.
NEIGHBOURS = "knn"
# Fitted on rows that are ordered first, as each row is looked up in a hundred trees.
FOREST = "random_forest"
# The order in which models are listed and in which the first of equals wins.
REGRESSION_ORDER = (
    "linear",
    "ridge",
    "lasso",
    "elastic_net",
    "decision_tree",
    "random_forest",
    "gradient_boosting",
    "rbf_regression",
    NEIGHBOURS,
    "gbt_deep",
    "gbt_31leaf",
)
CLASSIFICATION_ORDER = (
    "logistic",
    "decision_tree",
    "random_forest",
    "gradient_boosting",
    "rbf_svc",
    NEIGHBOURS,
    "mlp",
    "gbt_deep",
    "gbt_31leaf",
)
# Models that overfit few rows; left out below a hundred training rows.
LARGE_ONLY = ("gbt_31leaf", "gbt_deep", "mlp", "gradient_boosting")


def registry(task: str) -> dict[str, Builder]:
    return {"regression": REGRESSION, "classification": CLASSIFICATION}.get(task, CLUSTERING)


def model_order(task: str) -> tuple[str, ...]:
    return {"regression": REGRESSION_ORDER, "classification": CLASSIFICATION_ORDER}.get(
        task, tuple(CLUSTERING)
    )


def usable_value(x) -> bool:
    return x is not None and not (isinstance(x, float) and math.isnan(x))


