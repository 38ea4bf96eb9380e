"""Registered queries: models, predictions and their scores."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from ..operators import charts, evaluation, folds, neighbours, training
from ..operators.features import prepare
from ..operators.splitting import train_test_split
from .base import Query, table, union_sql

# --- predictions made by rule from the given tables, to check the scores on ---------

NUMBER_COLUMNS = ["o_orderkey", "o_totalprice AS y", "o_totalprice * 0.9 + o_custkey AS p"]
CLASS_COLUMNS = [
    "event_id",
    "event_type AS y",
    "CASE WHEN value > 60 THEN 'purchase' WHEN value > 30 THEN 'click'"
    " WHEN user_id % 3 = 0 THEN 'view' ELSE event_type END AS p",
]
SCORED_NUMBERS = f"SELECT {', '.join(NUMBER_COLUMNS)} FROM orders"
SCORED_CLASSES = f"SELECT {', '.join(CLASS_COLUMNS)} FROM events"


def _scored_numbers(spark, folder):
    return table(spark, folder, "orders").selectExpr(*NUMBER_COLUMNS)


def _scored_classes(spark, folder):
    return table(spark, folder, "events").selectExpr(*CLASS_COLUMNS)


def _rounded(df, *names, digits=6):
    return df.select(
        *[(F.round(c, digits) + 0.0).alias(c) if c in names else F.col(c) for c in df.columns]
    )


def _regression_metrics(spark, folder):
    out = evaluation.regression_metrics(_scored_numbers(spark, folder), "y", "p")
    return out.select(F.round("rmse", 4).alias("rmse"), F.round("mae", 4).alias("mae"), F.round("r2", 6).alias("r2"))


CONFUSION_SQL = f"SELECT y AS actual, p AS predicted, count(*) AS n FROM ({SCORED_CLASSES}) GROUP BY ALL"
CLASS_SCORES_CTE = (
    f"WITH s AS ({SCORED_CLASSES}), l AS (SELECT y AS v FROM s UNION SELECT p FROM s), t AS (SELECT v,"
    " (SELECT count(*) FROM s WHERE y = v) AS support, (SELECT count(*) FROM s WHERE p = v) AS claimed,"
    " (SELECT count(*) FROM s WHERE y = v AND p = v) AS tp FROM l), m AS (SELECT v, support, tp,"
    " CASE WHEN claimed = 0 THEN 0 ELSE tp / claimed END AS p, CASE WHEN support = 0 THEN 0 ELSE tp / support END AS r,"
    " CASE WHEN support + claimed = 0 THEN 0 ELSE 2 * tp / (support + claimed) END AS f FROM t)"
)


def _leaderboard(spark, folder):
    """A board from how well the price of an order is guessed from its group's mean."""
    orders = table(spark, folder, "orders")
    whole = orders.agg(F.avg("o_totalprice").alias("m")).scalar()
    out = None
    for i, by in enumerate(("o_orderstatus", "o_orderpriority", "o_orderstatus")):
        means = orders.groupBy(F.col(by).alias("g")).agg(F.avg("o_totalprice").alias("p"))
        guess = orders.join(means, orders[by] == means["g"])
        r2 = F.round(
            1 - F.sum((F.col("o_totalprice") - F.col("p")) ** 2) / F.sum((F.col("o_totalprice") - whole) ** 2), 9
        )
        row = guess.agg(r2.alias("score")).select(
            F.lit(f"{by}_{i}").alias("model"),
            F.lit(i).alias("model_order"),
            F.lit("r2").alias("primary_metric"),
            "score",
            F.lit(None).cast("double").alias("cv_std_f1"),
        )
        out = row if out is None else out.unionByName(row)
    return training.rank_models(out)


BOARD_CTE = (
    "WITH b AS ("
    + union_sql(
        [
            f"SELECT '{by}_{i}' AS model, {i} AS model_order, 'r2' AS primary_metric,"
            f" round(1 - sum((o_totalprice - p) * (o_totalprice - p)) / sum((o_totalprice - m) * (o_totalprice - m)), 9)"
            f" AS score FROM (SELECT o_totalprice, avg(o_totalprice) OVER (PARTITION BY {by}) AS p,"
            " avg(o_totalprice) OVER () AS m FROM orders)"
            for i, by in enumerate(("o_orderstatus", "o_orderpriority", "o_orderstatus"))
        ]
    )
    + "), r AS (SELECT *, row_number() OVER (ORDER BY score DESC, model_order)::INTEGER AS place FROM b)"
)

# --- linear models on one feature: their solutions have a closed form -----------------


def _line(name, target="o_totalprice", feature="o_custkey", source="orders"):
    def run(spark, folder):
        df = table(spark, folder, source).select(F.col(feature).cast("double"), F.col(target))
        matrix = training.build_matrix(df, [feature], target, task="regression")
        model = training.fit_one(name, matrix, matrix.df, training.fit_context(matrix.df, matrix))
        rows = [(float(model.coefficients[0]), float(model.intercept))]
        out = spark.createDataFrame(rows, "slope double, intercept double")
        return out.select(F.round("slope", 3).alias("slope"), F.round("intercept", 2).alias("intercept"))

    return run


def _cv_linear(spark, folder):
    """The price of an order by its customer number: each fold is scored by a line through the others."""
    orders = table(spark, folder, "orders").select(
        "o_orderkey", "o_totalprice", array_to_vector(F.array(F.col("o_custkey").cast("double"))).alias("x")
    )
    found = folds.cross_validate_linear(orders, "x", "o_totalprice", ["o_orderkey"], ["linear", "ridge"])
    return found.select("model", "fold", "rows", F.round("rmse", 4).alias("rmse"), F.round("r2", 6).alias("r2"))


# A line of one feature has a closed form; the ridge penalty is one over the training rows.
CV_LINEAR_SQL = (
    "WITH m AS (SELECT o_custkey::DOUBLE AS x, o_totalprice AS y, ((row_number() OVER (ORDER BY"
    " md5(concat(CAST(o_orderkey AS VARCHAR), ':', '42'))) - 1) % 5)::INTEGER AS fold FROM orders),"
    " t AS (SELECT f.fold, count(*) AS n, avg(x) AS mx, avg(y) AS my, covar_pop(x, y) AS sxy, var_pop(x) AS sxx"
    " FROM m, (SELECT DISTINCT fold FROM m) f WHERE m.fold <> f.fold GROUP BY 1),"
    " b AS (SELECT model, fold, mx, my, sxy / (sxx + penalty / n) AS slope FROM t, (VALUES ('linear', 0.0), ('ridge', 1.0)) p(model, penalty)),"
    " e AS (SELECT model, m.fold, y, y - my - slope * (x - mx) AS e FROM m JOIN b USING (fold))"
    " SELECT model, fold, count(*) AS rows, round(sqrt(avg(e * e)), 4) AS rmse,"
    " round(1 - sum(e * e) / (var_pop(y) * count(*)), 6) AS r2 FROM e GROUP BY ALL"
)

LINE_SUMS = (
    "WITH s AS (SELECT count(*) AS n, avg(x) AS mx, avg(y) AS my, covar_pop(x, y) AS sxy, var_pop(x) AS sxx"
    " FROM (SELECT o_custkey::DOUBLE AS x, o_totalprice AS y FROM orders))"
)


def _line_sql(slope):
    return (
        f"{LINE_SUMS}, t AS (SELECT {slope} AS b, mx, my FROM s)"
        " SELECT round(b, 3) AS slope, round(my - b * mx, 2) AS intercept FROM t"
    )


# --- nearest neighbours -----------------------------------------------------------------


def _knn_classify(spark, folder):
    rows = train_test_split(table(spark, folder, "customer"), ["c_custkey"])
    train, test = rows.filter("split = 'train'"), rows.filter("split = 'test'")
    return neighbours.knn_classify(train, test, ["c_acctbal", "c_nationkey"], "c_custkey", "c_mktsegment")


def _knn_regress(spark, folder):
    rows = train_test_split(table(spark, folder, "part"), ["p_partkey"])
    train, test = rows.filter("split = 'train'"), rows.filter("split = 'test'")
    found = neighbours.knn_regress(train, test, ["p_partkey", "p_size"], "p_partkey", "p_retailprice")
    return _rounded(found, "prediction")


def _near_sql(source, key, features, label):
    far = " + ".join(f"(a.{f} - b.{f})::DOUBLE * (a.{f} - b.{f})::DOUBLE" for f in features)
    return (
        f"WITH h AS (SELECT *, substr(md5(concat(CAST({key} AS VARCHAR), ':', '42')), 1, 8) < '33333333' AS test"
        f" FROM {source}), n AS (SELECT a.{key}, b.{label} AS y, row_number() OVER (PARTITION BY a.{key}"
        f" ORDER BY {far}, b.{key}) AS place FROM h a, h b WHERE a.test AND NOT b.test)"
    )


# --- silhouette ----------------------------------------------------------------------------


def _silhouette(spark, folder):
    out = evaluation.silhouette_euclidean(
        table(spark, folder, "embeddings"), "vec_id", "embedding", "label"
    )
    return _rounded(out, "silhouette")


SILHOUETTE_SQL = (
    "WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings),"
    " d AS (SELECT a.vec_id, a.label AS own, b.label AS other, sum(list_distance(a.x, b.x)) AS s FROM e a, e b"
    " GROUP BY ALL), c AS (SELECT label, count(*) AS n FROM e GROUP BY label),"
    " m AS (SELECT vec_id, max(CASE WHEN own = other AND n > 1 THEN s / (n - 1) END) AS a,"
    " min(CASE WHEN own <> other THEN s / n END) AS b FROM d JOIN c ON c.label = d.other GROUP BY vec_id)"
    " SELECT count(*) AS rows, round(avg(CASE WHEN a IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END), 6) + 0.0"
    " AS silhouette FROM m"
)


def _silhouette_squared(spark, folder):
    df = table(spark, folder, "embeddings").select(
        "label", array_to_vector(F.col("embedding").cast("array<double>")).alias("features")
    )
    score = evaluation.silhouette_squared(df, "features", "label")
    out = spark.createDataFrame([(score,)], "silhouette double")
    return _rounded(out, "silhouette", digits=5)


SQUARED_SQL = (
    "WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings),"
    " d AS (SELECT a.vec_id, a.label AS own, b.label AS other,"
    " sum(list_distance(a.x, b.x) * list_distance(a.x, b.x)) AS s FROM e a, e b GROUP BY ALL),"
    " c AS (SELECT label, count(*) AS n FROM e GROUP BY label),"
    " m AS (SELECT vec_id, max(CASE WHEN own = other AND n > 1 THEN s / (n - 1) END) AS a,"
    " min(CASE WHEN own <> other THEN s / n END) AS b FROM d JOIN c ON c.label = d.other GROUP BY vec_id)"
    " SELECT round(avg(CASE WHEN a IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END), 5) + 0.0 AS silhouette FROM m"
)

# --- fitted models: no SQL can give their results ---------------------------------------------


def order_matrix(spark, folder, target="o_orderstatus"):
    """All orders, prepared: price, keys and priority predict the target."""
    ready = prepare(table(spark, folder, "orders"), target, key=["o_orderkey"])
    return training.build_matrix(ready.vectors, ready.feature_names, target, "o_orderkey")


def embedding_matrix(spark, folder):
    """The vectors as they are, with no target."""
    df = table(spark, folder, "embeddings")
    return training.Matrix(
        df.select(
            F.col("vec_id").alias("__key"),
            array_to_vector(F.col("embedding").cast("array<double>")).alias("features"),
            F.lit(0.0).alias("label"),
            F.col("label").cast("string").alias("target"),
            F.lit("train").alias("split"),
        ),
        [f"d{i}" for i in range(64)],
        "unsupervised",
    )


def _scores(target, *names):
    """Fit the named models on all training orders, score them on the held-out ones."""

    def run(spark, folder):
        matrix = order_matrix(spark, folder, target)
        done = training.train_models(matrix, names)
        return done.leaderboard.select("place", "model", "primary_metric", "score", "error")

    return run


def _importance(spark, folder):
    matrix = order_matrix(spark, folder)
    train = training.training_rows(matrix)
    model = training.fit_one("random_forest", matrix, train, training.fit_context(train, matrix))
    train.unpersist()
    return training.importance_table(matrix.df, model, matrix.names)


def _permutation(spark, folder):
    matrix = order_matrix(spark, folder)
    train = training.training_rows(matrix)
    model = training.fit_one("logistic", matrix, train, training.fit_context(train, matrix))
    train.unpersist()
    return training.permutation_importance(model, matrix)


def _batch(spark, folder):
    matrix = order_matrix(spark, folder)
    train = matrix.part("train")
    model = training.fit_one("logistic", matrix, train, training.fit_context(train, matrix))
    return training.score_batch(model, matrix)


def _clusters(spark, folder):
    matrix = embedding_matrix(spark, folder)
    done = training.train_models(matrix)
    found = done.best.transform(matrix.df)
    return found.groupBy(F.col("prediction").alias("cluster")).agg(F.count("*").alias("n"))


def _scatter(spark, folder):
    matrix = embedding_matrix(spark, folder)
    return charts.cluster_scatter(matrix.df, "__key", "features", "target")


def _line_points(spark, folder):
    df = _scored_numbers(spark, folder)
    return charts.actual_vs_predicted(df, "o_orderkey", "y", "p")


POINTS_SQL = (
    f"WITH s AS ({SCORED_NUMBERS}), p AS (SELECT * FROM s ORDER BY md5(CAST(o_orderkey AS VARCHAR)), o_orderkey LIMIT 1000)"
    " SELECT 'points' AS series, CAST(o_orderkey AS VARCHAR) AS key, y AS x, p AS y FROM p"
    " UNION ALL SELECT 'ideal', 'lo', min(y), min(y) FROM s UNION ALL SELECT 'ideal', 'hi', max(y), max(y) FROM s"
)

QUERIES = [
    Query("cv_linear", _cv_linear, CV_LINEAR_SQL),
    Query(
        "regression_metrics",
        _regression_metrics,
        f"WITH s AS ({SCORED_NUMBERS}) SELECT round(sqrt(avg((y - p) * (y - p))), 4) AS rmse,"
        " round(avg(abs(y - p)), 4) AS mae, round(1 - sum((y - p) * (y - p)) / (var_pop(y) * count(y)), 6) AS r2 FROM s",
    ),
    Query(
        "classification_metrics",
        lambda s, d: _rounded(
            evaluation.classification_metrics(_scored_classes(s, d), "y", "p"),
            "accuracy",
            "precision",
            "recall",
            "f1",
        ),
        CLASS_SCORES_CTE + " SELECT round(sum(tp) / sum(support), 6) AS accuracy, round(sum(p * support) / sum(support), 6)"
        " AS precision, round(sum(r * support) / sum(support), 6) AS recall,"
        " round(sum(f * support) / sum(support), 6) AS f1 FROM m",
    ),
    Query(
        "class_scores",
        lambda s, d: _rounded(
            evaluation.class_scores(_scored_classes(s, d), "y", "p").select(
                "class", "support", "precision", "recall", "f1"
            ),
            "precision",
            "recall",
            "f1",
        ),
        CLASS_SCORES_CTE + " SELECT v AS class, support, round(p, 6)::DOUBLE AS precision, round(r, 6)::DOUBLE AS recall,"
        " round(f, 6)::DOUBLE AS f1 FROM m",
    ),
    Query(
        "confusion_matrix",
        lambda s, d: evaluation.confusion_matrix(_scored_classes(s, d), "y", "p"),
        CONFUSION_SQL,
    ),
    Query("silhouette_exact", _silhouette, SILHOUETTE_SQL),
    Query("silhouette_squared", _silhouette_squared, SQUARED_SQL),
    Query(
        "leaderboard",
        lambda s, d: _leaderboard(s, d).select("place", "model", "primary_metric", "score"),
        BOARD_CTE + " SELECT place, model, primary_metric, score FROM r",
    ),
    Query(
        "best_model",
        lambda s, d: training.best_model(_leaderboard(s, d)),
        BOARD_CTE + " SELECT model, score FROM r WHERE place = 1",
    ),
    Query(
        "model_comparison",
        lambda s, d: charts.model_comparison(_leaderboard(s, d)).select("place", "model", "score"),
        BOARD_CTE + " SELECT place, model, score FROM r WHERE score IS NOT NULL",
    ),
    Query(
        "linear_regression_1d",
        _line("linear"),
        "SELECT round(regr_slope(o_totalprice, o_custkey), 3) AS slope,"
        " round(regr_intercept(o_totalprice, o_custkey), 2) AS intercept FROM orders",
    ),
    Query("ridge_1d", _line("ridge"), _line_sql("sxy / (sxx + 1.0 / n)")),
    Query("lasso_1d", _line("lasso"), _line_sql("sign(sxy) * greatest(abs(sxy) - 1.0, 0) / sxx")),
    Query(
        "elastic_net_1d",
        _line("elastic_net"),
        _line_sql("sign(sxy) * greatest(abs(sxy) - 0.5, 0) / (sxx + 0.5)"),
    ),
    Query(
        "knn_classify",
        _knn_classify,
        _near_sql("customer", "c_custkey", ["c_acctbal", "c_nationkey"], "c_mktsegment")
        + ", v AS (SELECT c_custkey, y, count(*) AS k FROM n WHERE place <= 5 GROUP BY ALL)"
        " SELECT c_custkey, first(y ORDER BY k DESC, y) AS prediction FROM v GROUP BY c_custkey",
    ),
    Query(
        "knn_regress",
        _knn_regress,
        _near_sql("part", "p_partkey", ["p_partkey", "p_size"], "p_retailprice")
        + " SELECT p_partkey, round(avg(y), 6) + 0.0 AS prediction FROM n WHERE place <= 5 GROUP BY p_partkey",
    ),
    Query("actual_vs_predicted", _line_points, POINTS_SQL),
    Query("linear_models", _scores("o_totalprice", "linear", "ridge", "lasso", "elastic_net")),
    Query("logistic_regression", _scores("o_orderstatus", "logistic")),
    Query("tree_models", _scores("o_orderstatus", "decision_tree")),
    Query("tree_regression", _scores("o_totalprice", "decision_tree")),
    Query("forest_models", _scores("o_orderstatus", "random_forest")),
    Query("forest_regression", _scores("o_totalprice", "random_forest")),
    Query("gbt_models", _scores("o_totalprice", "gradient_boosting")),
    Query("rbf_models", _scores("o_orderstatus", "rbf_svc")),
    Query("rbf_regression", _scores("o_totalprice", "rbf_regression")),
    Query("knn_leaderboard", _scores("o_orderstatus", "logistic", "knn")),
    Query("mlp_classifier", _scores("o_orderstatus", "mlp")),
    Query("kmeans_clusters", _clusters),
    Query("pca_scatter", _scatter),
    Query("feature_importance", _importance),
    Query("permutation_importance", _permutation),
    Query("batch_scoring", _batch),
]
