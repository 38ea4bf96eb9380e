"""Cleaning steps, feature preparation and splits."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tablewright.catalog import preparation
from tablewright.catalog.base import dirty_orders, table
from tablewright.operators import cleaning, features, splitting, training


def test_impute_mode_keeps_types_and_medians_widen(spark):
    df = spark.createDataFrame(
        [(1, "a", True), (None, "a", None), (4, None, False), (None, "b", False)], "n int, c string, b boolean"
    )
    out = cleaning.impute(df)
    assert dict(out.dtypes) == {"n": "double", "c": "string", "b": "boolean"}
    assert [r["n"] for r in out.collect()] == [1.0, 2.5, 4.0, 2.5]
    assert [r["c"] for r in out.collect()] == ["a", "a", "a", "b"]
    assert [r["b"] for r in out.collect()] == [True, False, False, False]


def test_clean_modes(spark, folder):
    dirty = dirty_orders(spark, folder)
    auto = cleaning.clean(dirty)
    assert auto.removed_columns == ["all_missing", "constant_col"]
    assert auto.df.filter("price IS NULL").count() > 0
    drop = cleaning.clean(dirty, {"handle_missing": "drop"})
    assert set(drop.removed_columns) == {"mostly_missing", "all_missing", "constant_col"}
    filled = cleaning.clean(dirty, {"handle_missing": "impute"})
    left = filled.df.select([F.count_if(F.col(c).isNull()).alias(c) for c in filled.df.columns]).first()
    assert sum(left) == 0
    for done in (auto, drop, filled):
        assert done.df.count() == table(spark, folder, "orders").count()
        done.release()


def test_null_token_is_optional(spark):
    df = spark.createDataFrame([(" A ",), (None,)], "c string")
    assert [r[0] for r in cleaning.normalize_categories(df, ["c"]).collect()] == ["a", None]
    assert [r[0] for r in cleaning.normalize_categories(df, ["c"], "nan").collect()] == ["a", "nan"]


def test_dates_hidden_by_blanks_are_found(spark):
    df = spark.range(60).select(
        F.concat(F.lit(" 2020-01-"), F.lpad((F.col("id") % 9 + 1).cast("string"), 2, "0")).alias("d"), "id"
    )
    assert dict(cleaning.clean(df).df.dtypes)["d"] == "timestamp_ntz"


def test_scalers(spark):
    rng = np.random.default_rng(3)
    frame = pd.DataFrame({"a": rng.normal(5, 2, 400), "same": 4.0})
    df = spark.createDataFrame(frame)
    standard = features.scale(df, ["a", "same"]).toPandas()
    assert standard["a"].mean() == pytest.approx(0, abs=1e-12)
    assert standard["a"].std(ddof=0) == pytest.approx(1)
    assert (standard["same"] == 0).all()
    spread = features.scale(df, ["a"], "minmax").toPandas()["a"]
    assert (spread.min(), spread.max()) == (0.0, 1.0)
    robust = features.scale(df, ["a"], "robust").toPandas()["a"]
    assert robust.median() == pytest.approx(0, abs=1e-12)


def test_onehot_binary_and_unknown(spark):
    train = spark.createDataFrame([("a",), ("b",), ("b",)], "c string")
    plan = features.fit_features(train, None, {"rename_features": False})
    assert plan.names == ["cat__c_b"]
    rows = plan.transform(spark.createDataFrame([("a",), ("b",), ("z",), (None,)], "c string")).collect()
    assert [r[0] for r in rows] == [0.0, 1.0, 0.0, 1.0]  # a gap takes the mode


def test_ordinal_unknown_is_minus_one(spark):
    train = spark.createDataFrame([("a",), ("b",), ("c",), ("c",)], "c string")
    plan = features.fit_features(train, None, {"encoding": "ordinal"})
    rows = plan.transform(spark.createDataFrame([("c",), ("a",), ("z",)], "c string")).collect()
    assert [r[0] for r in rows] == [2.0, 0.0, -1.0]


def test_dictionary_codes_in_buckets_and_with_hot_values(spark):
    df = spark.range(4000).select(
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("v"), F.col("id") % 700)).alias("c"), "id"
    )
    book = features.code_dictionary(df, "c", per_bucket=50)
    plain = sorted({r["c"] for r in df.select("c").distinct().collect()})
    assert {r["value"]: r["code"] for r in book.collect()} == {v: float(i) for i, v in enumerate(plain)}
    rows = df.unionByName(spark.createDataFrame([("never seen", -1), (None, -2)], "c string, id long"))
    for limit in (10_000, 10):  # broadcast, then the shuffled way
        coded = features.join_codes(rows, "c", book, "k", broadcast_rows=limit).toPandas()
        assert len(coded) == 4002
        for c, k in zip(coded["c"], coded["k"]):
            assert k == (float(plain.index(c)) if c in plain else -1.0)


def test_long_dictionaries_become_sparse_vectors(spark, monkeypatch):
    monkeypatch.setattr(features.fit_categories, "__defaults__", (5,))
    df = spark.range(300).select(F.concat(F.lit("v"), F.col("id") % 12).alias("c"), (F.col("id") * 1.5).alias("x"))
    plan = features.fit_features(df)
    packed = plan.assemble(df).select("features").collect()
    assert {r[0].size for r in packed} == {13}
    assert all(r[0].numNonzeros() <= 2 for r in packed)
    unknown = plan.assemble(spark.createDataFrame([("zzz", 1.0)], "c string, x double")).first()[0]
    assert sum(1 for v in unknown.toArray() if v == 1.0) == 0


def many(spark, k, rows=40_000):
    return spark.range(rows).select("id", F.concat(F.lit("v"), F.col("id") % k).alias("c"), (F.col("id") * 1.5).alias("x"))


def test_a_category_more_is_a_feature_more_at_every_count(spark):
    """1,000 categories are written into the plan, 1,001 are joined: the features are the same."""
    widths = []
    for k in (1000, 1001):
        df = many(spark, k)
        fitted = features.fit_onehot(df, ["c"])
        assert fitted.width == len(fitted.names) == k
        wide = features.onehot(df.filter("id < 30"), ["c"])
        assert len(wide.columns) == 2 + 30
        vectors = {r["id"]: r["features"] for r in fitted.vectors(df).filter("id < 50").collect()}
        cells = {r["id"]: r for r in fitted.cells(df, ["id"]).filter("id < 50").collect()}
        assert len(vectors) == len(cells) == 50
        for i, v in vectors.items():
            assert v.size == k and list(v.indices) == [cells[i]["place"]] and fitted.names[cells[i]["place"]] == cells[i]["feature"] == f"c_v{i}"
        plan = features.fit_features(df, None, {"rename_features": False})
        assert plan.parameters.filter("stat = 'category'").count() == k
        row = plan.assemble(df, ["id"]).filter("id = 7").first()["features"]
        assert row.size == len(plan.names) and plan.names[int([i for i in row.indices if row[int(i)] == 1.0][-1])] == "cat__c_v7"
        plain = plan.transform(df.filter("id = 7"))
        assert list(plain.first()) == list(row.toArray()) and plain.columns == plan.names
        ready = features.prepare(df, "x", {"encoding": "onehot"}, key=["id"])
        matrix = training.build_matrix(ready.vectors, ready.feature_names, "x", "id", task="regression")
        assert len(matrix.names) == matrix.df.first()["features"].size == len(ready.feature_names)
        widths.append((len(plan.names), len(ready.feature_names)))
    assert widths[1] == (widths[0][0] + 1, widths[0][1] + 1)


def test_onehot_gaps_unknown_values_and_pairs(spark, monkeypatch):
    df = spark.createDataFrame([(1, "a", "p"), (2, "b", "q"), (3, "b", "q"), (4, None, None)], "id long, c string, d string")
    new = spark.createDataFrame([(1, "zzz", "p"), (2, "b", "never"), (3, None, "q")], "id long, c string, d string")
    got = []
    for limit in (1000, 1):
        monkeypatch.setattr(features.fit_categories, "__defaults__", (limit,))
        fitted = features.fit_onehot(df, ["c", "d"])
        assert fitted.names == ["c_b", "d_q"]
        plain = {r["id"]: (r["c_b"], r["d_q"]) for r in fitted.columns(new).collect()}
        assert plain == {1: (0.0, 0.0), 2: (1.0, 0.0), 3: (1.0, 1.0)}
        assert {r["id"]: tuple(r["features"].toArray()) for r in fitted.vectors(new).collect()} == plain
        got.append(sorted(tuple(r) for r in fitted.cells(new, ["id"]).collect()))
    assert got[0] == got[1] == [(2, 0, "c_b", 1.0), (3, 0, "c_b", 1.0), (3, 1, "d_q", 1.0)]


@pytest.mark.parametrize("encoding,scaling,limit", [("onehot", "standard", 1000), ("onehot", "robust", 3), ("ordinal", "minmax", 3), ("ordinal", "none", 1000)])
def test_a_saved_plan_makes_the_same_features(spark, tmp_path, monkeypatch, encoding, scaling, limit):
    monkeypatch.setattr(features.fit_categories, "__defaults__", (limit,))
    monkeypatch.setattr(features, "MAX_LITERAL_CATEGORIES", limit)
    df = spark.range(600).selectExpr(
        "id", "IF(id % 7 = 0, NULL, id * 1.5) AS `odd name`", "IF(id % 5 = 0, NULL, concat('v ', id % 12)) AS c",
        "IF(id % 3 = 0, NULL, id % 2 = 0) AS b", "IF(id % 2 = 0, 'p', 'q') AS pair", "'same' AS constant", "id % 3 AS y",
    )
    plan = features.fit_features(df.drop("id"), "y", {"encoding": encoding, "scaling": scaling})
    plan.save(str(tmp_path / "plan"))
    again = features.FeaturePlan.load(spark, str(tmp_path / "plan"))
    assert (again.names, again.target, again.removed, again.config.encoding) == (plan.names, "y", plan.removed, encoding)
    assert {k: sorted(v) for k, v in again.by_class.items()} == {k: sorted(v) for k, v in plan.by_class.items()}
    new = df.unionByName(df.filter("id < 3").withColumns({"c": F.lit("never seen"), "odd name": F.lit(None).cast("decimal(22,1)")}))
    for made in ("transform", "assemble"):
        one, two = (getattr(p, made)(new, ["id"]) for p in (plan, again))
        assert one.columns == two.columns
        assert sorted(map(str, one.collect())) == sorted(map(str, two.collect()))
    again.save(str(tmp_path / "again"))
    assert sorted(map(str, spark.read.parquet(str(tmp_path / "again")).collect())) == sorted(map(str, spark.read.parquet(str(tmp_path / "plan")).collect()))


def test_an_absent_target_is_told(spark):
    with pytest.warns(UserWarning, match="nothing"):
        plan = features.fit_features(many(spark, 4, 40), "nothing")
    assert plan.audit.filter("action = 'target_absent'").count() == 1


def test_long_ordinal_equals_short(spark):
    df = spark.range(500).select(F.concat(F.lit("v"), F.col("id") % 40).alias("c"), "id")
    short = {r["id"]: r["c"] for r in features.ordinal(df, ["c"]).collect()}
    book = features.code_dictionary(df, "c")
    long = {r["id"]: r["k"] for r in features.join_codes(df, "c", book, "k").collect()}
    assert short == long


def test_scaling_none_and_drop(spark):
    df = spark.range(50).select(F.col("id").cast("double").alias("x"), F.concat(F.lit("k"), F.col("id") % 3).alias("c"))
    plain = features.fit_features(df, None, {"scaling": "none"})
    assert plain.transform(df).agg(F.max("num__x")).first()[0] == 49.0
    assert features.fit_features(df, None, {"scaling": "drop"}).names == ["cat__c_k0", "cat__c_k1", "cat__c_k2"]
    with pytest.raises(ValueError):
        features.fit_features(df.select("x"), None, {"scaling": "drop"})
    with pytest.raises(ValueError):
        features.fit_features(df, None, {"scaling": "bogus"})


def test_fit_on_train_differs_from_all(spark):
    df = spark.range(400).select("id", F.exp(F.col("id") / 40).alias("x"), F.rand(1).alias("y"))
    everything = features.prepare(df, "y", key=["id"]).data
    training = features.prepare(df, "y", {"fit_on": "train"}, key=["id"]).data
    assert everything.agg(F.avg("num__x")).first()[0] == pytest.approx(0, abs=1e-9)
    assert abs(training.agg(F.avg("num__x")).first()[0]) > 1e-6


def test_transform_twice_is_the_same(spark, folder):
    df = table(spark, folder, "orders")
    plan = features.fit_features(df, "o_orderstatus")
    a, b = plan.transform(df).toPandas(), plan.transform(df).toPandas()
    pd.testing.assert_frame_equal(a.sort_values(list(a)).reset_index(drop=True), b.sort_values(list(b)).reset_index(drop=True))


@pytest.mark.parametrize("partitions", [1, 7])
def test_split_is_stable_under_partitioning(spark, folder, partitions):
    df = table(spark, folder, "orders")
    want = {r["o_orderkey"] for r in splitting.train_test_split(df, ["o_orderkey"]).filter("split = 'test'").collect()}
    moved = splitting.train_test_split(df.repartition(partitions), ["o_orderkey"])
    assert {r["o_orderkey"] for r in moved.filter("split = 'test'").collect()} == want


def test_golden_splits(spark):
    df = table(spark, "/root/testdata/sf0.01", "orders")
    assert splitting.train_test_split(df, ["o_orderkey"]).filter("split = 'test'").count() == 3055
    exact = splitting.stratified_split(df, "o_orderstatus", ["o_orderkey"]).filter("split = 'test'")
    assert {r[0]: r[1] for r in exact.groupBy("o_orderstatus").count().collect()} == {"F": 987, "O": 996, "P": 1018}


def test_class_of_one_stays_in_training(spark):
    df = spark.range(101).withColumn("y", F.when(F.col("id") == 0, "rare").otherwise("common"))
    out = splitting.stratified_split(df, "y", ["id"])
    assert out.filter("y = 'rare'").first()["split"] == "train"
    assert out.filter("split = 'test'").count() == 20


def test_folds_are_balanced_per_class(spark):
    df = spark.range(503).withColumn("y", F.col("id") % 3)
    folds = splitting.assign_folds(df, "y", ["id"], 5).groupBy("y", "fold").count().toPandas()
    assert folds.groupby("y")["count"].agg(lambda s: s.max() - s.min()).max() <= 1
    assert folds["count"].sum() == 503


def test_plans_stay_on_the_engine(spark, folder):
    df = splitting.train_test_split(table(spark, folder, "orders"), ["o_orderkey"]).select("o_orderkey", "split")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan
    assert "ReadSchema: struct<o_orderkey:bigint>" in plan


def test_copies_do_not_break_the_cut(spark):
    # A third of all rows are copies of one row; without a key they share a hash.
    df = spark.range(600).select(F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id")).alias("v"), F.lit("c").alias("y"))
    for seed in range(4):
        out = splitting.stratified_split(df, "y", seed=seed)
        sides = out.filter("v = -1").select("split").distinct().count()
        assert sides == 1
        assert out.filter("split = 'test'").count() <= 120
        assert out.count() == 600
    folds = splitting.assign_folds(df, "y")
    assert folds.count() == 600 and folds.filter("v = -1").select("fold").distinct().count() == 1


def test_prepared_rows_are_made_once(spark, folder):
    """The rows without copies are written once; runs over them shuffle no table, by their class neither."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        made = preparation._prepared(spark, folder)
        plan = made._jdf.queryExecution().executedPlan().toString()
        assert made.inputFiles() and all("/table-" in f for f in made.inputFiles())
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
        rows = dirty_orders(spark, folder)
        assert made.count() == rows.distinct().count() < rows.count()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
