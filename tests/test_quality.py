"""Typing, missing data, frequencies, outliers and target checks on fixtures."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tablewright.catalog.base import table
from tablewright.functions.schema import physical_types
from tablewright.operators import frequency, missing, numeric, outliers, target, typing
from tablewright.operators.schema_checks import duplicate_names, schema_report
from tablewright.plans.profiling import profile
from tablewright.plans.validation import DataValidationError, ValidationConfig, validate

GOLDEN = "/root/testdata/sf0.01"


def kinds(df):
    return {t.column: t.semantic_type for t in typing.infer_types(df)}


def test_types_by_value(spark):
    rows = [(i, i % 2, float(i % 2), "Yes" if i % 2 else "no", f"2020-01-{i % 28 + 1:02d}", f"w{i}", "k%d" % (i % 7),
             None, None, [i], "2020-01-01" if i else "nope") for i in range(100)]
    df = spark.createDataFrame(
        rows,
        "id long, flag int, half double, answer string, day string, word string, kind string, void double,"
        " empty string, list array<int>, broken string",
    )
    assert kinds(df) == {
        "id": "numeric",
        "flag": "boolean",
        "half": "numeric",
        "answer": "boolean",
        "day": "datetime",
        "word": "text",
        "kind": "categorical",
        "void": "boolean",
        "empty": "boolean",
        "list": "unknown",
        "broken": "unknown",
    }


def test_three_spellings_are_not_boolean(spark):
    df = spark.createDataFrame([("yes",), ("no",), ("Yes",)], "a string")
    assert kinds(df) == {"a": "categorical"}


@pytest.mark.parametrize("distinct,expected", [(20, "categorical"), (21, "text"), (50, "text")])
def test_category_limit_by_count(spark, distinct, expected):
    df = spark.range(100).select(F.concat(F.lit("v"), F.col("id") % distinct).alias("c"))
    assert kinds(df)["c"] == expected


@pytest.mark.parametrize("distinct,expected", [(200, "categorical"), (201, "text"), (120, "categorical")])
def test_category_limit_by_share(spark, distinct, expected):
    df = spark.range(4000).select(F.concat(F.lit("v"), F.col("id") % distinct).alias("c"))
    assert kinds(df)["c"] == expected


def test_decimal_and_bool_columns(spark):
    df = spark.range(30).select(
        (F.col("id") / 7).cast("decimal(10,3)").alias("d"), (F.col("id") % 2 == 0).alias("b"), F.current_date().alias("t")
    )
    assert kinds(df) == {"d": "numeric", "b": "boolean", "t": "datetime"}
    assert [r["kind"] for r in physical_types(df).collect()] == ["number", "boolean", "datetime"]


def test_golden_types(spark):
    assert kinds(table(spark, GOLDEN, "labels")) == {"doc_id": "numeric", "quality": "boolean", "toxic": "boolean"}
    assert kinds(table(spark, GOLDEN, "nation"))["n_name"] == "text"
    assert kinds(table(spark, GOLDEN, "part"))["p_name"] == "categorical"


@pytest.mark.parametrize("method,expected", [("iqr", 463), ("zscore", 834), ("mad", 1686)])
def test_golden_outliers(spark, method, expected):
    row = outliers.outlier_report(table(spark, GOLDEN, "events"), method, columns=["value"]).first()
    assert row["outliers"] == expected


def test_ties_take_the_smallest_value(spark):
    df = spark.createDataFrame([("a",), ("a",), ("b",), ("b",), ("c",), (None,)], "x string")
    row = frequency.most_least_frequent(df).first()
    assert (row["most_frequent"], row["least_frequent"], row["unique_values"]) == ("a", "c", 3)
    assert [r["value"] for r in frequency.top_values(df, k=2).orderBy("position").collect()] == ["a", "b"]
    assert frequency.modes(df, ["x"]).first()["mode"] == "a"


def test_duplicates_with_gaps_and_lists(spark):
    df = spark.createDataFrame([(1, None, [1]), (1, None, [1]), (1, None, [2])], "a int, b string, c array<int>")
    row = frequency.duplicate_rows(df).first()
    assert (row["n_rows"], row["n_distinct_rows"], row["duplicates"]) == (3, 2, 1)


def test_empty_table_divides_by_nothing(spark):
    df = spark.createDataFrame([], "a double, b string")
    assert {r["missing_pct"] for r in missing.missing_by_column(df).collect()} == {None}
    assert frequency.duplicate_rows(df).first()["duplicates"] == 0
    assert missing.row_missing_distribution(df).first()["n_rows"] == 0
    assert numeric.describe(df).first()["p50"] is None
    assert outliers.outlier_report(df).count() == 0


def test_one_row(spark):
    df = spark.createDataFrame([(1.0, "x")], "a double, b string")
    row = numeric.describe(df).first()
    assert (row["std"], row["p50"], row["count"]) == (None, 1.0, 1)


def test_many_gap_columns_use_the_matrix(spark):
    base = spark.range(200)
    wide = base.select(
        *[F.when(F.col("id") % (k + 2) != 0, F.col("id")).alias(f"c{k}") for k in range(44)],
        F.when(F.col("id") % 2 != 0, F.col("id")).alias("twin"),
    )
    found = missing.co_missing_correlation(wide).collect()
    assert ("c0", "twin", 1.0) in {(r[0], r[1], round(r[2], 9)) for r in found}


def test_many_columns_correlate_through_the_matrix(spark):
    df = spark.range(100).select(*[F.rand(i).alias(f"c{i}") for i in range(14)])
    got = {(r[0], r[1]): r[2] for r in numeric.correlation_matrix(df).collect()}
    real = df.toPandas().corr()
    assert len(got) == 91
    assert got["c0", "c5"] == pytest.approx(real.loc["c0", "c5"], abs=1e-5)


@pytest.mark.parametrize("values,hits", [([1.0] * 10 + [9.0], 1), ([1.0] * 12, 0), ([1.0] * 8 + [99.0], None)])
def test_mad_of_zero_and_too_few_values(spark, values, hits):
    df = spark.createDataFrame([(v,) for v in values], "x double")
    row = outliers.outlier_report(df, "mad").first()
    assert (row and row["outliers"]) == hits


def test_zero_deviation_has_no_z_outliers(spark):
    df = spark.createDataFrame([(1.0,)] * 12, "x double")
    assert outliers.outlier_report(df, "zscore").first()["outliers"] == 0
    assert outliers.outlier_report(df, "other").count() == 0


def test_task_rules(spark):
    df = spark.range(100).select(
        (F.col("id") % 3).cast("int").alias("whole"),
        (F.col("id") % 3).cast("double").alias("real"),
        (F.col("id") % 2 == 0).alias("flag"),
        F.col("id").alias("many"),
    )
    tasks = {c: target.detect_task(df, c) for c in df.columns}
    assert tasks == {"whole": "classification", "real": "regression", "flag": "classification", "many": "regression"}
    assert target.detect_task(df, None) == target.detect_task(df, "absent") == "unsupervised"


def test_text_target_skips_correlation(spark, folder):
    checks = {r["check"] for r in target.target_leakage(table(spark, folder, "orders"), "o_orderstatus").collect()}
    assert checks == {"id_like", "datetime"}
    assert target.target_leakage(table(spark, folder, "orders"), "absent").count() == 0


def test_single_class_is_balanced(spark):
    df = spark.createDataFrame([("a",)] * 3, "x string")
    row = target.class_balance(df, "x").first()
    assert (row["imbalance_ratio"], row["is_imbalanced"], row["has_rare_class"]) == (1.0, False, False)


def test_schema_report_finds_duplicate_names(spark):
    df = spark.createDataFrame([(1, 2)], "a int, b int").toDF("a", "A")
    assert duplicate_names(df) == ["a"]
    assert schema_report(df).first()["check"] == "duplicate_names"


def test_validation_passes_fails_and_raises(spark, folder):
    good = validate(table(spark, folder, "orders"), "o_orderstatus")
    assert good.status == "PASS" and not good.errors
    strict = validate(table(spark, folder, "orders"), "o_orderstatus", {"fail_on_warnings": True})
    assert strict.status == "FAIL"
    with pytest.raises(DataValidationError):
        strict.raise_on_failure()


def test_partial_config_keeps_defaults():
    cfg = ValidationConfig.merged({"missing_thresholds": {"column_max_missing_pct": 10.0}})
    assert (cfg.column_max_missing_pct, cfg.row_max_missing_pct, cfg.outlier_method) == (10.0, 80.0, "iqr")


def test_small_tables_warn(spark):
    df = spark.createDataFrame(pd.DataFrame({f"c{i}": range(3) for i in range(5)}))
    found = validate(df)
    assert any(w.startswith("very_small") for w in found.warnings)
    assert any(w.startswith("more_features_than_rows") for w in found.warnings)
    described = profile(df)
    assert described.warnings == ["critical_few_rows", "more_features_than_rows"]
    assert described.health_score == 80
