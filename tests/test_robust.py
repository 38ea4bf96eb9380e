import numpy as np
import pytest
from pyspark.sql import functions as F

from tablewright.operators import charts, frequency, numeric, outliers, splitting, target
from tablewright.sources.readers import load_table

INFINITE = float("inf")


def endless(spark):
    rows = [(float(i), float(i) * 2, INFINITE if i == 7 else -INFINITE if i == 9 else float(i)) for i in range(200)]
    return spark.createDataFrame(rows, "y double, twin double, x double")


def test_infinities_make_no_outliers_and_no_leakage(spark):
    df = endless(spark)
    report = {r["column"]: r["outliers"] for r in outliers.outlier_report(df, "zscore", 3.0).collect()}
    assert report["x"] == 0
    leaks = {r["column"] for r in target.target_leakage(df, "y").collect() if r["check"] == "high_correlation"}
    assert leaks == {"twin"}
    assert {r["column_b"]: r["correlation"] for r in numeric.correlation_matrix(df).collect() if r["column_a"] == "y"} == {"twin": 1.0, "x": None}


def test_histogram_counts_infinities_apart(spark):
    bins = {r["bin"]: r["n"] for r in charts.histogram(endless(spark), "x", 10).collect()}
    assert bins[-1] == 1 and bins[10] == 1 and sum(bins.values()) == 200 and bins[0] == 18 and bins[5] == 20
    assert {r["n"] for r in charts.histogram(endless(spark).where("x = 3"), "x", 1).collect()} == {1}


def test_zero_has_one_sign(spark):
    df = spark.createDataFrame([(0.0,), (-0.0,), (1.0,)], "x double")
    assert {r["value"]: r["n"] for r in frequency.value_frequencies(df, ["x"]).collect()} == {"0.0": 2, "1.0": 1}


def test_long_texts_count_by_digest(spark):
    df = spark.createDataFrame([("a" * 500,), ("a" * 500,), ("a" * 499 + "b",), ("short",), (None,)], "t string")
    assert frequency.distinct_counts(df, ["t"]).first()["n_distinct"] == 3


def test_wide_correlation_equals_the_pair_form(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(1e6, 1, (400, 20))
    x[:, 1] = x[:, 0] * -2
    x[:, 2] = 5.0
    rows = [[None if rng.random() < 0.1 else float(v) for v in r] for r in x]
    df = spark.createDataFrame(rows, ", ".join(f"c{i} double" for i in range(20)))
    wide = {(r[0], r[1]): r[2] for r in numeric.correlation_matrix(df).collect()}
    assert len(wide) == 190
    for k in range(0, 20, 10):
        names = [f"c{i}" for i in range(k, k + 10)]
        for a, b, r in numeric.correlation_matrix(df.select(*names)).collect():
            assert wide[(a, b)] == (None if r is None else pytest.approx(r, abs=2e-6))


def test_stratified_split_takes_any_number_of_classes(spark):
    df = spark.range(20_000).select("id", (F.col("id") % 2_500).alias("g"))
    counts = splitting.stratified_split(df, "g", ["id"], 0.25).groupBy("g").agg(F.count_if(F.col("split") == "test").alias("n"))
    assert {r["n"] for r in counts.collect()} == {2} and counts.count() == 2_500


def written(folder, name, text, charset="utf-8"):
    (folder / name).write_bytes(text.encode(charset))


def test_quoted_line_breaks_stay_in_their_cell(spark, tmp_path):
    written(tmp_path, "a.csv", 'id,t\n1,"line one\nline two"\n2,plain\n')
    assert [tuple(r) for r in load_table(spark, str(tmp_path / "a.csv")).collect()] == [(1, "line one\nline two"), (2, "plain")]


def test_folders_of_mixed_files_keep_every_row(spark, tmp_path):
    lines, csv = tmp_path / "j.json", tmp_path / "c.csv"
    lines.mkdir()
    csv.mkdir()
    written(lines, "a.json", '{"x": 1}\n{"x": 2}\n')
    written(lines, "b.json", '[{"x": 3.5},\n {"x": 4}]\n')
    assert sorted(r["x"] for r in load_table(spark, str(lines)).collect()) == [1, 2, 3.5, 4]
    written(csv, "a.csv", "id,t\n1,5\n2,6\n")
    written(csv, "b.csv", "id,t\n3,caf\u00e9\n", "latin-1")
    written(csv, "c.csv", 'id,t\n4,"two\nlines"\n')
    got = sorted(tuple(r) for r in load_table(spark, str(csv)).collect())
    assert got == [(1, "5"), (2, "6"), (3, "caf\u00e9"), (4, "two\nlines")]
