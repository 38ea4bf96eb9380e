"""Quantiles, ranks, text and numeric expressions on hard cases."""

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tablewright.functions import quantiles
from tablewright.functions.numeric import (
    nan_to_null,
    pairwise_correlation,
    sample_kurtosis,
    sample_skewness,
)
from tablewright.functions.quantiles import exact_quantiles
from tablewright.functions.ranks import hash_cutoffs, hash_rank, prefix_length, row_hash
from tablewright.functions.text import normalize_category, parse_timestamp, unique_feature_names

PROBS = (0.0, 0.01, 0.25, 0.5, 0.75, 0.99, 1.0)


def numbers(spark, **columns):
    return spark.createDataFrame(pd.DataFrame(columns))


@pytest.mark.parametrize("limit", [3, 50, 20_000])
def test_quantiles_equal_sorting(spark, limit):
    rng = np.random.default_rng(1)
    n = 6000
    skewed = np.where(rng.random(n) < 0.35, 7.0, rng.normal(0, 1e6, n))  # a third is one value
    frame = pd.DataFrame(
        {
            "normal": rng.normal(0, 1, n),
            "few": rng.integers(0, 4, n).astype(float),
            "skewed": skewed,
            "heavy": np.exp(rng.normal(0, 20, n)),
            "constant": np.full(n, 3.5),
        }
    )
    found = exact_quantiles(spark.createDataFrame(frame), list(frame), PROBS, gather_limit=limit)
    for c in frame:
        for p in PROBS:
            assert found[c][p] == pytest.approx(frame[c].quantile(p), rel=1e-12, abs=1e-12)


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.one_of(st.none(), st.integers(-5, 5), st.floats(-1e9, 1e9)), min_size=1, max_size=60))
def test_quantiles_of_any_list(spark, values):
    df = spark.createDataFrame([(None if v is None else float(v),) for v in values], "x double")
    known = pd.Series([v for v in values if v is not None], dtype=float)
    found = exact_quantiles(df, ["x"], (0.25, 0.5, 0.9), gather_limit=2)["x"]
    for p in (0.25, 0.5, 0.9):
        if known.empty:
            assert found[p] is None
        else:
            assert found[p] == pytest.approx(known.quantile(p), rel=1e-12, abs=1e-9)


def test_quantiles_with_infinities(spark):
    df = spark.createDataFrame([(float("inf"),), (float("-inf"),), (0.0,), (1.0,), (2.0,)], "x double")
    found = exact_quantiles(df, ["x"], (0.0, 0.5, 1.0))["x"]
    assert found == {0.0: float("-inf"), 0.5: 1.0, 1.0: float("inf")}


def test_quantiles_of_nothing(spark):
    df = spark.createDataFrame([(None,)], "x double")
    assert exact_quantiles(df, ["x"], (0.5,)) == {"x": {0.5: None}}
    assert exact_quantiles(df, [], (0.5,)) == {}


@pytest.mark.parametrize("rows", [None, 10**8])
def test_hash_rank_is_the_order_of_hashes(spark, rows):
    df = spark.range(5000).withColumn("g", F.when(F.col("id") % 3 == 0, "a").otherwise("b"))
    ranked = hash_rank(df, ["id"], 42, F.col("g"), rows=rows).toPandas()
    import hashlib

    ranked["h"] = [hashlib.md5(f"{i}:42".encode()).hexdigest() for i in ranked["id"]]
    for _, part in ranked.groupby("g"):
        assert part.sort_values("h")["rank"].tolist() == list(range(1, len(part) + 1))


def test_prefix_grows_with_rows():
    assert prefix_length(10) == 1
    assert prefix_length(10**8) == 3
    assert prefix_length(10**14) == 8


def test_cutoffs_take_exact_shares(spark):
    df = spark.range(1000).withColumn("g", F.when(F.col("id") < 1, "one").when(F.col("id") < 300, "b"))
    cuts = hash_cutoffs(df, ["id"], 42, F.col("g"), 0.2, rows=10**7)
    hashed = df.select(F.col("g"), row_hash(df, ["id"], 42).alias("h"))
    taken = {r["g"]: hashed.filter(F.col("g").eqNullSafe(F.lit(r["g"])) & (F.col("h") <= r["cut"])).count() for r in cuts.collect()}
    assert taken == {"b": 60, None: 140}  # round(0.2 * 1) = 0


def test_bias_corrected_moments(spark):
    rng = np.random.default_rng(2)
    x = rng.exponential(2, 500)
    row = numbers(spark, x=x).agg(sample_skewness(F.col("x")), sample_kurtosis(F.col("x"))).first()
    assert row[0] == pytest.approx(pd.Series(x).skew())
    assert row[1] == pytest.approx(pd.Series(x).kurt())


@pytest.mark.parametrize("values,skew,kurt", [([1.0] * 12, 0.0, 0.0), ([1.0, 2.0], None, None), ([1.0], None, None)])
def test_moments_of_little(spark, values, skew, kurt):
    df = spark.createDataFrame([(v,) for v in values], "x double")
    assert tuple(df.agg(sample_skewness(F.col("x")), sample_kurtosis(F.col("x"))).first()) == (skew, kurt)


def test_correlation_is_guarded_and_pairwise(spark):
    df = spark.createDataFrame(
        [(1.0, 5.0, 2.0), (2.0, 5.0, None), (3.0, 5.0, 7.0), (4.0, 5.0, 1.0)], "a double, b double, c double"
    )
    row = df.agg(
        pairwise_correlation(F.col("a"), F.col("b")), pairwise_correlation(F.col("a"), F.col("c"))
    ).first()
    assert row[0] is None
    assert row[1] == pytest.approx(df.toPandas()["a"].corr(df.toPandas()["c"]))


def test_nan_becomes_null_and_infinity_stays(spark):
    df = spark.createDataFrame([(float("nan"),), (float("inf"),), (None,), (-0.0,)], "x double")
    assert nan_to_null(df).agg(F.count("x")).first()[0] == 2


def test_category_spaces(spark):
    df = spark.createDataFrame([(" A  b\t",), ("a b",), (" a  B",), (None,)], "c string")
    out = [r[0] for r in df.select(normalize_category(F.col("c"))).collect()]
    assert out == ["a b", "a b", "a b", None]


@pytest.mark.parametrize(
    "text,day",
    [
        ("2020-02-29", "2020-02-29"),
        ("2020-02-30", None),
        ("2020/03/01", "2020-03-01"),
        ("12/31/1999", "1999-12-31"),
        ("20200301", "2020-03-01"),
        ("2020-03-01T10:20:30", "2020-03-01"),
        ("n/a", None),
        ("", None),
    ],
)
def test_dates(spark, text, day):
    df = spark.createDataFrame([(text,)], "c string")
    found = df.select(F.date_format(parse_timestamp(F.col("c")), "yyyy-MM-dd")).first()[0]
    assert found == day


def test_feature_names_stay_apart():
    assert unique_feature_names(["num__a b", "num__a_b", "num__A-b"]) == ["num__a_b", "num__a_b_2", "num__a_b_3"]


@pytest.mark.parametrize("scale", [1e-12, 1.0, 1e15])
def test_mean_keeps_its_precision(spark, scale):
    from tablewright.functions.numeric import mean_of

    x = np.random.default_rng(4).normal(3, 1, 300) * scale
    df = numbers(spark, x=x).repartition(5)
    assert df.agg(mean_of(df, "x")).first()[0] == pytest.approx(x.mean(), rel=1e-13)
    nothing = spark.createDataFrame([(None,)], "x double")
    assert nothing.agg(mean_of(nothing, "x")).first()[0] is None
    times = spark.range(1000).select((F.lit(1_700_000_000_000) + F.col("id") * 1_234_567).alias("x"))
    assert times.agg(mean_of(times, "x")).first()[0] == 1_700_000_000_000 + 999 * 1_234_567 / 2


def test_zones_are_counted_by_a_row_each():
    """Whatever the number of rows and columns, a task hands on one row a zone; gaps count nowhere."""
    nan, inf = math.nan, math.inf
    batches = [
        pa.RecordBatch.from_pydict({"v0": [3.0, None, 1.0, -inf, 2.0, 1.0], "v2": [5.0, 5.0, None, None, 6.0, 7.0]}),
        pa.RecordBatch.from_pydict({"v0": [inf, nan, 1.5, 9.0, 1.0, None], "v2": pa.array([None] * 6, pa.float64())}),
    ]
    ranges = [(0, None, None, [1.0, 3.0]), (0, 1.0, 9.0, [2.0]), (2, 5.0, None, [6.0, 8.0])]
    found = [r for b in quantiles._zone_counts(ranges)(batches) for r in b.to_pylist()]
    got = {(r["c"], r["z"]): (r["n"], r["least"], r["most"]) for r in found}
    assert len(found) == len(got) and math.isnan(got[0, 4][2])
    assert got.pop((0, 4))[:2] == (3, 9.0)
    assert got == {
        (0, 0): (1, -inf, -inf), (0, 1): (3, 1.0, 1.0), (0, 2): (2, 1.5, 2.0), (0, 3): (1, 3.0, 3.0),
        (1, 0): (1, 1.5, 1.5), (1, 1): (1, 2.0, 2.0), (1, 2): (1, 3.0, 3.0),
        (2, 1): (1, 6.0, 6.0), (2, 2): (1, 7.0, 7.0),
    }
