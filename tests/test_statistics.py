"""The shared statistics run answers as separate runs over plain Python do."""

import datetime as dt
import itertools
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tablewright.functions.schema import col
from tablewright.functions.statistics import Counted, Statistics, half_up
from tablewright.operators import missing
from tablewright.plans.profiling import profile
from tablewright.plans.validation import validate

SCHEMA = "i int, l long, d double, s string, b boolean, day date, at timestamp, wall timestamp_ntz, m decimal(9,2), `odd name.x` string"


def rows_for(seed, n=400):
    rng = random.Random(seed)

    def maybe(x, share=0.3):
        return None if rng.random() < share else x

    start = dt.datetime(2024, 3, 30, 23, 0)
    return [
        (
            maybe(rng.randrange(4)), maybe(rng.randrange(10**12), 0.0), maybe(rng.choice([0.0, -0.0, 1.5, float("inf")])),
            maybe(rng.choice(["a", "A", "x" * 100, "x" * 99 + "y", ""])), maybe(rng.random() < 0.5), maybe(start.date() + dt.timedelta(rng.randrange(3))),
            maybe(start + dt.timedelta(minutes=30 * rng.randrange(8))), maybe(start + dt.timedelta(minutes=30 * rng.randrange(8))),
            maybe(Decimal(rng.randrange(5))), None,
        )
        for _ in range(n)
    ]


@pytest.mark.parametrize("seed", [1, 2])
def test_answers_equal_plain_python(spark, seed):
    rows = rows_for(seed)
    df = spark.createDataFrame(rows, SCHEMA)
    stats = Statistics(df)
    stats.want_patterns()
    stats.want_values(df.columns)
    stats.want_marks({"size": F.length(col("s")).cast("string")})
    stats.want("top", F.max("l"))
    stats.want_quantiles(["l", "m"], (0.1, 0.5))
    stats.collect()
    assert stats.rows == len(rows) and stats["top"] == max(r[1] for r in rows)
    for k, name in enumerate(df.columns):
        held = [r[k] for r in rows if r[k] is not None]
        counts = [sum(v == w for v in held) for w in set(held)]
        assert stats.missing(name) == len(rows) - len(held)
        assert stats.counted[name] == (Counted(len(counts), len(held), max(counts), min(counts)) if held else Counted())
    assert stats.marked["size"].distinct == len({len(r[3]) for r in rows if r[3] is not None})
    cells = [sum(v is None for v in r) for r in rows]
    assert stats.histogram == {k: cells.count(k) for k in set(cells)}
    for (i, a), (j, b) in itertools.combinations(enumerate(df.columns), 2):
        if all(0 < stats.missing(c) < stats.rows for c in (a, b)):
            assert stats.together.get((a, b), 0) == sum(r[i] is None and r[j] is None for r in rows)
    found = stats.quantiles(["l", "m"], (0.1, 0.5))
    assert found["l"][0.5] == pytest.approx(sorted(r[1] for r in rows)[199] / 2 + sorted(r[1] for r in rows)[200] / 2)
    assert 0 <= found["m"][0.1] <= found["m"][0.5] <= 4


def test_nothing_wanted_and_nothing_there(spark):
    stats = Statistics(spark.createDataFrame([], SCHEMA))
    stats.want_patterns()
    stats.want_values(["s", "l"])
    stats.want_quantiles(["d"], (0.5,))
    stats.collect()
    assert stats.rows == 0 and stats.histogram == {} and stats.distinct("s") == 0 and stats.quantiles(["d"], (0.5,)) == {"d": {0.5: None}}
    assert Statistics(spark.range(3)).collect().counted == {}


@pytest.mark.parametrize("method", ["iqr", "zscore", "mad", "none such"])
def test_reports_of_odd_tables(spark, method):
    for rows in ([], rows_for(3, 1), rows_for(4, 40)):
        df = spark.createDataFrame(rows, SCHEMA)
        found = validate(df, "i", {"outlier_method": method})
        assert found.report.count() > 10
        assert profile(df, "i").report.count() > 10
    assert validate(df, "not there").report.filter("check = 'target_absent'").count() == 1


def test_same_names_are_an_error_and_nothing_else(spark):
    found = validate(spark.createDataFrame([(1, 2)], "a int, b int").toDF("a", "A"))
    assert found.status == "FAIL" and found.report.count() == 1


def test_gaps_of_many_columns_by_pattern(spark):
    names = [f"c{i}" for i in range(60)]
    df = spark.range(3000).select(*[F.when((F.col("id") + i // 2) % (3 + i // 2) == 0, None).otherwise(1).alias(c) for i, c in enumerate(names)])
    got = {(r["column_a"], r["column_b"]) for r in missing.co_missing_correlation(df).collect()}
    assert got == {(names[i], names[i + 1]) for i in range(0, 60, 2)}


def test_rounding_is_that_of_the_engine(spark):
    values = [0.5, 1.005, 2.675, -2.5, 1e-9, 123456.785, 0.1 + 0.2, 5e-324, 1e300, None]
    for digits in (0, 2, 6):
        got = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double").select(F.round("v", digits)).collect()
        assert [r[0] for r in got] == [half_up(v, digits) for v in values]
