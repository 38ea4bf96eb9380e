import random
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablewright.llm import hard_negatives, queries

sys.path.insert(0, "tools")
from compare import connect, rows_of  # noqa: E402

MIDDLE = "/root/testdata/sf0.01"
SCHEMA = "vec_id long, embedding array<long>, label int"


def brute(rows, every, positives=5, negatives=3, low=50, high=95):
    best = {}
    for i, v, label in rows:
        if i is None or v is None or label is None or None in v or sum(x * x for x in v) >= 2**53:
            continue
        best[i] = min(best.get(i, (label, v)), (label, v))
    out = []
    for a, (la, va) in best.items():
        if a % every:
            continue
        scored = sorted((-sum(x * y for x, y in zip(va, v)), i, lb) for i, (lb, v) in best.items() if i != a and len(v) == len(va))
        for ps, p, _ in [s for s in scored if s[2] == la][:positives]:
            fits = [s for s in scored if s[2] != la and low * -ps <= 100 * -s[0] <= high * -ps]
            out += [(a, p, k + 1, n, -ps, -ns) for k, (ns, n, _) in enumerate(fits[:negatives])]
    return sorted(out)


def mined(spark, rows, every, **more):
    df = spark.createDataFrame(rows, SCHEMA).withColumn("rank", F.lit("own")).withColumn("score", F.lit("own"))
    return sorted(tuple(r) for r in hard_negatives.mine(df, F.col("vec_id") % every == 0, **more).collect())


def test_twin(spark):
    df = queries.op13_hard_negatives(spark, MIDDLE)
    cur = connect(MIDDLE).execute(hard_negatives.ORACLE_SQL)
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(names, cur.fetchall())


@pytest.mark.parametrize("seed", range(3))
def test_equals_brute_force_over_many_blocks(spark, seed, monkeypatch):
    monkeypatch.setattr(hard_negatives, "ROWS", 40)
    monkeypatch.setattr(hard_negatives, "ANCHORS", 7)
    rng = random.Random(seed)
    base = [[rng.randrange(-9, 10) for _ in range(20)] for _ in range(12)]
    rows = [(i, [x + rng.choice((0, 0, 1)) for x in rng.choice(base)], rng.randrange(3)) for i in range(400)]
    rows += [(i, [0] * 20, 1) for i in range(400, 420)] + [(i, base[0], 2) for i in range(420, 600)]
    assert mined(spark, rows, 9) == brute(rows, 9)
    assert mined(spark, rows, 9, positives=2, negatives=8, low=-40, high=100) == brute(rows, 9, 2, 8, -40, 100)


def test_odd_rows(spark):
    rows = [
        (0, [3, 4], 1), (0, [9, 9], 2), (None, [3, 4], 1), (1, None, 1), (2, [3, None], 1), (3, [3, 4], None), (4, [3, 4], 1), (4, [3, 4], 1),
        (5, [2, 2], 2), (6, [1, 3], 2), (7, [3, 4, 5], 2), (8, [], 1), (9, [], 2), (10, [], 1), (11, [2**40, 1], 2), (12, [3, 4], 1), (13, [2, 2], 2),
    ]
    assert mined(spark, rows, 10) == brute(rows, 10) != []
    assert mined(spark, [], 10) == [] and mined(spark, rows, 1_000_003)[:0] == []
    assert mined(spark, [(1, [1, 2], 1), (2, [1, 2], 2)], 50) == []


def test_postings_lose_no_pair_and_read_less_for_high_thresholds():
    rng = np.random.default_rng(3)
    x = np.floor(rng.standard_normal((500, 64)) * 40 * np.linspace(3, 0.1, 64))
    q = np.floor(rng.standard_normal((30, 64)) * 40 * np.linspace(3, 0.1, 64))
    index, live = hard_negatives.Postings(x, q), np.arange(30)
    full = x @ q.T
    read = []
    for share in (0.8, 0.4, 0.1, 0.0, -1.0):
        t = share * full.max(axis=0)[live]
        row, place, score = index.reaching(live, t)
        assert sorted(zip(row, place)) == sorted(zip(*np.nonzero(full[:, live] >= t))) and (score == full[row, live[place]]).all()
        read.append(index.depth.mean())
        live = live[:-3]
    assert read[0] < 8 and read == sorted(read)
