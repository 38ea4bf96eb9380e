"""The cell tree loses no neighbour, whatever its depth."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablewright.operators import neighbours


def plain(train, test, k):
    out = {}
    for i, x in test:
        near = sorted((float(sum((a - b) ** 2 for a, b in zip(x, y))), j) for j, y in train)[:k]
        out[i] = [(j, d) for d, j in near]
    return out


def found(spark, train, test, k, **options):
    dim = len(train[0][1]) if train else 2
    names = [f"x{i}" for i in range(dim)]
    schema = "id long, " + ", ".join(f"{n} double" for n in names)
    left = spark.createDataFrame([(i, *map(float, x)) for i, x in train], schema).withColumn("y", F.col("id") % 3)
    right = spark.createDataFrame([(i, *map(float, x)) for i, x in test], schema)
    out = {}
    for r in neighbours.nearest(left, right, names, "id", "y", k, broadcast_cells=0, **options).collect():
        out.setdefault(r["id"], []).append((r["neighbour"], r["distance2"]))
    return {i: sorted(v, key=lambda p: (p[1], p[0])) for i, v in out.items()}


@pytest.mark.parametrize("shape", ["clusters", "line", "copies", "noise"])
def test_deep_trees_find_what_a_plain_search_finds(spark, monkeypatch, shape):
    monkeypatch.setattr(neighbours, "FANOUT", 4)
    rng = np.random.default_rng(len(shape))
    train = {
        "clusters": lambda: rng.integers(0, 9, (300, 2)) * 100 + rng.integers(0, 5, (300, 2)),
        "line": lambda: np.column_stack([np.arange(300), np.arange(300) * 2]),
        "copies": lambda: np.vstack([np.zeros((200, 2)), rng.integers(0, 3, (100, 2))]),
        "noise": lambda: rng.standard_normal((300, 2)).round(2),
    }[shape]().tolist()
    rows = list(enumerate(train))
    asked = [(1000 + i, x) for i, x in enumerate([*train[::17], [0, 0], [1e6, -1e6], [50.5, 0.25]])]
    assert found(spark, rows, asked, 5, chunk_rows=9) == plain(rows, asked, 5)


def test_the_tree_grows_with_the_rows_and_stops_at_its_bound(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "FANOUT", 4)
    depth = []
    for rows in (30, 600):
        base = spark.range(rows).select("id", F.array(F.col("id") * 1.0, F.sin("id") * 50).alias("x"))
        tree, placed = neighbours.grow_tree(base, 2, 10, 10_000)
        assert placed.groupBy(F.element_at("nodes", -1)).count().agg(F.max("count")).first()[0] <= 10
        depth.append(placed.agg(F.max(F.size("nodes"))).first()[0])
    assert depth[1] > depth[0]
    assert len(neighbours.grow_tree(base, 2, 10, 30)[0].pivots) <= 30


def test_fewer_rows_than_neighbours_and_none(spark):
    rows = [(1, [0, 0]), (2, [3, 4])]
    assert found(spark, rows, [(9, [0, 0])], 5) == {9: [(1, 0.0), (2, 25.0)]}
    assert found(spark, [], [(9, [0, 0])], 5) == {} and found(spark, rows, [], 5) == {}


def test_many_pairs_are_met_in_cells_on_all_cores(spark, monkeypatch):
    """A training side small enough to be broadcast, and rows that are too many to compare with all of it."""
    rng = np.random.default_rng(4)
    train = [(i, x) for i, x in enumerate(rng.integers(0, 60, (400, 2)).tolist())]
    asked = [(1_000 + i, x) for i, x in enumerate(rng.integers(0, 60, (90, 2)).tolist())]
    left = spark.createDataFrame([(i, *x, i % 3) for i, x in train], "id long, a long, b long, y long")
    right = spark.createDataFrame([(i, *x) for i, x in asked], "id long, a long, b long")
    monkeypatch.setattr(neighbours, "BROADCAST_PAIRS", 1_000)
    tasks, meet = [], neighbours._against_cells
    monkeypatch.setattr(neighbours, "_against_cells", lambda base, probe, *rest: tasks.append(base.rdd.getNumPartitions()) or meet(base, probe, *rest))
    monkeypatch.setattr("tablewright.session.TASK_ROWS", 50)
    out = {}
    for r in neighbours.nearest(left.coalesce(1), right.coalesce(1), ["a", "b"], "id", "y", 5, chunk_rows=40).collect():
        out.setdefault(r["id"], []).append((r["neighbour"], r["distance2"]))
    assert {i: sorted(v, key=lambda p: (p[1], p[0])) for i, v in out.items()} == plain(train, asked, 5)
    assert tasks == [8]


def test_a_known_bound_leaves_few_cells_and_loses_none():
    rng = np.random.default_rng(5)
    y, x = rng.standard_normal((4_000, 3)), rng.standard_normal((200, 3))
    tree = neighbours.CellTree(3)
    tree.grow(None, y[:200])
    paths, fars = tree.paths(y)
    leaf, far = np.array([p[-1] for p in paths]), np.array([f[-1] for f in fars])
    n = np.bincount(leaf, minlength=200)
    radius = np.array([far[leaf == c].max() for c in range(200)])
    kth = np.array([np.sort(far[leaf == c])[min(4, n[c] - 1)] for c in range(200)])
    distance = np.sqrt(neighbours._squares(x, y))
    bound = np.sort(distance, axis=1)[:, 4]
    loose, close = tree.reach(x, n, radius, kth, 5), tree.reach(x, n, radius, kth, 5, bound)
    assert len(close[0]) < len(loose[0])
    for pairs in (loose, close):
        met = set(zip(pairs[0].tolist(), pairs[1].tolist()))
        assert all((i, leaf[j]) in met for i in range(200) for j in np.flatnonzero(distance[i] <= bound[i]))


def test_tiles_bound_the_memory_of_a_block():
    import tracemalloc

    rng = np.random.default_rng(0)
    x, y = rng.standard_normal((4_000, 64)), rng.standard_normal((20_000, 64))
    tree = neighbours.CellTree(64)
    tree.grow(None, y[:1_000])
    tracemalloc.start()
    neighbours._best(np.arange(1_000), x[:1_000], np.arange(20_000), y, np.arange(20_000), 5)
    tree.paths(x)
    tree.reach(x, np.full(1_000, 20), np.full(1_000, 12.0), np.full(1_000, 9.0), 5)
    assert tracemalloc.get_traced_memory()[1] < 500_000_000
    tracemalloc.stop()


def test_cluster_sums_in_bounded_memory_and_exact():
    import tracemalloc

    import pandas as pd

    from tablewright.operators import evaluation

    rng = np.random.default_rng(2)
    x = rng.standard_normal((3_000, 64)) + 1e4  # far from the origin, some alike
    x[::7] = x[0]
    others = pd.DataFrame({"label": rng.choice(list("abc"), 20_000), "x": list(np.vstack([x, rng.standard_normal((17_000, 64)) + 1e4]))})
    tracemalloc.start()
    got = evaluation._cluster_sums(x, others, ["a", "b", "c", "d"])
    assert tracemalloc.get_traced_memory()[1] < 300_000_000
    tracemalloc.stop()
    matrix = np.array(others["x"].tolist())
    for i in (0, 1, 7, 2_999):
        far = np.sqrt(((matrix - x[i]) ** 2).sum(axis=1))
        assert got[i] == pytest.approx([far[(others["label"] == n).to_numpy()].sum() for n in "abcd"], rel=1e-12)
