import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablewright.llm import jaccard_join, links, paragraph_dedup

from . import brute


def plain(sets, component, percent):
    """The components after joining all linked pairs, whatever their number."""
    root = {c: c for c in component}

    def top(c):
        while root[c] != c:
            c = root[c]
        return c

    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            if i < j and 100 * len(a & b) >= percent * len(a | b):
                x, y = top(component[i]), top(component[j])
                root[max(x, y)] = min(x, y)
    return [top(c) for c in component]


@pytest.mark.parametrize("rows,columns", [(1, 1), (3, 4), (1_024, 1_024)])
def test_groups_are_joined_as_by_all_pairs(monkeypatch, rows, columns):
    monkeypatch.setattr(links, "ROWS", rows)
    monkeypatch.setattr(links, "COLUMNS", columns)
    rng = random.Random(rows)
    for _ in range(200):
        m = rng.randrange(1, 12)
        sets = [{rng.randrange(12) for _ in range(rng.randrange(9))} for _ in range(m)]
        component = [rng.randrange(m) for _ in range(m)]
        arrays = [np.array(sorted(s), np.int64) for s in sets]
        for percent in (60, 100):
            pairs = links._linked(arrays, np.array(component), percent)
            assert all(100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]) for i, j in pairs)
            assert len(pairs) < m
            joined = plain([sets[i] if any(i in p for p in pairs) else {-i - 1} for i in range(m)], component, percent)
            assert joined == plain(sets, component, percent)
            # samples of the tokens leave every pair that links
            low = [np.array([x for x in sorted(s) if x < 5], np.int64) for s in sets]
            part = links._may_link(low, np.array([len(s) for s in sets]), np.array(component), (100 - percent) / 100).tolist()
            assert all(part[i] == part[j] >= 0 for i, j in pairs)


@pytest.mark.parametrize("small", [4_096, 16])
def test_a_hot_passage_in_many_documents(spark, monkeypatch, small):
    """400 near copies of one passage, of which few pairs link: one group, no pair of all leaves a task."""
    monkeypatch.setattr(links, "SMALL", small)
    rng = random.Random(small)
    base = [f"w{i}" for i in range(100)]
    rows = []
    for i in range(400):
        words = list(base)
        for _ in range(rng.randrange(4)):
            words[rng.randrange(100)] = f"x{rng.randrange(40)}"
        rows.append((i, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_components(df).collect()}
    assert got == brute.jaccard_components(rows, 3, 90)
    found = paragraph_dedup.repeated_passages(df).where(F.col("kind") == "paragraph").select("doc_id").distinct().count()
    assert found == sum(1 for i, _ in rows if any(i != j and 100 * len(a & b) >= 80 * len(a | b) for j, b, a in _others(rows, i)))


def _others(rows, i, cache={}):  # noqa: B006
    sets = cache.setdefault(id(rows), {j: brute.shingle_set(t, 5) for j, t in rows})
    return [(j, sets[j], sets[i]) for j, _ in rows]
