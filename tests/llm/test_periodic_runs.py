import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from tablewright.llm import periodic_runs, queries

MIDDLE = "/root/testdata/sf0.01"


def brute_runs(words, least=6, times=4):
    """Every lag by itself; a run counts under its smallest period only."""
    out, n = [], len(words)
    for q in range(1, n // times + 1):
        i = q
        while i < n:
            if words[i] != words[i - q]:
                i += 1
                continue
            start = i - q
            while i < n and words[i] == words[i - q]:
                i += 1
            length = i - start
            if length >= max(least, times * q):
                part = words[start:i]
                if not any(part[d:] == part[:-d] for d in range(1, q)):
                    out.append((start, length, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def brute_digest(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    h = zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    found = brute_runs(words)
    dropped = {i for s, m, q in found for i in range(s + q, s + m)}
    top = min(found, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (
        doc_id, len(found), *top, None if top[0] is None else 1000 * top[1] // top[2],
        sha("".join(f"{s},{m},{q}\n" for s, m, q in found)), sha(" ".join(w for i, w in enumerate(words) if i not in dropped)),
    )


def numbered(texts):
    return periodic_runs._numbered([[str(w).encode() for w in t] for t in texts])


@pytest.mark.parametrize("seed", range(12))
def test_runs_equal_brute_force(seed):
    rng = random.Random(seed)
    texts = []
    for _ in range(150):
        letters = "ab" if rng.random() < 0.5 else "abc"
        t = []
        while len(t) < rng.randrange(90):
            root = [rng.choice(letters) for _ in range(rng.randrange(1, 9))]
            t += (root * 9)[: rng.randrange(1, 5 * len(root) + 6)]
        texts.append(t)
    for least, times in ((6, 4), (1, 3), (10, 5)):
        got = periodic_runs.find_runs(*numbered(texts), least, times)
        for i, t in enumerate(texts):
            assert [tuple(r) for r in got[got[:, 0] == i][:, 1:].tolist()] == brute_runs(t, least, times)


def test_words_that_repeat_throughout_a_very_long_text():
    n = 400_000
    got = periodic_runs.find_runs(np.zeros(n, np.int64), np.array([0, n]))
    assert got.tolist() == [[0, 0, n, 1]]
    period = np.random.default_rng(1).integers(0, 9, 50_000)
    got = periodic_runs.find_runs(np.tile(period, 8), np.array([0, n]))
    assert [0, 0, n, 50_000] in got.tolist()


def test_runs_of_few_periods_are_refused():
    with pytest.raises(ValueError):
        periodic_runs.find_runs(np.zeros(3, np.int64), np.array([0, 3]), times=2)


def test_query_equals_brute_force(spark):
    got = {r["doc_id"]: tuple(r) for r in queries.op12_periodic_runs(spark, MIDDLE).collect()}
    docs = spark.read.parquet(f"{MIDDLE}/documents.parquet").where("length(text) < 6000").collect()
    assert len(got) >= len(docs) > 800
    for r in docs:
        assert got[r["doc_id"]] == brute_digest(r["doc_id"], r["text"]), r["doc_id"]


def test_odd_rows(spark):
    rows = [(1, None, "x"), (2, "", None), (3, " \n\t", "x"), (None, "a a a a a a a", "x"), (5, "é 😀 " * 5, "x"), (5, "é 😀 " * 5, "x"), (7, "a b a b a b a", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, runs string").selectExpr("*", "'own' AS collapsed", "'own' AS n_words", "'kept' AS other")
    got = sorted(((r["doc_id"] or 0, r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"], r["other"]) for r in periodic_runs.periodic_runs(df).collect()))
    assert got == [
        (0, 7, [(0, 7, 1)], "a", "kept"), (1, 0, [], "", "kept"), (2, 0, [], "", "kept"), (3, 0, [], "", "kept"),
        (5, 10, [(0, 10, 2)], "é 😀", "kept"), (5, 10, [(0, 10, 2)], "é 😀", "kept"), (7, 7, [], "a b a b a b a", "kept"),
    ]
    assert periodic_runs.periodic_runs(df.limit(0)).collect() == []
