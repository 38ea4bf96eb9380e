import hashlib
import random
import re
import sys

import pytest
from pyspark.sql import functions as F

from tablewright.llm import fingerprints, queries

sys.path.insert(0, "tools")
from compare import connect, rows_of  # noqa: E402

MIDDLE = "/root/testdata/sf0.01"


def brute_sketch(text, words=5, scale=8):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())
    digest = lambda x: hashlib.md5(" ".join(x).encode()).hexdigest()[:16]
    runs = {digest(w[i : i + words]) for i in range(max(len(w) - words + 1, 1))} if w else set()
    return digest(w), sorted(h for h in runs if int(h, 16) < 2**64 // scale)


def brute_near(a, b):
    x, y = set(a[1]), set(b[1])
    return len(x & y) / len(x | y) if x | y else float(a[0] == b[0])


def made(spark, rows, schema="doc_id long, text string"):
    return {(r["doc_id"], r["n_chars"]): r for r in fingerprints.edited_fingerprints(spark.createDataFrame(rows, schema)).collect()}


def test_twin(spark):
    df = queries.op11_fingerprints(spark, MIDDLE)
    cur = connect(MIDDLE).execute(fingerprints.ORACLE_SQL)
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(names, cur.fetchall())


def test_near_texts_score_above_others(spark):
    got = queries.op11_fingerprints(spark, MIDDLE).where("n_chars > 300").select("near_edited", "near_next").collect()
    assert sum(r[0] > r[1] for r in got) >= 0.97 * len(got)
    assert 0.4 < sum(r[0] for r in got) / len(got) < 0.6


@pytest.mark.parametrize("scale", [2, 8, 64])
def test_sketch_equals_brute_force(spark, scale):
    rng = random.Random(scale)
    texts = [None, "", " \n", "one", "One two\tthree", "a b c d e", "日本語 テキスト 😀 x y z"]
    texts += [" ".join(rng.choice("abcdefgh") for _ in range(rng.randrange(80))) for _ in range(40)]
    texts.append(" ".join(f"w{i % 9973}" for i in range(30_000)))
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    for r in df.select("i", fingerprints.spelled(fingerprints.sketch(F.col("t"), scale=scale)).alias("s")).collect():
        name, kept = brute_sketch(texts[r["i"]], scale=scale)
        assert r["s"] == f"{name}:{','.join(kept)}"


def test_scale_must_be_a_power_of_two():
    for bad in (0, 1, 3, 2**33):
        with pytest.raises(ValueError):
            fingerprints.sketch(None, scale=bad)


def test_short_text_is_found_inside_a_long_one(spark):
    words = [f"w{i}" for i in range(40_000)]
    df = spark.createDataFrame([(" ".join(words), " ".join(words[7_000:8_000]), " ".join(f"v{i}" for i in range(1_000)))], "a string, b string, c string")
    a, b, c = (fingerprints.sketch(F.col(x)) for x in "abc")
    part, back, other = df.select(fingerprints.containment(b, a), fingerprints.containment(a, b), fingerprints.containment(c, a)).first()
    assert part == 1 and abs(back - 1_000 / 40_000) < 0.01 and other == 0


def test_merged_sketches_are_the_sketch_of_all_texts(spark):
    rows = [(1, f"a{i} b c d e{i % 3} f g") for i in range(200)] + [(2, None), (2, "x y")]
    df = spark.createDataFrame(rows, "k int, t string")
    got = {}
    for k, h in fingerprints.merged(df, "k", fingerprints.sketch(F.col("t"))["kept"]).collect():
        got.setdefault(k, set()).add(f"{h:016x}")
    for k in (1, 2):
        assert got.get(k, set()) == set().union(*(brute_sketch(t)[1] for i, t in rows if i == k))


def test_neighbours_and_edits_equal_brute_force(spark):
    rng = random.Random(5)
    texts = {i: "".join(rng.choice("ab \n😀é") for _ in range(rng.randrange(60))) for i in rng.sample(range(-500, 500), 90)}
    got = made(spark, list(texts.items()))
    ids = sorted(texts, reverse=True)
    for at, i in enumerate(ids):
        t, after = texts[i], texts[ids[(at + 1) % len(ids)]]
        r = got[i, len(t)]
        assert r["edited"] == t[: len(t) - len(t) // 3] + after[: len(t) // 3]
        assert (r["sketch"]["name"], [f"{h:016x}" for h in r["sketch"]["kept"]]) == brute_sketch(t)
        assert r["next_sketch"]["name"] == brute_sketch(after)[0]
        assert r["edited_sketch"]["name"] == brute_sketch(r["edited"])[0]


def test_odd_rows(spark):
    assert made(spark, []) == {}
    assert made(spark, [(4, "abcdef")])[4, 6]["edited"] == "abcdab"
    got = made(spark, [(None, "abcdef"), (3, None), (2, ""), (1, "xyz")])
    assert got[None, 6]["edited"] == "abcd" and got[3, 0]["edited"] == "" and got[2, 0]["edited"] == "" and got[1, 3]["edited"] == "xy"


def test_rows_that_share_an_id_have_one_next_document(spark):
    rows = [(2, "same text"), (2, "same text"), (2, "other"), (1, "abcdefghi"), (3, "123456789")]
    df = fingerprints.edited_fingerprints(spark.createDataFrame(rows, "doc_id long, text string"))
    got = sorted((r["doc_id"], r["edited"]) for r in df.collect())
    chosen = {e[6:] for i, e in got if i == 3}
    assert chosen <= {"sam", "oth"} and len(chosen) == 1 and len(got) == 5
    assert [e for i, e in got if i == 2] == ["othea", "same tabc", "same tabc"]


def test_names_of_other_columns_do_not_matter(spark):
    df = spark.createDataFrame([(1, "a b", "x", "y")], "doc_id long, text string, sketch string, next_id string")
    assert fingerprints.edited_fingerprints(df).count() == 1
