"""Records that span lines come whole, wherever splits are cut."""

import csv
import io
import json
import os
import random

import pytest
from pyspark.sql import functions as F

from tablewright.sources import splits
from tablewright.sources.readers import load_table, read_delimited, read_json


@pytest.fixture(params=[64, 1000, 1 << 20])
def small_splits(spark, request):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", request.param)
    spark.conf.set("spark.sql.files.openCostInBytes", 1)
    yield request.param
    spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
    spark.conf.set("spark.sql.files.openCostInBytes", before[1])


CELLS = ["plain", "with, comma", 'a "quoted" word', "line\nbreak", "two\n\nbreaks, and \"\n", "", " x ", '"', "é😀", "tab\there", "\n", "x" * 200, "back\\slash", "a\r\nb"]


def odd_rows(seed, n=120):
    rng = random.Random(seed)
    return [[str(i), rng.choice(CELLS), rng.choice(CELLS), str(rng.randrange(10**6))] for i in range(n)]


def as_text(rows, sep, end="\n"):
    out = io.StringIO()
    csv.writer(out, delimiter=sep, quoting=csv.QUOTE_MINIMAL, lineterminator=end).writerows(rows)
    return out.getvalue()


@pytest.mark.parametrize("sep,end", [(",", "\n"), ("\t", "\n"), (",", "\r\n")])
def test_quoted_line_breaks_at_any_split(spark, tmp_path, small_splits, sep, end):
    rows = odd_rows(small_splits)
    path = str(tmp_path / ("t.csv" if sep == "," else "t.tsv"))
    with open(path, "w", newline="", encoding="utf-8") as f:
        f.write(as_text([["id", "a", "b", "n"], *rows], sep, end))
    df = load_table(spark, path)
    assert df.columns == ["id", "a", "b", "n"] and dict(df.dtypes)["id"] == dict(df.dtypes)["n"] == "int"
    got = sorted((r["id"], r["a"], r["b"], r["n"]) for r in df.collect())
    assert got == [(int(i), a or None, b or None, int(n)) for i, a, b, n in rows]
    if small_splits == 1000:
        assert splits.pieces(spark, path, splits.Quoted(sep)).rdd.getNumPartitions() > 4


def test_quotes_inside_plain_cells_do_not_open(spark, tmp_path, small_splits):
    path = str(tmp_path / "t.csv")
    with open(path, "w") as f:
        f.write('id,size,note\n' + "".join(f'{i},{i}" pipe,"a\nb"\n' for i in range(60)))
    got = sorted(tuple(r) for r in load_table(spark, path).collect())
    assert got == [(i, f'{i}" pipe', "a\nb") for i in range(60)]


def test_folder_of_charsets_and_line_breaks(spark, tmp_path, small_splits):
    place = tmp_path / "all.csv"
    os.makedirs(place)
    (place / "a.csv").write_bytes('n,word\n1,"caf\né"\n2,x\n'.encode())
    (place / "b.csv").write_bytes("n,word\n3,\"caf\né\"\n".encode("latin-1"))
    (place / "c.csv").write_bytes(b"\xef\xbb\xbfn,word\n4,plain\n")
    (place / "d.csv").write_bytes(b"n,word\n5,caf\xe9\n")
    got = sorted(tuple(r) for r in load_table(spark, str(place)).collect())
    assert got == [(1, "caf\né"), (2, "x"), (3, "caf\né"), (4, "plain"), (5, "café")]


def test_given_schema_and_ragged_rows(spark, tmp_path):
    path = str(tmp_path / "t.csv")
    with open(path, "w") as f:
        f.write('a,b,c\n1,"x\ny"\n2,z,3,4\n\n')
    got = sorted(tuple(r) for r in read_delimited(spark, path, schema="a int, b string, c long").collect())
    assert got == [(1, "x\ny", None), (2, "z", 3)]


def records_of(seed, n=80):
    rng = random.Random(seed)
    texts = ["", "plain", 'q"uote', "brace } and { and ]", "back\\slash\\", "é😀", "\n", "[,]"]
    return [
        {"id": i, "s": rng.choice(texts), "deep": {"list": [{"x": rng.randrange(9)} for _ in range(rng.randrange(3))], "t": rng.choice(texts)}}
        for i in range(n)
    ]


@pytest.mark.parametrize("indent", [None, 1])
def test_arrays_on_one_line_or_many(spark, tmp_path, small_splits, indent):
    rows = records_of(small_splits)
    path = str(tmp_path / "t.json")
    with open(path, "w", encoding="utf-8") as f:
        json.dump(rows, f, indent=indent, ensure_ascii=False)
        f.write("\n")
    df = read_json(spark, path)
    got = sorted(df.collect(), key=lambda r: r["id"])
    assert [(r["id"], r["s"], r["deep"]["t"], [x["x"] for x in r["deep"]["list"]]) for r in got] == [
        (r["id"], r["s"], r["deep"]["t"], [x["x"] for x in r["deep"]["list"]]) for r in rows
    ]
    assert "_corrupt_record" not in df.columns
    if small_splits == 1000:
        assert splits.pieces(spark, path, splits.Arrays()).rdd.getNumPartitions() > 4


def test_folder_of_arrays_lines_and_empty_arrays(spark, tmp_path, small_splits):
    place = tmp_path / "all.json"
    os.makedirs(place)
    (place / "a.json").write_text('[{"n": 1, "s": "x"}, {"n": 2, "s": "}"}]')
    (place / "b.json").write_text('{"n": 3, "s": "["}\n{"n": 4, "s": "y"}\n')
    (place / "c.json").write_text("[]")
    (place / "d.json").write_text('[\n  {"n": 5,\n "s": "{"}\n]\n')
    got = sorted((r["n"], r["s"]) for r in load_table(spark, str(place)).collect())
    assert got == [(1, "x"), (2, "}"), (3, "["), (4, "y"), (5, "{")]


def test_states_are_composed_over_splits_inside_one_record(spark, tmp_path):
    """A cell longer than several splits: whole splits are the middle of one record."""
    spark.conf.set("spark.sql.files.maxPartitionBytes", 50)
    spark.conf.set("spark.sql.files.openCostInBytes", 1)
    try:
        long = "\n".join(f"line {i}, of a cell" for i in range(100))
        path = str(tmp_path / "t.csv")
        with open(path, "w") as f:
            f.write(as_text([["a", "b"], ["1", long], ["2", "x"], ["3", long]], ","))
        got = sorted(tuple(r) for r in load_table(spark, path).select(F.col("a"), F.col("b")).collect())
        assert got == [(1, long), (2, "x"), (3, long)]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
