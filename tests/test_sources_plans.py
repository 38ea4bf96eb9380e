"""File formats, fingerprints, whole runs, narratives, charts and arrivals."""

import gzip
import hashlib
import json
import os
import random
import tempfile

import pandas as pd
import pyarrow as pa
import pyarrow.feather as feather
import pytest
from pyspark.sql import functions as F

from tablewright.catalog.base import table
from tablewright.operators import charts, insights
from tablewright.plans.analysis import analyse, process
from tablewright.plans.sinks import append_audit, audit_frame, summary_json, write_report
from tablewright.plans.validation import DataValidationError
from tablewright.session import checkpointed
from tablewright.sources import digests
from tablewright.sources.columns import check_target
from tablewright.sources.fingerprint import file_manifest, table_fingerprint
from tablewright.sources.readers import EmptyTableError, charset_by_file, load_table
from tablewright.streaming.arrivals import validate_arrivals


@pytest.fixture
def place():
    return tempfile.mkdtemp(prefix="run-", dir="/tmp")


def put(place, name, content):
    path = os.path.join(place, name)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as f:
        f.write(content if isinstance(content, bytes) else content.encode())
    return path


@pytest.mark.parametrize(
    "name,content",
    [
        ("a.csv", "n, word \n1,café\n2,x\n"),
        ("b.csv", b"\xef\xbb\xbfn,word\n1,caf\xc3\xa9\n2,x\n"),
        ("c.csv", b"n,word\n1,caf\xe9\n2,x\n"),
        ("d.TSV", "n\tword\n1\tcafé\n2\tx\n"),
        ("e.json", '{"n": 1, "word": "café"}\n{"n": 2, "word": "x"}\n'),
        ("f.json", '[{"n": 1, "word": "café"},\n {"n": 2, "word": "x"}]'),
        ("g.xml", "<data><row><n>1</n><word>café</word></row><row><n>2</n><word>x</word></row></data>"),
    ],
)
def test_text_formats(spark, place, name, content):
    df = load_table(spark, put(place, name, content))
    assert df.columns == ["n", "word"]
    assert {(r["n"], r["word"]) for r in df.collect()} == {(1, "café"), (2, "x")}


def test_folder_of_mixed_charsets(spark, place):
    put(place, "all.csv/one.csv", "n,word\n1,café\n")
    put(place, "all.csv/two.csv", b"n,word\n2,caf\xe9\n")
    path = os.path.join(place, "all.csv")
    assert {r["charset"] for r in charset_by_file(spark, path).collect()} == {"UTF-8", "ISO-8859-1"}
    assert {(r["n"], r["word"]) for r in load_table(spark, path).collect()} == {(1, "café"), (2, "café")}


def test_feather_files(spark, place):
    os.makedirs(os.path.join(place, "t.feather"))
    for i in range(3):
        feather.write_feather(pa.table({"n": [i, i + 10], "x": [0.5, float("nan")]}), os.path.join(place, "t.feather", f"{i}.feather"))
    df = load_table(spark, os.path.join(place, "t.feather"))
    assert df.count() == 6 and df.filter("x IS NULL").count() == 3


def test_bad_sources(spark, place):
    with pytest.raises(FileNotFoundError):
        load_table(spark, os.path.join(place, "none.csv"))
    with pytest.raises(FileNotFoundError):
        load_table(spark, os.path.join(place, "none.parquet"))
    with pytest.raises(ValueError):
        load_table(spark, put(place, "x.docx", "x"))
    with pytest.raises(EmptyTableError):
        load_table(spark, put(place, "e.csv", ""))
    with pytest.raises(EmptyTableError):
        load_table(spark, put(place, "h.csv", "a,b\n"))


def test_repeated_headers_are_told_apart(spark, place):
    df = load_table(spark, put(place, "a.csv", "a,a,b\n1,2,3\n"))
    assert len(set(c.lower() for c in df.columns)) == 3


def test_manifest_digests(spark, place):
    path = put(place, "a.csv", "a\n1\n")
    row = file_manifest(spark, path).first()
    assert row["sha256"] == hashlib.sha256(b"a\n1\n").hexdigest() and row["length"] == 4


def test_manifest_digests_long_files_slice_by_slice(spark, place):
    """Bytes of any kind: no task is given a whole file, and the digests are those of the files."""
    rng = random.Random(7)
    noise = rng.randbytes(90_000)
    contents = {
        "noise.parquet": noise,
        "ends [1].bin": noise[:50_000] + b"\n",
        "marked.txt": b"\xef\xbb\xbf" + b"a\r\n" * 9_000,
        "marked open.txt": b"\xef\xbb\xbf" + b"b\n\n" * 9_000 + b"c",
        "no lines.bin": bytes(40_000),
        "only lines.bin": b"\n" * 30_000,
        "packed.gz": gzip.compress(noise),
        "k=1/short.bin": b"x",
    }
    os.mkdir(os.path.join(place, "k=1"))
    for name, content in contents.items():
        with open(os.path.join(place, name), "wb") as f:
            f.write(content)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        found = {r["path"]: (r["length"], r["sha256"]) for r in file_manifest(spark, place, slice_bytes=10_000).collect()}
        pieces = digests._pieces_of(spark, [os.path.join(place, "noise.parquet")])
        most = pieces.groupBy("block").agg(F.sum(F.length("data")).alias("n")).agg(F.max("n")).first()[0]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert found == {f"file:{place}/{n}": (len(c), hashlib.sha256(c).hexdigest()) for n, c in contents.items()}
    assert most < 10_000


def test_fingerprint_ignores_order_not_content(spark):
    rows = [(1, "a", [1]), (2, None, None), (3, "", [])]
    schema = "n int, s string, l array<int>"
    one = table_fingerprint(spark.createDataFrame(rows, schema)).first()
    assert one == table_fingerprint(spark.createDataFrame(rows[::-1], schema).repartition(3)).first()
    for other in (rows[:2], rows + rows[:1], [(1, "a", [1]), (2, "", None), (3, "", [])]):
        assert one != table_fingerprint(spark.createDataFrame(other, schema)).first()


def test_target_check(spark, folder):
    found = {r["column"]: (r["is_match"], r["is_suggestion"]) for r in check_target(table(spark, folder, "orders"), "ORDER").collect()}
    assert found["o_orderkey"] == (False, True) and found["o_custkey"] == (False, False)
    exact = check_target(table(spark, folder, "orders"), " o_custkey ")
    assert exact.filter("is_match").first()["column"] == "o_custkey"


def test_whole_run_from_a_file(spark, place):
    frame = pd.DataFrame({"id": range(240)})
    frame["size"] = frame["id"] * 0.5 % 17
    frame["kind"] = ["red " if i % 3 else " Blue" for i in frame["id"]]
    frame["price"] = frame["size"] * 3 + (frame["id"] % 3 == 0) * 10
    path = os.path.join(place, "t.csv")
    frame.to_csv(path, index=False)
    done = analyse(spark, path, "price", ["id"], ["linear", "decision_tree"])
    assert done.trained.task == "regression"
    assert done.trained.leaderboard.agg(F.max("r2")).first()[0] > 0.9
    assert done.processed.validation.status == "PASS"
    steps = [r["name"] for r in done.processed.audit.orderBy("step").collect()]
    assert steps == ["source_file", "load", "validate", "clean", "profile", "prepare", "finish"]
    assert done.payload.filter("section = 'model_metrics'").count() >= 6
    assert done.payload.filter("section = 'predictions'").count() == 20
    assert {r["section"] for r in done.bullets.collect()} >= {"descriptive_analytics", "predictive_analytics"}
    assert done.charts.filter("family = 'model'").count() == 2
    out = append_audit(done.processed.audit, os.path.join(place, "audit"))
    append_audit(done.processed.audit, out)
    assert spark.read.parquet(out).count() == 14
    told = json.loads(summary_json({"board": done.trained.leaderboard, "charts": done.charts}).first()["summary"])
    assert {r["model"] for r in told["board"]} == {"linear", "decision_tree"}
    assert spark.read.json(write_report(done.charts, os.path.join(place, "r"), "json")).count() == done.charts.count()


def test_run_without_target_clusters(spark):
    df = spark.range(120).select((F.col("id") % 3 * 10 + F.rand(1)).alias("x"), F.rand(2).alias("y"))
    done = analyse(spark, df, None)
    assert done.trained.task == "unsupervised" and done.predictions is None
    assert done.trained.best_name == "kmeans"


def test_failed_validation_stops_with_an_audit(spark):
    df = spark.range(200).select("id", F.lit(None).cast("double").alias("void"))
    with pytest.raises(DataValidationError) as failure:
        process(spark, df)
    assert failure.value.audit.filter("status = 'FAILED'").count() == 1
    assert process(spark, df.withColumn("k", F.col("id") % 7), fail_on_validation_error=False).prepared.feature_names


def test_narratives(spark):
    texts = {
        1: '{"descriptive_analytics": [" a ", "", "b"], "risk_assessment": "one"}',
        2: '{"predictive_analytics": ["1","2","3","4","5","6","7"], "extra": ["x"]}',
        3: "not json",
        4: '{"prescriptive_analytics": [1, 2.5, true, {"k": "v"}, null], "diagnostic_analytics": {}}',
        5: "[1, 2]",
        6: None,
    }
    df = spark.createDataFrame(list(texts.items()), "id int, raw string")
    found = {}
    for r in insights.validate_narratives(df, "id", "raw").orderBy("id", "section", "bullet_no").collect():
        found.setdefault((r["id"], r["section"]), []).append(r["bullet"])
    assert found == {
        (1, "descriptive_analytics"): ["a", "b"],
        (1, "risk_assessment"): ["one"],
        (2, "predictive_analytics"): ["1", "2", "3", "4", "5"],
        (4, "diagnostic_analytics"): ["{}"],
        (4, "prescriptive_analytics"): ["1", "2.5", "True", '{"k":"v"}', "None"],
    }


def test_chart_rules(spark, folder):
    orders = table(spark, folder, "orders")

    def families(*args):
        return {r["family"] for r in charts.recommend(*args).collect()}

    assert families(orders, "o_totalprice", None) == {"kpi", "comparison", "composition", "trend", "relationship", "distribution"}
    assert families(orders, "o_orderstatus", "classification") == {"relationship", "distribution", "model"}
    assert families(table(spark, folder, "pages"), None, "unsupervised") == {"distribution", "clustering"}


def test_chart_edges(spark):
    one = spark.createDataFrame([(4.0,)] * 3, "x double")
    bars = charts.histogram(one, "x", 4).orderBy("bin").collect()
    assert [r["n"] for r in bars] == [3, 0, 0, 0]
    assert charts.histogram(one.limit(0), "x").count() == 0
    with pytest.raises(ValueError):
        charts.trend_series(one, "x", "x", "second")


def test_arrivals_are_checked_batch_by_batch(spark, folder, place):
    drop = os.path.join(place, "drop")
    orders = table(spark, folder, "orders")
    orders.write.parquet(drop)
    out = os.path.join(place, "found")
    marks = os.path.join(place, "marks")
    for _ in range(2):
        query = validate_arrivals(spark, drop, orders.schema, out, marks, "o_orderstatus")
        query.awaitTermination()
        orders.limit(50).write.mode("append").parquet(drop)
    found = spark.read.parquet(out)
    assert {r["batch"] for r in found.select("batch").distinct().collect()} == {0, 1}
    assert found.filter("batch = 1 AND check = 'very_small'").count() == 1


def test_checkpoint_cuts_lineage(spark):
    df = checkpointed(spark.range(10).withColumn("x", F.col("id") * 2))
    assert df.agg(F.sum("x")).first()[0] == 90
    assert "Project" not in df._jdf.queryExecution().logical().toString()
