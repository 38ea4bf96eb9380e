"""Near-duplicate vectors by random-hyperplane signs in several tables."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import components, written
from .vectors import matrix, of_usual_length, runs

THRESHOLD = 0.98
#: Share of linked pairs that may be missed: those that agree in no table.
MISSED = 1e-5
#: Rows of a bucket that a task compares at once; larger buckets are compared block by block.
BLOCK = 1_024
SEED = 20_240


def tables_for(rows: int, threshold: float = THRESHOLD, missed: float = MISSED) -> tuple[int, int]:
    """Bits of a table's key and number of tables.

    Bits grow with the rows, so that a bucket of unrelated vectors stays small; the
    number of tables follows from the chance that a pair at the threshold agrees in
    all bits of a table (one minus the angle over pi, for each bit).
    """
    bits = min(48, max(8, math.ceil(math.log2(max(rows, 1) / 32))))
    agree = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(missed) / math.log(1 - agree))


def _signatures(bits: int, tables: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes = None
        for batch in batches:
            if not len(batch):
                continue
            x = matrix(batch.column("embedding"))
            if planes is None:
                planes = np.random.default_rng(SEED).standard_normal((x.shape[1], tables * bits))
            signs = (x @ planes >= 0).reshape(len(x), tables, bits)
            codes = (signs * (1 << np.arange(bits, dtype=np.int64))).sum(axis=2)
            codes = pa.ListArray.from_arrays(np.arange(0, len(x) * tables + 1, tables, dtype=np.int32), pa.array(codes.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, codes], names=[*batch.schema.names, "codes"])

    return run


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least row reachable from each of ``n`` rows by the links a-b."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _compare(threshold: float):
    """Links inside each block of a bucket: how many each vector has, and edges that span its components.

    A pair counts in the first table in which its codes agree, so in one block of all tables.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in runs(batches, ["label", "t", "code", "lo", "hi"]):
            if len(group) < 2:
                continue
            group = group.combine_chunks()
            ids = group["vec"].to_numpy()
            part = group["part"].to_numpy()
            lo, hi, t = (group[k][0].as_py() for k in ("lo", "hi", "t"))
            copies = group["copies"].to_numpy()
            x = matrix(group["embedding"].chunk(0))
            x = x / np.linalg.norm(x, axis=1, keepdims=True)
            codes = group["codes"].chunk(0).flatten().to_numpy().reshape(len(x), -1)
            left = np.flatnonzero(part == lo)
            right = left if lo == hi else np.flatnonzero(part == hi)
            a, b = np.nonzero(x[left] @ x[right].T >= threshold)
            a, b = left[a], right[b]
            kept = a < b if lo == hi else np.ones(len(a), bool)
            if t:
                kept &= ~(codes[a, :t] == codes[b, :t]).any(axis=1)
            a, b = a[kept], b[kept]
            if not len(a):
                continue
            links = np.zeros(len(ids), np.int64)
            np.add.at(links, a, copies[b])
            np.add.at(links, b, copies[a])
            root = _roots(len(ids), a, b)
            some = np.flatnonzero(links)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[some]), pa.array(ids[root[some]]), pa.array(links[some])], names=["vec", "other", "links"])

    return run


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, missed: float = MISSED) -> DataFrame:
    """One row a vector: vec_id, n_links, component_id, kept.

    Vectors of equal, non-null labels link at a cosine (in doubles) of ``threshold``
    or more; every link is verified, and at most the share ``missed`` of pairs at the
    threshold is not found. Equal vectors of a label are one class first. Vectors
    that are null, zero, hold null or non-finite components, or differ in length from
    most, link with nothing and are kept, as are those without label or vec_id.
    Repeated rows are vectors of their own. An empty table gives none. Columns
    besides vec_id, embedding and label are not read.

    Buckets above BLOCK vectors are split by a hash into parts that are compared
    pair of parts by pair of parts, in tasks of their own; a task gives counts and
    spanning edges, not pairs.
    """
    rows = vectors.select("vec_id", "embedding", "label")
    fit = of_usual_length(rows.where("vec_id is not null and label is not null"))
    classes = fit.groupBy("label", "embedding").agg(F.min("vec_id").alias("vec"), F.count("*").alias("copies"))
    classes = written(classes)
    # a vec_id may stand for classes of two labels: a class is named by a number of its own
    most = classes.groupBy("label").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    bits, tables = tables_for(most, threshold, missed)
    signed = classes.mapInArrow(_signatures(bits, tables), T.StructType([*classes.schema.fields, T.StructField("codes", T.ArrayType(T.LongType()))]))
    placed = signed.select("*", F.posexplode("codes").alias("t", "code"))
    sizes = placed.groupBy("label", "t", "code").agg(F.count("*").alias("n")).where(F.col("n") > BLOCK)
    parts = sizes.select("label", "t", "code", F.ceil(F.col("n") / BLOCK).cast("int").alias("parts"))
    cut = placed.join(parts, ["label", "t", "code"], "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    cut = cut.withColumn("part", F.pmod(F.xxhash64("vec", "embedding"), F.col("parts")).cast("int"))
    blocks = cut.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select(
        "label", "t", "code", F.least("part", "with").alias("lo"), F.greatest("part", "with").alias("hi"),
        "vec", "part", "copies", "embedding", "codes")
    key = ["label", "t", "code", "lo", "hi"]
    found = written(
        blocks.repartition(*key).sortWithinPartitions(*key).mapInArrow(_compare(threshold), "vec long, other long, links long")
    )
    direct = found.groupBy("vec").agg(F.sum("links").alias("links"))
    reach = components(found.select(F.col("vec").alias("src"), F.col("other").alias("dst")))
    known = (
        classes.join(direct, "vec", "left")
        .join(reach.withColumnRenamed("id", "vec"), "vec", "left")
        .select("label", "embedding", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
                F.coalesce("component_id", "vec").alias("component_id"))
    )
    out = rows.join(known, ["label", "embedding"], "left").select(
        "vec_id",
        F.when(F.col("vec_id").isNull(), 0).otherwise(F.coalesce("n_links", F.lit(0))).cast("long").alias("n_links"),
        F.when(F.col("vec_id").isNotNull(), F.coalesce("component_id", "vec_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
