"""What the operators of this subpackage share: tables, written stages, batches, components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Edges that one task joins into components, at most (16 bytes each); more are joined in distributed rounds.
ONE_TASK = 250_000
#: Longs that are broadcast, at most, to find their rows; beyond, both sides are joined by a shuffle.
BROADCAST_KEYS = 2_000_000


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of the folder, read by Spark alone (the folder may be in any store)."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``; a folder of our own only where unset."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        context.setCheckpointDir(tempfile.mkdtemp(prefix="tablewright-"))
        folder = context.getCheckpointDir()
    return folder.rstrip("/")


def written(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    This cuts the lineage: lost executors cost only the tasks that they ran. The
    schema is given to the reader, so that empty tables come back whole.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/stage-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def kept_in(rows: DataFrame, keys: DataFrame, on: str, how: str = "left_semi") -> DataFrame:
    """The rows whose key is among the distinct ``keys``: these are broadcast if few, else both sides are shuffled."""
    return rows.join(F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys, on, how)


def text_slices(batch: pa.RecordBatch, limit: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """Cut a batch by the bytes of its ``text``, so that work on it takes bounded memory.

    A slice holds one row or up to ``limit`` bytes. No text is cut.
    """
    sizes = np.fromiter(
        (0 if x is None else x for x in pa.compute.binary_length(batch.column("text")).to_pylist()), np.int64, len(batch)
    )
    start, held = 0, 0
    for i, size in enumerate(sizes):
        if held and held + size > limit:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += int(size)
    if start < len(batch):
        yield batch.slice(start)


def _change(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)"))).first()
    return tuple(row)


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The least id reachable, for the ids of a bounded number of edges."""
    held = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
    if not held:
        return
    src, dst = (np.concatenate(x) for x in zip(*held, strict=True))
    ids, place = np.unique(np.concatenate([src, dst]), return_inverse=True)
    a, b = place[: len(src)], place[len(src) :]
    root, before = np.arange(len(ids)), None
    while before is None or (root != before).any():
        before = root.copy()
        low = np.minimum(root[a], root[b])
        for end in (a, b, before[a], before[b]):
            np.minimum.at(root, end, low)
        root = root[root]
    yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(ids[root])], names=["id", "component_id"])


def components(edges: DataFrame) -> DataFrame:
    """(id, component_id): the smallest id reachable, for every id that has an edge.

    ``edges`` has long columns src and dst. Large-star and small-star steps in turn
    bind every id to the least one of its neighbourhood until nothing changes; the
    number of rounds grows with the logarithm of a component's size. Each step is a
    pre-aggregated minimum by id and a join back, so that an id with very many
    edges is counted map-side; the rows of a round are written to the shared folder.
    At most ONE_TASK distinct edges are joined by one task at once instead.
    """
    e = written(
        edges.where("src <> dst")
        .select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst"))
        .distinct()
    )
    before = _change(e)
    if 0 < before[0] <= ONE_TASK:
        return written(e.coalesce(1).mapInArrow(_joined, "id long, component_id long"))
    while before[0]:
        both = e.unionAll(e.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        least = both.groupBy("src").agg(F.least(F.min("dst"), F.first("src")).alias("m"))
        large = (
            both.join(least, "src")
            .where("dst > src")
            .select(F.col("dst").alias("src"), F.col("m").alias("dst"))
            .where("src <> dst")
        )
        least = large.groupBy("src").agg(F.min("dst").alias("m"))
        down = large.join(least, "src")
        e = written(
            down.where("dst <> m")
            .select(F.col("dst").alias("src"), F.col("m").alias("dst"))
            .unionAll(least.select("src", F.col("m").alias("dst")))
            .distinct()
        )
        now = _change(e)
        if now == before:
            break
        before = now
    return e.select(F.col("src").alias("id"), F.col("dst").alias("component_id")).unionAll(
        e.select(F.col("dst").alias("id"), F.col("dst").alias("component_id")).distinct()
    )
