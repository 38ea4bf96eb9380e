"""Integrity: a manifest of files and an order-free digest of a table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.report import local_rows
from ..functions.schema import col, flat_columns, is_nested
from .digests import PACKED, SLICE_BYTES, can_split, plain_path, split_digests

SEPARATOR = "\u0001"
NULL_MARK = "\u0000"


def file_manifest(spark: SparkSession, path: str, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """``(path, length, modified, sha256)`` per file.

    A digest needs the bytes in order: a file of up to ``slice_bytes`` is read by one task,
    a longer one slice by slice, by tasks that hand on the state of the digest.  A packed file
    (``.gz`` and the like), and any file where ``hashlib`` is not built on a shared library,
    is read whole by one task, up to 2 GB.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    facts = ["path", "length", F.col("modificationTime").alias("modified")]
    read = [*facts, F.sha2("content", 256).alias("sha256")]
    if not can_split():
        return files.select(*read)
    name = F.xxhash64("_metadata.file_path").alias("name")
    long = files.where(F.col("length") > slice_bytes).select("path", name, "length").collect()
    done = files.where(F.col("length") <= slice_bytes).select(*read)
    packed = [r["path"] for r in long if PACKED.search(r["path"])]
    split = [tuple(r) for r in long if not PACKED.search(r["path"])]
    if packed:
        whole = spark.read.format("binaryFile").option("recursiveFileLookup", True).load([plain_path(p) for p in packed])
        done = done.unionAll(whole.select(*read))
    if split:
        digests = local_rows(files, split_digests(spark, split, slice_bytes), "path string, sha256 string")
        known = files.where(F.col("length") > slice_bytes).select(*facts)
        done = done.unionAll(known.join(F.broadcast(digests), "path"))
    return done


def table_fingerprint(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``(rows, checksum, parity)``: equal for equal rows in any order.

    Every row becomes a 48-bit number from its md5; their sum and their exclusive
    or are mergeable, so this is one partial aggregate with no shuffle of rows.
    """
    names = list(columns) if columns is not None else df.columns
    flat = set(flat_columns(df))
    types = {f.name: f.dataType for f in df.schema.fields}
    cells = [
        F.coalesce(
            col(c).cast("string") if c in flat else F.to_json(F.struct(col(c))), F.lit(NULL_MARK)
        )
        for c in names
        if c in flat or is_nested(types[c])
    ]
    digest = F.substring(F.md5(F.concat_ws(SEPARATOR, *cells)), 1, 12)
    number = F.conv(digest, 16, 10).cast("bigint")
    return df.select(number.alias("h")).agg(
        F.count("*").alias("rows"),
        F.coalesce(F.sum(F.col("h").cast("decimal(38,0)")), F.lit(0)).cast("string").alias("checksum"),
        F.coalesce(F.bit_xor("h"), F.lit(0)).cast("string").alias("parity"),
    )
