"""Ranks and splits by a hash of the row key, without putting a group in one task.

``row_number() over (partition by class order by hash)`` sends a whole class to
one task.  Hash values are uniform, so a short hash prefix cuts every class into
even buckets: bucket sizes give each bucket's offset, and only rows of the same
class *and* bucket are ever sorted together.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .schema import col, flat_columns

ROWS_PER_BUCKET = 100_000


def row_hash(df: DataFrame, key: Sequence[str] | None, seed: int) -> Column:
    """md5 text of the key columns and the seed: the same on any partitioning."""
    names = list(key) if key else flat_columns(df)
    if len(names) == 1:
        text = F.coalesce(col(names[0]).cast("string"), F.lit("\u0000"))
    else:
        text = F.concat_ws(
            "\u0001", *[F.coalesce(col(c).cast("string"), F.lit("\u0000")) for c in names]
        )
    return F.md5(F.concat(text, F.lit(f":{seed}")))


def prefix_length(rows: int, per_bucket: int = ROWS_PER_BUCKET) -> int:
    """Hex digits that keep a bucket of ``rows`` uniform hashes near ``per_bucket``."""
    if rows <= per_bucket:
        return 1
    return max(1, math.ceil(math.log(rows / per_bucket, 16)))


def hash_rank(
    df: DataFrame,
    key: Sequence[str],
    seed: int,
    group: Column | None = None,
    name: str = "rank",
    rows: int | None = None,
) -> DataFrame:
    """Add the 1-based position of each row in hash order, within its group.

    ``key`` must tell rows apart: equal keys would share a bucket.
    """
    digits = prefix_length(df.count() if rows is None else rows)
    grouped = F.lit("") if group is None else F.coalesce(group.cast("string"), F.lit("\u0000"))
    marked = df.withColumns({"__g": grouped, "__h": row_hash(df, key, seed)}).withColumn(
        "__b", F.substring("__h", 1, digits)
    )
    # At most 16**digits rows per group reach this window.
    earlier = Window.partitionBy("__g").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        marked.groupBy("__g", "__b")
        .agg(F.count("*").alias("__n"))
        .select("__g", "__b", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before"))
    )
    in_bucket = Window.partitionBy("__g", "__b").orderBy("__h")
    return (
        marked.join(offsets, ["__g", "__b"])
        .withColumn(name, (F.col("__before") + F.row_number().over(in_bucket)).cast("long"))
        .drop("__g", "__h", "__b", "__before")
    )


#: So many groups, by a sketch, send one row each to every task.
FEW_GROUPS = 100_000


def hash_cutoffs(
    df: DataFrame,
    key: Sequence[str] | None,
    seed: int,
    group: Column,
    share: float,
    rows: int | None = None,
) -> DataFrame:
    """``(g, cut)``: per group the largest hash of its first ``round(share*n)`` rows.

    One row a group, for any number of groups; rows are split by comparing their
    hash with their group's.  Where nothing of the last bucket fits, its prefix is
    the cut.  A group without any such row has no entry.
    """
    counted = df.agg(F.count("*").alias("rows"), F.approx_count_distinct(group.cast("string"), 0.1).alias("groups")).first()
    digits = prefix_length(counted["rows"] if rows is None else rows)
    marked = df.select(group.cast("string").alias("g"), row_hash(df, key, seed).alias("h"))
    marked = marked.withColumn("b", F.substring("h", 1, digits))
    upto = Window.partitionBy("g").orderBy("b").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("g")
    histogram = (
        marked.groupBy("g", "b")
        .agg(F.count("*").alias("n"))
        .withColumns({"upto": F.sum("n").over(upto), "total": F.sum("n").over(whole)})
        .withColumn("want", F.round(F.col("total") * F.lit(share)).cast("long"))
    )
    edge = histogram.filter(
        (F.col("upto") - F.col("n") < F.col("want")) & (F.col("upto") >= F.col("want"))
    ).select(F.col("g").alias("eg"), F.col("b").alias("eb"), (F.col("want") - F.col("upto") + F.col("n")).alias("need"))
    if counted["groups"] <= FEW_GROUPS:  # one row a group
        edge = F.broadcast(edge)
    # Only the rows of the buckets with a cut are looked at.  Copies of a row share its
    # hash: count them first, so that a crowd of copies is one row here.  The cut never
    # splits them and never takes too many.
    upto_hash = Window.partitionBy("g").orderBy("h").rowsBetween(Window.unboundedPreceding, 0)
    found = (
        marked.join(edge, F.col("g").eqNullSafe(F.col("eg")) & (F.col("b") == F.col("eb")))
        .groupBy("g", "eb", "need", "h")
        .agg(F.count("*").alias("n"))
        .withColumn("pos", F.sum("n").over(upto_hash))
        .groupBy("g", "eb")
        .agg(F.max(F.when(F.col("pos") <= F.col("need"), F.col("h"))).alias("h"))
    )
    cuts = found.select("g", F.coalesce("h", "eb").alias("cut"))
    # a row a group: rows that look up their few groups are not shuffled by them
    return F.broadcast(cuts) if counted["groups"] <= FEW_GROUPS else cuts
