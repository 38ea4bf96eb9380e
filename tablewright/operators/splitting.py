"""Train/test split and folds from a hash of the row key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ranks import hash_cutoffs, hash_rank, row_hash
from ..functions.schema import col

TEST_SHARE = 0.2
SEED = 42
FOLDS = 5


def _threshold(share: float) -> str:
    return format(min(int(share * 2**32), 2**32 - 1), "08x")


def split_column(df: DataFrame, key: Sequence[str] | None, share: float, seed: int) -> Column:
    """``test`` for rows whose hash falls under the share, else ``train``."""
    head = F.substring(row_hash(df, key, seed), 1, 8)
    return F.when(head < F.lit(_threshold(share)), "test").otherwise("train")


def train_test_split(
    df: DataFrame, key: Sequence[str] | None = None, share: float = TEST_SHARE, seed: int = SEED
) -> DataFrame:
    """Add ``split``: a projection, stable under any partitioning; no shuffle."""
    return df.withColumn("split", split_column(df, key, share, seed))


def stratified_split(
    df: DataFrame,
    target: str,
    key: Sequence[str] | None = None,
    share: float = TEST_SHARE,
    seed: int = SEED,
) -> DataFrame:
    """Add ``split`` with exactly ``round(share * n)`` test rows in every class.

    The cut-off hash of each class comes from a histogram of hash prefixes and
    the rows of one prefix bucket, and reaches the rows by a join: any number of
    classes will do.  Equal keys share a hash and so a side.
    """
    cuts = hash_cutoffs(df, key, seed, col(target), share).select(
        F.col("g").alias("__class"), F.col("cut").alias("__cut")
    )
    hashed = row_hash(df, key, seed)
    marked = df.withColumns({"__h": hashed, "__of": col(target).cast("string")})
    joined = marked.join(cuts, F.col("__of").eqNullSafe(F.col("__class")), "left")
    test = F.coalesce(F.col("__h") <= F.col("__cut"), F.lit(False))
    return joined.withColumn("split", F.when(test, "test").otherwise("train")).drop(
        "__class", "__cut", "__h", "__of"
    )


def assign_folds(
    df: DataFrame,
    target: str | None,
    key: Sequence[str] | None = None,
    folds: int = FOLDS,
    seed: int = SEED,
) -> DataFrame:
    """Add ``fold`` in ``0..folds-1``; within a class the sizes differ by one at most.

    Without a key the row's own hash picks the fold: sizes are then only even on
    average, and copies of a row stay together.
    """
    if not key:
        number = F.conv(F.substring(row_hash(df, None, seed), 1, 12), 16, 10).cast("bigint")
        return df.withColumn("fold", F.pmod(number, F.lit(folds)).cast("int"))
    group = None if target is None else col(target)
    ranked = hash_rank(df, key, seed, group, "__position")
    return ranked.withColumn("fold", F.pmod(F.col("__position") - 1, F.lit(folds)).cast("int")).drop(
        "__position"
    )
