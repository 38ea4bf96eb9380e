"""Vectors as numpy rows, and sorted runs of rows in a partition."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def usable(embedding: str = "embedding") -> F.Column:
    """True for vectors that are neither null, empty nor zero and hold finite numbers only."""
    c = F.col(embedding)
    odd = F.exists(c, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(c.isNotNull() & ~odd & F.exists(c, lambda x: x != 0), F.lit(False))


def matrix(column: pa.Array) -> np.ndarray:
    """Arrays of one length as rows of doubles."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def of_usual_length(vectors: DataFrame, embedding: str = "embedding") -> DataFrame:
    """Usable vectors of the most frequent length (of equal counts the smaller); others compare with nothing."""
    size = F.size(embedding)
    kept = vectors.where(usable(embedding))
    top = kept.groupBy(size.alias("n")).agg(F.count("*").alias("c")).orderBy(F.desc("c"), "n").first()
    return kept.where(size == (top["n"] if top else 0))


def runs(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The rows of each key, from batches in which equal keys stand together.

    Holds the rows of one key and one batch at a time.
    """
    held: list[pa.RecordBatch] = []
    before = None
    for batch in batches:
        if not len(batch):
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        new = np.zeros(len(batch), bool)
        for c in columns:
            new[1:] |= c[1:] != c[:-1]
        first = tuple(c[0] for c in columns)
        new[0] = before is None or first != before
        before = tuple(c[-1] for c in columns)
        cuts = np.flatnonzero(new).tolist()
        edges = [*cuts, len(batch)] if cuts and cuts[0] == 0 else [0, *cuts, len(batch)]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            if a == b:
                continue
            if new[a] and held:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)
