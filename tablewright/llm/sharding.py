"""Sharding by a minimax contiguous partition of atomic groups."""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

SHARDS = 24
#: Cells that come to the driver in one round, at most.
CELLS = 32_768
SLOT_BUCKETS = 256
_LOW, _SPAN = -(2**63), 2**64


def _greedy(prefix: list[int], capacity: int, shards: int) -> list[int] | None:
    """Cuts between cells when shards fill in turn, or None if ``shards`` do not hold all."""
    cuts, at, last = [], 0, len(prefix) - 1
    while True:
        end = bisect_right(prefix, prefix[at] + capacity) - 1
        if end >= last:
            return cuts
        if end == at or len(cuts) + 1 >= shards:
            return None
        cuts.append(end)
        at = end


def _least_capacity(prefix: list[int], low: int, shards: int) -> int:
    """Binary search of the least capacity, from ``low``, that the greedy filling finds feasible."""
    high = max(low, prefix[-1])
    while low < high:
        mid = (low + high) // 2
        if _greedy(prefix, mid, shards) is None:
            low = mid + 1
        else:
            high = mid
    return low


def _cut_cells(prefix: list[int], low: int, high: int, shards: int) -> set[int]:
    """The cells in which a cut may lie at any capacity from ``low`` to ``high``.

    Ends of filled shards only grow with the capacity; inside a cell they are not
    known yet, so the lower end is rounded down to a cell's start and the upper end
    is the full sum.
    """
    found, first, furthest, last = set(), 0, 0, len(prefix) - 1
    for _ in range(shards):
        first = bisect_right(prefix, prefix[first] + low) - 1
        furthest = min(furthest + high, prefix[-1])
        found.update(range(first, min(bisect_right(prefix, furthest), last)))
    return found


def _count_cells(groups: DataFrame, spans: list[tuple[int, int]]) -> list[tuple]:
    """Split each span of keys evenly and sum its groups: one aggregate over the groups, at most CELLS rows."""
    parts = max(2, CELLS // len(spans))
    edges = groups.sparkSession.createDataFrame([(a, b, max(1, -(-(b - a + 1) // parts)) if b - a < 2**62 else None) for a, b in spans], "lo long, hi long, step long")
    whole = F.col("step").isNull()
    # only the first round spans more than a long holds; there a cell is a run of leading bits
    bits = max(1, (parts - 1).bit_length() - 1)
    cell = F.when(whole, F.shiftright("h", 64 - bits)).otherwise(F.floor((F.col("h") - F.col("lo")) / F.col("step")).cast("long"))
    return [
        tuple(r)
        for r in groups.join(F.broadcast(edges), F.col("h").between(F.col("lo"), F.col("hi")))
        .groupBy("lo", cell.alias("cell"))
        .agg(F.min("h").alias("first"), F.max("h").alias("last"), F.sum("weight").alias("weight"),
             F.count("*").alias("n"), F.max("weight").alias("largest"))
        .select("first", "last", "weight", "n", "largest")
        .collect()
    ]


def shard_cuts(groups: DataFrame, shards: int) -> list[int]:
    """The last key of each shard but the last, for the least feasible capacity; exact.

    ``groups`` has one row an atomic group: its key h (long) and weight; the order is
    that of h. Cells of whole groups come to the driver, at most CELLS a round: first
    all keys in even runs, then, finer, the cells in which a cut may lie at any
    capacity still possible. Once all those hold one group each, searching the cells
    is searching the groups.
    """
    cells = sorted(_count_cells(groups, [(_LOW, _LOW + _SPAN - 1)]))
    while cells:
        prefix = [0]
        for c in cells:
            prefix.append(prefix[-1] + c[2])
        low = max(max(c[4] for c in cells), -(-prefix[-1] // shards))
        high = _least_capacity(prefix, low, shards)
        wide = [i for i in _cut_cells(prefix, low, high, shards) if cells[i][3] > 1]
        if not wide:
            return [cells[i - 1][1] for i in _greedy(prefix, high, shards)]
        wide = set(sorted(wide)[: CELLS // 8])
        finer = _count_cells(groups, [(cells[i][0], cells[i][1]) for i in sorted(wide)])
        cells = sorted([c for i, c in enumerate(cells) if i not in wide] + finer)
    return []


def shard_documents(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """All rows of ``docs`` with size, text_crc32, law, shard, slot and grown_shard.

    Rows of equal texts are one atomic group; groups stand in the order of a 64-bit
    hash of the text. The least capacity that lets ``shards`` contiguous runs hold
    all groups is found by binary search with a greedy check, and the runs are cut
    there. ``law`` is 'bytes': the fullest shard is as small as whole groups allow.
    Size: UTF-8 bytes of the text plus 8. A null text is a text of its own, of size
    8 and CRC 0. Slots count the rows of a shard from 0 by (bucket of doc_id,
    doc_id, hash), so that a shard's rows are numbered in many tasks; equal rows are
    interchangeable. An empty table gives none. Input columns named like the added
    ones are replaced.
    """
    added = ("size", "text_crc32", "law", "shard", "slot", "grown_shard")
    rows = docs.select(
        *[docs[c] for c in docs.columns if c.lower() not in added],
        (F.coalesce(F.octet_length(docs["text"]), F.lit(0)).cast("long") + 8).alias("size"),
        F.coalesce(F.crc32(docs["text"].cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
        F.xxhash64(F.coalesce(docs["text"], F.lit("")), docs["text"].isNull()).alias("__h"),
    )
    groups = rows.groupBy(F.col("__h").alias("h")).agg(F.sum("size").alias("weight"))
    shard = F.lit(0)
    for last in shard_cuts(written(groups), shards):
        shard = shard + (F.col("__h") > F.lit(last)).cast("int")
    placed = rows.withColumn("shard", shard.cast("int")).withColumn(
        "__b", F.pmod(F.xxhash64("doc_id"), F.lit(SLOT_BUCKETS)).cast("int")
    )
    # at most shards * SLOT_BUCKETS rows, summed by a window over the buckets of one shard
    counts = placed.groupBy("shard", "__b").agg(F.count("*").alias("__n"))
    before = Window.partitionBy("shard").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "__b", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__from"))
    inside = Window.partitionBy("shard", "__b").orderBy("doc_id", "__h")
    out = placed.withColumn("__i", F.row_number().over(inside) - 1).join(F.broadcast(offsets), ["shard", "__b"])
    return out.select(
        *[c for c in rows.columns if c != "__h"],
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("__from") + F.col("__i")).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
