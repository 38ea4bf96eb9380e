"""Links between items that share a bucket, without all pairs of a bucket."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_KEYS, components, kept_in, written
from .shingles import mix
from .vectors import runs

#: Items of a group that one task compares; larger groups take further heads.
SMALL = 4_096
#: So many tokens of its items count as one item more, so that a group of long sets is no larger in memory.
WEIGHT = 1_024
#: Items, and tokens whose holders are looked at, at once.
ROWS, COLUMNS = 1_024, 1_024
#: Items that are set against all of their group at once, once it is known what they share.
STRIP = 128
#: Jaccard distance to a head up to which items are compared by their differences from it.
NEAR = 0.5
#: A pair is not compared further if its distance is shown to be at least so many times that of a link.
SHOWN = 1.5
#: The share of the tokens in samples, in link distances: enough to show that unlike sets are far.
SAMPLE = 1.25


#: Gives the sets (item, tokens) of the items asked for.
Sets = Callable[[DataFrame], DataFrame]


def _sets_of(rows: DataFrame, name: str, sets: Sets, tokens: str) -> DataFrame:
    """The sets of the items in a column of ``rows``; others are not shuffled."""
    keys = written(rows.select(F.col(name).alias("item")).distinct())
    return sets(keys).select(F.col("item").alias(name), F.col("tokens").alias(tokens))


def _few(rows: DataFrame) -> DataFrame:
    """Written rows of a few longs, to be broadcast to what they are joined with if they are few, so that sets stay where they are."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_KEYS else rows


def _distinct_buckets(rows: DataFrame) -> DataFrame:
    """``rows`` without buckets of one item, and one bucket of those that hold the same items.

    A passage or copy puts the same items into many buckets. Contents are told apart
    by their number, ends and a 64-bit fingerprint.
    """
    ends = rows.groupBy("bucket").agg(
        F.min("item").alias("lo"), F.max("item").alias("hi"), F.count("*").alias("rows"), F.bit_xor(F.xxhash64("item")).alias("content"))
    one = ends.where("lo <> hi").groupBy("lo", "hi", "rows", "content").agg(F.min("bucket").alias("bucket")).select("bucket")
    return kept_in(rows, written(one), "bucket")


def size_classes(buckets: DataFrame, percent: int) -> DataFrame:
    """``buckets`` split so that a bucket holds like sizes only, without those of one item or of the same items.

    Sizes are classed by their logarithm; those of sets that link lie in one class or
    in two next to each other, so each row goes to the bucket of its class and the next.
    """
    level = F.floor(F.log("size") / F.lit(-math.log(percent / 100 - 1e-9)))
    both = buckets.withColumn("level", F.explode(F.array(level, level + 1)))
    both = both.select(F.xxhash64("bucket", "level").alias("bucket"), "item", "size")
    return _distinct_buckets(both)


def similar_sets(pairs: DataFrame, sets: Sets) -> DataFrame:
    """(a, b, both, n_a, n_b) for pairs of items, from their sets (item, tokens): exact intersections."""
    left = _sets_of(pairs, "a", sets, "ta")
    right = _sets_of(pairs, "b", sets, "tb")
    met = right.join(_few(written(pairs.select("a", "b"))), "b").join(left, "a")
    return met.select("a", "b", F.size(F.array_intersect("ta", "tb")).cast("long").alias("both"),
                      F.size("ta").cast("long").alias("n_a"), F.size("tb").cast("long").alias("n_b"))


def _samples(sets: DataFrame, share: float) -> DataFrame:
    """(item, low, n): the tokens in the first ``share`` of their range, as 31 bits each, and the size of each set.

    Two tokens that become one are one difference less, so what samples show to be far is far.
    """
    end = min(int(max(share, 0.05) * 2**64), 2**63 - 1)
    low = F.filter("tokens", lambda x: (x >= 0) & (x < F.lit(end)))
    short = F.array_distinct(F.transform(low, lambda x: F.shiftright(x, max(0, end.bit_length() - 31)).cast("int")))
    return sets.select("item", short.alias("low"), F.size("tokens").cast("long").alias("n"))


def _sampled(pairs: DataFrame, low: DataFrame) -> DataFrame:
    """(a, b, n_a, n_b, least): a lower bound of the Jaccard distance of pairs, from a sample of their tokens.

    Sets that differ in at least d tokens have a union of at least (n_a + n_b + d) / 2,
    of which these d are not shared. Those that differ in the sample are no more than all.
    """
    left = low.select(F.col("item").alias("a"), F.col("low").alias("la"), F.col("n").alias("n_a"))
    right = low.select(F.col("item").alias("b"), F.col("low").alias("lb"), F.col("n").alias("n_b"))
    apart = F.size("la") + F.size("lb") - 2 * F.size(F.array_intersect("la", "lb"))
    met = right.join(_few(pairs.select("a", "b")), "b").join(left, "a")
    return met.select("a", "b", "n_a", "n_b", (2 * apart / (F.col("n_a") + F.col("n_b") + apart)).alias("least"))


def _labelled(rows: DataFrame, reach: DataFrame | None, item: str = "item", name: str = "component") -> DataFrame:
    """``rows`` with the component of an item; an item without links is its own."""
    if reach is None:
        return rows.withColumn(name, F.col(item))
    known = reach.select(F.col("id").alias(item), F.col("component_id").alias("__c"))
    return rows.join(known, item, "left").withColumn(name, F.coalesce("__c", item)).drop("__c")


def _difference_buckets(star: DataFrame, sets: Sets, percent: int) -> DataFrame:
    """Buckets (bucket, item, size, degree) in which items of one head meet, if at least one of a pair does not link to the head.

    ``star``: head, item, degree, loose (does not link to the head). Items are taken as
    what they lack of the head's set and what they have besides. Let u be loose, and let
    u and v share none of these: then their similarity is at most that of u and the
    head, too low. So u must share some with v, and how many follows from the sizes. A
    loose item offers its rarest ones (a prefix: all but as many as it needs, less one),
    another item all of them, in one order for all; so a pair that may link meets in the
    bucket of the first one that it shares.
    """
    tight = percent / 100
    both = star.join(_sets_of(star, "item", sets, "tokens"), "item").join(_sets_of(star, "head", sets, "th"), "head").select(
        "head", "item", "degree", "loose", F.size("th").alias("c"), F.size("tokens").alias("n"),
        F.array_except("th", "tokens").alias("lack"), F.array_except("tokens", "th").alias("more"))
    keys = F.concat(F.transform("lack", lambda x: F.struct(F.lit(0).alias("side"), x.alias("key"))),
                    F.transform("more", lambda x: F.struct(F.lit(1).alias("side"), x.alias("key"))))
    rows = both.select("head", "item", "degree", "loose", "c", "n", F.size("lack").alias("l"), F.explode(keys).alias("k"))
    rows = written(rows.select("*", "k.side", "k.key").drop("k"))
    often = rows.groupBy("head", "side", "key").agg(F.count("*").alias("df")).where("df > 1")
    own = Window.partitionBy("head", "item")
    offered = (
        rows.join(often, ["head", "side", "key"])
        .withColumn("sl", F.sum((F.col("side") == 0).cast("int")).over(own))
        .withColumn("sm", F.sum((F.col("side") == 1).cast("int")).over(own))
        # what a loose item must make up for by sharing
        .withColumn("need", F.when(F.col("loose"), F.lit(tight) * (F.col("n") + F.col("l")) - (F.col("c") - F.col("l")) - 1e-9).otherwise(0.0))
        .where(F.col("sm") + tight * F.col("sl") >= F.col("need"))
        .withColumn("place", F.row_number().over(own.orderBy("df", "side", "key")))
        .where(F.col("place") <= F.col("sl") + F.col("sm") - F.greatest(F.ceil("need"), F.lit(1)) + 1)
    )
    # a bucket without a loose item joins nothing that the head does not
    bucket = F.xxhash64("head", "side", "key").alias("bucket")
    made = written(offered.select(bucket, "item", F.col("n").cast("long").alias("size"), "degree", "loose"))
    wanted = made.groupBy("bucket").agg(F.max("loose").alias("any"), F.count("*").alias("rows")).where("any and rows > 1").select("bucket")
    return _distinct_buckets(made.join(wanted, "bucket").select("bucket", "item", "size", "degree").distinct())


def _holders(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(token, holder): numbers of the values that several sets hold, in order, and the sets that hold them."""
    values = np.concatenate(sets)
    order = np.argsort(values, kind="stable")
    values = values[order]
    holder = np.repeat(np.arange(len(sets), dtype=np.int32), [len(x) for x in sets])[order]
    del order
    # a value of one holder is in no intersection
    as_next = values[1:] == values[:-1]
    more = np.zeros(len(values), bool)
    more[1:] |= as_next
    more[:-1] |= as_next
    values, holder = values[more], holder[more]
    new = np.zeros(len(values), bool)
    new[1:] = values[1:] != values[:-1]
    return np.cumsum(new, dtype=np.int32), holder


def _shared(sets: list[np.ndarray]) -> Iterator[tuple[int, np.ndarray]]:
    """(first, both): how many values STRIP sets from ``first`` on share with each of all, from who holds which."""
    token, holder = _holders(sets)
    kinds, total = int(token[-1]) + 1 if len(token) else 0, len(sets)
    for first in range(0, total, ROWS):
        both = np.zeros((min(ROWS, total - first), total), np.float32)
        for start in range(0, kinds, COLUMNS):
            a, b = np.searchsorted(token, [start, start + COLUMNS])
            marks = np.zeros((total, min(COLUMNS, kinds - start)), np.float32)
            marks[holder[a:b], token[a:b] - start] = 1
            both += marks[first : first + ROWS] @ marks.T
        marks = None
        for at in range(0, len(both), STRIP):
            yield first + at, both[at : at + STRIP].astype(np.int32)  # whole numbers below 2^24 are exact


def _may_link(sets: list[np.ndarray], n: np.ndarray, component: np.ndarray, tight: float) -> np.ndarray:
    """For each set the first place of those it may be joined with, or -1.

    Two sets may link if they are of different components and a sample of their tokens does
    not show them to be far from each other; sets that such pairs connect belong together.
    """
    size = np.array([len(x) for x in sets])
    first_of, any_pair = np.arange(len(sets)), np.zeros(len(sets), bool)
    for first, both in _shared(sets):
        rows = slice(first, first + len(both))
        apart = size[rows, None] + size[None, :] - 2 * both
        near = 2 * apart <= (tight + 1e-9) * (n[rows, None] + n[None, :] + apart)
        i, j = np.nonzero(near & (component[rows, None] != component[None, :]))
        i += first
        any_pair[i] = True
        before = None
        while before is None or (first_of != before).any():
            before = first_of.copy()
            least = np.minimum(first_of[i], first_of[j])
            for end in (i, j, before[i], before[j]):
                np.minimum.at(first_of, end, least)
            first_of = first_of[first_of]
    return np.where(any_pair, first_of, -1)


def _linked(sets: list[np.ndarray], component: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Places of pairs that link, as few as join the components: exact, all pairs of the group."""
    n = np.array([len(x) for x in sets])
    root = {c: c for c in component.tolist()}

    def top(c):
        while root[c] != c:
            root[c] = root[root[c]]
            c = root[c]
        return c

    out = []
    for first, both in _shared(sets):
        rows = slice(first, first + len(both))
        union = n[rows, None] + n[None, :] - both
        found = (100 * both.astype(np.int64) >= percent * union) & (component[rows, None] != component[None, :])
        for i, j in np.argwhere(np.triu(found, first + 1)).tolist():
            x, y = top(int(component[first + i])), top(int(component[j]))
            if x != y:
                root[max(x, y)] = min(x, y)
                out.append((first + i, j))
    return out


def _lists(column: pa.ChunkedArray) -> list[np.ndarray]:
    """Each list as an array; none is copied."""
    out = []
    for chunk in column.chunks:
        at = (chunk.offsets.to_numpy() - chunk.offsets[0].as_py()).tolist()
        values = chunk.flatten().to_numpy()
        out += [values[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
    return out


def _spanning(groups: DataFrame, low: DataFrame, sets: Sets, percent: int) -> DataFrame:
    """Links (a, b) between items of a group (bucket, item, component), as few as join the group's components.

    A group is bounded (SMALL, WEIGHT) and one task's work. Samples of the sets (``low``)
    come to it first, and cut it into parts that may be joined; a part is named by the
    items in it (64 bits), so that one found in many groups is looked at once. Whole sets
    follow for the items of these parts alone. No pair leaves a task but those that join
    two components.
    """
    tight = (100 - percent) / 100

    def pick(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in runs(batches, ["bucket"]):
            component, items = group["component"].to_numpy(), group["item"].to_numpy()
            part = _may_link(_lists(group["low"]), group["n"].to_numpy(), component, tight)
            left = np.flatnonzero(part >= 0)
            if len(left):
                name, place = np.zeros(len(part), np.uint64), part[left]
                np.bitwise_xor.at(name, place, mix(items[left].view(np.uint64)))
                count = np.bincount(place, minlength=len(part)).astype(np.uint64)
                bucket = mix(name + mix(count))[place].view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in (bucket, items[left], component[left])], names=["bucket", "item", "component"])

    def join(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in runs(batches, ["bucket"]):
            ids = group["item"].to_numpy()
            pairs = _linked(_lists(group["tokens"]), group["component"].to_numpy(), percent)
            if pairs:
                i, j = (ids[list(x)] for x in zip(*pairs, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(i, j)), pa.array(np.maximum(i, j))], names=["a", "b"])

    sampled = low.join(_few(written(groups.distinct())), "item").select("bucket", "item", "component", "low", "n")
    open_groups = written(sampled.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(pick, "bucket long, item long, component long").distinct())
    if open_groups.isEmpty():
        return open_groups.select(F.col("item").alias("a"), F.col("item").alias("b"))
    whole = _sets_of(open_groups, "item", sets, "tokens").join(_few(open_groups), "item").select("bucket", "item", "component", "tokens")
    return whole.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(join, "a long, b long")


def _weighed(rows: DataFrame, key: str) -> DataFrame:
    """``rows`` of the keys that hold several components, with the weight ``n`` of their key."""
    sums = rows.groupBy(key).agg(
        (F.count("*") + F.floor(F.sum("size") / WEIGHT)).alias("n"), F.min("component").alias("lo"), F.max("component").alias("hi"))
    return rows.join(sums.where("lo <> hi").select(key, "n"), key)


def link(buckets: DataFrame, sets: Sets, percent: int) -> tuple[DataFrame, DataFrame]:
    """All links between items of a bucket, up to what their components need.

    ``buckets``: distinct rows (bucket, item, size), longs; ``sets`` fetches (item, tokens) of given items.
    Items link if 100 * both >= percent * union. Returns links (a, b) that span the
    components of the full graph, and (id, component_id) for the items in them.

    In a round each bucket compares its head, the item with most neighbours, with its
    other items: by a share of the tokens first, and by whole sets only those that
    the share does not show to be far. Then the buckets whose other items lie in
    one component are done, as pairs inside a component change nothing. In the
    others, what is near a head (of whatever bucket) is one group, and what is far from
    the head, with what may be a partner of it (the Jaccard distance is a metric, so
    that must be about as far), another. Groups of bounded size are compared by one task
    each, by samples and then by whole sets, which returns no more links than join their
    components. Larger ones go
    through another round: those near a head in the buckets of their differences from
    it, the others as they are. So a large group of near copies costs about a pair an
    item, and no pair that could join components is left out.
    """
    sizes = buckets.groupBy("bucket").agg((F.count("*") - 1).alias("n"))
    degree = buckets.join(sizes, "bucket").groupBy("item").agg(F.sum("n").alias("degree"))
    current = written(buckets.join(degree, "item").select("bucket", "item", "size", "degree"))
    tight, links, reach, small = (100 - percent) / 100, None, None, SMALL
    low = written(_samples(sets(written(buckets.select("item").distinct())), SAMPLE * tight))
    while True:
        heads = current.groupBy("bucket").agg(F.max(F.struct("degree", "item", "size")).alias("h"), F.min("item").alias("lo"), F.max("item").alias("hi"))
        heads = heads.where("lo <> hi").select("bucket", F.col("h.item").alias("head"), F.col("h.size").alias("head_size"))
        met = written(current.join(heads, "bucket").where("item <> head"))
        # sizes further apart than this mean a distance above NEAR
        fits = F.least("size", "head_size") >= F.greatest("size", "head_size") * (1 - NEAR - 1e-9)
        pairs = written(met.where(fits).select(F.col("head").alias("a"), F.col("item").alias("b")).distinct())
        told = written(_sampled(pairs, low))
        # a bound this far beyond the links' distance is not settled further
        shown = F.col("least") >= SHOWN * tight + 1e-9
        exact = similar_sets(told.where(~shown), sets).withColumn("union", F.col("n_a") + F.col("n_b") - F.col("both"))
        exact = exact.withColumn("loose", F.col("both") * 100 < F.col("union") * percent)
        seen = written(
            exact.select("a", "b", (1 - F.col("both") / F.col("union")).alias("far"), F.lit(None).cast("double").alias("least"), "loose")
            .unionAll(told.where(shown).select("a", "b", F.lit(None).cast("double").alias("far"), "least", F.lit(True).alias("loose")))
        )
        new = seen.where("not loose").select("a", "b")
        links = new if links is None else links.unionAll(new)
        reach = components(links.select(F.col("a").alias("src"), F.col("b").alias("dst")))
        far = seen.withColumnsRenamed({"a": "head", "b": "item"})
        # sizes that do not fit mean a distance above NEAR
        rows = _labelled(met.join(far, ["head", "item"], "left").withColumn("least", F.coalesce("least", F.lit(NEAR))), reach)
        spread = rows.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("bucket")
        rows = written(rows.join(spread, "bucket"))
        if rows.isEmpty():
            return links, reach

        star = rows.where(F.col("far") <= NEAR).select("head", "item", "size", "degree", "component", "loose").distinct()
        star = written(_weighed(star.join(star.where("loose").select("head").distinct(), "head", "left_semi"), "head"))
        beyond = F.when(F.col("far").isNull(), F.col("least")).when(F.col("far") > NEAR, F.col("far"))
        floors = rows.groupBy("bucket").agg(F.min(beyond).alias("floor")).where("floor is not null")
        apart = rows.join(floors, "bucket").where(F.coalesce("far", F.lit(1.0)) >= F.col("floor") - tight - 1e-9).drop("floor")
        apart = written(_distinct_buckets(_weighed(apart, "bucket")))
        at_once = F.col("n") <= small
        groups = star.where(at_once).select(F.xxhash64(F.lit("near"), "head").alias("bucket"), "item", "component").unionAll(
            apart.where(at_once).select("bucket", "item", "component"))
        links = links.unionAll(written(_spanning(groups, low, sets, percent)))
        reach = components(links.select(F.col("a").alias("src"), F.col("b").alias("dst")))
        columns = ["bucket", "item", "size", "degree"]
        current = apart.where(~at_once).select(*columns)
        crowded = star.where(~at_once)
        if not crowded.isEmpty():
            current = current.unionAll(_difference_buckets(crowded, sets, percent).select(*columns))
        if current.isEmpty():
            return links, reach
        current = written(current)
        small *= 4
