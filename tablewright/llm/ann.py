"""Approximate nearest neighbours by a forest of random-projection trees."""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import written
from .vectors import matrix, of_usual_length, runs

#: Vectors that the trees' planes are fitted on, at most (those of the smallest hashes); all are indexed.
SAMPLE = 8_192
TREES = 10
LEAF = 64
#: Share of all vectors that a search may expect to meet. Vectors without any
#: structure need so many for the recall asked for; clustered ones are found early.
SEARCH = 0.7
#: Vectors and queries of a leaf that a task compares at once.
BLOCK = 4_096
SEED = 7


@dataclass
class Forest:
    """Trees as arrays: a node's plane, threshold and children; a leaf has no children (-1)."""

    normals: np.ndarray
    cuts: np.ndarray
    children: np.ndarray
    roots: list[int]

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row in each tree, all rows a level at a time."""
        out = np.empty((len(x), len(self.roots)), np.int32)
        for t, root in enumerate(self.roots):
            at = np.full(len(x), root)
            live = np.arange(len(x))
            while len(live):
                live = live[self.children[at[live], 0] >= 0]
                node = at[live]
                side = np.einsum("ij,ij->i", x[live], self.normals[node]) >= self.cuts[node]
                at[live] = self.children[node, side.astype(int)]
            out[:, t] = at
        return out

    def search(self, q: np.ndarray, share: np.ndarray, goal: float) -> list[int]:
        """The leaves nearest to ``q``, by one queue over all trees.

        A branch waits with the largest distance to any plane between it and the
        query; the nearest goes first. It ends when the trees, taken as independent,
        have shown ``goal`` of all vectors; ``share``: the share of them in each leaf.
        """
        queue = [(0.0, root, t) for t, root in enumerate(self.roots)]
        missing = np.ones(len(self.roots))
        found = []
        while queue and missing.prod() > 1 - goal:
            margin, node, t = heapq.heappop(queue)
            while self.children[node, 0] >= 0:
                d = float(q @ self.normals[node] - self.cuts[node])
                near, far = (1, 0) if d >= 0 else (0, 1)
                heapq.heappush(queue, (max(margin, abs(d)), int(self.children[node, far]), t))
                node = int(self.children[node, near])
            if share[node] > 0:
                found.append(node)
                missing[t] = max(0.0, missing[t] - share[node])
        return found


def grow(sample: np.ndarray, trees: int = TREES, leaf: int = LEAF) -> Forest:
    """Trees of random directions cut at the median of the sample, down to ``leaf`` of its rows."""
    rng = np.random.default_rng(SEED)
    dim = sample.shape[1]
    normals, cuts, children, roots = [], [], [], []

    def node(idx: np.ndarray) -> int:
        me = len(normals)
        normals.append(np.zeros(dim))
        cuts.append(0.0)
        children.append((-1, -1))
        if len(idx) > leaf:
            w = rng.standard_normal(dim)
            w /= np.linalg.norm(w)
            p = sample[idx] @ w
            cut = float(np.median(p))
            low = p < cut
            if low.any() and not low.all():
                normals[me], cuts[me] = w, cut
                children[me] = (node(idx[low]), node(idx[~low]))
        return me

    for _ in range(trees):
        roots.append(node(np.arange(len(sample))))
    return Forest(np.array(normals).reshape(-1, dim), np.array(cuts), np.array(children).reshape(-1, 2), roots)


def _best(ids: np.ndarray, d: np.ndarray, k: int) -> np.ndarray:
    """The k nearest, ties to the smaller id."""
    if len(d) > 4 * k:
        some = np.flatnonzero(d <= np.partition(d, k - 1)[k - 1])
        return some[np.lexsort((ids[some], d[some]))[:k]]
    return np.lexsort((ids, d))[:k]


def nearest(vectors: DataFrame, queries: F.Column, k: int = 10, search: float = SEARCH, trees: int = TREES,
            leaf: int = LEAF, sample: int = SAMPLE) -> DataFrame:
    """query_id, rank, vec_id, score: for each query row its ``k`` nearest found, by Euclidean distance.

    The forest's planes are fitted on at most ``sample`` vectors; every vector is put
    into a leaf of every tree. A query's leaves come from one queue over all trees;
    each leaf ranks its vectors for its queries by exact distance in doubles, and the
    best of all leaves are ranked again. Ties go to the smaller vec_id. A query's own
    row (its vec_id) is no candidate. Vectors that are null, zero, hold null or
    non-finite components, differ in length from most, or have no vec_id take no part.
    Of rows with equal vec_id, the nearest counts, and the smallest array is the query.
    Fewer candidates than ``k`` are all returned; an empty table gives none.

    Leaves above BLOCK vectors, as one of many copies of a vector, are split by a hash
    into blocks that rank alone; so are leaves with more queries than that.
    """
    spark = vectors.sparkSession
    rows = of_usual_length(vectors.select("vec_id", "embedding").where("vec_id is not null"))
    picked = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).collect()
    schema = "query_id long, rank int, vec_id long, score double"
    if not picked:
        return spark.createDataFrame([], schema)
    forest = spark.sparkContext.broadcast(grow(np.array([r["embedding"] for r in picked], float), trees, leaf))

    def index(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = forest.value.leaves(matrix(batch.column("embedding")))
            lists = pa.ListArray.from_arrays(np.arange(0, found.size + 1, found.shape[1], dtype=np.int32), pa.array(found.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], names=[*batch.schema.names, "leaves"])

    indexed = written(rows.mapInArrow(index, T.StructType([*rows.schema.fields, T.StructField("leaves", T.ArrayType(T.IntegerType()))])))
    # a row for each leaf, as many as the sample allows
    sizes = {r["leaf"]: r["n"] for r in indexed.select(F.explode("leaves").alias("leaf")).groupBy("leaf").agg(F.count("*").alias("n")).collect()}
    total = indexed.count()
    share = np.zeros(len(forest.value.cuts))
    for node, n in sizes.items():
        share[node] = n / total
    shares = spark.sparkContext.broadcast(share)

    def visit(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [forest.value.search(q, shares.value, search) for q in matrix(batch.column("embedding"))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.list_(pa.int32()))], names=[*batch.schema.names, "leaves"])

    asked = rows.where(queries).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    asked = asked.select("vec_id", "embedding").mapInArrow(visit, T.StructType([
        *rows.schema.fields, T.StructField("leaves", T.ArrayType(T.IntegerType()))]))
    asked = written(asked)
    visits = {r["leaf"]: r["n"] for r in asked.select(F.explode("leaves").alias("leaf")).groupBy("leaf").agg(F.count("*").alias("n")).collect()}

    def blocks(counts: dict[int, int]) -> F.Column:
        large = [(n, -(-c // BLOCK)) for n, c in counts.items() if c > BLOCK]
        if not large:
            return F.lit(1)
        pairs = F.create_map(*[F.lit(v) for pair in large for v in pair])
        return F.coalesce(pairs[F.col("leaf")], F.lit(1))

    def dealt(side: DataFrame, own: dict, other: dict, mine: str, theirs: str, flag: int) -> DataFrame:
        """A row of each leaf in its block, met by every block of the other side."""
        return (
            side.select("vec_id", "embedding", F.explode("leaves").alias("leaf"))
            .withColumn(mine, F.pmod(F.xxhash64("vec_id", "embedding"), blocks(own)).cast("int"))
            .withColumn(theirs, F.explode(F.sequence(F.lit(0), blocks(other) - 1)))
            .select("leaf", "vb", "qb", F.lit(flag).alias("side"), "vec_id", "embedding")
        )

    def rank(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in runs(batches, ["leaf", "vb", "qb"]):
            side = group["side"].to_numpy()
            if not side.any() or side.all():
                continue
            ids = group["vec_id"].to_numpy()
            x = matrix(group["embedding"].combine_chunks())
            v, vid = x[side == 0], ids[side == 0]
            out = [], [], []
            for q, qid in zip(x[side == 1], ids[side == 1], strict=True):
                d = np.sqrt(((v - q) ** 2).sum(axis=1))
                d[vid == qid] = np.inf
                best = _best(vid, d, k)
                best = best[np.isfinite(d[best])]
                out[0].append(np.full(len(best), qid))
                out[1].append(vid[best])
                out[2].append(d[best])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(o)) for o in out], names=["query_id", "vec_id", "score"])

    key = ["leaf", "vb", "qb"]
    both = dealt(indexed, sizes, visits, "vb", "qb", 0).unionAll(dealt(asked, visits, sizes, "qb", "vb", 1))
    scored = both.repartition(*key).sortWithinPartitions(*key).mapInArrow(rank, "query_id long, vec_id long, score double")
    best = scored.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
