"""k nearest neighbours, exact at any size.

A training side of a checked, small size that meets few rows is broadcast as one
matrix.  Otherwise it is cut into cells by a tree of pivots whose depth follows the
number of rows.  A row first meets the cell it lies in, which bounds its k-th distance;
the triangle inequality then tells which nodes can hold a nearer one, so rows only
meet the cells below those.  Crowded cells are cut into chunks of bounded size
on both sides, each chunk returns its own ``k`` best, and the best of those are kept.
Distances are worked out in tiles of a bounded number of rows, a dimension at a time.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.report import local_rows
from ..functions.schema import col
from ..session import checkpointed, spread, tasks_for

K = 5
BROADCAST_CELLS = 4_000_000
#: Pairs of rows that are compared without cells, at most.
BROADCAST_PAIRS = 500_000_000
CHUNK_ROWS = 8192
#: Children of a node of the cell tree, at most.
FANOUT = 256
#: Numbers of a tile of distances, and pairs of rows and pivots held at once.
TILE = 2_000_000
PAIRS = 65_536
#: Rounding must never lose a neighbour: every comparison of bounds is widened a little.
SLACK = 1e-9


def nearest(
    train: DataFrame,
    test: DataFrame,
    features: Sequence[str],
    key: str,
    label: str,
    k: int = K,
    broadcast_cells: int = BROADCAST_CELLS,
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """``(key, neighbour, distance2, label)``: the ``k`` closest training rows.

    Ties go to the smaller neighbour key; distances are squared Euclidean.  The
    key must tell the test rows apart.
    """
    x = F.array(*[col(c).cast("double") for c in features])
    base = train.select(col(key).alias("id"), col(label).alias("y"), x.alias("x"))
    base = base.filter(F.forall("x", lambda v: v.isNotNull()) & F.col("y").isNotNull())
    probe = test.select(col(key).alias("id"), x.alias("x"))
    probe = probe.filter(F.forall("x", lambda v: v.isNotNull()))
    known, asked = base.count(), probe.count()
    if known * len(features) <= broadcast_cells and known * asked <= BROADCAST_PAIRS:
        found = _against_broadcast(base, probe, k)
    else:
        found = _against_cells(spread(base, known), spread(probe, asked), k, chunk_rows, known, asked)
    best = Window.partitionBy("id").orderBy("distance2", "neighbour")
    return (
        found.withColumn("place", F.row_number().over(best))
        .filter(F.col("place") <= k)
        .select(F.col("id").alias(key), "neighbour", "distance2", F.col("y").alias("label"))
    )


def knn_regress(train, test, features, key, label, k: int = K, **options) -> DataFrame:
    """``(key, prediction)``: the mean label of the neighbours."""
    return (
        nearest(train, test, features, key, label, k, **options)
        .groupBy(key)
        .agg(F.avg(F.col("label").cast("double")).alias("prediction"))
    )


def knn_classify(train, test, features, key, label, k: int = K, **options) -> DataFrame:
    """``(key, prediction)``: the most common label; the smallest wins a tie."""
    votes = (
        nearest(train, test, features, key, label, k, **options)
        .groupBy(key, "label")
        .agg(F.count("*").alias("n"))
    )
    ranked = F.struct((-F.col("n")).alias("neg"), F.col("label"))
    return votes.groupBy(key).agg(F.min_by("label", ranked).alias("prediction"))


def _schema(base: DataFrame, probe: DataFrame) -> T.StructType:
    return T.StructType(
        [
            T.StructField("id", probe.schema["id"].dataType),
            T.StructField("neighbour", base.schema["id"].dataType),
            T.StructField("distance2", T.DoubleType()),
            T.StructField("y", base.schema["y"].dataType),
        ]
    )


def _best(ids, x, other_ids, other_x, other_y, k, bounds=None):
    """The ``k`` nearest of a bounded block for a bounded block of rows.

    Rows farther than ``bounds`` (squared, widened) are left out, if a row's is given and finite.
    """
    parts = []
    order = np.argsort(other_ids, kind="stable")
    other_ids, other_x, other_y = other_ids[order], other_x[order], other_y[order]
    step = max(1, TILE // max(1, len(other_x)))
    for start in range(0, len(x), step):
        rows = x[start : start + step]
        far = _squares(rows, other_x)
        kept = min(k, far.shape[1])
        edge = np.full(len(rows), np.inf) if bounds is None else bounds[start : start + step].copy()
        free = np.flatnonzero(np.isinf(edge))
        if len(free):
            edge[free] = _kth(far if len(free) == len(far) else far[free], kept)
        r, c = np.nonzero(far <= edge[:, None])  # ties at the edge included
        order = np.lexsort((c, far[r, c], r))  # keys ascend with c
        r, c = r[order], c[order]
        first = np.searchsorted(r, np.arange(len(rows)))
        near = np.arange(len(r)) - first[r] < kept
        r, c = r[near], c[near]
        parts.append(
            pd.DataFrame(
                {
                    "id": ids[start : start + step][r],
                    "neighbour": other_ids[c],
                    "distance2": far[r, c],
                    "y": other_y[c],
                }
            )
        )
    return pd.concat(parts) if parts else pd.DataFrame({"id": [], "neighbour": [], "distance2": [], "y": []})


def _kth(far: np.ndarray, k: int) -> np.ndarray:
    """The ``k``-th smallest of each row."""
    return np.partition(far, k - 1, axis=1)[:, k - 1]


def _matrix(column):
    return np.asarray(column.tolist(), dtype=float)


def _against_broadcast(base: DataFrame, probe: DataFrame, k: int) -> DataFrame:
    whole = base.toPandas()
    shared = base.sparkSession.sparkContext.broadcast(whole)

    def search(batches):
        other = shared.value
        if not len(other):
            return
        other_x = _matrix(other["x"])
        for rows in batches:
            if len(rows):
                yield _best(
                    rows["id"].to_numpy(),
                    _matrix(rows["x"]),
                    other["id"].to_numpy(),
                    other_x,
                    other["y"].to_numpy(),
                    k,
                )

    return probe.mapInPandas(search, _schema(base, probe))


class CellTree:
    """Pivots in levels: a node's rows are cut by which child pivot is nearest.

    Nodes stand in arrays; ``pivots[i]`` is the pivot of node i, ``children[i]`` the places
    of its children (none for a leaf).  The roots are the children of no node.
    """

    def __init__(self, dim: int) -> None:
        self.pivots = np.zeros((0, dim))
        self.children: list[np.ndarray] = []
        self.roots = np.zeros(0, np.int64)

    def grow(self, node: int | None, pivots: np.ndarray) -> None:
        """Give a leaf (or the tree itself) children at these pivots."""
        made = np.arange(len(self.pivots), len(self.pivots) + len(pivots))
        self.pivots = np.vstack([self.pivots, pivots])
        self.children += [np.zeros(0, np.int64) for _ in made]
        if node is None:
            self.roots = made
        else:
            self.children[node] = made

    def paths(self, x: np.ndarray) -> tuple[list[list[int]], list[list[float]]]:
        """For each row the nodes from root to leaf, and its distances to their pivots."""
        nodes: list[list[int]] = [[] for _ in x]
        fars: list[list[float]] = [[] for _ in x]
        waiting = [(self.roots, np.arange(len(x)))]
        while waiting:
            choice, rows = waiting.pop()
            for start in range(0, len(rows), max(1, TILE // len(choice))):
                part = rows[start : start + max(1, TILE // len(choice))]
                far = np.sqrt(_squares(x[part], self.pivots[choice]))
                nearest_child = far.argmin(axis=1)
                for r, c, f in zip(part.tolist(), choice[nearest_child].tolist(), far.min(axis=1).tolist(), strict=True):
                    nodes[r].append(c)
                    fars[r].append(f)
                for c in np.unique(nearest_child):
                    if len(self.children[choice[c]]):
                        waiting.append((self.children[choice[c]], part[nearest_child == c]))
        return nodes, fars

    def reach(
        self, x: np.ndarray, n: np.ndarray, radius: np.ndarray, kth: np.ndarray, k: int, known: np.ndarray | None = None
    ) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) for every leaf that may hold one of the row's ``k`` nearest.

        ``n``, ``radius``, ``kth``: of each node its rows, how far the farthest and the k-th
        closest of them lie from its pivot.  A node of k rows bounds the k-th neighbour's
        distance, as does ``known``; by the triangle inequality a node beyond the bound holds
        none.  Nor does one whose pivot is farther than a sibling's by more than twice the
        bound: its rows are nearest to its own pivot.
        """
        found: list[tuple[np.ndarray, np.ndarray]] = []
        # children of a node stand side by side
        width = np.array([len(c) for c in self.children])
        eldest = np.array([c[0] if len(c) else -1 for c in self.children])
        step = max(1, TILE // len(self.pivots))  # if no node can be left out, pairs still fit
        for start in range(0, len(x), step):
            part = x[start : start + step]
            far = np.sqrt(_squares(part, self.pivots[self.roots]))
            size = n[self.roots]
            bound = np.where(size >= k, far + kth[self.roots], np.inf).min(axis=1)
            # several nodes together hold k rows within the last one's far end
            ends = far + radius[self.roots]
            order = np.argsort(ends, axis=1)
            held = np.cumsum(size[order], axis=1)
            enough = (held >= k).argmax(axis=1)
            rows = np.arange(len(part))
            several = np.take_along_axis(ends, order, axis=1)[rows, enough]
            several[held[:, -1] < k] = np.inf
            bound = np.minimum(bound, several)
            if known is not None:
                bound = np.minimum(bound, known[start : start + step])
            wide = (bound * (1 + SLACK))[:, None] + SLACK * (1 + far)
            row, place = np.nonzero((far - radius[self.roots] <= wide) & (far - far.min(axis=1)[:, None] <= 2 * wide))
            node = self.roots[place]
            while len(row):
                leaf = width[node] == 0
                found.append((row[leaf] + start, node[leaf]))
                row, node = row[~leaf], node[~leaf]
                if not len(row):
                    break
                many = width[node]
                row, child = np.repeat(row, many), np.repeat(eldest[node] - np.cumsum(many) + many, many) + np.arange(many.sum())
                far = np.empty(len(row))
                for a in range(0, len(row), PAIRS):
                    gap = part[row[a : a + PAIRS]] - self.pivots[child[a : a + PAIRS]]
                    far[a : a + PAIRS] = np.sqrt((gap * gap).sum(axis=1))
                np.minimum.at(bound, row, np.where(n[child] >= k, far + kth[child], np.inf))
                nearest_child = np.repeat(np.minimum.reduceat(far, np.cumsum(many) - many), many)
                wide = bound[row] * (1 + SLACK) + SLACK * (1 + far)
                keep = (far - radius[child] <= wide) & (far - nearest_child <= 2 * wide)
                row, node = row[keep], child[keep]
        return np.concatenate([r for r, _ in found]), np.concatenate([c for _, c in found])


def _squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of ``x`` and ``y``, a dimension at a time: two tiles of numbers at most."""
    far = np.zeros((len(x), len(y)))
    for d in range(x.shape[1]):
        gap = x[:, d][:, None] - y[:, d][None, :]
        gap *= gap
        far += gap
    return far


def grow_tree(base: DataFrame, dim: int, leaf_rows: int, most_pivots: int) -> tuple[CellTree, DataFrame]:
    """The tree, and the rows with ``nodes`` and ``fars`` from root to leaf.

    Leaves of more than ``leaf_rows`` rows get children (so many that these have a quarter of
    that, or FANOUT), level by level, until none is left that differs inside, or ``most_pivots`` stand: so the depth follows the rows, and
    what is broadcast has a bound.  Pivots are the different rows of least hash; any choice
    gives the same neighbours.
    """
    tree, context = CellTree(dim), base.sparkSession.sparkContext
    first = base.select("x", F.xxhash64("x").alias("h")).dropDuplicates(["h"]).orderBy("h").limit(FANOUT).collect()
    tree.grow(None, np.array([r["x"] for r in first], float).reshape(-1, dim))
    schema = T.StructType(
        [*base.schema.fields, T.StructField("nodes", T.ArrayType(T.IntegerType())), T.StructField("fars", T.ArrayType(T.DoubleType()))]
    )
    final: set[int] = set()
    while True:
        shared = context.broadcast(tree)

        def place(batches, shared=shared):
            for rows in batches:
                if len(rows):
                    rows["nodes"], rows["fars"] = shared.value.paths(_matrix(rows["x"]))
                    yield rows

        placed = checkpointed(base.mapInPandas(place, schema))
        leaf = F.element_at("nodes", -1)
        sizes = {r["leaf"]: r["n"] for r in placed.groupBy(leaf.alias("leaf")).agg(F.count("*").alias("n")).collect()}
        crowded = sorted((c for c, n in sizes.items() if n > leaf_rows and c not in final), key=lambda c: -sizes[c])
        fanout = min(FANOUT, (most_pivots - len(tree.pivots)) // max(1, len(crowded)))
        if not crowded or fanout < 2:
            return tree, placed
        wanted = local_rows(base, [(c,) for c in crowded], "leaf int")
        inside = placed.select(leaf.alias("leaf"), "x", F.xxhash64("x").alias("h")).join(F.broadcast(wanted), "leaf")
        least = Window.partitionBy("leaf").orderBy("h")
        picked = inside.dropDuplicates(["leaf", "h"]).withColumn("i", F.row_number().over(least)).filter(F.col("i") <= fanout)
        pivots: dict[int, list] = {}
        for r in picked.select("leaf", "x").collect():
            pivots.setdefault(r["leaf"], []).append(r["x"])
        for c in crowded:
            if len(pivots[c]) > 1:
                tree.grow(c, np.array(pivots[c][: max(2, -(-4 * sizes[c] // leaf_rows))], float))
            else:
                final.add(c)  # copies of one row


def _against_cells(base: DataFrame, probe: DataFrame, k: int, chunk_rows: int, known: int, asked: int) -> DataFrame:
    spark = base.sparkSession
    head = base.select(F.size("x").alias("d")).first()
    if head is None:
        return spark.createDataFrame([], _schema(base, probe))
    dim = max(1, head["d"])
    tree, placed = grow_tree(base, dim, max(1, chunk_rows // 2), max(FANOUT, BROADCAST_CELLS // dim))
    cells = placed.select("id", "y", "x", F.element_at("nodes", -1).alias("cell"))
    # Per node: rows, radius, and how far its k-th closest row is from the pivot.
    each = placed.select(F.inline(F.arrays_zip("nodes", "fars"))).toDF("node", "far")
    near = Window.partitionBy("node").orderBy("far")
    kth = each.withColumn("i", F.row_number().over(near)).filter(F.col("i") <= k).groupBy("node").agg(F.max("far").alias("kth"))
    stats = each.groupBy("node").agg(F.count("*").alias("n"), F.max("far").alias("radius")).join(kth, "node").collect()
    n, radius, nearest_k = (np.zeros(len(tree.pivots)) for _ in range(3))
    radius[:] = -np.inf  # a node without rows is never near
    for r in stats:
        n[r["node"]], radius[r["node"]], nearest_k[r["node"]] = r["n"], r["radius"], r["kth"]
    shared = spark.sparkContext.broadcast((tree, n, radius, nearest_k))
    # Comparing costs far more than the bytes of the rows tell: partitions by rows, not by size.
    tasks = 4 * tasks_for(spark, known + asked)
    keys = ("cell", "chunk", "slice")

    def meet(left, right, search, schema):
        left, right = left.repartition(tasks, *keys), right.repartition(tasks, *keys)
        return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(search, schema)

    def sizes(df, name):
        return df.groupBy("cell").agg(F.ceil(F.count("*") / chunk_rows).cast("int").alias(name))

    spread_rows = F.xxhash64("id")
    chunks = sizes(cells, "chunks")
    chunked = cells.join(F.broadcast(chunks), "cell").withColumn("chunk", F.pmod(spread_rows, "chunks").cast("int"))

    # First a row meets its own cell (of a crowded one a chunk): the k-th distance there bounds the others.
    def home(batches):
        for rows in batches:
            if len(rows):
                rows["cell"] = np.array([path[-1] for path in shared.value[0].paths(_matrix(rows["x"]))[0]], "int32")
                yield rows

    def bounded(rows, other):
        bound = np.full(len(rows), np.inf)
        if len(other) >= k and len(rows):
            x, other_x = _matrix(rows["x"]), _matrix(other["x"])
            step = max(1, TILE // len(other_x))
            for start in range(0, len(x), step):
                bound[start : start + step] = np.sqrt(_kth(_squares(x[start : start + step], other_x), k))
        return rows[["id", "x"]].assign(bound=bound)

    at_home = checkpointed(probe.mapInPandas(home, T.StructType([*probe.schema.fields, T.StructField("cell", T.IntegerType())])))
    # Where a cell meets many rows those are cut into slices, and each of its chunks meets every slice.
    parts = F.broadcast(chunks.join(sizes(at_home, "slices"), "cell"))
    draw = F.xxhash64("id", "x")
    left = at_home.join(F.broadcast(sizes(at_home, "slices")), "cell").join(F.broadcast(chunks), "cell", "left").select(
        "id", "x", "cell", F.coalesce(F.pmod(draw, "chunks"), F.lit(0)).cast("int").alias("chunk"),
        F.pmod(F.shiftright(draw, 20), "slices").cast("int").alias("slice"),
    )
    right = chunked.drop("chunks").join(parts, "cell").select(
        "x", "cell", "chunk", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice")
    )
    edged = meet(left, right, bounded, T.StructType([*probe.schema.fields, T.StructField("bound", T.DoubleType())]))

    def route(batches):
        for rows in batches:
            if len(rows):
                r, c = shared.value[0].reach(_matrix(rows["x"]), *shared.value[1:], k, rows["bound"].to_numpy())
                for a in range(0, len(r), PAIRS):
                    out = rows.iloc[r[a : a + PAIRS]].copy()
                    out["cell"] = c[a : a + PAIRS].astype("int32")
                    yield out

    routed = checkpointed(edged.mapInPandas(route, T.StructType([*edged.schema.fields, T.StructField("cell", T.IntegerType())])))
    # A crowded cell (copies, or a tree at its bound) is cut into chunks; where it meets many
    # rows those are cut into slices too, and each chunk meets every slice.  A row a cell.
    parts = F.broadcast(chunks.join(sizes(routed, "slices"), "cell"))
    left = routed.join(parts, "cell").select(
        "id", "x", "bound", "cell", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), F.pmod(spread_rows, "slices").cast("int").alias("slice")
    )
    right = chunked.drop("chunks").join(parts, "cell").select(
        "id", "y", "x", "cell", "chunk", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice")
    )

    def search(rows, other):
        if not len(rows) or not len(other):
            return pd.DataFrame({"id": [], "neighbour": [], "distance2": [], "y": []})
        return _best(
            rows["id"].to_numpy(),
            _matrix(rows["x"]),
            other["id"].to_numpy(),
            _matrix(other["x"]),
            other["y"].to_numpy(),
            k,
            (rows["bound"].to_numpy() ** 2) * (1 + 4 * SLACK),
        )

    return meet(left, right, search, _schema(base, probe))
