"""Hard negatives for contrastive training, mined by threshold joins with suffix-norm bounds.

For an anchor, the rows of another label that score nearly as high as its positives are
the hard ones. Rows are an inverted index: dimensions, largest energy first, each with
its postings. A row's last dimensions are not indexed as long as the norm of that suffix
bounds what they could add below the threshold. Partial scores are accumulated over the
postings; pairs that the norms of the rest cannot lift to the threshold are pruned, the
others scored in full. Thresholds start high and are lowered, which extends the postings,
until an anchor's windows are full or its lowest threshold is reached. Nothing is missed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_KEYS, written
from .vectors import matrix, runs

#: Rows and anchors that a task joins at once.
ROWS, ANCHORS = 4_096, 1_024
#: Dimensions whose postings are read at once.
DIMS = 8
#: Pairs scored in full at once.
PAIRS = 65_536
#: While more than this share of the pairs may reach the threshold, further postings are read.
SHARE = 1 / 16
#: How thresholds fall: of positives, and of negatives.
FALL_POSITIVES, FALL_NEGATIVES = 0.5, 0.8
#: Below this share of the highest score that can be, the lowest threshold is next.
LAST = 0.1
#: Sums of squares below this make every inner product exact in double precision.
EXACT = 2.0**53


class Postings:
    """Rows by dimension, and partial scores against a block of anchors.

    ``x`` (rows) and ``q`` (anchors) hold integers as doubles, so that scores are exact.
    """

    def __init__(self, x: np.ndarray, q: np.ndarray) -> None:
        order = np.argsort(-(x * x).sum(axis=0), kind="stable")
        self.x, self.q = np.ascontiguousarray(x[:, order]), np.ascontiguousarray(q[:, order])
        self.steps = range(0, x.shape[1], DIMS)
        self.rest_x, self.rest_q = self._rest(self.x), self._rest(self.q)
        #: postings read of each row, in steps
        self.depth = np.zeros(len(x), np.int64)
        self.partial = np.zeros((len(x), len(q)))

    def _rest(self, m: np.ndarray) -> np.ndarray:
        """The norm of what follows each step, a little enlarged against rounding; 0 after the last."""
        squares = (m * m)[:, ::-1].cumsum(axis=1)[:, ::-1]
        out = np.zeros((len(m), len(self.steps) + 1))
        out[:, :-1] = np.sqrt(squares[:, :: DIMS]) * (1 + 1e-9) + 1e-6
        return out

    def _open(self, live: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (row, place in ``live``) that may still reach their anchor's threshold."""
        bound = np.empty((len(self.x), len(live)))
        for d in np.unique(self.depth):
            at = self.depth == d
            bound[at] = self.partial[np.ix_(at, live)] + np.outer(self.rest_x[at, d], self.rest_q[live, d])
        return np.nonzero(bound >= t)

    def reaching(self, live: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All (row, place in ``live``, score) with a score of at least the threshold ``t`` of their anchor.

        ``live`` only shrinks from call to call, as postings are read for the live anchors alone.
        """
        last = len(self.steps)
        if (t <= 0).any():
            covered = np.zeros(last + 1)
        else:
            # the largest suffix norm of a row that no anchor can lift to its threshold
            with np.errstate(divide="ignore"):
                covered = 1 / (self.rest_q[live] / t[:, None]).max(axis=0)
        for step in range(last):
            rows = (self.depth == step) & (self.rest_x[:, step] >= covered[step])
            self._read(rows, live, step)
        row, place = self._open(live, t)
        while len(row) > SHARE * len(self.x) * len(live) and self.depth.min(initial=last) < last:
            step = int(self.depth.min())
            self._read(self.depth == step, live, step)
            row, place = self._open(live, t)
        score = np.empty(len(row))
        for a in range(0, len(row), PAIRS):
            r, p = row[a : a + PAIRS], live[place[a : a + PAIRS]]
            score[a : a + PAIRS] = np.einsum("ij,ij->i", self.x[r], self.q[p])
        reached = score >= t[place]
        return row[reached], place[reached], score[reached]

    def _read(self, rows: np.ndarray, live: np.ndarray, step: int) -> None:
        if rows.any():
            dims = slice(step * DIMS, (step + 1) * DIMS)
            self.partial[np.ix_(rows, live)] += self.x[rows, dims] @ self.q[live, dims].T
            self.depth[rows] = step + 1


def _first(group: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the first ``k`` of each group, by score, then smaller id."""
    order = np.lexsort((ids, -score, group))
    g = group[order]
    start = np.searchsorted(g, g)
    return order[np.arange(len(g)) - start < k]


def _best_positives(rows: dict, anchors: dict, k: int) -> tuple:
    """(anchor id, row id, score) of the first ``k`` other rows of each anchor, within one label and block."""
    index = Postings(rows["v"], anchors["v"])
    norm_x, norm_q = np.sqrt((rows["v"] ** 2).sum(axis=1)), np.sqrt((anchors["v"] ** 2).sum(axis=1))
    most = norm_q * norm_x.max(initial=0)
    out = []

    # the last threshold is below every score
    floor = -most - 1
    live, t = np.arange(len(most)), 0.8 * most
    while len(live):
        row, place, score = index.reaching(live, t)
        other = rows["id"][row] != anchors["id"][live[place]]
        row, place, score = row[other], place[other], score[other]
        full = (np.bincount(place, minlength=len(live)) >= k) | (t <= floor[live])
        done = full[place]
        row, place, score = row[done], place[done], score[done]
        at = _first(place, score, rows["id"][row], k)
        out.append((anchors["id"][live[place[at]]], rows["id"][row[at]], score[at]))
        live, t = live[~full], t[~full] * FALL_POSITIVES
        t = np.where(t <= LAST * most[live], floor[live], t)
    return tuple(np.concatenate(c) for c in zip(*out, strict=True)) if out else ()


def _best_negatives(rows: dict, anchors: dict, k: int, low: int, high: int) -> tuple:
    """(anchor id, positive id, positive score, row id, score): the first ``k`` in each window, within one block.

    An anchor's windows: one for each of its positives, from low to high percent of its score.
    """
    owner = np.repeat(np.arange(len(anchors["id"])), [len(p) for p in anchors["positives"]])
    if not len(owner):
        return ()
    wanted = [p for positives in anchors["positives"] for p in positives]
    score_of = np.array([p["score"] for p in wanted], np.int64)
    id_of = np.array([p["vec_id"] for p in wanted], np.int64)
    # 100 n from low p to high p, in whole numbers: scores are below 2^53, percentages at most 100
    least, most = -(-low * score_of // 100), high * score_of // 100
    count = len(anchors["id"])
    top, floor = np.full(count, -np.inf), np.full(count, np.inf)
    # a positive of negative score leaves no window: low percent of it is above high percent
    holds = least <= most
    np.maximum.at(top, owner[holds], most[holds].astype(float))
    np.minimum.at(floor, owner[holds], least[holds].astype(float))
    index = Postings(rows["v"], anchors["v"])
    begin = np.searchsorted(owner, np.arange(count + 1))
    out = []
    live = np.flatnonzero(np.isfinite(floor))
    t = np.maximum(np.where(top[live] > 0, 0.9 * top[live], top[live]), floor[live])
    while len(live):
        row, place, score = index.reaching(live, t)
        other = rows["label"][row] != anchors["label"][live[place]]
        row, place, score = row[other], place[other], score[other].astype(np.int64)
        # a pair for each window of its anchor that it lies in
        size = (begin[1:] - begin[:-1])[live]
        pair = np.repeat(np.arange(len(row)), size[place])
        window = begin[live[place[pair]]] + np.arange(len(pair)) - np.searchsorted(pair, pair)
        inside = (score[pair] >= least[window]) & (score[pair] <= most[window])
        pair, window = pair[inside], window[inside]
        held = np.bincount(window, minlength=len(owner))
        full = np.ones(count, bool)
        np.logical_and.at(full, owner, (held >= k) | ~holds)
        full = full[live] | (t <= floor[live])
        done = full[place[pair]]
        pair, window = pair[done], window[done]
        at = _first(window, score[pair], rows["id"][row[pair]], k)
        pair, window = pair[at], window[at]
        out.append((anchors["id"][live[place[pair]]], id_of[window], score_of[window], rows["id"][row[pair]], score[pair]))
        live, t = live[~full], t[~full]
        t = np.maximum(np.where(t <= LAST * top[live], -np.inf, t * FALL_NEGATIVES), floor[live])
    return tuple(np.concatenate(c) for c in zip(*out, strict=True)) if out else ()


def _usable(v: Column) -> Column:
    """Whole vectors of whole numbers whose inner products are exact."""
    squares = F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    return F.coalesce(F.when(F.exists(v, lambda x: x.isNull()), False).otherwise(squares < EXACT), F.lit(False))


def _dealt(rows: DataFrame, counts: DataFrame, keys: list[str], positives: DataFrame | None) -> DataFrame:
    """Rows and anchors of a key, in blocks of at most about ROWS and ANCHORS, each block met by each of the other side."""
    few = counts.count() <= BROADCAST_KEYS // 8
    sized = rows.join(F.broadcast(counts) if few else counts, keys)
    row_blocks = F.ceil(F.col("n") / ROWS).cast("int")
    anchor_blocks = F.ceil(F.col("a") / ANCHORS).cast("int")
    spread = F.xxhash64("vec_id")
    none = F.lit(None).cast("array<struct<vec_id:bigint,score:bigint>>")
    as_rows = sized.where("a > 0").select(
        *keys, F.pmod(spread, row_blocks).cast("int").alias("rb"), F.explode(F.sequence(F.lit(0), anchor_blocks - 1)).alias("ab"),
        F.lit(0).alias("side"), "vec_id", "v", F.col("label").alias("own"), none.alias("positives"),
    )
    asked = sized.where("anchor")
    asked = asked.withColumn("positives", none) if positives is None else asked.join(positives, "vec_id")
    as_anchors = asked.select(
        *keys, F.explode(F.sequence(F.lit(0), row_blocks - 1)).alias("rb"), F.pmod(spread, anchor_blocks).cast("int").alias("ab"),
        F.lit(1).alias("side"), "vec_id", "v", F.col("label").alias("own"), "positives",
    )
    key = [*keys, "rb", "ab"]
    return as_rows.unionAll(as_anchors).repartition(*key).sortWithinPartitions(*key)


def _joined(keys: list[str], work: Callable[[dict, dict], tuple], names: list[str]) -> Callable:
    """A function over sorted blocks that runs ``work`` on the rows and anchors of each."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in runs(batches, [*keys, "rb", "ab"]):
            side = block["side"].to_numpy()
            if side.all() or not side.any():
                continue
            parts = []
            for s in (0, 1):
                part = block.filter(pa.array(side == s)).combine_chunks()
                parts.append({
                    "id": part["vec_id"].to_numpy(), "label": part["own"].to_numpy(),
                    "v": matrix(part["v"].combine_chunks()), "positives": part["positives"].to_pylist() if s else None,
                })
            found = work(*parts)
            if found and len(found[0]):
                yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in found], names=names)

    return run


def mine(vectors: DataFrame, anchors: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``vectors`` has vec_id, label (a whole number) and embedding, an array of whole
    numbers; ``anchors`` is true for the rows to mine for. A score is the inner product
    with the anchor, exact; higher ones come first, ties by smaller vec_id. An anchor's
    positives are its first ``positives`` other rows of its label (all, if fewer). For each
    of them the first ``negatives`` rows of other labels are returned (all, if fewer) whose
    score lies between ``low`` and ``high`` percent of the positive's.

    Rows without vec_id, label or vector, with null components, or with a sum of squares of
    2^53 or more (their scores could not be told exactly) take no part. Of rows that share
    a vec_id the smallest (label, vector) counts. Vectors of different lengths do not
    compare; of length 0 all score 0. Other columns are not used. An empty table, or one
    without anchors, gives none.

    Anchors meet rows in blocks, of their own label for positives and of all labels for
    negatives. A block leaves the first few of each anchor or window, so neither a label of
    very many rows nor copies of a vector make a large group.
    """
    v = F.col("embedding")
    kept = vectors.select("vec_id", F.col("label").cast("long").alias("label"), v.alias("v"), F.coalesce(anchors, F.lit(False)).alias("anchor"))
    kept = kept.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & _usable(F.col("v")))
    kept = kept.select("vec_id", F.struct("label", F.col("v").cast("array<int>").alias("v"), "anchor").alias("r"))
    rows = written(kept.groupBy("vec_id").agg(F.min("r").alias("r")).select("vec_id", "r.label", "r.v", F.size("r.v").alias("dim"), "r.anchor"))
    counted = [F.count("*").alias("n"), F.count_if("anchor").alias("a")]

    by_label = ["label", "dim"]
    found = _dealt(rows, rows.groupBy(*by_label).agg(*counted), by_label, None).mapInArrow(
        _joined(by_label, lambda x, q: _best_positives(x, q, positives), ["vec_id", "positive_id", "score"]),
        "vec_id long, positive_id long, score long",
    )
    order = Window.partitionBy("vec_id").orderBy(F.desc("score"), "positive_id")
    best = found.withColumn("k", F.row_number().over(order)).where(F.col("k") <= positives)
    # at most ``positives`` of each anchor
    lists = best.groupBy("vec_id").agg(F.array_sort(F.collect_list(F.struct(F.col("positive_id").alias("vec_id"), "score"))).alias("positives"))
    lists = written(lists)

    by_length = ["dim"]
    names = ["anchor_id", "positive_id", "positive_score", "negative_id", "negative_score"]
    found = _dealt(rows, rows.groupBy(*by_length).agg(*counted), by_length, lists).mapInArrow(
        _joined(by_length, lambda x, q: _best_negatives(x, q, negatives, low, high), names), ", ".join(f"{n} long" for n in names)
    )
    order = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id")
    return (
        found.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= negatives)
        .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    )


ORACLE_SQL = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id, list_dot_product(a.e, b.e)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
p AS (SELECT anchor_id, vec_id, score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, p.vec_id AS positive_id,
  (row_number() OVER (PARTITION BY anchor_id, p.vec_id ORDER BY s.score DESC, s.vec_id))::INTEGER AS rank,
  s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score
FROM p JOIN s USING (anchor_id)
WHERE NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score
QUALIFY rank <= 3"""
