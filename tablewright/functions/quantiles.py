"""Exact quantiles with bounded memory on any number of rows.

Spark's ``percentile`` keeps a map of every distinct value of a column in one
task, which a column of doubles outgrows quickly.  Here a bounded sketch only
proposes cut points around each wanted rank.  One small aggregate then counts the
rows on and between the cut points, which tells *exactly* where each rank lies:
on a cut point, whose value is the answer, or inside one zone.  A zone of few
rows is brought to the driver as ``(value, count)``; a larger one is sketched and
cut again, each round shrinking it a few hundred times.  The sketch never decides
a result, only how many rounds are needed.  All rounds are partial aggregates of
a few rows per task: no shuffle of data.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .schema import col

SKETCH_SIZE = 1000
SKETCH_MARGIN = 0.004  # beyond the sketch's own rank error of about 0.002
GATHER_LIMIT = 20_000


@dataclass
class _Zone:
    """Rows strictly between two cut points (None: no bound) and their ranks."""

    column: int
    low: float | None
    high: float | None
    before: int = 0
    rows: int = 0
    least: float | None = None
    most: float | None = None

    def test(self) -> str:
        return _inside(f"v{self.column}", self.low, self.high)


def _inside(v: str, low: float | None, high: float | None) -> str:
    parts = [f"{v} IS NOT NULL"]
    if low is not None:
        parts.append(f"{v} > {_literal(low)}")
    if high is not None:
        parts.append(f"{v} < {_literal(high)}")
    return " AND ".join(parts)


def interpolate(position: float, lower: float, upper: float) -> float:
    """Linear interpolation between two neighbouring order statistics."""
    floor, ceil = math.floor(position), math.ceil(position)
    if floor == ceil or lower == upper:
        return float(lower)
    return (ceil - position) * lower + (position - floor) * upper


def exact_quantiles(
    df: DataFrame,
    columns: Sequence[str],
    probs: Sequence[float],
    gather_limit: int = GATHER_LIMIT,
    cuts: list[list[float]] | None = None,
) -> dict[str, dict[float, float | None]]:
    """``{column: {prob: value}}`` with linear interpolation, NULLs left out.

    ``cuts``: first cut points of each column, where an aggregate of the caller has
    sketched them already (``first_sketch``); they decide how many runs follow, no result.
    """
    names, wanted = list(columns), list(dict.fromkeys(probs))
    if not names or not wanted:
        return {c: {} for c in names}
    data = df.select(*[col(c).cast("double").alias(f"v{i}") for i, c in enumerate(names)])
    cuts = _first_cuts(data, len(names), wanted) if cuts is None else cuts
    whole = {i: (None, None, 0, c) for i, c in enumerate(cuts)}
    zones, points = _count_zones(data, whole, list(whole))
    sizes = {
        i: sum(z.rows for z in zones if z.column == i)
        + sum(n for (c, _), (_, n) in points.items() if c == i)
        for i in range(len(names))
    }
    ranks = {
        (i, r)
        for i, n in sizes.items()
        if n
        for p in wanted
        for r in (math.floor((n - 1) * p), math.ceil((n - 1) * p))
    }
    found: dict[tuple[int, int], float] = {}
    while True:
        open_zones = _settle(ranks, zones, points, found)
        wide = [z for z in open_zones if z.rows > gather_limit]
        _gather(data, [z for z in open_zones if z.rows <= gather_limit], ranks, found)
        if not wide:
            break
        inner = _inner_cuts(data, wide, ranks - set(found))
        plan = {j: (z.low, z.high, z.before, c) for j, (z, c) in enumerate(zip(wide, inner))}
        zones, points = _count_zones(data, plan, [z.column for z in wide])
    out: dict[str, dict[float, float | None]] = {c: {} for c in names}
    for i, c in enumerate(names):
        for p in wanted:
            if not sizes[i]:
                out[c][p] = None
                continue
            position = (sizes[i] - 1) * p
            out[c][p] = interpolate(
                position, found[i, math.floor(position)], found[i, math.ceil(position)]
            )
    return out


def _around(fractions: Sequence[float]) -> list[float]:
    spread = {round(min(max(f + s, 0.0), 1.0), 9) for f in fractions for s in (-SKETCH_MARGIN, SKETCH_MARGIN)}
    return sorted(spread)


def first_sketch(column: str, count: str, sketch: str) -> list:
    """Measures that ``first_cuts`` needs of a column, under the given names."""
    x = col(column).cast("double")
    return [F.count(x).alias(count), F.kll_sketch_agg_double(x, F.lit(SKETCH_SIZE)).alias(sketch)]


def first_cuts(count: str, sketch: str, probs: Sequence[float]):
    """Cut points around the wanted ranks, from a sketch; NULL for a column without values."""
    fractions = F.array(*[F.lit(f) for f in _around(probs)])
    return F.when(F.col(count) > 0, F.kll_sketch_get_quantile_double(sketch, fractions))


def _first_cuts(data: DataFrame, n: int, probs: Sequence[float]) -> list[list[float]]:
    sketches = data.agg(*[m for i in range(n) for m in first_sketch(f"v{i}", f"n{i}", f"k{i}")])
    row = sketches.select(*[first_cuts(f"n{i}", f"k{i}", probs).alias(f"q{i}") for i in range(n)]).first()
    return [sorted(set(row[f"q{i}"] or [])) for i in range(n)]


def _inner_cuts(data: DataFrame, wide: list[_Zone], ranks) -> list[list[float]]:
    """Cut points inside each zone, around the ranks it still holds."""
    sketches = data.agg(
        *[
            F.kll_sketch_agg_double(
                F.expr(f"CASE WHEN {z.test()} THEN v{z.column} END"), F.lit(SKETCH_SIZE)
            ).alias(f"k{j}")
            for j, z in enumerate(wide)
        ]
    )
    picks = []
    for j, z in enumerate(wide):
        held = [r for i, r in ranks if i == z.column and z.before <= r < z.before + z.rows]
        inside = _around([(r - z.before) / max(z.rows - 1, 1) for r in held])
        picks.append(
            F.kll_sketch_get_quantile_double(
                f"k{j}", F.array(*[F.lit(f) for f in inside])
            ).alias(f"q{j}")
        )
    row = sketches.select(*picks).first()
    # The least and the most value are cut points too, so every round makes progress.
    return [
        sorted({*row[f"q{j}"], z.least, z.most}) for j, z in enumerate(wide)
    ]


def _literal(x: float) -> str:
    if math.isinf(x):
        return f"double('{'-' if x < 0 else ''}Infinity')"
    return f"{x!r}D"


def _zone_counts(ranges: list[tuple[int, float | None, float | None, list[float]]]):
    """``(c, z, n, least, most)`` of each zone in the rows of a task: odd on a cut point, even between two.

    A batch is sorted by column, so that the edges of all zones are found by halving;
    what is kept between batches is a row a zone.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[int, int], tuple[int, float, float]] = {}
        for batch in batches:
            ordered: dict[int, np.ndarray] = {}
            for i, (column, low, high, cuts) in enumerate(ranges):
                if column not in ordered:
                    ordered[column] = np.sort(batch.column(f"v{column}").drop_null().to_numpy(zero_copy_only=False))
                values = ordered[column]
                first = 0 if low is None else np.searchsorted(values, low, "right")
                end = len(values) if high is None else np.searchsorted(values, high, "left")
                edges = np.empty(2 * len(cuts) + 2, np.int64)
                edges[0], edges[-1] = first, max(first, end)
                edges[1:-1:2], edges[2:-1:2] = np.searchsorted(values, cuts, "left"), np.searchsorted(values, cuts, "right")
                edges = np.clip(edges, edges[0], edges[-1])
                for z in np.flatnonzero(np.diff(edges)).tolist():
                    start, stop = int(edges[z]), int(edges[z + 1])
                    bottom, top = float(values[start]), float(values[stop - 1])
                    n, least, most = found.get((i, z), (0, bottom, top))
                    found[i, z] = (n + stop - start, min(least, bottom), top if math.isnan(top) else max(most, top))
        rows = [(i, z, *kept) for (i, z), kept in found.items()]
        names = ["c", "z", "n", "least", "most"]
        if rows:
            yield pa.RecordBatch.from_pydict(dict(zip(names, map(list, zip(*rows)), strict=True)))

    return run


def _zone_values(bounds: list[tuple[int, float | None, float | None]]):
    """``(z, v, n)`` of the values strictly inside each zone."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            arrays = {c: batch.column(f"v{c}").drop_null().to_numpy(zero_copy_only=False) for c in {b[0] for b in bounds}}
            for j, (column, low, high) in enumerate(bounds):
                values = arrays[column]
                if low is not None:
                    values = values[(values > low) | np.isnan(values)]
                if high is not None:
                    values = values[values < high]
                if len(values):
                    distinct, n = np.unique(values, return_counts=True)
                    yield pa.RecordBatch.from_pydict({"z": np.full(len(n), j), "v": distinct, "n": n})

    return run


def _count_zones(
    data: DataFrame, plan: dict[int, tuple], columns: list[int]
) -> tuple[list[_Zone], dict]:
    """Exact row counts on and between the cut points of each planned range."""
    ranges = [(columns[i], low, high, cuts) for i, (low, high, _, cuts) in plan.items()]
    used = sorted({f"v{r[0]}" for r in ranges})
    counted = (
        data.select(*used)
        .mapInArrow(_zone_counts(ranges), "c long, z long, n long, least double, most double")
        .groupBy("c", "z")
        .agg(F.sum("n").alias("n"), F.min("least").alias("least"), F.max("most").alias("most"))
        .collect()
    )
    stats = {(r["c"], r["z"]): r for r in counted}
    zones: list[_Zone] = []
    points: dict[tuple[int, int], tuple[float, int]] = {}
    for place, (i, (low, high, before, cuts)) in enumerate(plan.items()):
        edges = [low, *cuts, high]
        for z in range(2 * len(cuts) + 1):
            r = stats.get((place, z))
            if r is None:
                continue
            if z % 2:
                points[columns[i], before] = (cuts[z // 2], r["n"])
            else:
                zones.append(
                    _Zone(columns[i], edges[z // 2], edges[z // 2 + 1], before, r["n"], r["least"], r["most"])
                )
            before += r["n"]
    return zones, points


def _settle(ranks, zones: list[_Zone], points, found) -> list[_Zone]:
    """Answer the ranks that fall on one value; return the zones that hold others."""
    for (i, start), (value, n) in points.items():
        for c, r in ranks:
            if c == i and start <= r < start + n:
                found[c, r] = float(value)
    left = []
    for z in zones:
        held = [(c, r) for c, r in ranks if c == z.column and z.before <= r < z.before + z.rows]
        for c, r in held:
            if r == z.before or z.least == z.most:
                found[c, r] = float(z.least)
            elif r == z.before + z.rows - 1:
                found[c, r] = float(z.most)
        if any(h not in found for h in held):
            left.append(z)
    return left


def _gather(data: DataFrame, zones: list[_Zone], ranks, found) -> None:
    """Bring the distinct values of small zones to the driver and read the ranks off."""
    if not zones:
        return
    used = sorted({f"v{z.column}" for z in zones})
    bounds = [(z.column, z.low, z.high) for z in zones]
    values = (
        data.select(*used)
        .mapInArrow(_zone_values(bounds), "z long, v double, n long")
        .groupBy("z", "v")
        .agg(F.sum("n").alias("n"))
        .toArrow()
        .to_pandas()
        .sort_values(["z", "v"])
    )
    for j, z in enumerate(zones):
        part = values[values["z"] == j]
        upto = part["n"].cumsum().to_numpy() + z.before
        ordered = part["v"].to_numpy()
        for c, r in ranks:
            if c == z.column and z.before <= r < z.before + z.rows:
                found[c, r] = float(ordered[int((upto <= r).sum())])
