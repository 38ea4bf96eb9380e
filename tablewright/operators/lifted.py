"""Kernel models fitted without a stored copy of the lifted rows.

Lifted rows are 256 numbers each; the blocks Spark ML stores for a fit are many times the
input.  Here the plain features are packed once into blocks, and each pass lifts a few
hundred rows at a time, adds up loss and gradient, and forgets them.  The objectives and the
optimisers are those of ``LinearSVC`` and of ``LinearRegression`` with Huber loss; all
classes share a pass, and so do the steps a line search is likely to ask for next.
"""

from __future__ import annotations

from collections.abc import Callable, Generator, Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
from pyspark import StorageLevel
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LinearSVCModel, OneVsRestModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.regression import LinearRegression, LinearRegressionModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Rows lifted at once: their 256 numbers stay in a core's cache.
STRIP = 256
# Cells of a packed block: 4 MB.
BLOCK_CELLS = 1 << 19
MEMORY = 10  # steps the optimisers remember, as in Spark ML


# --- rows ---------------------------------------------------------------------------------


def packed_rows(df: DataFrame, label: str, features: str):
    """An RDD of blocks ``(labels, shape, positions, values)``; positions are None for a dense block."""

    def pack(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            if not batch.num_rows:
                continue
            y = np.asarray(batch.column(0), dtype=float)
            cells = batch.column(1)
            x = np.asarray(cells.flatten(), dtype=float).reshape(len(y), -1)
            if cells.null_count or not (np.isfinite(x).all() and np.isfinite(y).all()):
                raise ValueError("labels and features must be finite numbers")
            step = max(1, BLOCK_CELLS // max(1, x.shape[1]))
            for k in range(0, len(y), step):
                part = x[k : k + step]
                at = np.flatnonzero(part) if 4 * np.count_nonzero(part) < part.size else None
                values = part.ravel() if at is None else part.ravel()[at]
                row = [y[k : k + step], np.array(part.shape), at, values]
                yield pa.RecordBatch.from_pydict({n: pa.array([None if v is None else v.tobytes()], pa.binary()) for n, v in zip("yspv", row)})

    def block(row):
        numbers = lambda b, kind=float: None if b is None else np.frombuffer(b, kind)
        return numbers(row[0]), tuple(numbers(row[1], np.int64).tolist()), numbers(row[2], np.int64), numbers(row[3])

    rows = df.select(F.col(label).cast("double"), vector_to_array(F.col(features)))
    return rows.mapInArrow(pack, "y binary, s binary, p binary, v binary").rdd.map(block)


@dataclass(frozen=True)
class Lift:
    """``z = sqrt(2 / width) cos(xW + b)`` as ``r = 1 / (1 + tan((xW + b) / 2)^2)``, where cos = 2r - 1.

    Scaled and centred, z and r are the same numbers; the tangent of whole vectors is
    several times faster than the cosine.
    """

    half: np.ndarray  # W / 2 with b / 2 as its last row

    @staticmethod
    def of(stage: Any) -> Lift:
        w, b = stage.draw()
        return Lift(np.vstack([w, b]) / 2.0)

    def strips(self, blocks: Iterator) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """``(labels, r)`` of a strip of rows; ``r`` is overwritten by the next one."""
        size, width = self.half.shape[0] - 1, self.half.shape[1]
        x, out = np.ones((STRIP, size + 1)), np.empty((STRIP, width))
        for y, shape, at, values in blocks:
            if at is None:
                cells = values.reshape(shape)
            else:
                cells = np.zeros(shape)
                cells.ravel()[at] = values
            for k in range(0, len(y), STRIP):
                n = min(STRIP, len(y) - k)
                x[:n, :size] = cells[k : k + n]
                r = out[:n]
                np.matmul(x[:n], self.half, out=r)
                np.tan(r, out=r)
                np.multiply(r, r, out=r)
                np.add(r, 1.0, out=r)
                np.reciprocal(r, out=r)
                yield y[k : k + n], r


def moments(blocks, lift: Lift) -> tuple[int, np.ndarray, np.ndarray, float]:
    """Rows, means and deviations of ``(label, r...)``, and the greatest label."""

    def add(a, b):
        (n, m, s, top), (k, mean, squares, high) = a, b
        d = mean - m
        return n + k, m + d * (k / (n + k)), s + squares + d * d * (n * k / (n + k)), max(top, high)

    def part(rows):
        found = None
        for y, r in lift.strips(rows):
            z = np.column_stack([y, r])
            mean = z.mean(axis=0)
            one = len(y), mean, ((z - mean) ** 2).sum(axis=0), float(y.max())
            found = one if found is None else add(found, one)
        return [] if found is None else [found]

    parts = blocks.mapPartitions(part).collect()
    if not parts:
        raise ValueError("no rows to fit on")
    total = parts[0]
    for p in parts[1:]:
        total = add(total, p)
    n, mean, squares, top = total
    deviation = np.sqrt(squares / max(n - 1, 1))
    deviation[1:][deviation[1:] <= 1e-14] = 0.0  # equal rows that differ by rounding
    return n, mean, deviation, top


# --- optimisers: each asks for points, the first of which it needs, and is sent their (value, gradient) ---

Asking = Generator[list[np.ndarray], list[tuple[float, np.ndarray]], np.ndarray]


class SearchFailed(Exception):
    """A step could not be found; the history is dropped once, then the search ends."""


class Oracle:
    """Remembers what was sent, so that guesses made early are not asked for again."""

    def __init__(self):
        self.known: dict[bytes, tuple[float, np.ndarray]] = {}

    def at(self, x: np.ndarray, *guesses: np.ndarray):
        if x.tobytes() not in self.known:
            asked = {p.tobytes(): p for p in (x, *guesses) if p.tobytes() not in self.known}
            found = yield list(asked.values())
            self.known |= dict(zip(asked, found))
        return self.known[x.tobytes()]

    def forget(self, x: np.ndarray) -> None:
        """Only ``x`` is kept: a search goes on from there."""
        self.known = {k: v for k, v in self.known.items() if k == x.tobytes()}


def _converged(value: float, gradient: np.ndarray, first: float, last: list[float], tol: float) -> bool:
    flat = len(last) >= 2 and abs(value - max(last)) <= tol * abs(first)
    return flat or bool(np.linalg.norm(gradient) <= max(tol * abs(value), 1e-8))


def two_loops(gradient: np.ndarray, history: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The quasi-Newton direction; ``history`` has the latest ``(step, gradient change)`` first."""
    scale = 1.0
    if history:
        s, y = history[0]
        if not s @ y >= 0:
            raise SearchFailed
        scale = (s @ y) / (y @ y)
    out, ratios = gradient.copy(), []
    with np.errstate(all="ignore"):
        for s, y in history:
            ratios.append((s @ out) / (s @ y))
            if np.isnan(ratios[-1]):
                raise SearchFailed
            out -= ratios[-1] * y
        out *= scale
        for (s, y), a in zip(reversed(history), reversed(ratios)):
            out += (a - (y @ out) / (s @ y)) * s
    return -out


def owlqn(start: np.ndarray, rounds: int, tol: float) -> Asking:
    """Orthant-wise quasi-Newton without an L1 term: the optimiser of ``LinearSVC``."""
    oracle, x, done, failed = Oracle(), start, 0, False
    value, gradient = yield from oracle.at(x)
    first, history, last = value, [], [np.inf]
    while done < rounds and not _converged(value, gradient, first, last, tol):
        try:
            d = two_loops(gradient, history)
            d = np.where(d * gradient < 0, d, 0.0)
            orthant = np.where(x != 0, np.sign(x), np.sign(-gradient))

            def step(alpha):
                moved = x + d * alpha
                return moved * (np.sign(moved) == orthant)

            alpha = yield from _backtrack(oracle, step, d, value, gradient, done)
            new = step(alpha)
            new_value, new_gradient = yield from oracle.at(new)
        except SearchFailed:
            if failed:
                break
            failed, history = True, []
            continue
        history = [(new - x, new_gradient - gradient), *history][:MEMORY]
        x, value, gradient, done, failed = new, new_value, new_gradient, done + 1, False
        last = [*last, value][-20:]
        oracle.forget(x)
    return x


def _backtrack(oracle: Oracle, step: Callable, d: np.ndarray, value: float, gradient: np.ndarray, done: int):
    """Shrink or grow the step until both Wolfe conditions hold.

    The first step is judged by the value the search starts from, as the optimiser of
    Spark ML does, so it shrinks wherever the direction descends; its own value is not
    asked for then.
    """
    shrink, slope = (0.5 if done else 0.1), float(gradient @ d)
    alpha, fresh = (1.0 if done else 0.5 / np.linalg.norm(gradient)), True
    for k in range(21):
        if fresh and value > value + alpha * slope * 1e-4:
            factor = shrink
        else:
            found, g = yield from oracle.at(step(alpha), *(step(alpha * f) for f in (shrink, 2.1)))
            found, rate, fresh = (value if fresh else found), float(g @ d), False
            if found > value + alpha * slope * 1e-4:
                factor = shrink
            elif rate < 0.9 * slope:
                factor = 2.1
            elif rate > -0.9 * slope:
                factor = shrink
            else:
                return alpha
        alpha, fresh = alpha * factor, False
        if k == 20 or not 1e-10 <= alpha <= 1e10:
            raise SearchFailed
    raise SearchFailed


@dataclass
class Compact:
    """The quasi-Newton matrix ``theta I - W M W'`` of the bounded optimiser."""

    theta: float
    w: np.ndarray
    m: np.ndarray
    steps: list[np.ndarray]
    changes: list[np.ndarray]

    @staticmethod
    def empty(n: int) -> Compact:
        return Compact(1.0, np.zeros((n, 1)), np.zeros((1, 1)), [], [])

    def updated(self, s: np.ndarray, y: np.ndarray) -> Compact:
        if not 2.2e-16 * (y @ y) < abs(s @ y):
            return self
        steps, changes = [*self.steps, s][-MEMORY:], [*self.changes, y][-MEMORY:]
        theta = (y @ y) / (y @ s)
        by_step, by_change = np.column_stack(steps), np.column_stack(changes)
        a = by_step.T @ by_change
        low = np.tril(a, -1)
        middle = np.block([[-np.diag(np.diag(a)), low.T], [low, theta * (by_step.T @ by_step)]])
        try:
            inverse = np.linalg.inv(middle)
        except np.linalg.LinAlgError as error:
            raise SearchFailed from error
        return Compact(theta, np.hstack([by_change, theta * by_step]), inverse, steps, changes)


def _cauchy(h: Compact, x: np.ndarray, g: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first minimum along the gradient bent at the bounds, and ``W'`` times the way there."""
    n = len(x)
    with np.errstate(over="ignore", divide="ignore", invalid="ignore"):
        t = np.where(g == 0, np.finfo(float).max, (x - np.where(g < 0, high, low)) / g)
    d = np.where(t == 0, 0.0, -g)
    point, p, c = x.copy(), h.w.T @ d, np.zeros(h.m.shape[0])
    slope = g @ d
    bend = -h.theta * slope - p @ (h.m @ p)
    least, gone = -(slope / bend), 0.0
    order = np.argsort(t, kind="stable")
    i = int(np.argmax(t[order] != 0)) if (t != 0).any() else n
    while i < n and least >= t[order[i]] - gone:
        b = order[i]
        span, gone = t[b] - gone, t[b]
        point[b] = high[b] if d[b] > 0 else low[b]
        c = c + p * span
        row, away = h.w[b], point[b] - x[b]
        slope += span * bend + g[b] * g[b] + h.theta * g[b] * away - g[b] * (row @ (h.m @ c))
        bend += -h.theta * g[b] * g[b] - 2.0 * g[b] * (row @ (h.m @ p)) - g[b] * g[b] * (row @ (h.m @ row))
        p = p + row * g[b]
        d[b] = 0.0
        least = -slope / bend
        i += 1
    least = max(least, 0.0)
    rest = order[i:]
    point[rest] = x[rest] + (gone + least) * d[rest]
    return point, c + p * least


def _subspace(h: Compact, point: np.ndarray, x: np.ndarray, c: np.ndarray, g: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The minimum of the model over what is not at a bound, cut where it would leave the bounds."""
    free = np.flatnonzero((point != low) & (point != high))
    w = h.w[free].T
    rest = (g + h.theta * (point - x) - h.w @ (h.m @ c))[free]
    v = h.m @ (w @ rest)
    v = np.linalg.solve(np.eye(len(v)) - h.m @ (w @ w.T / h.theta), v)
    way = -(rest / h.theta + w.T @ v / h.theta**2)
    with np.errstate(over="ignore", divide="ignore", invalid="ignore"):
        room = (np.where(way > 0, high[free], low[free]) - point[free]) / way
    out = point.copy()
    out[free] += min(1.0, room[way != 0].min(initial=1.0)) * way
    return out


def lbfgsb(start: np.ndarray, low: np.ndarray, high: np.ndarray, rounds: int, tol: float) -> Asking:
    """Bounded quasi-Newton: the optimiser of ``LinearRegression`` with Huber loss."""
    oracle, x, done, failed = Oracle(), start, 0, False
    value, gradient = yield from oracle.at(x)
    first, history, last = value, Compact.empty(len(x)), [np.inf]
    while done < rounds and not _converged(value, gradient, first, last, tol):
        if np.abs(np.clip(x - gradient, low, high) - x).max() < 1e-5:
            break
        try:
            point, c = _cauchy(history, x, gradient, low, high)
            d = (_subspace(history, point, x, c, gradient, low, high) if done else point) - x

            def step(alpha):
                return np.clip(x + d * alpha, low, high)

            with np.errstate(over="ignore", divide="ignore", invalid="ignore"):
                bound = ((np.where(d < 0, low, high) - x) / d)[d != 0].min(initial=np.inf)
            alpha = yield from _strong_wolfe(oracle, step, d, bound)
            new = step(alpha)
            new_value, new_gradient = yield from oracle.at(new)
            history = history.updated(new - x, new_gradient - gradient)
        except SearchFailed:
            if failed:
                break
            failed, history = True, Compact.empty(len(x))
            continue
        x, value, gradient, done, failed = new, new_value, new_gradient, done + 1, False
        last = [*last, value][-20:]
        oracle.forget(x)
    return x


def _strong_wolfe(oracle: Oracle, step: Callable, d: np.ndarray, bound: float, most: int = 64):
    """A step that meets both Wolfe conditions: grown, then narrowed by cubic interpolation."""

    def phi(t, *guesses):
        value, g = yield from oracle.at(step(t), *map(step, guesses))
        return t, float(g @ d), value

    def between(a, b):
        (t, slope, value), (u, rate, other) = a, b
        one = slope + rate - 3 * (value - other) / (t - u)
        two = np.sqrt(one * one - slope * rate) if one * one >= slope * rate else np.nan
        at = u - (u - t) * (rate + two - one) / (rate - slope + 2 * two)
        least, top = t + 0.1 * (u - t), t + 0.9 * (u - t)
        return least if at < least else top if at > top else at

    low = yield from phi(0.0)
    start, slope = low[2], low[1]
    if slope > 0:
        raise SearchFailed

    def zoom(low, high):
        for _ in range(most):
            c = yield from phi(between(high, low) if low[0] > high[0] else between(low, high))
            if c[2] > start + 1e-4 * c[0] * slope or c[2] >= low[2]:
                high = c
                continue
            if abs(c[1]) <= 0.9 * abs(slope):
                return c[0]
            if c[1] * (high[0] - low[0]) >= 0:
                high = low
            low = c
        raise SearchFailed

    t = min(1.0, bound)
    for k in range(most):
        c = yield from phi(t, min(1.5 * t, bound))
        if not np.isfinite(c[2]):
            t /= 2.0
            continue
        if c[2] > start + 1e-4 * t * slope or (c[2] >= low[2] and k):
            return (yield from zoom(low, c))
        if abs(c[1]) <= 0.9 * abs(slope):
            return t
        if c[1] >= 0:
            return (yield from zoom(c, low))
        low = c
        if t == bound:
            return t
        t = min(1.5 * t, bound)
    raise SearchFailed


def solved(searches: list[Asking], ask: Callable[[list[tuple[int, np.ndarray]]], list[tuple[float, np.ndarray]]]) -> list[np.ndarray]:
    """Run searches in step: what all of them want is worked out by one pass over the rows."""
    found: list[Any] = [None] * len(searches)
    wanted = {}
    for k, search in enumerate(searches):
        wanted[k] = next(search)
    while wanted:
        points = [(k, x) for k, many in wanted.items() for x in many]
        sent = iter(ask(points))
        for k, many in list(wanted.items()):
            try:
                wanted[k] = searches[k].send([next(sent) for _ in many])
            except StopIteration as end:
                found[k] = end.value
                del wanted[k]
    return found


# --- objectives -----------------------------------------------------------------------------


def _summed(blocks, lift: Lift, slopes: np.ndarray, offsets: np.ndarray, losses: Callable) -> list[np.ndarray]:
    """Sums over all rows: loss, multiplier and further numbers of each point, and r times the multipliers."""

    def part(rows):
        total = None
        for y, r in lift.strips(rows):
            sums, multiplier = losses(y[:, None], r @ slopes + offsets)
            sums = [*(v.sum(axis=0) for v in sums), multiplier.sum(axis=0), r.T @ multiplier]
            total = sums if total is None else [a + b for a, b in zip(total, sums)]
        return [] if total is None else [total]

    parts = blocks.mapPartitions(part).collect()
    return [sum(p[i] for p in parts) for i in range(len(parts[0]))]


def _hinge(classes: np.ndarray) -> Callable:
    """Each column is one class against the rest."""

    def losses(y, margin):
        sign = np.where(y == classes, 1.0, -1.0)
        loss = 1.0 - sign * margin
        hit = loss > 0
        return [np.where(hit, loss, 0.0)], np.where(hit, -sign, 0.0)

    return losses


def _huber(sigma: np.ndarray, epsilon: float) -> Callable:
    def losses(y, margin):
        e = y - margin
        with np.errstate(over="ignore", divide="ignore", invalid="ignore"):
            near, ratio = np.abs(e) <= sigma * epsilon, e / sigma
            inside = 0.5 * (sigma + e * e / sigma)
            loss = np.where(near, inside, 0.5 * (sigma + 2.0 * epsilon * np.abs(e) - sigma * epsilon * epsilon))
            by_sigma = 0.5 * (1.0 - np.where(near, ratio * ratio, epsilon * epsilon))
            return [loss, by_sigma], np.where(near, -ratio, np.where(e >= 0, -epsilon, epsilon))

    return losses


@dataclass(frozen=True)
class Scaled:
    """What turns weights of scaled and centred r into weights of z, and sums over rows into a gradient."""

    rows: int
    mean: np.ndarray
    inverse: np.ndarray  # one over the deviation, 0 where there is none
    reg: float

    @staticmethod
    def of(rows: int, mean: np.ndarray, deviation: np.ndarray, reg: float) -> Scaled:
        return Scaled(rows, mean, np.divide(1.0, deviation, out=np.zeros_like(deviation), where=deviation > 0), reg)

    def lines(self, points: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Slopes and offsets on r of points ``(weights..., intercept, ...)``."""
        n = len(self.mean)
        slopes = np.column_stack([x[:n] * self.inverse for x in points])
        return slopes, np.array([x[n] for x in points]) - self.mean @ slopes

    def sent(self, points, loss, multiplier, along, *more) -> list[tuple[float, np.ndarray]]:
        out, n = [], len(self.mean)
        for k, x in enumerate(points):
            w = x[:n]
            g = (along[:, k] - self.mean * multiplier[k]) * self.inverse / self.rows + self.reg * w
            rest = [m[k] / self.rows for m in (multiplier, *more)]
            out.append((float(loss[k] / self.rows + 0.5 * self.reg * (w @ w)), np.append(g, rest)))
        return out

    def plain(self, x: np.ndarray, width: int) -> tuple[np.ndarray, float]:
        """Coefficients and intercept on ``z = sqrt(2 / width) (2 r - 1)``."""
        n, half = len(self.mean), np.sqrt(2.0 / width)
        coefficients = x[:n] * self.inverse / (2.0 * half)
        return coefficients, float(x[n] - coefficients @ (half * (2.0 * self.mean - 1.0)))


# --- estimators --------------------------------------------------------------------------------


def _java(spark, name: str, *values):
    return getattr(spark.sparkContext._jvm.org.apache.spark.ml, name.split(".")[0]).__getattr__(name.split(".")[1])(*values)


def _vector(spark, values: np.ndarray):
    from pyspark.ml.common import _py2java

    return _py2java(spark.sparkContext, Vectors.dense(values))


def fit_svc(blocks, lift: Lift, last: Any, spark) -> OneVsRestModel:
    """One linear SVC a class, all in the same passes."""
    svc, width = last.getClassifier(), lift.half.shape[1]
    rows, mean, deviation, top = moments(blocks, lift)
    scale = Scaled.of(rows, mean[1:], deviation[1:], svc.getRegParam())

    def ask(points):
        many = [x for _, x in points]
        slopes, offsets = scale.lines(many)
        loss, multiplier, along = _summed(blocks, lift, slopes, offsets, _hinge(np.array([float(k) for k, _ in points])))
        return scale.sent(many, loss, multiplier, along)

    searches = [owlqn(np.zeros(width + 1), svc.getMaxIter(), svc.getTol()) for _ in range(int(top) + 1)]
    models = []
    for x in solved(searches, ask):
        coefficients, intercept = scale.plain(x, width)
        model = LinearSVCModel(_java(spark, "classification.LinearSVCModel", svc.uid, _vector(spark, coefficients), intercept))
        columns = {svc.featuresCol: last.getFeaturesCol(), svc.predictionCol: last.getPredictionCol()}
        models.append(svc._copyValues(model, columns))
    return last._copyValues(OneVsRestModel(models=models))


def fit_huber(blocks, lift: Lift, last: LinearRegression, spark) -> LinearRegressionModel:
    width = lift.half.shape[1]
    rows, mean, deviation, _ = moments(blocks, lift)
    if deviation[0] == 0:  # equal labels: the library answers with them
        coefficients, intercept, sigma = np.zeros(width), float(mean[0]), 1.0
    else:
        scale = Scaled.of(rows, mean[1:], deviation[1:], last.getRegParam())

        def ask(points):
            many = [x for _, x in points]
            slopes, offsets = scale.lines(many)
            sigma = np.array([x[-1] for x in many])
            loss, by_sigma, multiplier, along = _summed(blocks, lift, slopes, offsets, _huber(sigma, last.getEpsilon()))
            return scale.sent(many, loss, multiplier, along, by_sigma)

        start = np.ones(width + 2)
        start[width] += ((scale.mean - 0.5) * scale.inverse).sum()  # one on rows that are not centred
        low, high = np.full(width + 2, -np.finfo(float).max), np.full(width + 2, np.finfo(float).max)
        low[-1] = 5e-324
        (x,) = solved([lbfgsb(start, low, high, last.getMaxIter(), last.getTol())], ask)
        (coefficients, intercept), sigma = scale.plain(x, width), float(x[-1])
    model = LinearRegressionModel(_java(spark, "regression.LinearRegressionModel", last.uid, _vector(spark, coefficients), intercept, sigma))
    return last._copyValues(model)


class LiftedModel(PipelineModel):
    """Scores from plain rows, lifted strip by strip; the lifted column is worked out only where it is read."""

    def _transform(self, dataset: DataFrame) -> DataFrame:
        stage, last = self.stages
        found = getattr(last, "models", [last])
        lift, width = Lift.of(stage), stage.getOrDefault("width")
        slopes = np.column_stack([m.coefficients.toArray() for m in found]) * np.sqrt(2.0 / width)
        offsets = np.array([m.intercept for m in found]) - slopes.sum(axis=0)

        @F.pandas_udf("array<double>")
        def margins(x):
            import pandas as pd

            cells = np.asarray(x.tolist(), dtype=float)
            block = np.zeros(len(cells)), cells.shape, None, cells
            parts = [r @ (2.0 * slopes) + offsets for _, r in lift.strips(iter([block] if len(cells) else []))]
            return pd.Series(list(np.vstack(parts)) if parts else [])

        out = stage.transform(dataset).withColumn("__margins", margins(vector_to_array(F.col(stage.getInputCol()))))
        answer = F.col("__margins")[0]
        if isinstance(last, OneVsRestModel):
            # The first of the greatest; no margin is greatest where all are NaN.
            answer = F.greatest(F.array_position("__margins", F.array_max("__margins")) - 1, F.lit(0)).cast("double")
            if last.getRawPredictionCol():
                out = out.withColumn(last.getRawPredictionCol(), array_to_vector("__margins"))
        return out.withColumn(last.getPredictionCol(), answer).drop("__margins")


class LiftedPipeline(Pipeline):
    """A lift and a linear model on it; the fit reads plain rows and lifts them in each pass."""

    def _fit(self, dataset: DataFrame) -> PipelineModel:
        stage, last = self.getStages()
        spark = dataset.sparkSession
        blocks = packed_rows(dataset, last.getLabelCol(), stage.getInputCol()).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            fit = fit_huber if isinstance(last, LinearRegression) else fit_svc
            return LiftedModel(stages=[stage, fit(blocks, Lift.of(stage), last, spark)])
        finally:
            blocks.unpersist()
