"""What several checks want to know of a table, from the few runs that they share.

Checks say what they want: measures (one aggregate over one scan), values counted by
column (one shuffle, map-side first) and quantiles (whose sketches ride in the same
aggregate).  Wants that several checks have in common are worked out once.  What comes
back is bounded by the number of columns, pairs of columns with gaps included.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from decimal import ROUND_HALF_UP, Decimal
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .quantiles import exact_quantiles, first_cuts, first_sketch
from .schema import col, is_floating, is_integral

LONG_TEXT = 48


def short_text(text: Column) -> Column:
    """Long texts by their digest, so that whole texts are not shuffled to be counted."""
    digest = F.concat(F.lit("\u0000"), F.md5(text.cast("binary")))
    return F.when(F.octet_length(text) > LONG_TEXT, digest).otherwise(text)


def half_up(x: float | None, digits: int) -> float | None:
    """Rounded as the engine rounds doubles: half up, on the shortest decimal that names the double."""
    if x is None or not math.isfinite(x) or abs(x) >= 2**53:  # beyond, doubles have no fraction
        return x
    return float(Decimal(repr(float(x))).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP))


@dataclass(frozen=True)
class Counted:
    """The values of a column: how many differ, how many rows hold one, the largest and the smallest count."""

    distinct: int = 0
    rows: int = 0
    most: int = 0
    least: int = 0


def _typed(c: Column, dtype: T.DataType) -> dict[str, Column]:
    """The one field of a counted value that its type uses; equal values are equal there, and only those."""
    if is_integral(dtype):
        return {"l": c.cast("bigint")}
    if is_floating(dtype):
        return {"d": c.cast("double")}
    if isinstance(dtype, T.DateType):
        return {"l": F.unix_date(c).cast("bigint")}
    if isinstance(dtype, T.TimestampType):
        return {"l": F.unix_micros(c)}
    if isinstance(dtype, T.TimestampNTZType):
        return {"t": c}
    return {"s": short_text(c.cast("string"))}


class Statistics:
    """Collects wants, then ``collect`` runs them; afterwards the answers can be read."""

    def __init__(self, df: DataFrame):
        self.df = df
        self.types = {f.name: f.dataType for f in df.schema.fields}
        self._measures: dict[str, Column] = {}
        self._values: list[str] = []
        self._marks: dict[str, Column] = {}
        self._probs: dict[str, list[float]] = {}
        self._gaps = False
        self._row: dict[str, Any] = {}
        self._kinds: dict[str, T.DataType] = {}
        self.counted: dict[str, Counted] = {}
        self.marked: dict[str, Counted] = {}
        #: rows by the number of their missing cells
        self.histogram: dict[int, int] = {}
        #: rows in which both columns of a pair are missing
        self.together: dict[tuple[str, str], int] = {}

    # --- wants ---------------------------------------------------------------

    def want(self, key: str, measure: Column) -> None:
        self._measures.setdefault(key, measure)

    def want_presence(self, columns: Iterable[str] | None = None) -> None:
        self.want("rows", F.count(F.lit(1)))
        for c in self.df.columns if columns is None else columns:
            self.want(f"present:{c}", F.count(col(c)))

    def want_patterns(self) -> None:
        """Which cells are missing together, row by row."""
        self.want_presence()
        self._gaps = True

    def want_values(self, columns: Iterable[str]) -> None:
        self._values = list(dict.fromkeys([*self._values, *columns]))

    def want_marks(self, marks: dict[str, Column]) -> None:
        """Count the values of text expressions, under names of their own."""
        self._marks |= marks

    def want_quantiles(self, columns: Sequence[str], probs: Sequence[float]) -> None:
        for c in columns:
            self._probs[c] = list(dict.fromkeys([*self._probs.get(c, []), *probs]))

    # --- runs ----------------------------------------------------------------

    def collect(self) -> Statistics:
        """One aggregate of all measures and sketches, then one run that counts values."""
        self._aggregate()
        self._count()
        return self

    def _aggregate(self) -> None:
        keys = list(self._measures)
        sketched = list(self._probs)
        made = [self._measures[k].alias(f"m{i}") for i, k in enumerate(keys)]
        made += [a for i, c in enumerate(sketched) for a in first_sketch(c, f"n{i}", f"k{i}")]
        if not made:
            return
        wide = self.df.agg(*made)
        wide = wide.select(
            *[F.col(f"m{i}") for i in range(len(keys))],
            *[first_cuts(f"n{i}", f"k{i}", self._probs[c]).alias(f"q{i}") for i, c in enumerate(sketched)],
        )
        row = wide.first()
        self._row = {k: row[f"m{i}"] for i, k in enumerate(keys)}
        self._kinds = {k: wide.schema[f"m{i}"].dataType for i, k in enumerate(keys)}
        self._cuts = {c: sorted(set(row[f"q{i}"] or [])) for i, c in enumerate(sketched)}

    def _count(self) -> None:
        """Values grouped by (column, value), then by column; gaps by their pattern, then by number and pair."""
        partly = [c for c in self.df.columns if self._gaps and 0 < self.missing(c) < self.rows]
        items = [_typed(col(c), self.types[c]) for c in self._values] + [{"s": m} for m in self._marks.values()]
        if partly:
            items.append({"s": F.concat(*[F.when(col(c).isNull(), "1").otherwise("0") for c in partly])})
        if items:
            self._gather(items, partly)
        empty = sum(1 for c in self.df.columns if self._gaps and self.rows and self.missing(c) == self.rows)
        if self._gaps and not partly and self.rows:
            self.histogram = {empty: self.rows}
        elif empty:
            self.histogram = {k + empty: n for k, n in self.histogram.items()}

    def _gather(self, items: list[dict[str, Column]], partly: list[str]) -> None:
        kinds = {"l": "bigint", "d": "double", "t": "timestamp_ntz", "s": "string"}

        def cell(i: int, item: dict[str, Column]) -> Column:
            values = [item.get(f, F.lit(None)).cast(k).alias(f) for f, k in kinds.items()]
            return F.struct(F.lit(i).alias("c"), *values)

        cells = F.array(*[cell(i, x) for i, x in enumerate(items)])
        groups = (
            self.df.select(F.inline(cells))
            .filter("l IS NOT NULL OR d IS NOT NULL OR t IS NOT NULL OR s IS NOT NULL")
            .groupBy("c", *kinds)
            .agg(F.count("*").alias("n"))
        )
        whole = F.array(F.struct(F.lit(-1).alias("x"), F.lit(-1).alias("y")))
        if partly:
            # a pattern counts under its number of gaps, and under every pair of them
            places = F.filter(F.sequence(F.lit(0), F.lit(len(partly) - 1)), lambda i: F.substring("s", i + 1, F.lit(1)) == "1")
            pairs = F.transform(
                places, lambda a: F.transform(F.filter(places, lambda b: b > a), lambda b: F.struct(a.alias("x"), b.alias("y")))
            )
            number = F.array(F.struct(F.size(places).alias("x"), F.lit(-1).alias("y")))
            whole = F.when(F.col("c") == len(items) - 1, F.concat(number, F.flatten(pairs))).otherwise(whole)
        found = (
            groups.select("c", "n", F.inline(whole))
            .groupBy("c", "x", "y")
            .agg(F.count("*").alias("k"), F.sum("n").alias("rows"), F.max("n").alias("most"), F.min("n").alias("least"))
            .collect()
        )
        names = [*self._values, *self._marks]
        self.counted = {c: Counted() for c in self._values}
        self.marked = {c: Counted() for c in self._marks}
        for r in found:
            if r["c"] < len(names):
                one = Counted(r["k"], r["rows"], r["most"], r["least"])
                (self.counted if r["c"] < len(self._values) else self.marked)[names[r["c"]]] = one
            elif r["y"] >= 0:
                self.together[partly[r["x"]], partly[r["y"]]] = r["rows"]
            else:
                self.histogram[r["x"]] = r["rows"]

    # --- answers -------------------------------------------------------------

    def __getitem__(self, key: str) -> Any:
        return self._row[key]

    def get(self, key: str) -> Any:
        """The measure, or None if nobody wanted it."""
        return self._row.get(key)

    @property
    def rows(self) -> int:
        return self._row.get("rows", 0)

    def missing(self, column: str) -> int:
        return self.rows - self._row[f"present:{column}"]

    def distinct(self, column: str) -> int:
        return self.counted[column].distinct

    def quantiles(self, columns: Sequence[str], probs: Sequence[float]) -> dict[str, dict[float, float | None]]:
        """Exact quantiles of columns whose sketches were wanted: the counting runs are left, the sketching is done."""
        return exact_quantiles(self.df, columns, probs, cuts=[self._cuts[c] for c in columns])

    def one_row(self, names: dict[str, str]) -> list[tuple[str, T.DataType, Any]]:
        """(alias, type, value) of the given measures: ``names`` maps an alias to a key."""
        return [(a, self._kinds[k], self._row[k]) for a, k in names.items()]
