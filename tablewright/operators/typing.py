"""What a column means, judged from its values."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.report import local_rows
from ..functions.schema import (
    col,
    is_floating,
    is_integral,
    is_nested,
    is_numeric,
    is_temporal,
    is_text,
    text_columns,
)
from ..functions.statistics import Statistics
from ..functions.text import BOOLEAN_TOKENS, DATE_PREFIX, lexical_kind, parse_timestamp
from .frequency import distinct_lookup, value_frequencies

CATEGORICAL_RATIO = 0.05
CATEGORICAL_VALUES = 20
SEMANTIC_TYPES = ("numeric", "categorical", "datetime", "boolean", "text", "unknown")
# A sketched count this many times away from a limit settles the question.
DECISIVE = 2.0


@dataclass(frozen=True)
class ColumnType:
    column: str
    physical_type: str
    semantic_type: str
    unparsed: int = 0


def infer_types(
    df: DataFrame, columns: Sequence[str] | None = None, stats: Statistics | None = None
) -> list[ColumnType]:
    """Classify every column; the first fitting rule wins.

    boolean (two boolean spellings at most), datetime (typed, or date-like text
    that parses throughout), numeric, categorical (few distinct texts), text,
    unknown.  One aggregate answers all rules but the distinct counts of text
    columns; those are sketched in the same pass and counted exactly only where
    the sketch is within a factor of two of a limit.  ``stats``: the answers of
    ``want_types``, where other checks have asked along.
    """
    names = list(columns) if columns is not None else df.columns
    types = {f.name: f.dataType for f in df.schema.fields}
    if stats is None:
        stats = Statistics(df)
        want_types(stats, names)
        stats.collect()
    rows = stats.rows
    boolean: dict[str, bool] = {}
    temporal: dict[str, int] = {}
    open_text: list[str] = []
    for c in names:
        present = stats[f"present:{c}"]
        tokens_only = present == 0 or stats.get(f"bad:{c}") == 0
        boolean[c] = tokens_only
        if is_text(types[c]):
            if tokens_only and present:
                open_text.append(c)
            elif stats[f"dated:{c}"] > 0:
                temporal[c] = 0
            elif _is_close(stats[f"ndv:{c}"], rows):
                open_text.append(c)
    counted = {c: stats.counted[c].distinct for c in open_text if c in stats.counted}
    exact = counted | distinct_lookup(df, [c for c in open_text if c not in counted])
    temporal = _unparsed(df, list(temporal))
    out = []
    for c in names:
        dtype = types[c]
        kind, unparsed = "unknown", 0
        small = exact.get(c)
        # Typed columns can only hold 0/1 or true/false here: two values at most.
        if boolean[c] and not is_nested(dtype) and (small is None or small <= 2):
            kind = "boolean"
        elif is_temporal(dtype):
            kind = "datetime"
        elif is_text(dtype):
            count = small if small is not None else stats[f"ndv:{c}"]
            if c in temporal:
                unparsed = temporal[c]
                kind = "datetime" if unparsed == 0 else "unknown"
            elif count <= CATEGORICAL_VALUES or count <= CATEGORICAL_RATIO * rows:
                kind = "categorical"
            else:
                kind = "text"
        elif is_numeric(dtype):
            kind = "numeric"
        out.append(ColumnType(c, dtype.simpleString(), kind, unparsed))
    return out


def _unparsed(df: DataFrame, names: Sequence[str]) -> dict[str, int]:
    """How many cells of each date-like text column are no date after all."""
    if not names:
        return {}
    bad = [F.count_if(col(c).isNotNull() & parse_timestamp(col(c)).isNull()) for c in names]
    return dict(zip(names, df.agg(*[b.alias(f"u{i}") for i, b in enumerate(bad)]).first()))


def _is_close(estimate: int, rows: int) -> bool:
    if estimate <= CATEGORICAL_VALUES / DECISIVE:
        return False
    limit = max(CATEGORICAL_VALUES, CATEGORICAL_RATIO * rows)
    return limit / DECISIVE < estimate < limit * DECISIVE


def want_types(stats: Statistics, names: Sequence[str]) -> None:
    """What the rules of :func:`infer_types` read."""
    stats.want_presence(names)
    for name in names:
        c, dtype = col(name), stats.types[name]
        if is_nested(dtype) or is_temporal(dtype) or is_floating(dtype):
            continue
        if is_integral(dtype):
            stats.want(f"bad:{name}", F.count_if(~c.isin(0, 1)))
        elif isinstance(dtype, T.BooleanType):
            stats.want(f"bad:{name}", F.max(F.lit(0)))
        else:
            word = c.cast("string")
            stats.want(f"bad:{name}", F.count_if(~F.lower(word).isin(*BOOLEAN_TOKENS)))
        if is_text(dtype):
            stats.want(f"dated:{name}", F.count_if(c.rlike(DATE_PREFIX)))
            stats.want(f"ndv:{name}", F.hll_sketch_estimate(F.hll_sketch_agg(c, 12)))


def column_types(df: DataFrame) -> DataFrame:
    """``(column, physical_type, semantic_type)``, one row per column."""
    rows = [(t.column, t.physical_type, t.semantic_type) for t in infer_types(df)]
    return local_rows(df, rows, "column string, physical_type string, semantic_type string")


def types_by_class(types: Sequence[ColumnType]) -> dict[str, list[str]]:
    out: dict[str, list[str]] = {k: [] for k in SEMANTIC_TYPES}
    for t in types:
        out[t.semantic_type].append(t.column)
    return out


def type_summary(df: DataFrame) -> DataFrame:
    """``(semantic_type, n_columns)`` for all six classes, zero included."""
    by_class = types_by_class(infer_types(df))
    rows = [(k, len(v)) for k, v in by_class.items()]
    return local_rows(df, rows, "semantic_type string, n_columns bigint")


def lexical_kinds(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Kinds of spelling per text column, and whether they are mixed."""
    names = list(columns) if columns is not None else text_columns(df)
    if not names:
        return local_rows(df, [], "column string, kind string, n bigint, is_mixed boolean")
    kinds = df.select(*[lexical_kind(col(c)).alias(c) for c in names])
    counted = value_frequencies(kinds, names).withColumnRenamed("value", "kind")
    # Five kinds per column at most: this second aggregate is tiny.
    mixed = counted.groupBy("column").agg(
        F.collect_list(F.struct("kind", "n")).alias("kinds"), (F.count("*") > 1).alias("is_mixed")
    )
    return mixed.select("column", "is_mixed", F.inline("kinds")).select(
        "column", "kind", "n", "is_mixed"
    )
