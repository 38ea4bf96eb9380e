"""One global aggregate for many columns, turned into one row per column.

``per_column`` keeps every measure of every column in a single partial/final
aggregate (one scan, one row through the exchange) and only then spreads that
row out, so a report never costs a shuffle of the data itself.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


def per_column(
    df: DataFrame,
    columns: Sequence[str],
    measures: Callable[[str], Mapping[str, Column]],
    shape: Callable[[str, Mapping[str, Column]], Mapping[str, Column]] | None = None,
    schema: str | None = None,
    wide: DataFrame | None = None,
) -> DataFrame:
    """Aggregate ``measures(c)`` for every column, return one row per column.

    ``shape`` may derive the output fields of a column from its aggregated
    measures.  Measures whose name starts with ``_`` are shared by all columns
    and computed once.  ``schema`` is used when there is nothing to report on.
    ``wide``: the aggregated row, where it is known already.
    """
    aggregates: list[Column] = []
    seen: dict[str, str] = {}
    per_col: dict[str, dict[str, Column]] = {}
    for i, name in enumerate(columns):
        refs: dict[str, Column] = {}
        for key, expr in measures(name).items():
            alias = key if key.startswith("_") else f"m{i}_{key}"
            if alias not in seen:
                seen[alias] = alias
                aggregates.append(expr.alias(alias))
            refs[key] = F.col(alias)
        per_col[name] = refs
    if not aggregates:
        return local_rows(df, [], schema or "column string")
    wide = df.agg(*aggregates) if wide is None else wide
    structs = []
    for name in columns:
        out = per_col[name] if shape is None else shape(name, per_col[name])
        structs.append(
            F.struct(
                F.lit(name).alias("column"),
                *[e.alias(k) for k, e in out.items() if not k.startswith("_")],
            )
        )
    return wide.select(F.inline(F.array(*structs)))


def local_rows(df: DataFrame, rows: Sequence[tuple], schema: str | T.StructType) -> DataFrame:
    """A small report (bounded by columns or checks) as a DataFrame.

    Going through Arrow makes it a local relation of the plan, which needs no job
    and no Python worker, where a list of rows would become a distributed scan.
    """
    kind = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    arrow = to_arrow_schema(kind)
    columns = list(zip(*rows)) if rows else [()] * len(kind)
    arrays = [pa.array(list(c), type=f.type) for c, f in zip(columns, arrow)]
    table = pa.Table.from_arrays(arrays, schema=arrow)
    return df.sparkSession.createDataFrame(table, schema=kind)


def settled(report: DataFrame) -> DataFrame:
    """Run a small report now and keep its rows, so that readers share one run.

    Only for reports bounded by columns, checks or models.
    """
    return local_rows(report, [tuple(r) for r in report.collect()], report.schema)
