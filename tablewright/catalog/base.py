"""Shared pieces of the registered queries and their SQL twins."""

from __future__ import annotations

import os
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..sources.readers import load_table


@dataclass(frozen=True)
class Query:
    """A registered query; ``sql`` is its twin for another engine, if there is one."""

    name: str
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return load_table(spark, os.path.join(folder, f"{name}.parquet"), require_rows=False)


# A view over all of orders with every kind of dirt: gaps that come together, a
# mostly missing and an all-missing column, a constant, untidy categories, dates
# as text, spikes, a leaking column, a rare class and repeated rows.
_DIRTY_COLUMNS = [
    "o_orderkey",
    "o_custkey",
    "CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_totalprice END AS price",
    "CASE WHEN o_orderkey % 20 < 13 THEN NULL ELSE o_totalprice END AS mostly_missing",
    "CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_custkey END AS co_missing",
    "CAST(NULL AS DOUBLE) AS all_missing",
    "'same' AS constant_col",
    "CASE WHEN o_orderkey % 11 = 0 THEN NULL"
    " WHEN o_orderkey % 3 = 0 THEN concat('  ', upper(o_orderpriority), ' ')"
    " ELSE lower(o_orderpriority) END AS messy_cat",
    "CASE WHEN o_orderstatus = 'F' THEN 'Yes' ELSE 'no' END AS flag_text",
    "CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS flag_int",
    "substr(CAST(o_orderdate AS STRING), 1, 10) AS date_text",
    "CASE WHEN o_orderkey % 100 = 1 THEN 'n/a'"
    " ELSE substr(CAST(o_orderdate AS STRING), 1, 10) END AS bad_date_text",
    "CASE WHEN o_orderkey % 500 = 0 THEN o_totalprice * 50 ELSE o_totalprice END AS spiky",
    "o_totalprice * 2 + 1 AS leak",
    "CASE WHEN o_orderkey % 200 = 0 THEN 'rare' ELSE o_orderstatus END AS skewed_class",
]
DIRTY_COLUMNS = [c.rsplit(" AS ", 1)[-1] for c in _DIRTY_COLUMNS]
DIRTY_SQL = (
    "base AS (SELECT "
    + ", ".join(_DIRTY_COLUMNS)
    + " FROM orders), dirty AS (SELECT * FROM base UNION ALL"
    " SELECT * FROM base WHERE o_orderkey % 50 = 0)"
)
SPARSE_SQL = (
    "sparse AS (SELECT c.c_custkey, c.c_acctbal, c.c_mktsegment, o.o_orderkey,"
    " o.o_totalprice, o.o_orderstatus FROM customer c LEFT JOIN orders o"
    " ON c.c_custkey = o.o_custkey AND o.o_orderstatus = 'F' AND o.o_totalprice > 250000)"
)
SPARSE_COLUMNS = [
    "c_custkey",
    "c_acctbal",
    "c_mktsegment",
    "o_orderkey",
    "o_totalprice",
    "o_orderstatus",
]


def dirty_orders(spark: SparkSession, folder: str) -> DataFrame:
    base = table(spark, folder, "orders").selectExpr(*_DIRTY_COLUMNS)
    return base.unionAll(base.where("o_orderkey % 50 = 0"))


def sparse_join(spark: SparkSession, folder: str) -> DataFrame:
    c = table(spark, folder, "customer")
    o = table(spark, folder, "orders").where("o_orderstatus = 'F' AND o_totalprice > 250000")
    return c.join(o, c.c_custkey == o.o_custkey, "left").select(*SPARSE_COLUMNS)


def union_sql(parts: list[str]) -> str:
    return "\nUNION ALL\n".join(parts)
