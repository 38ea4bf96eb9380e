"""Registered queries: types, missing data, distinct values, numbers, outliers, target."""

from __future__ import annotations

from ..operators import frequency, missing, numeric, outliers, target, typing
from .base import (
    DIRTY_COLUMNS,
    DIRTY_SQL,
    SPARSE_COLUMNS,
    SPARSE_SQL,
    Query,
    dirty_orders,
    sparse_join,
    table,
    union_sql,
)

LINEITEM_NUMERIC = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
LINEITEM_TEXT = ["l_returnflag", "l_linestatus"]
DIRTY_NUMERIC = [
    "o_orderkey",
    "o_custkey",
    "price",
    "mostly_missing",
    "co_missing",
    "flag_int",
    "spiky",
    "leak",
]
DIRTY_TEXT = ["constant_col", "messy_cat", "flag_text", "date_text", "bad_date_text", "skewed_class"]


def missing_sql(columns, source, ctes):
    parts = [
        f"SELECT '{c}' AS \"column\", count(*) AS n_rows, count(*) - count({c}) AS missing_count,"
        f" round((count(*) - count({c})) * 100.0 / count(*), 2)::DOUBLE AS missing_pct FROM {source}"
        for c in columns
    ]
    return f"WITH {ctes}, by_column AS ({union_sql(parts)})"


def row_missing_sql(columns, source, ctes):
    cells = " + ".join(f"(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END)" for c in columns)
    return f"WITH {ctes}, per_row AS (SELECT ({cells}) * 100.0::DOUBLE / {len(columns)} AS x FROM {source})"


def distinct_sql(columns, source):
    return union_sql(
        [
            f"SELECT '{c}' AS \"column\", count(DISTINCT {c}) AS n_distinct, count(*) AS n_rows FROM {source}"
            for c in columns
        ]
    )


def frequency_sql(columns, source):
    return union_sql(
        [
            f"SELECT '{c}' AS \"column\", CAST({c} AS VARCHAR) AS value, count(*) AS n FROM {source}"
            f" WHERE {c} IS NOT NULL GROUP BY {c}"
            for c in columns
        ]
    )


def describe_sql(columns, source, with_ctes=""):
    probs = (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99)
    names = ("p01", "p05", "p25", "p50", "p75", "p95", "p99")
    parts = []
    for c in columns:
        points = ", ".join(
            f"round(quantile_cont({c}::DOUBLE, {p}), 4) AS {n}" for p, n in zip(probs, names)
        )
        parts.append(
            f"SELECT '{c}' AS \"column\", count({c}) AS count, round(avg({c}), 4) AS mean,"
            f" round(stddev_samp({c}), 4) AS std, round(min({c})::DOUBLE, 4) AS min, {points},"
            f" round(max({c})::DOUBLE, 4) AS max FROM {source}"
        )
    return with_ctes + union_sql(parts)


def outlier_sql(columns, source, method, with_ctes="", t=1.5):
    parts = []
    for c in columns:
        x = f"{c}::DOUBLE"
        if method == "iqr":
            stats = f"quantile_cont({x}, 0.25) AS a, quantile_cont({x}, 0.75) AS b"
            hit = f"x < a - {t} * (b - a) OR x > b + {t} * (b - a)"
            head = f"(SELECT {stats} FROM {source})"
        elif method == "zscore":
            head = f"(SELECT avg({x}) AS a, stddev_samp({x}) AS b FROM {source})"
            hit = f"b > 0 AND abs((x - a) / b) > {t}"
        else:
            head = (
                f"(SELECT a, quantile_cont(abs(x - a), 0.5) AS b FROM (SELECT {x} AS x FROM {source}),"
                f" (SELECT quantile_cont({x}, 0.5) AS a FROM {source}) GROUP BY a)"
            )
            hit = f"(b = 0 AND x <> a) OR (b > 0 AND abs(0.6745 * (x - a) / b) > {t})"
        parts.append(
            f"SELECT '{c}' AS \"column\", '{method}' AS method, count(*) FILTER (WHERE {hit}) AS outliers,"
            f" round(count(*) FILTER (WHERE {hit}) * 100.0 / count(x), 2)::DOUBLE AS outlier_pct"
            f" FROM (SELECT {x} AS x FROM {source}), {head}"
        )
    return with_ctes + union_sql(
        [f"SELECT * FROM ({p}) WHERE outliers IS NOT NULL" for p in parts]
    )


# Sixteen columns with gaps that come in different rows.
WIDE_COLUMNS = [f"c{i}" for i in range(16)]
WIDE_SQL = (
    "SELECT "
    + ", ".join(
        f"CASE WHEN l_orderkey % {i + 7} <> 0 THEN"
        f" {('l_quantity', 'l_extendedprice', 'l_discount', 'l_tax')[i % 4]} * {i + 1} + l_partkey % {i + 2} END AS c{i}"
        for i in range(16)
    )
    + " FROM lineitem"
)


def _wide(spark, folder):
    return table(spark, folder, "lineitem").selectExpr(*WIDE_SQL[len("SELECT ") : -len(" FROM lineitem")].split(", "))


def _epochs(spark, folder):
    return table(spark, folder, "events").selectExpr("unix_millis(cast(ts AS timestamp)) AS epoch_ms")


def _endless(spark, folder):
    """Events with a copy of the value, and one in which some values are infinite."""
    return table(spark, folder, "events").selectExpr(
        "value",
        "user_id",
        "value * 3 + 1 AS twin",
        "CASE WHEN event_id % 90 = 1 THEN double('Infinity') WHEN event_id % 90 = 2 THEN double('-Infinity') ELSE value END AS endless",
    )


# (table, column, kind of storage) of all given tables, as the files declare them.
GIVEN_TABLES = {
    "region": "r_regionkey:int r_name:string",
    "nation": "n_nationkey:int n_name:string n_regionkey:int",
    "customer": "c_custkey:bigint c_name:string c_nationkey:int c_acctbal:double c_mktsegment:string",
    "supplier": "s_suppkey:bigint s_name:string s_nationkey:int s_acctbal:double",
    "part": "p_partkey:bigint p_name:string p_brand:string p_type:string p_size:int"
    " p_retailprice:double",
    "orders": "o_orderkey:bigint o_custkey:bigint o_orderstatus:string o_totalprice:double"
    " o_orderdate:timestamp_ntz o_orderpriority:string",
    "lineitem": "l_orderkey:bigint l_partkey:bigint l_suppkey:bigint l_linenumber:int"
    " l_quantity:double l_extendedprice:double l_discount:double l_tax:double l_returnflag:string"
    " l_linestatus:string l_shipdate:timestamp_ntz",
    "events": "event_id:bigint ts:timestamp_ntz user_id:bigint event_type:string value:double"
    " props:string",
    "documents": "doc_id:bigint text:string lang:string source:string n_chars:bigint",
    "embeddings": "vec_id:bigint embedding:array<float> label:int",
    "pages": "page_id:bigint url:string html:string",
    "benchmark": "item_id:bigint text:string",
    "labels": "doc_id:bigint quality:int toxic:int",
    "conversations": "conv_id:bigint turn:bigint role:string text:string",
}


def type_sql(column, kind, source):
    """The typing rules of one column as SQL, value by value."""
    if kind.startswith("array"):
        rule = "CASE WHEN count(*) >= 0 THEN 'unknown' END"
    elif kind == "string":
        rule = (
            f"CASE WHEN count(DISTINCT {column}) <= 2 AND coalesce(bool_and(lower({column}) IN"
            " ('true','false','1','0','yes','no','y','n')), true) THEN 'boolean'"
            f" WHEN coalesce(bool_or(regexp_matches({column}, '^\\d{{4}}-\\d{{2}}-\\d{{2}}')), false) THEN"
            f" CASE WHEN count({column}) = count(TRY_CAST({column} AS TIMESTAMP)) THEN 'datetime'"
            " ELSE 'unknown' END"
            f" WHEN count(DISTINCT {column}) <= 20 OR count(DISTINCT {column}) <= 0.05 * count(*)"
            " THEN 'categorical' ELSE 'text' END"
        )
    elif kind == "timestamp_ntz":
        rule = f"CASE WHEN count({column}) = 0 THEN 'boolean' ELSE 'datetime' END"
    elif kind == "double":
        rule = f"CASE WHEN count({column}) = 0 THEN 'boolean' ELSE 'numeric' END"
    else:
        rule = f"CASE WHEN coalesce(bool_and({column} IN (0, 1)), true) THEN 'boolean' ELSE 'numeric' END"
    return (
        f"SELECT '{column}' AS \"column\", '{kind}' AS physical_type, {rule} AS semantic_type FROM {source}"
    )


def given_types(spark, folder):
    from pyspark.sql import functions as F

    out = None
    for name in GIVEN_TABLES:
        part = typing.column_types(table(spark, folder, name)).withColumn("table_name", F.lit(name))
        out = part if out is None else out.union(part)
    return out


GIVEN_TYPES_SQL = union_sql(
    [
        f"SELECT t.*, '{name}' AS table_name FROM ({type_sql(*f.split(':', 1), name)}) t"
        for name, fields in GIVEN_TABLES.items()
        for f in fields.split()
    ]
)

DIRTY_KINDS = dict(
    zip(
        DIRTY_COLUMNS,
        "bigint bigint double double bigint double string string string int string string double"
        " double string".split(),
    )
)
DIRTY_TYPES_SQL = union_sql([type_sql(c, k, "dirty") for c, k in DIRTY_KINDS.items()])
DIRTY = f"WITH {DIRTY_SQL} "
LEXICAL_SQL = (
    "CASE WHEN regexp_matches({c}, '^[+-]?[0-9]+$') THEN 'integer'"
    " WHEN regexp_matches({c}, '^[+-]?([0-9]+\\.[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?$') THEN 'decimal'"
    " WHEN regexp_matches({c}, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') THEN 'date'"
    " WHEN lower({c}) IN ('true','false','yes','no','y','n') THEN 'boolean' ELSE 'other' END"
)


def correlation_sql(pairs, source, with_ctes=""):
    return with_ctes + union_sql(
        [
            f"SELECT '{a}' AS column_a, '{b}' AS column_b,"
            f" round(corr({a}::DOUBLE, {b}::DOUBLE), 6) + 0.0 AS correlation FROM {source}"
            for a, b in pairs
        ]
    )


def _pairs(names):
    return [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]


CO_MISSING_SQL = (
    f"WITH {DIRTY_SQL}, found AS ("
    + union_sql(
        [
            f"SELECT '{a}' AS column_a, '{b}' AS column_b,"
            f" CASE WHEN count(DISTINCT {a} IS NULL) = 2 AND count(DISTINCT {b} IS NULL) = 2 THEN"
            f" corr(CASE WHEN {a} IS NULL THEN 1.0 ELSE 0.0 END, CASE WHEN {b} IS NULL THEN 1.0 ELSE 0.0 END)"
            f" END AS r FROM dirty"
            for a, b in _pairs(["price", "mostly_missing", "co_missing", "messy_cat", "all_missing"])
        ]
    )
    + ") SELECT column_a, column_b, round(r, 6) AS correlation FROM found WHERE abs(r) > 0.8"
)


# Sixty columns with gaps of their own, those of neighbours alike but for few rows.
WIDE_GAPS = {
    f"w{i:02}": f"CASE WHEN (o_orderkey + {i // 2}) % {3 + i // 2} = 0 AND (o_orderkey % {41 + i} > 1) THEN NULL ELSE o_custkey END"
    for i in range(60)
}


def _co_missing_wide(spark, folder):
    df = table(spark, folder, "orders").selectExpr(*[f"{e} AS {c}" for c, e in WIDE_GAPS.items()])
    return _rounded(missing.co_missing_correlation(df), "correlation")


CO_MISSING_WIDE_SQL = (
    "WITH w AS (SELECT "
    + ", ".join(f"{e} AS {c}" for c, e in WIDE_GAPS.items())
    + " FROM orders), k AS (SELECT row_number() OVER () AS r, * FROM w),"
    + " g AS (SELECT r, name, place FROM (UNPIVOT (SELECT r, "
    + ", ".join(f"({c} IS NULL)::INT AS {c}" for c in WIDE_GAPS)
    + " FROM k) ON COLUMNS(* EXCLUDE (r)) INTO NAME name VALUE gap) JOIN (VALUES "
    + ", ".join(f"('{c}', {i})" for i, c in enumerate(WIDE_GAPS))
    + ") p(name, place) USING (name) WHERE gap = 1),"
    + " s AS (SELECT name, place, count(*)::DOUBLE AS s FROM g GROUP BY ALL),"
    + " j AS (SELECT a.name AS a, b.name AS b, count(*)::DOUBLE AS j FROM g a JOIN g b ON a.r = b.r AND a.place < b.place GROUP BY ALL),"
    + " f AS (SELECT x.name AS column_a, y.name AS column_b, (n * coalesce(j, 0) - x.s * y.s)"
    + " / (sqrt(x.s * (n - x.s)) * sqrt(y.s * (n - y.s))) AS c FROM s x JOIN s y ON x.place < y.place"
    + " LEFT JOIN j ON j.a = x.name AND j.b = y.name, (SELECT count(*)::DOUBLE AS n FROM orders))"
    + " SELECT column_a, column_b, round(c, 6) AS correlation FROM f WHERE abs(c) > 0.8"
)


def _rounded(df, column):
    from pyspark.sql import functions as F

    return df.withColumn(column, F.round(column, 6))


def _row_missing(spark, folder):
    df = missing.row_missing_distribution(dirty_orders(spark, folder))
    for c in ("mean", "std", "min", "p25", "p50", "p75", "max"):
        df = _rounded(df, c)
    return df


def _median_mad(spark, folder):
    df = numeric.median_mad(table(spark, folder, "lineitem"), LINEITEM_NUMERIC)
    return _rounded(_rounded(df, "median"), "mad")


MEDIAN_MAD_SQL = union_sql(
    [
        f"SELECT '{c}' AS \"column\", round(m, 6) AS median, round(quantile_cont(abs({c} - m), 0.5), 6) AS mad"
        f" FROM lineitem, (SELECT quantile_cont({c}, 0.5) AS m FROM lineitem) GROUP BY m"
        for c in LINEITEM_NUMERIC
    ]
)

FLAGGED_SQL = union_sql(
    [
        f"SELECT event_id, '{c}' AS \"column\", {c}::DOUBLE AS value,"
        f" ({c} < a - 1.5 * (b - a) OR {c} > b + 1.5 * (b - a)) AS is_outlier FROM events,"
        f" (SELECT quantile_cont({c}::DOUBLE, 0.25) AS a, quantile_cont({c}::DOUBLE, 0.75) AS b FROM events)"
        for c in ("user_id", "value")
    ]
)


def leakage_sql(target):
    others = [c for c in DIRTY_NUMERIC if c != target]
    r = union_sql(
        [f"SELECT '{c}' AS \"column\", abs(corr({c}::DOUBLE, {target})) AS v FROM dirty" for c in others]
    )
    ids = distinct_sql([c for c in others if c != "flag_int"], "dirty")
    return (
        f"WITH {DIRTY_SQL}, r AS ({r}), ids AS ({ids})"
        " SELECT 'high_correlation' AS \"check\", \"column\", round(v, 6) AS value FROM r WHERE v > 0.95"
        " UNION ALL SELECT 'id_like', \"column\", round(n_distinct / n_rows, 6) FROM ids"
        " WHERE n_distinct / n_rows > 0.9"
    )


CLASS_SQL = (
    DIRTY + "SELECT skewed_class AS class, count(*) AS n,"
    " round(count(*) * 100.0 / (SELECT count(*) FROM dirty), 2)::DOUBLE AS pct"
    " FROM dirty WHERE skewed_class IS NOT NULL GROUP BY skewed_class"
)
BALANCE_SQL = (
    DIRTY + ", c AS (SELECT count(*) AS n FROM dirty WHERE skewed_class IS NOT NULL GROUP BY skewed_class)"
    " SELECT count(*) AS n_classes, round(max(n) / min(n), 6)::DOUBLE AS imbalance_ratio,"
    " max(n) / min(n) > 10 AS is_imbalanced,"
    " min(n) * 100.0 / (SELECT count(*) FROM dirty) < 1 AS has_rare_class,"
    " round(min(n) * 100.0 / (SELECT count(*) FROM dirty), 2)::DOUBLE AS smallest_pct FROM c"
)
ANALYSIS_SQL = (
    DIRTY + ", c AS (SELECT skewed_class AS k, count(*) AS n FROM dirty GROUP BY skewed_class),"
    " b AS (SELECT max(n) / min(n) AS ratio, min(n) * 100.0 / (SELECT count(*) FROM dirty) AS low FROM c)"
    " SELECT 'missing_count' AS metric, count(*) FILTER (WHERE skewed_class IS NULL)::DOUBLE AS value,"
    " NULL::VARCHAR AS detail FROM dirty"
    " UNION ALL SELECT 'unique_values', count(DISTINCT skewed_class)::DOUBLE, NULL FROM dirty"
    " UNION ALL SELECT 'task_type', NULL, 'classification'"
    " UNION ALL SELECT 'imbalance_ratio', round(ratio, 6), NULL FROM b"
    " UNION ALL SELECT 'warning', NULL, 'severe_imbalance' FROM b WHERE ratio > 10"
    " UNION ALL SELECT 'warning', NULL, 'moderate_imbalance' FROM b WHERE ratio > 5 AND ratio <= 10"
    " UNION ALL SELECT 'warning', NULL, 'rare_class' FROM b WHERE low < 1"
    " UNION ALL SELECT 'class_count', n::DOUBLE, k FROM c"
    " UNION ALL SELECT 'class_pct', round(n * 100.0 / (SELECT count(*) FROM dirty), 2)::DOUBLE, k FROM c"
)
REGRESSION_ANALYSIS_SQL = (
    "WITH d AS (" + describe_sql(["o_totalprice"], "orders") + ")"
    " SELECT 'missing_count' AS metric, count(*) FILTER (WHERE o_totalprice IS NULL)::DOUBLE AS value,"
    " NULL::VARCHAR AS detail FROM orders"
    " UNION ALL SELECT 'unique_values', count(DISTINCT o_totalprice)::DOUBLE, NULL FROM orders"
    " UNION ALL SELECT 'task_type', NULL, 'regression'"
    + "".join(
        f" UNION ALL SELECT '{m}', {m}::DOUBLE, NULL FROM d"
        for m in ("count", "mean", "std", "min", "p25", "p50", "p75", "max")
    )
)
WHOLE_COLUMNS = {
    "o_orderkey",
    "o_custkey",
    "co_missing",
    "flag_int",
    *DIRTY_TEXT,
}
TASK_SQL = (
    DIRTY + ", d AS (" + distinct_sql(DIRTY_COLUMNS, "dirty") + ')'
    ' SELECT "column", n_distinct, CASE WHEN n_distinct <= 20 AND "column" IN ('
    + ", ".join(f"'{c}'" for c in sorted(WHOLE_COLUMNS))
    + ") THEN 'classification' ELSE 'regression' END AS task FROM d"
)

DUPLICATES_SQL = (
    "SELECT count(*) AS n_rows, (SELECT count(*) FROM (SELECT DISTINCT * FROM {t})) AS n_distinct_rows,"
    " count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM {t})) AS duplicates,"
    " round((count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM {t}))) * 100.0 / count(*), 2)::DOUBLE"
    " AS duplicate_pct FROM {t}"
)

SKEW_SQL = union_sql(
    [
        f"SELECT '{c}' AS \"column\", round(skewness({c}), 6) + 0.0 AS skewness,"
        f" round(kurtosis({c}), 6) + 0.0 AS kurtosis FROM {t}"
        for t, c in (("events", "value"), ("events", "user_id"), ("events", "event_id"))
    ]
)
HEALTH_SQL = union_sql(
    [
        f"SELECT '{c}' AS \"column\", count(*) FILTER (WHERE {c} = 0) AS zeros,"
        f" count(*) FILTER (WHERE {c} < 0) AS negatives,"
        f" count(*) FILTER (WHERE isinf({c}::DOUBLE)) AS infinites, min({c})::DOUBLE AS min,"
        f" max({c})::DOUBLE AS max,"
        f" round(quantile_cont({c}::DOUBLE, 0.75) - quantile_cont({c}::DOUBLE, 0.25), 6) AS iqr FROM customer"
        for c in ("c_custkey", "c_nationkey", "c_acctbal")
    ]
)

QUERIES = [
    Query(
        "missing_by_column",
        lambda s, d: missing.missing_by_column(dirty_orders(s, d)),
        missing_sql(DIRTY_COLUMNS, "dirty", DIRTY_SQL) + " SELECT * FROM by_column",
    ),
    Query(
        "missing_overall",
        lambda s, d: missing.missing_overall(dirty_orders(s, d)),
        missing_sql(DIRTY_COLUMNS, "dirty", DIRTY_SQL)
        + " SELECT max(n_rows) AS n_rows, count(*) AS n_columns, sum(missing_count)::BIGINT AS total_missing,"
        " round(sum(missing_count) * 100.0 / sum(n_rows), 2)::DOUBLE AS total_missing_pct,"
        " count(*) FILTER (WHERE missing_pct > 0) AS columns_with_missing FROM by_column",
    ),
    Query(
        "missing_threshold",
        lambda s, d: missing.missing_over_threshold(dirty_orders(s, d)),
        missing_sql(DIRTY_COLUMNS, "dirty", DIRTY_SQL)
        + " SELECT * FROM by_column WHERE missing_pct > 50",
    ),
    Query(
        "row_missing_distribution",
        _row_missing,
        row_missing_sql(DIRTY_COLUMNS, "dirty", DIRTY_SQL)
        + " SELECT count(*) AS n_rows, count(*) FILTER (WHERE x > 0) AS rows_with_missing,"
        " round(avg(x), 6) AS mean, round(stddev_samp(x), 6) AS std, round(min(x), 6) AS min,"
        " round(quantile_cont(x, 0.25), 6) AS p25, round(quantile_cont(x, 0.5), 6) AS p50,"
        " round(quantile_cont(x, 0.75), 6) AS p75, round(max(x), 6) AS max FROM per_row",
    ),
    Query(
        "row_missing_check",
        lambda s, d: missing.row_missing_check(sparse_join(s, d), row_limit=40.0),
        row_missing_sql(SPARSE_COLUMNS, "sparse", SPARSE_SQL)
        + " SELECT count(*) FILTER (WHERE x > 40) AS rows_over,"
        " round(count(*) FILTER (WHERE x > 40) * 100.0 / count(*), 6)::DOUBLE AS rows_over_pct,"
        " count(*) FILTER (WHERE x > 40) * 100.0 / count(*) > 10 AS is_warning FROM per_row",
    ),
    Query(
        "comissing_correlation",
        lambda s, d: _rounded(missing.co_missing_correlation(dirty_orders(s, d)), "correlation"),
        CO_MISSING_SQL,
    ),
    Query("comissing_wide", _co_missing_wide, CO_MISSING_WIDE_SQL),
    Query("column_types", given_types, GIVEN_TYPES_SQL),
    Query(
        "column_types_dirty",
        lambda s, d: typing.column_types(dirty_orders(s, d)),
        DIRTY + DIRTY_TYPES_SQL,
    ),
    Query(
        "type_summary",
        lambda s, d: typing.type_summary(dirty_orders(s, d)),
        DIRTY
        + f", t AS ({DIRTY_TYPES_SQL}), k(semantic_type) AS (VALUES ('numeric'), ('categorical'),"
        " ('datetime'), ('boolean'), ('text'), ('unknown')) SELECT k.semantic_type,"
        " count(t.semantic_type) AS n_columns FROM k LEFT JOIN t USING (semantic_type) GROUP BY 1",
    ),
    Query(
        "lexical_kinds",
        lambda s, d: typing.lexical_kinds(dirty_orders(s, d)),
        DIRTY
        + ", c AS ("
        + union_sql(
            [
                f"SELECT '{c}' AS \"column\", {LEXICAL_SQL.format(c=c)} AS kind, count(*) AS n FROM dirty"
                f" WHERE {c} IS NOT NULL GROUP BY 2"
                for c in DIRTY_TEXT
            ]
        )
        + ') SELECT "column", kind, n, count(*) OVER (PARTITION BY "column") > 1 AS is_mixed FROM c',
    ),
    Query(
        "distinct_counts",
        lambda s, d: frequency.cardinality(table(s, d, "lineitem")),
        "SELECT \"column\", n_distinct, round(n_distinct * 10000.0::DOUBLE / n_rows) / 10000 AS ratio FROM ("
        + distinct_sql([f.split(":")[0] for f in GIVEN_TABLES["lineitem"].split()], "lineitem")
        + ")",
    ),
    Query(
        "constant_columns",
        lambda s, d: frequency.constant_columns(dirty_orders(s, d)),
        DIRTY
        + ", d AS ("
        + distinct_sql(DIRTY_COLUMNS, "dirty")
        + ') SELECT "column", n_distinct FROM d WHERE n_distinct <= 1',
    ),
    Query(
        "high_cardinality",
        lambda s, d: frequency.high_cardinality(table(s, d, "documents")),
        "SELECT \"column\", n_distinct, round(n_distinct * 10000.0::DOUBLE / n_rows) / 10000 AS ratio FROM ("
        + distinct_sql(["text", "lang", "source"], "documents")
        + ") WHERE n_distinct / n_rows > 0.8",
    ),
    Query(
        "value_frequencies",
        lambda s, d: frequency.value_frequencies(table(s, d, "lineitem"), LINEITEM_TEXT + ["l_linenumber"]),
        frequency_sql(LINEITEM_TEXT + ["l_linenumber"], "lineitem"),
    ),
    Query(
        "most_least_frequent",
        lambda s, d: frequency.most_least_frequent(table(s, d, "events")),
        "WITH f AS ("
        + frequency_sql(["event_type", "props"], "events")
        + ') SELECT "column", count(*) AS unique_values,'
        " first(value ORDER BY n DESC, value) AS most_frequent, max(n) AS most_frequent_count,"
        " first(value ORDER BY n, value) AS least_frequent, min(n) AS least_frequent_count"
        ' FROM f GROUP BY "column"',
    ),
    Query(
        "top5_values",
        lambda s, d: frequency.top_values(table(s, d, "part"), ["p_name", "p_brand", "p_type"]),
        "WITH f AS ("
        + frequency_sql(["p_name", "p_brand", "p_type"], "part")
        + '), r AS (SELECT "column", value, n, row_number() OVER (PARTITION BY "column"'
        " ORDER BY n DESC, value) AS position FROM f)"
        ' SELECT "column", value, n, position FROM r WHERE position <= 5',
    ),
    Query(
        "duplicate_rows",
        lambda s, d: frequency.duplicate_rows(dirty_orders(s, d)),
        DIRTY + DUPLICATES_SQL.format(t="dirty"),
    ),
    Query(
        "numeric_describe",
        lambda s, d: numeric.describe(table(s, d, "lineitem"), LINEITEM_NUMERIC),
        describe_sql(LINEITEM_NUMERIC, "lineitem"),
    ),
    Query(
        "numeric_describe_epoch",
        lambda s, d: numeric.describe(_epochs(s, d), ["epoch_ms"]).select("column", "count", "mean", "min", "max"),
        "SELECT 'epoch_ms' AS \"column\", count(*) AS count, round(avg(e), 4) AS mean, min(e)::DOUBLE AS min, max(e)::DOUBLE AS max"
        " FROM (SELECT epoch_us(ts) // 1000 AS e FROM events)",
    ),
    Query(
        "correlation_wide",
        lambda s, d: numeric.correlation_matrix(_wide(s, d), WIDE_COLUMNS),
        correlation_sql(_pairs(WIDE_COLUMNS), "w", f"WITH w AS ({WIDE_SQL}) "),
    ),
    Query(
        "correlation_inf",
        lambda s, d: numeric.correlation_matrix(_endless(s, d), ["value", "user_id", "endless"]),
        correlation_sql([("value", "user_id")], "events")
        + " UNION ALL SELECT c, 'endless', NULL FROM (VALUES ('value'), ('user_id')) v(c)",
    ),
    Query(
        "outliers_zscore_inf",
        lambda s, d: outliers.outlier_report(_endless(s, d), "zscore", columns=["value", "endless"]),
        outlier_sql(["value"], "events", "zscore") + " UNION ALL SELECT 'endless', 'zscore', 0, 0.0",
    ),
    Query(
        "target_leakage_inf",
        lambda s, d: target.target_leakage(_endless(s, d).select("value", "endless", "twin"), "value").where("check = 'high_correlation'"),
        "SELECT 'high_correlation' AS \"check\", 'twin' AS \"column\", 1.0::DOUBLE AS value",
    ),
    Query(
        "numeric_describe_gaps",
        lambda s, d: numeric.describe(dirty_orders(s, d), ["price", "mostly_missing", "co_missing"]),
        describe_sql(["price", "mostly_missing", "co_missing"], "dirty", DIRTY),
    ),
    Query("numeric_health", lambda s, d: numeric.numeric_health(table(s, d, "customer")), HEALTH_SQL),
    Query(
        "skew_kurtosis",
        lambda s, d: numeric.skew_kurtosis(
            table(s, d, "events"), ["value", "user_id", "event_id"]
        ),
        SKEW_SQL,
    ),
    Query("median_mad", _median_mad, MEDIAN_MAD_SQL),
    Query(
        "correlation_matrix",
        lambda s, d: numeric.correlation_matrix(table(s, d, "lineitem"), LINEITEM_NUMERIC),
        correlation_sql(_pairs(LINEITEM_NUMERIC), "lineitem"),
    ),
    Query(
        "correlation_gaps",
        lambda s, d: numeric.correlation_matrix(
            dirty_orders(s, d), ["price", "mostly_missing", "spiky", "leak"]
        ),
        correlation_sql(_pairs(["price", "mostly_missing", "spiky", "leak"]), "dirty", DIRTY),
    ),
    *[
        Query(
            f"outliers_{m}",
            lambda s, d, m=m: outliers.outlier_report(
                table(s, d, "lineitem"), m, columns=LINEITEM_NUMERIC
            ),
            outlier_sql(LINEITEM_NUMERIC, "lineitem", m),
        )
        for m in outliers.METHODS
    ],
    Query(
        "outliers_spiky",
        lambda s, d: outliers.outlier_report(dirty_orders(s, d), "iqr"),
        outlier_sql([c for c in DIRTY_NUMERIC], "dirty", "iqr", DIRTY),
    ),
    Query(
        "outlier_total",
        lambda s, d: outliers.outlier_total(
            outliers.outlier_report(table(s, d, "events"), "mad", columns=["user_id", "value"])
        ),
        "SELECT sum(outliers)::BIGINT AS total_outliers, count(*) AS columns_checked FROM ("
        + outlier_sql(["user_id", "value"], "events", "mad")
        + ")",
    ),
    Query(
        "outlier_rows",
        lambda s, d: outliers.flag_outliers(
            table(s, d, "events"), ["event_id"], "iqr", columns=["user_id", "value"]
        ),
        FLAGGED_SQL,
    ),
    Query(
        "target_leakage",
        lambda s, d: target.target_leakage(dirty_orders(s, d), "leak"),
        leakage_sql("leak"),
    ),
    Query(
        "id_like_columns",
        lambda s, d: target.id_like_columns(table(s, d, "lineitem")),
        "SELECT \"column\", round(n_distinct / n_rows, 6)::DOUBLE AS unique_ratio FROM ("
        + distinct_sql(["l_orderkey", "l_partkey", "l_suppkey"] + LINEITEM_NUMERIC, "lineitem")
        + ") WHERE n_distinct / n_rows > 0.9",
    ),
    Query(
        "class_distribution",
        lambda s, d: target.class_distribution(dirty_orders(s, d), "skewed_class"),
        CLASS_SQL,
    ),
    Query(
        "class_balance",
        lambda s, d: target.class_balance(dirty_orders(s, d), "skewed_class"),
        BALANCE_SQL,
    ),
    Query(
        "target_analysis",
        lambda s, d: target.target_analysis(dirty_orders(s, d), "skewed_class"),
        ANALYSIS_SQL,
    ),
    Query(
        "target_analysis_regression",
        lambda s, d: target.target_analysis(table(s, d, "orders"), "o_totalprice"),
        REGRESSION_ANALYSIS_SQL,
    ),
    Query("task_detection", lambda s, d: target.task_detection(dirty_orders(s, d)), TASK_SQL),
]
