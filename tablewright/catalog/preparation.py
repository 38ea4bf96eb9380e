"""Registered queries: validation, profile, cleaning, features and splits."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import cleaning, features, splitting
from ..operators.schema_checks import schema_report
from ..plans.profiling import health_score, profile
from ..plans.validation import validate
from ..session import shared_scratch, stored
from .base import DIRTY_COLUMNS, DIRTY_SQL, Query, dirty_orders, table, union_sql
from .quality import (
    DIRTY,
    DIRTY_NUMERIC,
    DIRTY_TEXT,
    GIVEN_TABLES,
    LEXICAL_SQL,
    LINEITEM_NUMERIC,
    describe_sql,
    distinct_sql,
    frequency_sql,
    leakage_sql,
    missing_sql,
    outlier_sql,
    row_missing_sql,
    type_sql,
)

NULL_D, NULL_S = "NULL::DOUBLE", "NULL::VARCHAR"
FINDING = '{check} AS "check", {severity} AS severity, {column} AS "column", {metric} AS metric, {value}::DOUBLE AS value, {threshold}::DOUBLE AS threshold'


def finding(check, severity, column, metric, value, threshold="NULL"):
    quote = lambda t: NULL_S if t is None else f"'{t}'"
    return "SELECT " + FINDING.format(
        check=quote(check),
        severity=quote(severity),
        column=column if column and column.startswith('"') else quote(column),
        metric=quote(metric),
        value=value,
        threshold=threshold,
    )


SCHEMA_PARTS = [
    finding("all_missing", "error", '"column"', "missing_count", "missing_count")
    + " FROM by_column WHERE missing_count = n_rows",
    finding("constant", "warning", '"column"', "n_distinct", "n_distinct", "1")
    + " FROM by_distinct WHERE n_distinct <= 1",
    finding("high_cardinality", "warning", '"column"', "n_distinct", "n_distinct", "0.8")
    + " FROM by_distinct WHERE n_distinct / n_rows > 0.8 AND \"column\" IN ("
    + ", ".join(f"'{c}'" for c in DIRTY_TEXT)
    + ")",
    finding("schema_info", "info", None, "total_columns", str(len(DIRTY_COLUMNS))),
    finding("schema_info", "info", None, "numeric_columns", str(len(DIRTY_NUMERIC) + 1)),
    finding("schema_info", "info", None, "categorical_columns", str(len(DIRTY_TEXT))),
    finding("schema_info", "info", None, "datetime_columns", "0"),
    finding("mixed_values", "warning", '"column"', "kinds", "count(*)", "1")
    + ' FROM kinds GROUP BY "column" HAVING count(*) > 1',
]
KINDS = union_sql(
    [
        f"SELECT DISTINCT '{c}' AS \"column\", {LEXICAL_SQL.format(c=c)} AS kind FROM dirty WHERE {c} IS NOT NULL"
        for c in DIRTY_TEXT
    ]
)
SCHEMA_CTES = (
    missing_sql(DIRTY_COLUMNS, "dirty", DIRTY_SQL)
    + f", by_distinct AS ({distinct_sql(DIRTY_COLUMNS, 'dirty')}), kinds AS ({KINDS})"
)
SCHEMA_SQL = SCHEMA_CTES + union_sql([f" {p}" for p in SCHEMA_PARTS])

ROW_CELLS = row_missing_sql(DIRTY_COLUMNS, "dirty", DIRTY_SQL).split("per_row AS ", 1)[1]
PAIRED = ["price", "mostly_missing", "co_missing", "messy_cat"]
PAIRS_SQL = union_sql(
    [
        f"SELECT '{a},{b}' AS \"column\", corr(CASE WHEN {a} IS NULL THEN 1.0 ELSE 0.0 END,"
        f" CASE WHEN {b} IS NULL THEN 1.0 ELSE 0.0 END) AS r FROM dirty"
        for i, a in enumerate(PAIRED)
        for b in PAIRED[i + 1 :]
    ]
)
VALIDATION_PARTS = [
    *SCHEMA_PARTS,
    finding("column_missing", "error", '"column"', "missing_pct", "missing_pct", "50")
    + " FROM by_column WHERE missing_pct > 50",
    finding("missing_together", "warning", '"column"', "correlation", "round(r, 6)", "0.8")
    + " FROM pairs WHERE abs(r) > 0.8",
    finding("missing_stats", "info", None, "total_missing", "sum(missing_count)") + " FROM by_column",
    finding(
        "missing_stats", "info", None, "total_missing_pct", "round(sum(missing_count) * 100.0 / sum(n_rows), 2)"
    )
    + " FROM by_column",
    finding("missing_stats", "info", None, "columns_with_missing", "count(*) FILTER (WHERE missing_pct > 0)")
    + " FROM by_column",
    finding("missing_stats", "info", None, "rows_with_missing", "count(*) FILTER (WHERE x > 0)")
    + " FROM per_row",
    *[
        finding("missing_stats", "info", None, f"row_missing_{m}", f"round({e}, 6)") + " FROM per_row"
        for m, e in (
            ("mean", "avg(x)"),
            ("std", "stddev_samp(x)"),
            ("min", "min(x)"),
            ("p25", "quantile_cont(x, 0.25)"),
            ("p50", "quantile_cont(x, 0.5)"),
            ("p75", "quantile_cont(x, 0.75)"),
            ("max", "max(x)"),
        )
    ],
    finding("missing_stats", "info", '"column"', "missing_pct", "missing_pct") + " FROM by_column",
    finding("outliers", "info", '"column"', "outliers", "outliers", "1.5") + " FROM strange",
    finding("outliers", "info", '"column"', "outlier_pct", "outlier_pct", "1.5") + " FROM strange",
    *[
        f"SELECT 'class_share' AS \"check\", 'info' AS severity, 'skewed_class' AS \"column\", '{m}:' || k AS metric,"
        f" {v}::DOUBLE AS value, NULL::DOUBLE AS threshold FROM classes"
        for m, v in (("rows", "n"), ("pct", "round(n * 100.0 / (SELECT count(*) FROM dirty), 2)"))
    ],
    finding("class_imbalance", "info", "skewed_class", "imbalance_ratio", "round(max(n) / min(n), 6)", "10")
    .replace("'info'", "CASE WHEN max(n) / min(n) > 10 THEN 'warning' ELSE 'info' END")
    + " FROM classes",
    finding(
        "rare_class",
        "info",
        "skewed_class",
        "smallest_pct",
        "round(min(n) * 100.0 / (SELECT count(*) FROM dirty), 2)",
        "1",
    ).replace(
        "'info'",
        "CASE WHEN min(n) * 100.0 / (SELECT count(*) FROM dirty) < 1 THEN 'warning' ELSE 'info' END",
    )
    + " FROM classes",
    finding("id_like", "warning", '"column"', "unique_ratio", "round(n_distinct / n_rows, 6)", "0.9")
    + " FROM by_distinct WHERE n_distinct / n_rows > 0.9 AND \"column\" IN ("
    + ", ".join(f"'{c}'" for c in DIRTY_NUMERIC if c != "flag_int")
    + ")",
    finding("small", "warning", None, "n_rows", "count(*)", "1000")
    + " FROM dirty HAVING count(*) BETWEEN 100 AND 999",
]
OUTLIER_COLUMNS = [c for c in DIRTY_NUMERIC]
VALIDATION_SQL = (
    SCHEMA_CTES
    + f", per_row AS {ROW_CELLS}, pairs AS ({PAIRS_SQL})"
    + f", strange AS ({outlier_sql(OUTLIER_COLUMNS, 'dirty', 'iqr')})"
    + ", classes AS (SELECT skewed_class AS k, count(*) AS n FROM dirty GROUP BY skewed_class)"
    + union_sql([f" {p}" for p in VALIDATION_PARTS])
)


def _validation(spark, folder):
    return validate(dirty_orders(spark, folder), "skewed_class").report


def _validation_status(spark, folder):
    out = None
    for name, target in (("orders", "o_orderstatus"), ("dirty", "skewed_class")):
        df = table(spark, folder, name) if name != "dirty" else dirty_orders(spark, folder)
        part = validate(df, target).status_row().select(F.lit(name).alias("source"), "status", "errors")
        out = part if out is None else out.unionByName(part)
    return out


STATUS_SQL = (
    missing_sql(DIRTY_COLUMNS, "dirty", DIRTY_SQL)
    + ", plain AS ("
    + union_sql(
        [
            f"SELECT count(*) AS n, count({f.split(':')[0]}) AS k FROM orders"
            for f in GIVEN_TABLES["orders"].split()
        ]
    )
    + "), e AS (SELECT 'dirty' AS source, count(*) FILTER (WHERE missing_count = n_rows)"
    " + count(*) FILTER (WHERE missing_pct > 50) AS errors FROM by_column UNION ALL"
    " SELECT 'orders', count(*) FILTER (WHERE k = 0) + count(*) FILTER (WHERE (n - k) * 100.0 / n > 50) FROM plain)"
    " SELECT source, CASE WHEN errors > 0 THEN 'FAIL' ELSE 'PASS' END AS status, errors FROM e"
)

# --- profile of orders with a class target -----------------------------------------

ORDER_FIELDS = [f.split(":") for f in GIVEN_TABLES["orders"].split()]
ORDER_NAMES = [n for n, _ in ORDER_FIELDS]
ORDER_NUMERIC = ["o_orderkey", "o_custkey", "o_totalprice"]
ORDER_TEXT = ["o_orderstatus", "o_orderpriority"]


def fact(section, column, metric, value, detail="NULL"):
    column = column if column.startswith('"') or column == "NULL" else f"'{column}'"
    return (
        f"SELECT '{section}' AS section, {column}::VARCHAR AS \"column\", {metric} AS metric,"
        f" {value}::DOUBLE AS value, {detail}::VARCHAR AS detail"
    )


def _profile_sql():
    ctes = (
        "WITH by_column AS ("
        + union_sql(
            [
                f"SELECT '{c}' AS \"column\", count(*) AS n_rows, count(*) - count({c}) AS missing_count FROM orders"
                for c in ORDER_NAMES
            ]
        )
        + f"), by_distinct AS ({distinct_sql(ORDER_NAMES, 'orders')})"
        + f", kinds AS ({union_sql([type_sql(c, k, 'orders') for c, k in ORDER_FIELDS])})"
        + f", numbers AS ({describe_sql(ORDER_NUMERIC, 'orders')})"
        + ", health AS ("
        + union_sql(
            [
                f"SELECT '{c}' AS \"column\", count(*) FILTER (WHERE {c} = 0) AS zeros,"
                f" count(*) FILTER (WHERE {c} < 0) AS negatives, count(*) FILTER (WHERE isinf({c}::DOUBLE)) AS infinites,"
                f" round(quantile_cont({c}::DOUBLE, 0.75) - quantile_cont({c}::DOUBLE, 0.25), 6) AS iqr,"
                f" round(skewness({c}), 6) + 0.0 AS skewness, round(kurtosis({c}), 6) + 0.0 AS kurtosis FROM orders"
                for c in ORDER_NUMERIC
            ]
        )
        + f"), f AS ({frequency_sql(ORDER_TEXT, 'orders')})"
        + ', top AS (SELECT "column", value, n, row_number() OVER (PARTITION BY "column" ORDER BY n DESC, value) AS position FROM f)'
        + ", twice AS (SELECT count(*) AS n, (SELECT count(*) FROM (SELECT DISTINCT * FROM orders)) AS d FROM orders)"
        + ", c AS (SELECT o_orderstatus AS k, count(*) AS n FROM orders GROUP BY 1)"
        + ", b AS (SELECT max(n) / min(n) AS ratio, min(n) * 100.0 / (SELECT count(*) FROM orders) AS low FROM c)"
        + ", notes AS (SELECT 'severe_imbalance' AS w FROM b WHERE ratio > 10"
        + " UNION ALL SELECT 'moderate_imbalance' FROM b WHERE ratio > 5 AND ratio <= 10"
        + " UNION ALL SELECT 'rare_class' FROM b WHERE low < 1)"
        + ", warnings AS (SELECT w FROM notes UNION ALL SELECT 'critical_few_rows' FROM twice WHERE n < 100"
        + " UNION ALL SELECT 'few_rows' FROM twice WHERE n BETWEEN 100 AND 999"
        + " UNION ALL SELECT 'duplicates' FROM twice WHERE (n - d) * 100.0 / n > 5)"
    )
    numbers = ("count", "mean", "std", "min", "p01", "p05", "p25", "p50", "p75", "p95", "p99", "max")
    parts = [
        fact("table", "NULL", "'rows'", "n") + " FROM twice",
        fact("table", "NULL", "'columns'", str(len(ORDER_NAMES))),
        fact("table", "NULL", "'missing_count'", "sum(missing_count)") + " FROM by_column",
        fact("table", "NULL", "'missing_pct'", "round(sum(missing_count) * 100.0 / sum(n_rows), 2)")
        + " FROM by_column",
        fact("table", "NULL", "'duplicates'", "n - d") + " FROM twice",
        fact("table", "NULL", "'duplicate_pct'", "round((n - d) * 100.0 / n, 2)") + " FROM twice",
        fact("table", "NULL", "'health_score'", "greatest(0, 100 - 10 * count(*))") + " FROM warnings",
        *[
            fact("types", "NULL", f"'{k}'", f"count(*) FILTER (WHERE semantic_type = '{k}')") + " FROM kinds"
            for k in ("numeric", "categorical", "datetime", "boolean", "text", "unknown")
        ],
        fact("schema", '"column"', "'physical_type'", "NULL", "physical_type") + " FROM kinds",
        fact("missing", '"column"', "'missing_count'", "missing_count") + " FROM by_column",
        fact("missing", '"column"', "'missing_pct'", "round(missing_count * 100.0 / n_rows, 2)")
        + " FROM by_column",
        fact("cardinality", '"column"', "'n_distinct'", "n_distinct") + " FROM by_distinct",
        fact("cardinality", '"column"', "'ratio'", "round(n_distinct * 10000.0::DOUBLE / n_rows) / 10000")
        + " FROM by_distinct",
        *[fact("numeric", '"column"', f"'{m}'", m) + " FROM numbers" for m in numbers],
        *[
            fact("health", '"column"', f"'{m}'", m) + " FROM health"
            for m in ("zeros", "negatives", "infinites", "iqr")
        ],
        *[fact("shape", '"column"', f"'{m}'", m) + " FROM health" for m in ("skewness", "kurtosis")],
        fact("category", '"column"', "'most_frequent'", "max(n)", "first(value ORDER BY n DESC, value)")
        + ' FROM f GROUP BY "column"',
        fact("category", '"column"', "'least_frequent'", "min(n)", "first(value ORDER BY n, value)")
        + ' FROM f GROUP BY "column"',
        fact("category", '"column"', "'top_' || position", "n", "value") + " FROM top WHERE position <= 5",
        fact("warning", "NULL", "w", "NULL") + " FROM warnings",
        fact("target", "o_orderstatus", "'missing_count'", "count(*) FILTER (WHERE o_orderstatus IS NULL)")
        + " FROM orders",
        fact("target", "o_orderstatus", "'unique_values'", "count(DISTINCT o_orderstatus)") + " FROM orders",
        fact("target", "o_orderstatus", "'task_type'", "NULL", "'classification'"),
        fact("target", "o_orderstatus", "'imbalance_ratio'", "round(ratio, 6)") + " FROM b",
        fact("target", "o_orderstatus", "'warning'", "NULL", "w") + " FROM notes",
        fact("target", "o_orderstatus", "'class_count'", "n", "k") + " FROM c",
        fact("target", "o_orderstatus", "'class_pct'", "round(n * 100.0 / (SELECT count(*) FROM orders), 2)", "k")
        + " FROM c",
    ]
    return ctes + union_sql([f" {p}" for p in parts])


HEALTH_SCORE_SQL = (
    missing_sql(DIRTY_COLUMNS, "dirty", DIRTY_SQL)
    + ", g AS (SELECT round(sum(missing_count) * 100.0 / sum(n_rows), 2)::DOUBLE AS missing_pct FROM by_column)"
    ", t AS (SELECT count(*) AS n, (SELECT count(*) FROM (SELECT DISTINCT * FROM dirty)) AS d FROM dirty)"
    ", c AS (SELECT count(*) AS n FROM dirty GROUP BY skewed_class)"
    ", b AS (SELECT max(n) / min(n) AS ratio, min(n) * 100.0 / (SELECT count(*) FROM dirty) AS low FROM c)"
    ", w AS (SELECT (CASE WHEN n < 1000 THEN 1 ELSE 0 END) + (CASE WHEN missing_pct > 10 THEN 1 ELSE 0 END)"
    " + (CASE WHEN (n - d) * 100.0 / n > 5 THEN 1 ELSE 0 END) + (CASE WHEN ratio > 5 THEN 1 ELSE 0 END)"
    " + (CASE WHEN low < 1 THEN 1 ELSE 0 END) AS k, n, d, missing_pct FROM t, g, b)"
    " SELECT n AS rows, missing_pct, round((n - d) * 100.0 / n, 2)::DOUBLE AS duplicate_pct, k::BIGINT AS n_warnings,"
    " greatest(0, 100 - 10 * k)::BIGINT AS health_score FROM w"
)

# --- cleaning -----------------------------------------------------------------------

GAPS = ["price", "mostly_missing", "co_missing"]
IMPUTE_MEDIAN_SQL = (
    DIRTY
    + "SELECT o_orderkey, "
    + ", ".join(
        f"round(coalesce({c}::DOUBLE, (SELECT quantile_cont({c}::DOUBLE, 0.5) FROM dirty)), 6) AS {c}" for c in GAPS
    )
    + " FROM dirty"
)


def _impute_median(spark, folder):
    df = cleaning.impute(dirty_orders(spark, folder).select("o_orderkey", *GAPS), GAPS)
    return df.select("o_orderkey", *[F.round(c, 6).alias(c) for c in GAPS])


IMPUTE_MODE_SQL = (
    DIRTY
    + "SELECT o_orderkey, coalesce(messy_cat, (SELECT first(messy_cat ORDER BY n DESC, messy_cat) FROM"
    " (SELECT messy_cat, count(*) AS n FROM dirty WHERE messy_cat IS NOT NULL GROUP BY 1))) AS messy_cat FROM dirty"
)
KEPT_FULL = [c for c in DIRTY_COLUMNS if c not in ("mostly_missing", "all_missing")]
KEPT_VARIED = [c for c in DIRTY_COLUMNS if c not in ("constant_col", "all_missing")]
KEPT_PRESENT = [c for c in DIRTY_COLUMNS if c != "all_missing"]


def _normalized_dates(spark, folder):
    df = cleaning.normalize_dates(dirty_orders(spark, folder), ["date_text", "bad_date_text"])
    show = [F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c) for c in ("date_text", "bad_date_text")]
    return df.select("o_orderkey", *show)


def _audit(spark, folder):
    return cleaning.clean(dirty_orders(spark, folder)).audit.select("action", "column", "before", "after")


def _audit_sql():
    kept = [c for c in DIRTY_NUMERIC]
    row = (
        "SELECT '{a}' AS action, {c}::VARCHAR AS \"column\", {b}::DOUBLE AS before, {n}::DOUBLE AS after"
    )
    tidy = "lower(regexp_replace(trim({c}), '\\s+', ' ', 'g'))"
    categories = ["messy_cat", "skewed_class"]
    parts = [
        row.format(a="remove_duplicates", c="NULL", b="count(*)", n="(SELECT count(*) FROM once)") + " FROM dirty",
        *[
            "SELECT * FROM ("
            + row.format(
                a="normalize_category",
                c=f"'{c}'",
                b=f"count(DISTINCT {c})",
                n=f"count(DISTINCT {tidy.format(c=c)})",
            )
            + " FROM once) WHERE before <> after"
            for c in categories
        ],
        row.format(a="drop_constant_column", c="'all_missing'", b="NULL", n="NULL"),
        row.format(a="drop_constant_column", c="'constant_col'", b="NULL", n="NULL"),
        row.format(a="outliers_found", c="NULL", b="NULL", n="sum(outliers)") + " FROM strange",
        row.format(a="outliers_in_column", c='"column"', b="NULL", n="outliers") + " FROM strange",
        row.format(a="rows", c="NULL", b="count(*)", n="(SELECT count(*) FROM once)") + " FROM dirty",
        row.format(a="columns", c="NULL", b=str(len(DIRTY_COLUMNS)), n=str(len(DIRTY_COLUMNS) - 2)),
    ]
    return (
        f"WITH {DIRTY_SQL}, once AS (SELECT DISTINCT * FROM dirty)"
        f", strange AS ({outlier_sql(kept, 'once', 'iqr')})" + union_sql([f" {p}" for p in parts])
    )


# --- features -----------------------------------------------------------------------


def _scaled(method):
    def run(spark, folder):
        df = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", *LINEITEM_NUMERIC)
        out = features.scale(df, LINEITEM_NUMERIC, method)
        return out.select(
            "l_orderkey", "l_linenumber", *[(F.round(c, 6) + 0.0).alias(c) for c in LINEITEM_NUMERIC]
        )

    return run


def _scaled_sql(method):
    centre, spread = {
        "standard": ("avg({c})", "stddev_pop({c})"),
        "minmax": ("min({c})", "max({c}) - min({c})"),
        "robust": ("quantile_cont({c}, 0.5)", "quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)"),
    }[method]
    stats = ", ".join(
        f"{centre.format(c=c)} AS a{i}, {spread.format(c=c)} AS b{i}" for i, c in enumerate(LINEITEM_NUMERIC)
    )
    cells = ", ".join(f"round(({c} - a{i}) / b{i}, 6) + 0.0 AS {c}" for i, c in enumerate(LINEITEM_NUMERIC))
    return (
        f"WITH s AS (SELECT {stats} FROM lineitem) SELECT l_orderkey, l_linenumber, {cells} FROM lineitem, s"
    )


PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")


def _onehot(spark, folder):
    df = table(spark, folder, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    out = features.onehot(df, ["o_orderstatus", "o_orderpriority"])
    names = sorted(c for c in out.columns if c != "o_orderkey")
    # Categories come from the data; the result is long so that its columns do not.
    return out.unpivot("o_orderkey", names, "feature", "value")


ONEHOT_SQL = union_sql(
    [
        f"SELECT o_orderkey, '{c}_' || v AS feature, CASE WHEN {c} = v THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS value"
        f" FROM orders, (SELECT DISTINCT {c} AS v FROM orders)"
        for c in ("o_orderstatus", "o_orderpriority")
    ]
)


def _onehot_wide(spark, folder):
    df = table(spark, folder, "orders").select("o_orderkey", F.col("o_custkey").cast("string"), "o_orderpriority")
    fitted = features.fit_onehot(df, ["o_custkey", "o_orderpriority"])
    return fitted.cells(df, ["o_orderkey"])


ONEHOT_WIDE_SQL = (
    "WITH k AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS place FROM"
    " (SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS v FROM orders)),"
    " p AS (SELECT v, row_number() OVER (ORDER BY v) - 1 + (SELECT count(*) FROM k) AS place FROM"
    " (SELECT DISTINCT o_orderpriority AS v FROM orders))"
    " SELECT o_orderkey, place, 'o_custkey_' || v AS feature, 1.0::DOUBLE AS value FROM orders"
    " JOIN k ON CAST(o_custkey AS VARCHAR) = v UNION ALL"
    " SELECT o_orderkey, place, 'o_orderpriority_' || v, 1.0::DOUBLE FROM orders JOIN p ON o_orderpriority = v"
)


def _ordinal(spark, folder):
    df = dirty_orders(spark, folder).select("o_orderkey", "messy_cat", "skewed_class", "date_text")
    return features.ordinal(df, ["messy_cat", "skewed_class", "date_text"])


def _ordinal_sql():
    maps, cells, joins = [], [], []
    for i, c in enumerate(("messy_cat", "skewed_class", "date_text")):
        maps.append(
            f"m{i} AS (SELECT v, (row_number() OVER (ORDER BY v) - 1)::DOUBLE AS code FROM"
            f" (SELECT DISTINCT {c} AS v FROM dirty WHERE {c} IS NOT NULL))"
            f", f{i} AS (SELECT first(v ORDER BY n DESC, v) AS v FROM (SELECT {c} AS v, count(*) AS n FROM dirty"
            f" WHERE {c} IS NOT NULL GROUP BY 1))"
        )
        cells.append(f"m{i}.code AS {c}")
        joins.append(f"JOIN m{i} ON m{i}.v = coalesce(d.{c}, (SELECT v FROM f{i}))")
    return (
        f"WITH {DIRTY_SQL}, {', '.join(maps)} SELECT d.o_orderkey, {', '.join(cells)} FROM dirty d {' '.join(joins)}"
    )


def _booleans(spark, folder):
    df = dirty_orders(spark, folder).select("o_orderkey", "flag_text", "flag_int")
    return features.booleans(df, ["flag_text", "flag_int"])


def _features_report(spark, folder):
    plan = features.fit_features(dirty_orders(spark, folder), "skewed_class", {"scaling": "standard"})
    return plan.parameters.filter("stat = 'feature'").select("column", "value")


def _prepared(spark, folder):
    df = stored(dirty_orders(spark, folder).dropDuplicates())
    ready = features.prepare(df, "skewed_class", key=["o_orderkey"])
    return ready.data.select(
        "o_orderkey", "split", *[(F.round(c, 6) + 0.0).alias(c) for c in ready.feature_names]
    )


_REAPPLIED = [
    "o_orderkey",
    "o_custkey",
    "CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_totalprice END AS price",
    "CASE WHEN o_orderkey % 9 = 0 THEN NULL WHEN o_orderstatus = 'F' THEN 'yes' ELSE 'no' END AS flag",
    "CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_orderpriority END AS priority",
]


def _prepare_reapplied(spark, folder):
    """Fitted on odd orders, saved, loaded, and put to even orders."""
    rows = table(spark, folder, "orders").selectExpr(*_REAPPLIED)
    path = f"{shared_scratch(spark)}/plan-{uuid.uuid4().hex}"
    features.fit_features(rows.where("o_orderkey % 2 = 1").drop("o_orderkey")).save(path)
    plan = features.FeaturePlan.load(spark, path)
    made = plan.transform(rows.where("o_orderkey % 2 = 0"), ["o_orderkey"])
    return made.unpivot("o_orderkey", plan.names, "feature", "value").withColumn("value", F.round("value", 6) + 0.0)


def _reapplied_sql():
    number = (
        "SELECT o_orderkey, 'num__{c}' AS feature, round((coalesce({c}, (SELECT quantile_cont({c}, 0.5) FROM odd)) - m) / s, 6) + 0.0 AS value"
        " FROM even, (SELECT avg(x) AS m, stddev_pop(x) AS s FROM (SELECT coalesce({c}, (SELECT quantile_cont({c}, 0.5) FROM odd))::DOUBLE AS x FROM odd))"
    )
    parts = [number.format(c=c) for c in ("o_custkey", "price")]
    parts.append(
        "SELECT o_orderkey, 'bool__flag' AS feature, CASE WHEN flag IS NULL THEN (SELECT (avg((flag = 'yes')::INT) > 0.5)::INT::DOUBLE FROM odd)"
        " ELSE (flag = 'yes')::INT::DOUBLE END AS value FROM even"
    )
    parts.append(
        "SELECT o_orderkey, lower(regexp_replace('cat__priority_' || v, '\\W', '_', 'g')) AS feature,"
        " (coalesce(priority, (SELECT first(priority ORDER BY n DESC, priority) FROM (SELECT priority, count(*) AS n FROM odd"
        " WHERE priority IS NOT NULL GROUP BY 1))) = v)::INT::DOUBLE AS value"
        " FROM even, (SELECT DISTINCT priority AS v FROM odd WHERE priority IS NOT NULL)"
    )
    return (
        f"WITH base AS (SELECT {', '.join(_REAPPLIED)} FROM orders), odd AS (SELECT * FROM base WHERE o_orderkey % 2 = 1),"
        " even AS (SELECT * FROM base WHERE o_orderkey % 2 = 0) " + union_sql(parts)
    )


SPLIT_SQL = (
    "SELECT o_orderkey, CASE WHEN substr(md5(concat(CAST(o_orderkey AS VARCHAR), ':', '42')), 1, 8) < '33333333'"
    " THEN 'test' ELSE 'train' END AS split FROM orders"
)
STRATIFIED_SQL = (
    "SELECT o_orderkey, o_orderstatus, CASE WHEN row_number() OVER (PARTITION BY o_orderstatus ORDER BY"
    " md5(concat(CAST(o_orderkey AS VARCHAR), ':', '42'))) <= round(0.2 * count(*) OVER (PARTITION BY o_orderstatus))"
    " THEN 'test' ELSE 'train' END AS split FROM orders"
)
FOLD_SQL = (
    "SELECT o_orderkey, o_orderstatus, ((row_number() OVER (PARTITION BY o_orderstatus ORDER BY"
    " md5(concat(CAST(o_orderkey AS VARCHAR), ':', '42'))) - 1) % 5)::INTEGER AS fold FROM orders"
)

QUERIES = [
    Query("schema_report", lambda s, d: schema_report(dirty_orders(s, d)), SCHEMA_SQL),
    Query("validation_report", _validation, VALIDATION_SQL),
    Query("validation_status", _validation_status, STATUS_SQL),
    Query(
        "profile_summary",
        lambda s, d: profile(table(s, d, "orders"), "o_orderstatus").report,
        _profile_sql(),
    ),
    Query(
        "health_score", lambda s, d: health_score(dirty_orders(s, d), "skewed_class"), HEALTH_SCORE_SQL
    ),
    Query(
        "drop_duplicates",
        lambda s, d: cleaning.drop_duplicates(dirty_orders(s, d)),
        DIRTY + "SELECT DISTINCT * FROM dirty",
    ),
    Query("impute_median", _impute_median, IMPUTE_MEDIAN_SQL),
    Query(
        "impute_mode",
        lambda s, d: cleaning.impute(dirty_orders(s, d).select("o_orderkey", "messy_cat"), ["messy_cat"]),
        IMPUTE_MODE_SQL,
    ),
    Query(
        "drop_missing_columns",
        lambda s, d: cleaning.drop_missing_columns(dirty_orders(s, d)),
        DIRTY + f"SELECT {', '.join(KEPT_FULL)} FROM dirty",
    ),
    Query(
        "drop_constant_columns",
        lambda s, d: cleaning.drop_constant_columns(dirty_orders(s, d)),
        DIRTY + f"SELECT {', '.join(KEPT_VARIED)} FROM dirty",
    ),
    Query(
        "drop_empty_columns",
        lambda s, d: cleaning.drop_empty_columns(dirty_orders(s, d)),
        DIRTY + f"SELECT {', '.join(KEPT_PRESENT)} FROM dirty",
    ),
    Query(
        "normalize_categories",
        lambda s, d: cleaning.normalize_categories(dirty_orders(s, d), ["messy_cat"]).select(
            "o_orderkey", "messy_cat"
        ),
        DIRTY + "SELECT o_orderkey, lower(regexp_replace(trim(messy_cat), '\\s+', ' ', 'g')) AS messy_cat FROM dirty",
    ),
    Query(
        "normalize_dates",
        _normalized_dates,
        DIRTY
        + "SELECT o_orderkey, "
        + ", ".join(
            f"strftime(TRY_CAST({c} AS TIMESTAMP), '%Y-%m-%d %H:%M:%S') AS {c}"
            for c in ("date_text", "bad_date_text")
        )
        + " FROM dirty",
    ),
    Query(
        "date_parse_report",
        lambda s, d: cleaning.date_parse_report(dirty_orders(s, d), ["date_text", "bad_date_text"]),
        DIRTY
        + union_sql(
            [
                f"SELECT '{c}' AS \"column\", count(*) AS total, count(TRY_CAST({c} AS TIMESTAMP)) AS parsed,"
                f" round((count(*) - count(TRY_CAST({c} AS TIMESTAMP))) * 100.0 / count(*), 2)::DOUBLE AS failed_pct"
                " FROM dirty"
                for c in ("date_text", "bad_date_text")
            ]
        ),
    ),
    Query("cleaning_audit", _audit, _audit_sql()),
    *[Query(f"scale_{m}", _scaled(m), _scaled_sql(m)) for m in ("standard", "minmax", "robust")],
    Query("onehot_encode", _onehot, ONEHOT_SQL),
    Query("onehot_wide", _onehot_wide, ONEHOT_WIDE_SQL),
    Query("ordinal_encode", _ordinal, _ordinal_sql()),
    Query(
        "boolean_encode",
        _booleans,
        DIRTY
        + "SELECT o_orderkey, (lower(flag_text) = 'yes')::INT::DOUBLE AS flag_text, flag_int::DOUBLE AS flag_int FROM dirty",
    ),
    Query("feature_names", _features_report),
    Query("prepared_features", _prepared),
    Query("prepare_reapplied", _prepare_reapplied, _reapplied_sql()),
    Query(
        "train_test_split",
        lambda s, d: splitting.train_test_split(table(s, d, "orders"), ["o_orderkey"]).select(
            "o_orderkey", "split"
        ),
        SPLIT_SQL,
    ),
    Query(
        "stratified_split",
        lambda s, d: splitting.stratified_split(
            table(s, d, "orders"), "o_orderstatus", ["o_orderkey"]
        ).select("o_orderkey", "o_orderstatus", "split"),
        STRATIFIED_SQL,
    ),
    Query(
        "stratified_split_many",
        lambda s, d: splitting.stratified_split(table(s, d, "orders"), "o_custkey", ["o_orderkey"]).select(
            "o_orderkey", "o_custkey", "split"
        ),
        STRATIFIED_SQL.replace("o_orderstatus", "o_custkey"),
    ),
    Query(
        "kfold_assign",
        lambda s, d: splitting.assign_folds(
            table(s, d, "orders"), "o_orderstatus", ["o_orderkey"]
        ).select("o_orderkey", "o_orderstatus", "fold"),
        FOLD_SQL,
    ),
]
