"""Registered queries: chart series, fingerprints, payload and narratives."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from ..operators import charts, insights
from ..operators.target import task_detection
from ..sources.fingerprint import file_manifest, table_fingerprint
from .base import DIRTY_COLUMNS, DIRTY_SQL, Query, dirty_orders, table, union_sql
from .quality import DIRTY_NUMERIC, DUPLICATES_SQL, missing_sql, outlier_sql

# Narratives derived from every document: lists, blanks, too many bullets, a
# section that is no list, a missing section, and text that is no JSON.
NARRATIVE_TEXT = (
    "CASE"
    " WHEN doc_id % 5 = 0 THEN concat('{\"descriptive_analytics\": [\"', lang, ' text\", \"   \", \" from ', source, ' \"],"
    " \"risk_assessment\": [\"1\", \"2\", \"3\", \"4\", \"5\", \"6\", \"7\"]}')"
    " WHEN doc_id % 5 = 1 THEN concat('{\"diagnostic_analytics\": \"', CAST(n_chars AS STRING), ' characters\","
    " \"predictive_analytics\": []}')"
    " WHEN doc_id % 5 = 2 THEN concat('not json ', source)"
    " WHEN doc_id % 5 = 3 THEN concat('{\"prescriptive_analytics\": [', CAST(n_chars AS STRING), ', \"keep ', lang, '\"],"
    " \"other\": [\"x\"]}')"
    " ELSE concat('{\"predictive_analytics\": ', CAST(n_chars AS STRING), '}') END"
)
NARRATIVE_SQL = f"SELECT doc_id, {NARRATIVE_TEXT} AS raw FROM documents"


def _narratives(spark, folder):
    told = table(spark, folder, "documents").selectExpr("doc_id", f"{NARRATIVE_TEXT} AS raw")
    return insights.validate_narratives(told, "doc_id", "raw")


NARRATIVE_TWIN = (
    f"WITH n AS ({NARRATIVE_SQL.replace('AS STRING', 'AS VARCHAR')}),"
    " ok AS (SELECT doc_id, raw::JSON AS j FROM n WHERE json_valid(raw)), s AS ("
    + union_sql(
        [
            f"SELECT doc_id, '{name}' AS section, CASE json_type(j, '$.{name}') WHEN 'ARRAY'"
            f" THEN list_transform(CAST(json_extract(j, '$.{name}') AS JSON[]), lambda x: trim(json_extract_string(x, '$')))"
            f" ELSE [trim(json_extract_string(j, '$.{name}'))] END AS b FROM ok"
            f" WHERE json_type(j, '$.{name}') IS NOT NULL"
            for name in insights.SECTIONS
        ]
    )
    + "), k AS (SELECT doc_id, section, list_filter(b, lambda x: x <> '')[1:5] AS b FROM s)"
    " SELECT doc_id, section, unnest(range(1, len(b) + 1))::INTEGER AS bullet_no, unnest(b) AS bullet FROM k"
)

PAYLOAD_SQL = (
    missing_sql(DIRTY_COLUMNS, "dirty", DIRTY_SQL)
    + f", t AS ({DUPLICATES_SQL.format(t='dirty')})"
    + union_sql(
        [
            " SELECT 'dataset_summary' AS section, 'rows' AS metric, max(n_rows)::DOUBLE AS value, NULL::VARCHAR AS detail"
            " FROM by_column",
            " SELECT 'dataset_summary', 'columns', count(*)::DOUBLE, NULL FROM by_column",
            " SELECT 'data_quality', 'missing_pct', round(sum(missing_count) * 100.0 / sum(n_rows), 2)::DOUBLE, NULL"
            " FROM by_column",
            " SELECT 'data_quality', 'duplicates', duplicates::DOUBLE, NULL FROM t",
            " SELECT 'charts', f, NULL, c FROM (VALUES ('kpi_1', 'KPI Card'), ('comparison_1', 'Bar Chart'),"
            " ('comparison_2', 'Grouped Bar'), ('comparison_3', 'Stacked Bar'), ('comparison_4', 'Column Chart'),"
            " ('composition_1', 'Pie Chart'), ('composition_2', 'Donut Chart'), ('composition_3', 'Treemap'),"
            " ('relationship_1', 'Scatter Plot'), ('relationship_2', 'Bubble Chart'),"
            " ('relationship_3', 'Correlation Heatmap'), ('distribution_1', 'Histogram'),"
            " ('distribution_2', 'Box Plot')) AS v(f, c)",
        ]
    )
)


def _bullets_sql():
    others = [c for c in DIRTY_NUMERIC if c != "leak"]
    r = union_sql(
        [f"SELECT '{c}' AS c, round(abs(corr({c}::DOUBLE, leak)), 4) AS r FROM dirty" for c in others]
    )
    numbered = "row_number() OVER (ORDER BY {o})::INTEGER AS bullet_no"
    return (
        missing_sql(DIRTY_COLUMNS, "dirty", DIRTY_SQL)
        + f", t AS ({DUPLICATES_SQL.format(t='dirty')}), r AS ({r})"
        + f", strange AS ({outlier_sql(DIRTY_NUMERIC, 'dirty', 'iqr')})"
        + ", o AS (SELECT max(n_rows) AS n, count(*) AS k, round(sum(missing_count) * 100.0 / sum(n_rows), 2)::DOUBLE AS p"
        " FROM by_column)"
        + union_sql(
            [
                " SELECT 'descriptive_analytics' AS section, 1 AS bullet_no,"
                " format('The table has {} rows and {} columns.', n, k) AS bullet FROM o",
                " SELECT 'descriptive_analytics', 2, format('{:.2f}% of all cells are missing.', p) FROM o",
                " SELECT 'descriptive_analytics', 3, format('{} rows are duplicates.', duplicates) FROM t",
                f" SELECT * FROM (SELECT 'diagnostic_analytics', {numbered.format(o='r DESC, c')},"
                " format('{} has an absolute correlation of {:.4f} with leak.', c, r) FROM r WHERE r IS NOT NULL"
                " ORDER BY r DESC, c LIMIT 5)",
                f" SELECT * FROM (SELECT 'risk_assessment', {numbered.format(o='outliers DESC, \"column\"')},"
                " format('{} has {} outliers ({:.2f}%).', \"column\", outliers, outlier_pct) FROM strange WHERE outliers > 0"
                " ORDER BY outliers DESC, \"column\" LIMIT 5)",
                " SELECT 'predictive_analytics', 1, format('leak has {} distinct values and asks for {}.',"
                " count(DISTINCT leak), 'regression') FROM dirty",
                f" SELECT * FROM (SELECT 'prescriptive_analytics', {numbered.format(o='missing_count DESC, \"column\"')},"
                " format('Fill or drop {}, missing in {:.2f}% of rows.', \"column\", missing_pct) FROM by_column"
                " WHERE missing_count > 0 ORDER BY missing_count DESC, \"column\" LIMIT 5)",
            ]
        )
    )


def _histogram_sql(source, c, bins=20):
    return (
        f"WITH e AS (SELECT min({c}) AS lo, (max({c}) - min({c})) / {bins} AS w FROM {source}),"
        f" b AS (SELECT least(floor(({c} - lo) / w), {bins - 1})::INTEGER AS bin, count(*) AS n FROM {source}, e GROUP BY 1),"
        f" a AS (SELECT unnest(range({bins}))::INTEGER AS bin)"
        " SELECT a.bin, round(lo + a.bin * w, 6) AS low, round(lo + (a.bin + 1) * w, 6) AS high,"
        " coalesce(n, 0)::BIGINT AS n FROM a LEFT JOIN b USING (bin), e"
    )


def _box_sql(source, columns):
    return union_sql(
        [
            f"SELECT '{c}' AS \"column\", min(x) FILTER (WHERE x BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1))"
            " AS low_whisker, round(any_value(q1), 6) AS q1, round(any_value(q2), 6) AS median,"
            " round(any_value(q3), 6) AS q3, max(x) FILTER (WHERE x BETWEEN q1 - 1.5 * (q3 - q1) AND"
            " q3 + 1.5 * (q3 - q1)) AS high_whisker, count(*) FILTER (WHERE x < q1 - 1.5 * (q3 - q1) OR"
            f" x > q3 + 1.5 * (q3 - q1)) AS beyond FROM (SELECT {c}::DOUBLE AS x FROM {source}),"
            f" (SELECT quantile_cont({c}::DOUBLE, 0.25) AS q1, quantile_cont({c}::DOUBLE, 0.5) AS q2,"
            f" quantile_cont({c}::DOUBLE, 0.75) AS q3 FROM {source})"
            for c in columns
        ]
    )


FINGERPRINT_SQL = (
    "WITH h AS (SELECT ('0x' || substr(md5(concat_ws(chr(1), {cells})), 1, 12))::BIGINT AS h FROM {source})"
    " SELECT count(*) AS rows, CAST(sum(h) AS VARCHAR) AS checksum, CAST(bit_xor(h) AS VARCHAR) AS parity FROM h"
)
TEXT_CELLS = ["doc_id", "text", "lang", "source", "n_chars"]


def _order_cells(names):
    return ", ".join(f"coalesce(CAST({c} AS VARCHAR), chr(0))" for c in names)


def _chart_plans(spark, folder):
    """The plan for each order column as a target; the data tells which task it sets."""
    orders, out = table(spark, folder, "orders"), None
    tasks = {r["column"]: r["task"] for r in task_detection(orders).collect()}
    for name in orders.columns:
        plan = charts.recommend(orders, name, tasks[name]).select(F.lit(name).alias("target"), "*")
        out = plan if out is None else out.unionByName(plan)
    return out


def _rounded(df):
    """Means to four places: engines add doubles in different orders."""
    return df.withColumn("mean", F.round("mean", 4))


QUERIES = [
    Query(
        "kpi_card",
        lambda s, d: _rounded(charts.kpi_card(table(s, d, "orders"), "o_totalprice")),
        "SELECT count(o_totalprice) AS count, round(sum(o_totalprice), 2) AS total, round(avg(o_totalprice), 4) AS mean,"
        " min(o_totalprice) AS min, round(quantile_cont(o_totalprice, 0.5), 4) AS median, max(o_totalprice) AS max"
        " FROM orders",
    ),
    Query(
        "histogram", lambda s, d: charts.histogram(table(s, d, "events"), "value"), _histogram_sql("events", "value")
    ),
    Query(
        "histogram_inf",
        lambda s, d: charts.histogram(
            table(s, d, "events").selectExpr(
                "CASE WHEN event_id % 90 = 1 THEN double('Infinity') WHEN event_id % 90 = 2 THEN double('-Infinity') ELSE value END AS x"
            ),
            "x",
        ),
        "WITH f AS (SELECT value AS x FROM events WHERE event_id % 90 NOT IN (1, 2)) SELECT * FROM ("
        + _histogram_sql("f", "x")
        + ") UNION ALL SELECT 20, 'Infinity'::DOUBLE, 'Infinity'::DOUBLE, count(*) FROM events WHERE event_id % 90 = 1"
        " UNION ALL SELECT -1, '-Infinity'::DOUBLE, '-Infinity'::DOUBLE, count(*) FROM events WHERE event_id % 90 = 2",
    ),
    Query(
        "box_plot",
        lambda s, d: charts.box_plot(table(s, d, "events"), ["value", "user_id"]),
        _box_sql("events", ["value", "user_id"]),
    ),
    Query(
        "category_comparison",
        lambda s, d: _rounded(
            charts.category_comparison(table(s, d, "lineitem"), "l_extendedprice", ["l_returnflag", "l_linestatus"])
        ),
        "SELECT l_returnflag, l_linestatus, count(l_extendedprice) AS n, round(sum(l_extendedprice), 2) AS total,"
        " round(avg(l_extendedprice), 4) AS mean FROM lineitem GROUP BY ALL",
    ),
    Query(
        "composition_share",
        lambda s, d: charts.composition_share(table(s, d, "orders"), "o_totalprice", "o_orderpriority"),
        "SELECT o_orderpriority AS category, round(sum(o_totalprice), 2) AS total,"
        " round(sum(o_totalprice) / (SELECT sum(o_totalprice) FROM orders), 6) AS share FROM orders GROUP BY 1",
    ),
    *[
        Query(
            f"trend_{grain}",
            lambda s, d, grain=grain: charts.trend_series(
                table(s, d, "orders").withColumn("o_totalprice", F.col("o_totalprice").cast("decimal(15,2)")),
                "o_orderdate",
                "o_totalprice",
                grain,
            ),
            f"WITH p AS (SELECT date_trunc('{grain}', o_orderdate)::DATE AS d, count(o_totalprice) AS n,"
            " sum(o_totalprice::DECIMAL(15, 2)) AS s FROM orders GROUP BY 1)"
            " SELECT strftime(d, '%Y-%m-%d') AS period, n, s::DOUBLE AS total, s::DOUBLE / n AS mean,"
            " (sum(s) OVER w)::DOUBLE / count(s) OVER w AS moving_mean,"
            " (s - lag(s) OVER (ORDER BY d))::DOUBLE AS change FROM p"
            " WINDOW w AS (ORDER BY d ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)",
        )
        for grain in ("month", "quarter")
    ],
    Query(
        "chart_sample",
        lambda s, d: charts.point_sample(table(s, d, "orders"), "o_orderkey", ["o_custkey", "o_totalprice"]),
        "SELECT o_orderkey, o_custkey, o_totalprice FROM orders"
        " ORDER BY md5(CAST(o_orderkey AS VARCHAR)), o_orderkey LIMIT 1000",
    ),
    Query(
        "chart_plan",
        _chart_plans,
    ),
    Query(
        "table_fingerprint",
        lambda s, d: table_fingerprint(table(s, d, "documents"), TEXT_CELLS),
        FINGERPRINT_SQL.format(cells=_order_cells(TEXT_CELLS), source="documents"),
    ),
    Query(
        "file_manifest",
        lambda s, d: file_manifest(s, os.path.join(d, "*.parquet")).select(
            F.element_at(F.split("path", "/"), -1).alias("file"), "length", "sha256"
        ),
    ),
    Query(
        "analysis_payload",
        lambda s, d: insights.analysis_payload(dirty_orders(s, d), "leak"),
        PAYLOAD_SQL,
    ),
    Query("narrative_validate", _narratives, NARRATIVE_TWIN),
    Query("rule_bullets", lambda s, d: insights.rule_bullets(dirty_orders(s, d), "leak"), _bullets_sql()),
]
