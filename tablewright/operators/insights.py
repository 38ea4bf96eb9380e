"""Facts and bullet points: the analysis payload, and narratives in a fixed schema."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.report import local_rows
from .charts import recommend
from .frequency import distinct_lookup, duplicate_rows
from .missing import missing_by_column, missing_overall
from .outliers import outlier_report
from .target import target_correlations, task_of

# The sections of a narrative, in order, and the bullets each may hold.
SECTIONS = (
    "descriptive_analytics",
    "diagnostic_analytics",
    "risk_assessment",
    "predictive_analytics",
    "prescriptive_analytics",
)
MAX_BULLETS = 5
PAYLOAD_SCHEMA = "section string, metric string, value double, detail string"
BULLET_SCHEMA = "section string, bullet_no int, bullet string"


def _bullets(raw: Column) -> Column:
    """The bullets of one section: trimmed texts, blanks dropped, the first five."""
    many = F.schema_of_variant(raw).startswith("ARRAY")
    texts = F.when(many, raw.try_cast("array<variant>")).otherwise(F.array(raw))
    texts = F.transform(texts, lambda v: F.regexp_replace(_text(v), r"(?U)(^\s+)|(\s+$)", ""))
    return F.slice(F.filter(texts, lambda t: t.isNotNull() & (t != "")), 1, MAX_BULLETS)


def _text(v: Column) -> Column:
    """Plain text for scalars (None, True and False included), JSON for anything nested."""
    word = F.coalesce(v.try_cast("string"), F.to_json(v))
    truth = F.schema_of_variant(v) == "BOOLEAN"
    return F.when(F.is_variant_null(v), "None").when(truth, F.initcap(word)).otherwise(word)


def validate_narratives(df: DataFrame, key: str, raw: str) -> DataFrame:
    """``(key, section, bullet_no, bullet)`` for a table of JSON narratives.

    Text that is no JSON object gives no bullets; a section that is not a list
    is one bullet.  Rows are only projected and spread out: no shuffle.
    """
    parsed = df.select(F.col(key), F.try_parse_json(raw).alias("v"))
    parts = []
    for name in SECTIONS:
        section = F.try_variant_get("v", f"$.{name}", "variant")
        parts.append(
            F.struct(F.lit(name).alias("section"), F.coalesce(_bullets(section), F.array()).alias("b"))
        )
    return (
        parsed.select(F.col(key), F.inline(F.array(*parts)))
        .select(F.col(key), "section", F.posexplode("b").alias("at", "bullet"))
        .select(key, "section", (F.col("at") + 1).alias("bullet_no"), "bullet")
    )


def analysis_payload(
    df: DataFrame, target: str | None = None, trained: Any = None, scored: DataFrame | None = None
) -> DataFrame:
    """Everything a narrative may state: ``(section, metric, value, detail)``."""
    gaps = missing_overall(df).select(
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(s).alias("section"),
                        F.lit(m).alias("metric"),
                        F.col(c).cast("double").alias("value"),
                        F.lit(None).cast("string").alias("detail"),
                    )
                    for s, m, c in (
                        ("dataset_summary", "rows", "n_rows"),
                        ("dataset_summary", "columns", "n_columns"),
                        ("data_quality", "missing_pct", "total_missing_pct"),
                    )
                ]
            )
        )
    )
    twice = duplicate_rows(df).select(
        F.lit("data_quality").alias("section"),
        F.lit("duplicates").alias("metric"),
        F.col("duplicates").cast("double").alias("value"),
        F.lit(None).cast("string").alias("detail"),
    )
    task = trained.task if trained is not None else None
    charts = recommend(df, target, task).select(
        F.lit("charts").alias("section"),
        F.concat_ws("_", "family", F.col("position").cast("string")).alias("metric"),
        F.lit(None).cast("double").alias("value"),
        F.col("chart").alias("detail"),
    )
    out = gaps.unionByName(twice).unionByName(charts)
    if trained is not None:
        out = out.unionByName(_model_facts(df, trained))
    if scored is not None:
        sample = scored.orderBy("__key").limit(20)
        out = out.unionByName(
            sample.select(
                F.lit("predictions").alias("section"),
                F.col("target").alias("metric"),
                F.col("prediction").alias("value"),
                F.col("__key").cast("string").alias("detail"),
            )
        )
    return out


def _model_facts(df: DataFrame, trained: Any) -> DataFrame:
    from .training import METRICS, feature_importance

    rows: list[tuple] = [
        ("model_info", "name", None, trained.best_name),
        ("model_info", "task", None, trained.task),
    ]
    for r in trained.leaderboard.collect():
        rows += [("model_metrics", m, r[m], r["model"]) for m in METRICS if r[m] is not None]
    if trained.best is not None:
        for name, weight in feature_importance(trained.best, trained.matrix.names) or []:
            rows.append(("feature_importance", name, weight, None))
    return local_rows(df, rows, PAYLOAD_SCHEMA)


def rule_bullets(df: DataFrame, target: str | None = None, trained: Any = None) -> DataFrame:
    """``(section, bullet_no, bullet)``: one plain fact each, five per section at most.

    Facts come from small reports (one row per column), so they are put into
    words on the driver.
    """
    said: dict[str, list[str]] = {s: [] for s in SECTIONS}
    gaps, twice = missing_overall(df).first(), duplicate_rows(df).first()
    said[SECTIONS[0]] += [
        f"The table has {gaps['n_rows']} rows and {gaps['n_columns']} columns.",
        f"{gaps['total_missing_pct']:.2f}% of all cells are missing.",
        f"{twice['duplicates']} rows are duplicates.",
    ]
    if target is not None and target in df.columns:
        linked = target_correlations(df, target).filter("correlation IS NOT NULL")
        linked = linked.withColumn("r", F.round("correlation", 4))
        for r in linked.orderBy(F.desc("r"), "column").limit(MAX_BULLETS).collect():
            said[SECTIONS[1]].append(
                f"{r['column']} has an absolute correlation of {r['r']:.4f} with {target}."
            )
        unique = distinct_lookup(df, [target]).get(target, 0)
        dtype = next(f.dataType for f in df.schema.fields if f.name == target)
        said[SECTIONS[3]].append(
            f"{target} has {unique} distinct values and asks for {task_of(dtype, unique)}."
        )
    strange = outlier_report(df).filter("outliers > 0").orderBy(F.desc("outliers"), "column")
    for r in strange.limit(MAX_BULLETS).collect():
        said[SECTIONS[2]].append(
            f"{r['column']} has {r['outliers']} outliers ({r['outlier_pct']:.2f}%)."
        )
    if trained is not None and trained.best_name:
        best = trained.leaderboard.filter("place = 1").first()
        said[SECTIONS[3]].append(
            f"{best['model']} scores best with {best['primary_metric']} {best['score']:.4f}."
        )
    holes = missing_by_column(df).filter("missing_count > 0")
    for r in holes.orderBy(F.desc("missing_count"), "column").limit(MAX_BULLETS).collect():
        said[SECTIONS[4]].append(f"Fill or drop {r['column']}, missing in {r['missing_pct']:.2f}% of rows.")
    rows = [(s, i + 1, b) for s in SECTIONS for i, b in enumerate(said[s][:MAX_BULLETS])]
    return local_rows(df, rows, BULLET_SCHEMA)


