"""From a file or a table to validated, clean, profiled, prepared and modelled data."""

from __future__ import annotations

import time
import uuid
from collections.abc import Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from ..functions.numeric import nan_to_null
from ..operators.charts import recommend
from ..operators.cleaning import Cleaned, clean
from ..operators.features import Prepared, prepare
from ..operators.insights import analysis_payload, rule_bullets
from ..operators.training import Trained, build_matrix, score_batch, train_models
from ..operators.typing import infer_types
from ..sources.fingerprint import file_manifest, table_fingerprint
from ..sources.readers import format_of, load_table, strip_headers
from .profiling import Profile, profile
from .sinks import audit_frame
from .validation import DataValidationError, Validation, validate


@dataclass
class Processed:
    """Everything one run produced; row-level parts stay distributed and lazy."""

    raw: DataFrame
    validation: Validation
    cleaned: Cleaned
    profile: Profile
    prepared: Prepared
    audit: DataFrame


class _Trail:
    """Collects one audit row per step; a run has a handful of them."""

    def __init__(self, spark: SparkSession):
        self.spark, self.run, self.rows = spark, uuid.uuid4().hex, []
        self.started = time.time()

    def add(self, name: str, status: str = "done", value: float | None = None, detail: str | None = None):
        self.rows.append(
            (self.run, len(self.rows) + 1, name, status, None if value is None else float(value), detail)
        )

    def frame(self) -> DataFrame:
        return audit_frame(self.spark, self.rows)


def process(
    spark: SparkSession,
    source: str | DataFrame,
    target: str | None = None,
    key: Sequence[str] | None = None,
    validation_config: Any = None,
    cleaning_config: Any = None,
    feature_config: Any = None,
    fail_on_validation_error: bool = True,
) -> Processed:
    """Load, validate the raw table, clean, profile the clean table, prepare features.

    Checks read the raw table several times.  Columnar files are simply scanned
    again, each check reading its own columns; any other source is persisted until
    the clean table, which is persisted too, stands.  Call
    ``result.cleaned.release()`` when done.  A failure carries the audit so far as
    ``error.audit``.
    """
    trail = _Trail(spark)
    try:
        if isinstance(source, str):
            for f in file_manifest(spark, source).collect():
                trail.add("source_file", "found", f["length"], f"{f['path']} sha256:{f['sha256']}")
            raw = load_table(spark, source)
            held = format_of(source) != "parquet"
        else:
            raw = nan_to_null(strip_headers(source))
            held = not (raw.storageLevel.useMemory or raw.storageLevel.useDisk)
            mark = table_fingerprint(raw).first()
            trail.add("source_table", "found", mark["rows"], mark["checksum"])
        if held:
            raw = raw.persist()
        rows = raw.count()
        target = target.strip() if target else target
        trail.add("load", "done", rows, ",".join(raw.columns))
        checked = validate(raw, target, validation_config)
        trail.add("validate", checked.status, len(checked.warnings), "; ".join(checked.errors) or None)
        if fail_on_validation_error:
            checked.raise_on_failure()
        cleaned = clean(raw, cleaning_config)
        clean_df = cleaned.df.persist()
        cleaned.df = clean_df
        cleaned.held.append(clean_df)
        trail.add("clean", "done", len(cleaned.steps), ",".join(cleaned.removed_columns) or None)
        types = infer_types(clean_df)
        if held:
            raw.unpersist()
        described = profile(clean_df, target, types)
        trail.add("profile", "done", described.health_score, ",".join(described.warnings) or None)
        ready = prepare(clean_df, target, feature_config, key)
        trail.add("prepare", "done", len(ready.feature_names), None)
        trail.add("finish", "SUCCESS", time.time() - trail.started, None)
    except Exception as error:
        trail.add("finish", "FAILED", time.time() - trail.started, str(error))
        error.audit = trail.frame()
        raise
    return Processed(raw, checked, cleaned, described, ready, trail.frame())


@dataclass
class Analysis:
    processed: Processed
    trained: Trained
    predictions: DataFrame | None
    charts: DataFrame
    payload: DataFrame
    bullets: DataFrame


def analyse(
    spark: SparkSession,
    source: str | DataFrame,
    target: str | None,
    key: Sequence[str] | None = None,
    models: Sequence[str] | None = None,
    **configs: Any,
) -> Analysis:
    """The whole run: process, rank models, score the test rows, plan charts, state facts."""
    done = process(spark, source, target, key, **configs)
    clean_df = done.cleaned.df
    known = target if target is not None and target in clean_df.columns else None
    one_key = key[0] if key and len(key) == 1 else None
    matrix = build_matrix(done.prepared.vectors, done.prepared.feature_names, known, one_key)
    trained = train_models(matrix, models)
    scored = None
    if trained.task != "unsupervised" and trained.best is not None:
        scored = score_batch(trained.best, trained.matrix)
    return Analysis(
        done,
        trained,
        scored,
        recommend(clean_df, known, trained.task),
        analysis_payload(clean_df, known, trained, scored),
        rule_bullets(clean_df, known, trained),
    )


__all__ = ["Analysis", "DataValidationError", "Processed", "analyse", "process"]
