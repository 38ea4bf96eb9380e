"""Where results go: models, reports and the audit trail."""

from __future__ import annotations

import os
from typing import Any

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.training import Matrix, NeighbourModel


def save_model(model: Any, matrix: Matrix, name: str, path: str) -> str:
    """Write the fitted model and one row of facts about it; returns the path.

    A nearest-neighbour model *is* its training rows, so those are written.
    """
    spark = matrix.df.sparkSession
    if isinstance(model, NeighbourModel):
        model.train.write.mode("overwrite").parquet(os.path.join(path, "rows"))
    else:
        stages = model if isinstance(model, PipelineModel) else PipelineModel(stages=[model])
        stages.write().overwrite().save(os.path.join(path, "stages"))
    facts = spark.createDataFrame(
        [(matrix.task, name, matrix.names, matrix.classes)],
        "task string, model_name string, feature_names array<string>, classes array<string>",
    )
    facts.write.mode("overwrite").parquet(os.path.join(path, "facts"))
    return path


def load_model(spark: SparkSession, path: str) -> tuple[Any, dict[str, Any]]:
    """The model and its facts, ready to score an assembled table."""
    facts = spark.read.parquet(os.path.join(path, "facts")).first().asDict()
    if facts["model_name"] == "knn":
        rows = spark.read.parquet(os.path.join(path, "rows"))
        matrix = Matrix(rows, facts["feature_names"], facts["task"], facts["classes"])
        return NeighbourModel(rows, matrix), facts
    return PipelineModel.load(os.path.join(path, "stages")), facts


def write_report(report: DataFrame, path: str, fmt: str = "parquet") -> str:
    report.write.mode("overwrite").format(fmt).save(path)
    return path


def summary_json(reports: dict[str, DataFrame]) -> DataFrame:
    """One row, one JSON text: every small report under its name.

    Only reports bounded by columns, checks or models belong here; row-level
    results are written as tables instead.
    """
    out = None
    for name, df in sorted(reports.items()):
        part = df.agg(
            F.sort_array(F.collect_list(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])))).alias("r")
        ).select(
            F.lit(name).alias("name"),
            F.concat(F.lit("["), F.concat_ws(",", "r"), F.lit("]")).alias("json"),
        )
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("Nothing to summarise")
    pieces = F.sort_array(F.collect_list(F.concat(F.lit('"'), "name", F.lit('":'), "json")))
    return out.agg(F.concat(F.lit("{"), F.concat_ws(",", pieces), F.lit("}")).alias("summary"))


AUDIT_SCHEMA = "run string, step int, name string, status string, value double, detail string"


def audit_frame(df_or_spark: DataFrame | SparkSession, rows: list[tuple]) -> DataFrame:
    spark = df_or_spark if isinstance(df_or_spark, SparkSession) else df_or_spark.sparkSession
    return spark.createDataFrame(rows, AUDIT_SCHEMA)


def append_audit(audit: DataFrame, path: str) -> str:
    audit.write.mode("append").parquet(path)
    return path


