"""Where results go: the data behind plots, and fitted models."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import DataFrame


def save_report(report: DataFrame, path: str, kind: str = "parquet") -> None:
    """Writes what a plot would show; kind is parquet, json, csv or orc."""
    if kind not in ("parquet", "json", "csv", "orc"):
        raise ValueError("kind is parquet, json, csv or orc")
    report.write.mode("overwrite").format(kind).option("header", True).save(path)


def save_model(model, path: str) -> None:
    """Writes a fitted Spark ML model, alone or as the one stage of a pipeline."""
    (model if isinstance(model, PipelineModel) else PipelineModel([model])).write().overwrite().save(path)


def load_model(path: str):
    model = PipelineModel.load(path)
    return model.stages[0] if len(model.stages) == 1 else model


def pipeline(*stages) -> Pipeline:
    return Pipeline(stages=list(stages))
