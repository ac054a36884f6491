"""Fitted models on streams: what a model learned is a static projection or lookup, so it applies to an endless frame as well."""

from __future__ import annotations

from pyspark.sql import DataFrame


def apply_to_stream(model, stream: DataFrame, path: str, checkpoint: str, trigger: dict | None = None):
    """Starts a query that writes model.transform(stream) to Parquet in append mode, exactly once."""
    if not stream.isStreaming:
        raise ValueError("a streaming frame is wanted")
    return model.transform(stream).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(**(trigger or {"availableNow": True})).start()
