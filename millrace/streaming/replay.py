"""Replaying a recipe on a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from millrace.plans.recipe import Recipe


def replay_stream(recipe: Recipe, stream: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Run a row-wise recipe on a streaming DataFrame and append the result to Parquet files.

    Such a recipe keeps no state, so the same projection and filters that run on a table run on each micro-batch.
    ``trigger`` is what ``DataStreamWriter.trigger`` takes; the default processes what is there and stops.
    """
    wide = [s.op for s in recipe.active if not s.local]
    if wide:
        raise ValueError(f"these steps look at more than one row and cannot run on a stream: {wide}")
    writer = recipe.apply(stream).writeStream.format("parquet").outputMode("append")
    writer = writer.option("path", path).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()
