"""Micro-batches of a stream through a pipeline: an addition of this library, for inputs that arrive bit by bit."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..pipeline import Pipeline, Plan


def run_stream(pipeline: Pipeline, stream: DataFrame, columns: list[str], order: list[str], sink: Callable[[Plan, int], None], checkpoint: str) -> StreamingQuery:
    """Each micro-batch is one finite run; sink(plan, batch number) writes its outputs, and is called again for a batch that failed."""
    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda df, n: sink(pipeline.plan(df, columns, order), n)).trigger(availableNow=True).start()
