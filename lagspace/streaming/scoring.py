"""Forecasts for a stream of states against a fixed library."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.simplex import simplex


def score(states: DataFrame, library: DataFrame, sink: Callable[[DataFrame, int], None], keys: Sequence[str] = (), checkpoint: str | None = None, **trigger) -> StreamingQuery:
    """Start a query that forecasts each micro-batch of a stream (keys, t, x0, ...) by simplex projection and hands the result to sink(frame, batch id).

    The batch plan is the same as for tables. A sink that writes by batch id gives
    each state exactly one forecast, whatever fails in between.
    """
    writer = states.writeStream.foreachBatch(lambda batch, i: sink(simplex(library, batch, keys), i))
    if checkpoint:
        writer = writer.option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()
