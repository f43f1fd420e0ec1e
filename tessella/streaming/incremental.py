"""Item-by-item evaluation as a stream. An extension: what it extends reads finite iterators only.

Counters are kept per key across micro-batches; a watermark bounds the state of the windowed form.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def windowed(stream: DataFrame, every: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """window_start, event_type, n, mean over tumbling windows."""
    rows = stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", every), "event_type")
    return rows.agg(F.count("*").alias("n"), F.avg("value").alias("mean")).select(F.col("window.start").alias("window_start"), "event_type", "n", "mean")


def running(stream: DataFrame) -> DataFrame:
    """event_type, n, mean after each micro-batch: counters that are carried from item to item."""

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, total = state.get if state.exists else (0, 0.0)
        for f in frames:
            n, total = n + len(f), total + float(f["value"].sum())
        state.update((n, total))
        yield pd.DataFrame({"event_type": [key[0]], "n": [n], "mean": [total / max(1, n)]})

    return stream.select("event_type", "value").groupBy("event_type").applyInPandasWithState(update, "event_type string, n long, mean double", "n long, total double", "update", GroupStateTimeout.NoTimeout)
