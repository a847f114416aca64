"""Streaming forms of the window operators: event time, watermarks and per-key state.

The batch operators work on an index; a stream has event time instead. Both functions take any
streaming DataFrame with a timestamp.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tiles(stream: DataFrame, ts: str, key: str, value: str, size: str, late: str) -> DataFrame:
    """Tumbling tiles per key with count, mean and deviation; rows later than ``late`` are left out."""
    t = stream.withColumn("__ts", F.col(ts).cast("timestamp")).withWatermark("__ts", late)
    g = t.groupBy(F.window("__ts", size).alias("w"), key).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"))
    return g.select(key, F.col("w.start").alias("start"), "n", "mean", "std")


def sessions(stream: DataFrame, ts: str, key: str, gap: str, late: str) -> DataFrame:
    """Sessions that a gap ends."""
    t = stream.withColumn("__ts", F.col(ts).cast("timestamp")).withWatermark("__ts", late)
    g = t.groupBy(F.session_window("__ts", gap).alias("w"), key).agg(F.count("*").alias("n"))
    return g.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def smoothed(stream: DataFrame, key: str, order: str, value: str, alpha: float) -> DataFrame:
    """Exponential smoothing that carries on from batch to batch; one state value per key."""

    def step(name, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(parts)).sort_values(order)
        out = []
        for x in rows[value]:
            last = x if last is None else last * (1 - alpha) + x * alpha
            out.append(last)
        state.update((float(last),))
        yield pd.DataFrame({key: rows[key], order: rows[order], "ema": out})

    kinds = dict(stream.dtypes)
    return stream.select(key, order, value).groupBy(key).applyInPandasWithState(step, f"{key} {kinds[key]}, {order} {kinds[order]}, ema double", "last double", "append", "NoTimeout")
