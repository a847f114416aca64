"""Streams of Parquet files against the batch results."""

import numpy as np
from pyspark.sql import functions as F

from tilewright.streaming import windows


def _run(spark, df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name)


def test_streams(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet")
    events.repartition(2).write.parquet(str(tmp_path / "events"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "events"))
    got = _run(spark, windows.tiles(stream, "ts", "user_id", "value", "1 day", "400 days"), "tiles_out", "append")
    assert got.columns == ["user_id", "start", "n", "mean", "std"]
    complete = _run(spark, windows.tiles(stream, "ts", "user_id", "value", "1 day", "400 days"), "tiles_all", "complete")
    assert complete.agg(F.sum("n")).first()[0] == events.count()
    s = _run(spark, windows.sessions(stream, "ts", "user_id", "6 hours", "400 days"), "sessions_all", "complete")
    assert s.agg(F.sum("n")).first()[0] == events.count()
    ema = _run(spark, windows.smoothed(stream, "user_id", "event_id", "value", 0.3), "ema_out")
    assert ema.count() == events.count() and np.isfinite(ema.agg(F.max("ema")).first()[0])
