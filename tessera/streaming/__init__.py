"""Structured Streaming: bars of an unbounded source.

The engine's contract is batch; bars are the one operator with a natural incremental form, so ticks can
be rolled to bars as they come in, and everything after works on the committed bars.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def bars(ticks: DataFrame, minutes: int = 1, lateness: str = "10 minutes") -> DataFrame:
    """symbol, bar_start_time, bar_end_time, open, high, low, close, volume of ticks (symbol, ts timestamp, value), streaming or not."""
    rolled = ticks.withWatermark("ts", lateness).groupBy("symbol", F.window("ts", f"{minutes} minutes").alias("w"))
    out = rolled.agg(F.min_by("value", "ts").alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", "ts").alias("close"), F.count("*").alias("volume"))
    return out.select("symbol", F.col("w.start").alias("bar_start_time"), F.col("w.end").alias("bar_end_time"), "open", "high", "low", "close", "volume")
