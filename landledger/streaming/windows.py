"""Event rates over time windows, the same for a table and for a stream.

On a stream, `delay` is how far behind the latest event a record may come. A window is told once, when the watermark has
passed its end, and its state is dropped; a record that comes after that is dropped too. On a table nothing is late.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DELAY = "1 hour"


def _timed(events: DataFrame, delay: str) -> DataFrame:
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)


def _measures() -> list[Column]:
    return [F.count("*").alias("events"), F.count_if(F.col("value").isNull()).alias("unvalued"), F.sum("value").alias("value"), F.max("value").alias("most")]


def _told(windowed: DataFrame, keys: list[str]) -> DataFrame:
    return windowed.select(F.col("window.start").alias("opened"), F.col("window.end").alias("closed"), *keys, "events", "unvalued", "value", "most")


def tumbling(events: DataFrame, length: str, keys: list[str], delay: str = DELAY) -> DataFrame:
    """Events, and sum and maximum of their values, per window and key; windows lie end to end."""
    return _told(_timed(events, delay).groupBy(F.window("ts", length).alias("window"), *keys).agg(*_measures()), keys)


def sliding(events: DataFrame, length: str, step: str, keys: list[str], delay: str = DELAY) -> DataFrame:
    """The same for windows that begin every `step`; an event counts in each window over it."""
    return _told(_timed(events, delay).groupBy(F.window("ts", length, step).alias("window"), *keys).agg(*_measures()), keys)


def sessions(events: DataFrame, gap: str, keys: list[str], delay: str = DELAY) -> DataFrame:
    """The same for runs of a key's events less than `gap` apart; a session closes `gap` after its last event."""
    return _told(_timed(events, delay).groupBy(F.session_window("ts", gap).alias("window"), *keys).agg(*_measures()), keys)


def rates(windows: DataFrame) -> DataFrame:
    """Events an hour and mean value of each window."""
    hours = (F.col("closed").cast("double") - F.col("opened").cast("double")) / 3600
    return windows.withColumns({"per_hour": F.col("events") / hours, "mean": F.try_divide(F.col("value"), F.col("events") - F.col("unvalued"))})
