"""Structured Streaming over log data: event-time windows with watermarks, sessions, order checks."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from daqframe.operators.time import floor_divide


def event_time(frame: DataFrame, ticks: str, ticks_per_second: int, into: str = "event_time") -> DataFrame:
    """frame with a timestamp from ticks since 1970, floored to the microsecond, exact for any rate."""
    micros = F.col(ticks).cast("decimal(20,0)") * F.lit(1_000_000).cast("decimal(7,0)")
    return frame.withColumn(into, F.timestamp_micros(floor_divide(micros, F.lit(ticks_per_second))))


def tumbling(frame: DataFrame, time: str, by: list[str], value: str, width: str, late: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """Count and sum by key and window; rows later than the watermark are dropped in append mode."""
    window = F.window(time, width, slide) if slide else F.window(time, width)
    grouped = frame.withWatermark(time, late).groupBy(window.alias("w"), *by)
    return grouped.agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("window_start"), *by, "n", "total")


def gaps(frame: DataFrame, time: str, by: list[str], gap: str, late: str = "10 minutes") -> DataFrame:
    """Sessions by key: rows less than gap apart."""
    grouped = frame.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("w"), *by)
    return grouped.agg(F.count("*").alias("n")).select(F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), *by, "n")


def order_violations(frame: DataFrame, by: list[str], value: str) -> DataFrame:
    """by and value of rows that don't exceed the largest value seen for their key so far, across micro-batches.

    State is one number for each key. Rows of one batch are taken by rising value of their arrival column ``position``.
    """

    def check(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(frames)).sort_values("position")
        last = state.get[0] if state.exists else None
        bad = []
        for x in rows[value]:
            if last is not None and x <= last:
                bad.append((*key, int(x)))
            last = int(x) if last is None else max(last, int(x))
        state.update((last,))
        yield pd.DataFrame(bad, columns=[*by, value])

    types = {f.name: f.dataType.simpleString() for f in frame.schema.fields}
    out = ", ".join(f"{c} {types[c]}" for c in by) + f", {value} long"
    return frame.groupBy(*by).applyInPandasWithState(check, out, "last long", "append", GroupStateTimeout.NoTimeout)


def memory_table(stream: DataFrame, name: str, mode: str) -> DataFrame:
    """Runs a stream over all that its source has now and returns its memory table; for small results and tests."""
    query = stream.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)
