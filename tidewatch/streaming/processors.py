"""Continuous forms: detectors as stateful processors, and event-time windows with late data.

A processor's state is the detector's own, of bounded size, kept by key in the state store; its alarms equal those of the batch fold.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def detect(stream: DataFrame, make: Callable, key: str = "client", order: str = "pos", value: str = "loss") -> DataFrame:
    """``key``, ``order``, ``width`` of a detector's alarms over a stream whose batches follow the order within each key."""

    def step(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        detector = pickle.loads(state.get[0]) if state.exists else make()
        rows = pd.concat(list(batches)).sort_values(order)  # one micro-batch of one key
        out = [(group[0], int(p), int(detector.width)) for p, x in zip(rows[order], rows[value]) if detector.step(x)]
        state.update((pickle.dumps(detector),))
        yield pd.DataFrame(out, columns=[key, order, "width"]).astype("int64")

    chosen = stream.select(key, order, value)
    return chosen.groupBy(key).applyInPandasWithState(step, f"{key} long, {order} long, width long", "state binary", "append", GroupStateTimeout.NoTimeout)


def _timed(stream: DataFrame, time: str, late: str) -> DataFrame:
    """With a watermark; wall-clock times count as the session's zone."""
    return stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)


def tumbling(stream: DataFrame, time: str, length: str, late: str, key: str, value: str) -> DataFrame:
    """Counts and sums of event-time windows, closed when the watermark (``late`` behind) has passed them."""
    return _timed(stream, time, late).groupBy(F.window(time, length), key).agg(F.count("*").alias("n"), F.sum(value).alias("total"))


def unique(stream: DataFrame, time: str, late: str, ids: list[str]) -> DataFrame:
    """Rows without repeats of ``ids`` within the watermark."""
    return _timed(stream, time, late).dropDuplicatesWithinWatermark(ids)


def sessions(stream: DataFrame, time: str, gap: str, late: str, key: str) -> DataFrame:
    """Sessions of a key: rows less than ``gap`` apart."""
    return _timed(stream, time, late).groupBy(F.session_window(time, gap), key).agg(F.count("*").alias("n"))


def finished(query_of: DataFrame, name: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Runs a streaming frame over what is there now and returns the collected rows' table (for bounded inputs)."""
    running = query_of.writeStream.format("memory").queryName(name).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    running.awaitTermination()
    return query_of.sparkSession.table(name)
