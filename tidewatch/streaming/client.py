"""A client's path as a stateful processor over a stream of its rows.

State lives in the state store in its parts: a value for the detector and the models in use, a list of the delayed samples, a list of the models'
histories, a list of the open session's losses, and an event-time timer that ends a session which no more samples will come for. All are of
bounded size for a key, a key's rows of a micro-batch are walked batch by batch, and a restart goes on from the checkpoint.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.detectors import HoeffdingMean
from ..operators.path import EVENTS, Path, Rules

#: The state store that list states and timers need.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class ClientPath(StatefulProcessor):
    """Steps :class:`Path` over a key's rows. Micro-batches follow the order of positions; within one rows are sorted."""

    def __init__(self, key: str, order: str, time: str, losses: list[str], rules: Rules, wait_ms: int):
        self.key, self.order, self.time, self.losses, self.rules, self.wait_ms = key, order, time, losses, rules, wait_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        sample = "array<double>"
        self.core = handle.getValueState("core", "current long, last long, proposed long, reference long, total double, n long, lowest double, lowest_n long, timer long")
        self.buffer = handle.getListState("buffer", f"pos long, losses {sample}")
        self.history = handle.getListState("history", "n long, total double")
        self.session = handle.getListState("session", "candidate double, reference double")

    def _load(self) -> tuple[Path, int]:
        path = Path(self.rules, len(self.losses))
        if not self.core.exists():
            return path, -1
        path.current, path.last, path.proposed, path.reference, total, n, lowest, lowest_n, timer = self.core.get()
        path.detector = HoeffdingMean()
        path.detector.total, path.detector.n = total, n
        path.detector.lowest = (lowest, lowest_n) if lowest_n else None
        path.buffer = [(pos, tuple(losses)) for pos, losses in self.buffer.get()]
        path.history = [[n, total] for n, total in self.history.get()]
        path.session = [tuple(x) for x in self.session.get()]
        return path, timer

    def _save(self, path: Path, timer: int) -> None:
        lowest, lowest_n = path.detector.lowest or (0.0, 0)
        self.core.update((path.current, path.last, path.proposed, path.reference, path.detector.total, path.detector.n, lowest, lowest_n, timer))
        for state, rows in ((self.buffer, [(pos, list(x)) for pos, x in path.buffer]), (self.history, [tuple(x) for x in path.history]), (self.session, path.session)):
            state.put(rows) if rows else state.clear()

    def _told(self, key, events: list[tuple]) -> pd.DataFrame:
        out = pd.DataFrame([(key[0], *e) for e in events], columns=[self.key, "pos", "kind", "model", "n", "value"])
        return out.astype({self.key: "int64", "pos": "int64", "model": "int64", "n": "int64", "value": "float64"})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        path, timer = self._load()
        columns, events = [self.order, self.time, *self.losses], []
        batch = pd.concat([r[columns] for r in rows]).sort_values(self.order)  # what one micro-batch brings for one key
        for pos, at, *losses in batch.itertuples(index=False, name=None):
            events += path.step(int(pos), tuple(map(float, losses)))
            if path.proposed >= 0 and timer < 0:
                timer = int(pd.Timestamp(at).timestamp() * 1000) + self.wait_ms
                self.handle.registerTimer(timer)
            elif path.proposed < 0 <= timer:
                self.handle.deleteTimer(timer)
                timer = -1
        self._save(path, timer)
        yield self._told(key, events)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        path, _ = self._load()
        events = path.finish()
        self._save(path, -1)
        yield self._told(key, events)

    def close(self) -> None:
        pass


def follow(stream: DataFrame, losses: list[str], time: str = "ts", late: str = "1 hour", wait: str = "30 days", rules: Rules | None = None, key: str = "client", order: str = "pos") -> DataFrame:
    """``key`` and the events of each key's path over a stream; a session still open ``wait`` after its proposal, by the watermark ``late``
    behind the newest row, is rejected. The session needs ``PROVIDER`` as its state store."""
    days = pd.Timedelta(wait)
    chosen = stream.select(key, order, F.col(time).cast("timestamp").alias(time), *losses).withWatermark(time, late)
    processor = ClientPath(key, order, time, losses, rules or Rules(), int(days.total_seconds() * 1000))
    return chosen.groupBy(key).transformWithStateInPandas(processor, f"{key} long, {EVENTS}", "Append", "EventTime")
