"""A client's whole path, row by row: prediction, validation of a proposed model, detector, delay buffer, resolution, release.

One machine (:class:`Path`) with an explicit state of bounded size; :func:`follow` walks it over whole keys in a batch,
``streaming.client`` keeps the same state between micro-batches. Both give the same events.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from .detectors import HoeffdingMean
from .folds import fold

EVENTS = "pos long, kind string, model long, n long, value double"


@dataclass(frozen=True)
class Rules:
    """The delay buffer's length, the least number of new samples to decide on, how far a fitting model's loss may pass its history, how many
    future samples validate a proposed model, and by how much it has to be better."""

    delay: int = 30
    least: int = 5
    limit: float = 0.1
    session: int = 10
    gain: float = 1e-4


@dataclass
class Path:
    """State of a client with models 0, 1, … whose losses come with each row.

    ``step`` returns events ``(pos, kind, model, n, value)``: at an alarm ``insufficient_data`` (the buffer stays), ``suppressed`` (a session is open),
    ``maintain``, ``reuse`` (another model fits its history), ``create`` (none does; the first model without history is proposed) or ``exhausted``
    (none is left), with the new samples' number and the decided model's mean loss on them; for a proposed model, after
    ``session`` samples, ``accepted`` or why not, with the mean difference to the model in use; ``finish`` rejects an open session.
    """

    rules: Rules = field(default_factory=Rules)
    models: int = 2
    current: int = 0
    last: int = -1
    detector: HoeffdingMean = field(default_factory=HoeffdingMean)
    buffer: list[tuple[int, tuple[float, ...]]] = field(default_factory=list)
    history: list[list[float]] = field(default_factory=list)
    proposed: int = -1
    reference: int = -1
    session: list[tuple[float, float]] = field(default_factory=list)

    def __post_init__(self):
        self.history = self.history or [[0, 0.0] for _ in range(self.models)]

    def step(self, pos: int, losses: tuple[float, ...]) -> list[tuple]:
        events, self.last = [], pos
        if self.proposed >= 0:
            self.session.append((losses[self.proposed], losses[self.reference]))
            if len(self.session) == self.rules.session:
                events.append(self._validated(pos))
        alarm = self.detector.step(min(1.0, max(0.0, losses[self.current])))
        self.buffer.append((pos, losses))
        if alarm:
            events.append(self._resolved(pos, self.detector.width))
        else:
            while len(self.buffer) > self.rules.delay:
                self._absorb(self.buffer.pop(0)[1])
        return events

    def finish(self) -> list[tuple]:
        if self.proposed < 0:
            return []
        event = self.last, "insufficient_forward_data", self.proposed, len(self.session), None
        self._close()
        return [event]

    def _absorb(self, losses: tuple[float, ...]) -> None:
        entry = self.history[self.current]
        entry[0] += 1
        entry[1] += losses[self.current]

    def _close(self) -> None:
        self.proposed = self.reference = -1
        self.session = []

    def _validated(self, pos: int) -> tuple:
        gaps, n, gain = [c - r for c, r in self.session], len(self.session), self.rules.gain
        recent = gaps[n // 2 :]
        full = sum(gaps) / n
        bad = not full < -gain, not sum(recent) / len(recent) < -gain
        kind = {(False, False): "accepted", (True, False): "full_interval", (False, True): "recent_interval", (True, True): "full_and_recent"}[bad]
        event = pos, kind, self.proposed, n, full
        if kind == "accepted":
            self.current = self.proposed
            self.detector.reset()
        self._close()
        return event

    def _resolved(self, pos: int, width: int) -> tuple:
        new = self.buffer[-min(len(self.buffer), width) :]
        for _, losses in self.buffer[: len(self.buffer) - len(new)]:
            self._absorb(losses)
        if self.proposed >= 0:
            for _, losses in new:
                self._absorb(losses)
            self.buffer = []
            return pos, "suppressed", self.current, len(new), None
        self.buffer = new
        if len(new) < self.rules.least:
            return pos, "insufficient_data", self.current, len(new), None
        means = [sum(x[m] for _, x in new) / len(new) for m in range(self.models)]
        fits = [(means[m], m) for m, (n, total) in enumerate(self.history) if n and total and means[m] - total / n <= self.rules.limit]
        self.buffer = []
        if fits:
            mean, model = min(fits)
            kind = "maintain" if model == self.current else "reuse"
        else:
            model = next((m for m, (n, _) in enumerate(self.history) if not n and m != self.current), -1)
            kind, mean = ("create", means[model]) if model >= 0 else ("exhausted", means[self.current])
        if kind in ("maintain", "exhausted"):
            self.history[self.current] = [len(new), sum(x[self.current] for _, x in new)]
        else:
            self.proposed, self.reference, self.session = model, self.current, []
        return pos, kind, model, len(new), mean


def follow(df: DataFrame, losses: list[str], rules: Rules | None = None, key: str = "client", order: str = "pos") -> DataFrame:
    """``key`` and the events of each key's path over all of its rows."""
    rules = rules or Rules()

    def start():
        path = Path(rules, len(losses))

        def step(pos, *values):
            found = path.finish() if pos is None else path.step(int(pos), tuple(map(float, values)))
            return ([e for e in found],) if found else None

        return step

    events = fold(df, [key], [order], start, [order, *losses], f"events array<struct<{EVENTS.replace(' ', ':').replace(',:', ',')}>>", flush=True)
    return events.selectExpr(key, "inline(events)")
