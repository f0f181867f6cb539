"""Change detectors as steps: one value in, (alarm, warning, width, ...) out, with state of bounded size.

The same steps run in batch folds (:func:`detect`), in the class-conditional forms, and in the streaming processors.
"""

from __future__ import annotations

import math
from collections import OrderedDict, deque
from collections.abc import Callable
from itertools import islice

import numpy as np
from pyspark.sql import DataFrame

from .folds import fold


def _unit(value: float) -> float:
    value = float(value)
    if not 0.0 <= value <= 1.0:
        raise ValueError("losses must lie in [0, 1]")
    return value


class AdaptiveWindow:
    """Tests all cuts of a window of at most ``longest`` values with a Bernstein-type bound; drops the older side at the best cut.

    The window is a stretch of an array of running sums, which moves to the front when it meets the end: a step appends one sum and
    compares all cuts by differences of sums, unless :meth:`_settled` shows that none can alarm.
    """

    #: What a bound leaves to rounding.
    MARGIN = 1e-6

    def __init__(self, delta: float = 0.05, longest: int = 1000, least: int = 10):
        self.delta, self.longest, self.least = delta, longest, least
        self.left = np.arange(1, longest)
        self.reset()

    def reset(self) -> None:
        self.sums, self.squares = np.zeros(2 * self.longest + 2), np.zeros(2 * self.longest + 2)
        self.start = self.end = 0  # the window's sums lie behind ``start``, up to ``end``
        self.tests, self.slack, self.low, self.high = 0, -math.inf, math.inf, -math.inf
        self.alarm = self.warning = False

    @property
    def width(self) -> int:
        return self.end - self.start

    def _compared(self, slack: float, n: int, mean: float, variance: float, log_term: float) -> None:
        """Keeps what :meth:`_settled` needs of a comparison of all cuts."""
        self.slack, self.then_start, self.then_n, self.then_mean, self.then_variance = slack, self.start, n, mean, variance
        self.reach = math.sqrt(variance * log_term * n / 2)
        self.low, self.high = math.inf, -math.inf

    def _settled(self, n: int, mean: float, variance: float, log_term: float) -> bool:
        """Whether no cut can alarm, by what has changed since all were compared.

        With ``k`` of ``n`` values on its left, whose sum is ``s``, a cut alarms if ``d = |s - k mean|`` is above ``a + 2/3 log_term``, where
        ``a = sqrt(2 variance log_term k (n - k) / n)``, ``reach`` at most. ``slack`` is the least distance to that. Since then ``d`` has grown by
        the mean's change times ``k`` and by what the ``gone`` values differ from the mean; ``a`` has shrunk with the deviation, and by
        ``sqrt(2 variance log_term gone)`` at most; the logarithm hasn't. A cut among the ``new`` values has a ``d`` of at most their
        number times their largest distance to the mean.
        """
        if not self.slack > 0 or n < self.then_n:
            return False
        gone = self.start - self.then_start
        inside = (n - self.then_n + gone) * max(self.high - mean, mean - self.low)
        grown = self.then_n * abs(mean - self.then_mean)
        shrunk = max(0.0, 1 - math.sqrt(variance / self.then_variance)) * self.reach
        if gone:
            grown += abs(float(self.sums[self.start] - self.sums[self.then_start]) - gone * mean)
            shrunk += math.sqrt(2 * variance * log_term * gone)
        return self.slack - grown - shrunk > self.MARGIN and 2 / 3 * log_term - inside > self.MARGIN

    @property
    def values(self) -> list[float]:
        return np.diff(self.sums[self.start : self.end + 1]).tolist()

    def step(self, value: float) -> bool:
        if self.end + 1 == len(self.sums):
            n = self.width
            for kept in (self.sums, self.squares):
                kept[: n + 1] = kept[self.start : self.end + 1] - kept[self.start]
            self.start, self.end, self.slack = 0, n, -math.inf
        x = float(value)
        self.sums[self.end + 1], self.squares[self.end + 1] = self.sums[self.end] + x, self.squares[self.end] + x * x
        self.end += 1
        self.start += self.width > self.longest
        self.low, self.high = min(self.low, x), max(self.high, x)
        n, self.alarm = self.width, False
        self.tests = n - 1 if n >= self.least else 0
        if not self.tests:
            return False
        base = self.sums[self.start]
        total = float(self.sums[self.end] - base)
        variance = max(float(self.squares[self.end] - self.squares[self.start]) / n - (total / n) ** 2, 1e-12)
        log_term = math.log(2 * n / self.delta)
        if self._settled(n, total / n, variance, log_term):
            return False
        sums, left = self.sums[self.start + 1 : self.end] - base, self.left[: n - 1]
        right = n - left
        inverse = n / (left * right)
        bound = np.sqrt(2 * variance * log_term * inverse) + 2 / 3 * log_term * inverse
        excess = np.abs(sums / left - (total - sums) / right) - bound
        best = int(np.argmax(excess))
        if excess[best] > 0:
            self.alarm, self.slack = True, -math.inf
            self.start += best + 1
        else:
            self._compared(float((-excess / inverse).min()), n, total / n, variance, log_term)
        return self.alarm


class EProcess:
    """Mixture e-process of the loss exceeding a baseline: from each start and at each rate a bet; alarms where the mixed capital of all
    starts reaches 1 / ``alpha``.

    A bet's log capital is a difference of two running sums of log gains, now and before its start. So the state is one running sum for
    each rate and, in a ring, its values before the newest ``longest`` starts, which bounds mixture and memory. While no start has been let
    go, a rate's capital over all starts follows from the last one: the gain times one more than it.
    """

    RATES = (0.05, 0.1, 0.2, 0.4, 0.8)
    #: How near to 0 and 1 a baseline may come.
    EDGE = 1e-6

    def __init__(self, baseline: float, alpha: float = 0.001, longest: int = 1000):
        self.threshold, self.longest, self.rates = -math.log(alpha), longest, np.array(self.RATES)
        self.reset(baseline)

    def reset(self, baseline: float | None = None) -> None:
        if baseline is not None:
            self.baseline = min(max(float(baseline), self.EDGE), 1 - self.EDGE)
        self.sums = [0.0] * len(self.RATES)
        self.capitals = [-math.inf] * len(self.RATES)
        self.before: list[list[float]] = []
        self.seen, self.tests, self.log_e = 0, 0, -math.inf
        self.alarm = self.warning = False

    def _starts(self) -> np.ndarray:
        """Log capital of each start (a row of the ring), mixed over the rates."""
        return np.logaddexp.reduce(np.array(self.sums) - np.array(self.before), axis=1) - math.log(len(self.RATES))

    @property
    def width(self) -> int:
        """Values since the best start, the oldest of equal ones."""
        if not self.seen:
            return 0
        n = len(self.before)
        ages = (self.seen - 1 - np.arange(n)) % self.longest if self.seen > self.longest else self.seen - 1 - np.arange(n)
        capital = self._starts()
        return int(ages[capital == capital.max()].max()) + 1

    def step(self, value: float) -> bool:
        if self.seen < self.longest:
            self.before.append(self.sums)
        else:
            self.before[self.seen % self.longest] = self.sums
        excess = _unit(value) / self.baseline - 1
        gains = [math.log1p(r * excess) for r in self.RATES]
        self.sums = [s + g for s, g in zip(self.sums, gains)]
        self.seen += 1
        self.tests = min(self.seen, self.longest) * len(self.RATES)
        if self.seen <= self.longest:
            self.capitals = [_log_of_sum(0.0, c) + g for c, g in zip(self.capitals, gains)]
            top = max(self.capitals)
            self.log_e = top + math.log(sum(math.exp(c - top) for c in self.capitals) / len(self.RATES))
        else:
            self.log_e = float(np.logaddexp.reduce(self._starts()))
        self.alarm = self.log_e >= self.threshold
        return self.alarm


def _log_of_sum(a: float, b: float) -> float:
    """The logarithm of exp(a) + exp(b)."""
    low, high = (a, b) if a < b else (b, a)
    return high + math.log1p(math.exp(low - high)) if low > -math.inf else high


class HoeffdingMean:
    """One-sided Hoeffding test of all values against the prefix whose upper bound is lowest; starts anew at an alarm.

    Of ``n`` values with mean ``m`` the bound at level ``c`` is ``m + sqrt(ln(1 / c) / 2n)``. A prefix of ``k`` is passed at level ``c`` if
    the means differ by at least ``sqrt((1 / k - 1 / n) ln(2 / c) / 2)``, as the rest's mean differs from the prefix's by that much more.
    """

    def __init__(self, confidence: float = 0.001, warning: float = 0.005):
        self.half_log = -math.log(confidence) / 2
        self.levels = tuple(math.log(2 / c) / 2 for c in (confidence, warning))
        self.reset()

    def reset(self) -> None:
        self.total, self.n = 0.0, 0
        self.lowest: tuple[float, int] | None = None  # mean and length of the prefix of the lowest bound
        self.width = self.tests = 0
        self.alarm = self.warning = False

    def _upper(self, mean: float, n: int) -> float:
        return mean + math.sqrt(self.half_log / n)

    def step(self, value: float) -> bool:
        self.n += 1
        self.total += _unit(value)
        mean = self.total / self.n
        self.alarm = self.warning = False
        self.width, self.tests = self.n, 0
        if self.lowest is None or self._upper(mean, self.n) <= self._upper(*self.lowest):
            self.lowest = mean, self.n
            return False
        low, k = self.lowest
        passed = [mean - low >= math.sqrt((1 / k - 1 / self.n) * level) for level in self.levels]
        width = self.n - k
        if passed[0]:
            self.reset()
            self.alarm, self.width, self.tests = True, width, 1
        else:
            self.warning, self.tests = passed[1], 2
        return self.alarm


class WeightedMean:
    """McDiarmid test of an exponentially weighted mean against the one at its lowest upper bound so far; starts anew at an alarm.

    McDiarmid's bound takes the sum of squared weights, which depends on the number of values alone: of ``n`` values with rate ``r`` and
    ``q = 1 - r`` the newest weighs ``r``, one ``k`` before it ``r q^k`` and the first ``q^(n - 1)``.
    """

    def __init__(self, confidence: float = 0.001, warning: float = 0.005, rate: float = 0.05):
        self.rate, self.alarm_log, self.warn_log = rate, -math.log(confidence) / 2, -math.log(warning) / 2
        self.reset()

    def reset(self) -> None:
        self.n = self.lowest_n = self.width = self.tests = 0
        self.mean = self.lowest_mean = self.later = math.nan
        self.lowest = math.inf
        self.alarm = self.warning = False

    def squares(self, n: int) -> float:
        """The sum of squared weights of ``n`` values."""
        q2 = (1 - self.rate) ** 2
        first = q2 ** (n - 1)
        return first + self.rate**2 * (1 - first) / (1 - q2)

    def step(self, value: float) -> bool:
        x = _unit(value)
        old, self.n = self.n, self.n + 1
        self.mean = self.mean + self.rate * (x - self.mean) if old else x
        bound = self.mean + math.sqrt(self.alarm_log * self.squares(self.n))
        self.alarm = self.warning = False
        if bound < self.lowest:
            self.lowest, self.lowest_n, self.lowest_mean = bound, self.n, self.mean
            self.width, self.tests = self.n, 0
            return False
        behind = self.n - self.lowest_n
        self.later = self.later + self.rate * (x - self.later) if behind > 1 else x
        rise = self.later - self.lowest_mean
        spread = self.squares(self.lowest_n) + self.squares(behind)
        self.alarm = rise > math.sqrt(self.alarm_log * spread)
        self.warning = not self.alarm and rise > math.sqrt(self.warn_log * spread)
        self.width, tests = self.n, 2 - self.alarm
        if self.alarm:
            self.reset()
            self.alarm, self.width = True, behind
        self.tests = tests
        return self.alarm


class ByClass:
    """A detector over all samples and one for each class; alarms if either does, and then all start anew.

    ``split`` is the stream position where the change is put: the overall window's start, else the class window's oldest sample among its
    last ``kept`` ones.
    """

    def __init__(self, make: Callable, kept: int = 1000):
        self.make, self.kept = make, kept
        self.reset()

    def reset(self) -> None:
        self.overall, self.classes, self.places = self.make(), {}, {}

    def step(self, pos: int, value: float, label) -> tuple[bool, int, int]:
        one = self.classes.get(label)
        if one is None:
            one = self.classes[label] = self.make()
        places = self.places.setdefault(label, [])
        places.append(pos)
        del places[: -self.kept]
        overall, own = self.overall.step(value), one.step(value)
        split = -1
        if overall:
            split = pos - self.overall.width + 1
        elif own:
            split = places[-min(one.width, len(places))]
        if overall or own:
            self.reset()
        return overall or own, 1 if overall else 2 if own else 0, split


class EProcessByClass:
    """A mixture of an overall e-process and one for each class (the others by their last values), at one threshold."""

    def __init__(self, baseline: float, classes: int, alpha: float = 0.001, overall: float = 0.5, longest: int = 1000):
        self.make = lambda: EProcess(baseline, alpha, longest)
        self.n, self.threshold = classes, math.log(1 / alpha)
        self.weight = 1 / (classes + 1) if overall is None else overall
        self.reset()

    def reset(self) -> None:
        self.all, self.parts = self.make(), OrderedDict()

    def step(self, value: float, label) -> tuple[bool, float]:
        part = self.parts.get(label)
        if part is None:
            part = self.parts[label] = self.make()
        self.all.step(value)
        part.step(value)
        total, shared = math.log(self.weight) + self.all.log_e, math.log((1 - self.weight) / self.n)
        for p in self.parts.values():
            total = _log_of_sum(total, shared + p.log_e)
        alarm = total >= self.threshold
        if alarm:
            self.reset()
        return alarm, total


KINDS: dict[str, Callable] = {"adaptive_window": AdaptiveWindow, "hoeffding": HoeffdingMean, "weighted": WeightedMean, "e_process": lambda: EProcess(0.15)}


def hypotheses(df: DataFrame, make: Callable, key: str = "client", order: str = "pos", value: str = "loss", name: str = "tests") -> DataFrame:
    """Comparisons that a detector, reset at its alarms, made over each key's rows, and its ``alarms``."""

    def start():
        detector, tests, alarms = make(), 0, 0

        def step(pos, x=None):
            nonlocal tests, alarms
            if pos is None:
                return tests, alarms
            alarm = detector.step(x)
            tests, alarms = tests + detector.tests, alarms + alarm
            if alarm:
                detector.reset()
            return None

        return step

    return fold(df, [key], [order], start, [order, value], f"{name} long, alarms long", flush=True)


def resets(df: DataFrame, make: Callable, key: str = "client", order: str = "pos", value: str = "loss") -> DataFrame:
    """Of each alarm that was handled by resetting the detector: ``pos``, ``width`` and ``seen``, the values since the reset before."""

    def start():
        detector, seen = make(), 0

        def step(pos, x):
            nonlocal seen
            seen += 1
            if not detector.step(x):
                return None
            row = (int(pos), int(detector.width), seen)
            detector.reset()
            seen = 0
            return row

        return step

    return fold(df, [key], [order], start, [order, value], f"{order} long, width long, seen long")


#: What a baseline may be: the running mean, kept away from 0 and 1.
LEAST_BASELINE = 0.01


def reset_baselines(df: DataFrame, delay: int = 30, alpha: float = 0.001, key: str = "client", order: str = "pos", value: str = "loss") -> DataFrame:
    """An e-process whose baseline is read anew at each reset: the mean of all values that have left the ``delay`` newest ones by then,
    ``LEAST_BASELINE`` at least and while none has. Of each alarm ``seen``, the values since the reset before, the ``baseline`` that it was
    tested against, and the one read ``then``."""

    def start():
        held: deque[float] = deque()
        detector, n, total, seen = EProcess(LEAST_BASELINE, alpha), 0, 0.0, 0

        def step(pos, x):
            nonlocal n, total, seen
            held.append(x)
            if len(held) > delay:
                n, total = n + 1, total + held.popleft()
            seen += 1
            if not detector.step(x):
                return None
            row = int(pos), seen, detector.baseline
            detector.reset(max(LEAST_BASELINE, total / n) if n else LEAST_BASELINE)
            seen = 0
            return *row, detector.baseline

        return step

    return fold(df, [key], [order], start, [order, value], f"{order} long, seen long, baseline double, then double")


class Insured:
    """A detector with an insurance: where it doesn't alarm, its window's losses, still in the delay buffer, are held against the history of the
    model in use.

    A value leaves the buffer of ``delay`` for the history ``delay`` values later. The insurance asks for three things: a window of at least
    ``delay - SLACK`` values and at most ``max(100, 2 (delay - SLACK))``; a buffer that holds as many; and a history whose mean, above 0, is passed by
    the window's mean in the buffer by ``limit`` or more. At an alarm, the detector's or the insurance's, the newest values (as many as the window,
    at most all of the buffer) begin the history of a new model, the others end the old one's; detector and buffer start anew.
    """

    SLACK = 5

    def __init__(self, detector, delay: int = 30, limit: float = 0.1):
        self.detector, self.delay, self.limit = detector, delay, limit
        self.buffer: deque[float] = deque()
        self.n, self.total = 0, 0.0

    def insured(self) -> bool:
        width, base = self.detector.width, self.delay - self.SLACK
        if not max(base, 1) <= width <= max(100, 2 * base) or len(self.buffer) < width or self.total <= 0:
            return False
        return math.fsum(islice(self.buffer, len(self.buffer) - width, None)) / width >= self.total / self.n + self.limit

    def step(self, value: float) -> tuple[int, int, float | None] | None:
        """1 (the detector) or 2 (the insurance), the width, and the history's mean before; None without an alarm."""
        self.buffer.append(value)
        width = self.detector.width + 1
        found = 1 if self.detector.step(value) else 0
        width = self.detector.width or width
        if not found and self.insured():
            found = 2
        if found:
            told = found, width, self.total / self.n if self.n else None
            new = list(self.buffer)[-width:]
            self.n, self.total = len(new), math.fsum(new)
            self.buffer.clear()
            self.detector.reset()
            return told
        if len(self.buffer) > self.delay:
            self.n, self.total = self.n + 1, self.total + self.buffer.popleft()
        return None


def insure(df: DataFrame, make: Callable, delay: int = 30, limit: float = 0.1, key: str = "client", order: str = "pos", value: str = "loss") -> DataFrame:
    """Alarms of an insured detector: ``source`` (1 the detector, 2 the insurance), ``width``, ``history`` (null without one)."""

    def start():
        insured = Insured(make(), delay, limit)

        def step(pos, x):
            return (int(pos), *told) if (told := insured.step(float(x))) else None

        return step

    return fold(df, [key], [order], start, [order, value], f"{order} long, source int, width long, history double")


def detect(df: DataFrame, make: Callable, key: str = "client", order: str = "pos", value: str = "loss", restart: bool = False, warnings: bool = False) -> DataFrame:
    """``key``, ``pos``, ``width``, ``warning`` of each alarm (and warning) of a bare detector; ``restart`` resets it at its alarms."""

    def start():
        detector = make()

        def step(pos, x):
            alarm, warned = detector.step(x), detector.warning
            if not alarm and not (warnings and warned):
                return None
            row = int(pos), int(detector.width), bool(warned)  # only here: an e-process looks through all its starts for a width
            if alarm and restart:
                detector.reset()
            return row

        return step

    return fold(df, [key], [order], start, [order, value], f"{order} long, width long, warning boolean")


def detect_by_class(df: DataFrame, make: Callable, key: str = "client", order: str = "pos", value: str = "loss", label: str = "label") -> DataFrame:
    """Alarms of a class-conditional detector: ``pos``, ``source`` (1 overall, 2 class), ``split``."""

    def start():
        detector = ByClass(make)

        def step(pos, x, c):
            alarm, source, split = detector.step(int(pos), x, c)
            return (int(pos), source, split) if alarm else None

        return step

    return fold(df, [key], [order], start, [order, value, label], f"{order} long, source int, split long")


def detect_e_by_class(df: DataFrame, baseline: float, classes: int, key: str = "client", order: str = "pos", value: str = "loss", label: str = "label") -> DataFrame:
    """Alarms of the class-conditional e-process: ``pos``, ``log_e``."""

    def start():
        detector = EProcessByClass(baseline, classes, overall=None)

        def step(pos, x, c):
            alarm, log_e = detector.step(x, c)
            return (int(pos), log_e) if alarm else None

        return step

    return fold(df, [key], [order], start, [order, value, label], f"{order} long, log_e double")
