"""Detectors spend work on what may alarm only, and find the same."""

import math
import random

import pytest

from tidewatch.operators import detectors as d


def levels(seed, n=2500):
    r, level, noise, out = random.Random(seed), 0.3, 0.2, []
    for _ in range(n):
        if r.random() < 0.004:
            level, noise = r.random(), r.choice([0, 0.05, 0.2, 1])
        out.append(min(1.0, max(0.0, level + noise * (r.random() - 0.5))))
    return out


def whole_comparisons(values, delta, longest, least):
    """Alarms and widths of a window that compares all its cuts at every step."""
    window = []
    for x in values:
        window = [*window, x][-longest:]
        n, found = len(window), None
        if n >= least:
            total, mean = math.fsum(window), math.fsum(window) / n
            variance, log_term = max(math.fsum(v * v for v in window) / n - mean**2, 1e-12), math.log(2 * n / delta)
            left, best = 0.0, 0.0
            for k in range(1, n):
                left += window[k - 1]
                inverse = n / (k * (n - k))
                excess = abs(left / k - (total - left) / (n - k)) - math.sqrt(2 * variance * log_term * inverse) - 2 / 3 * log_term * inverse
                if excess > best + 1e-12:
                    best, found = excess, k
        window = window[found:] if found else window
        yield bool(found), len(window)


@pytest.mark.parametrize("seed, longest", [(1, 1000), (2, 150), (3, 80)])
def test_skipped_comparisons_change_nothing(monkeypatch, seed, longest):
    compared, keep = [], d.AdaptiveWindow._compared
    monkeypatch.setattr(d.AdaptiveWindow, "_compared", lambda self, *a: (compared.append(1), keep(self, *a)))
    values, window = levels(seed), d.AdaptiveWindow(0.05, longest)
    got = [(window.step(x), window.width) for x in values]
    assert got == list(whole_comparisons(values, 0.05, longest, 10))
    assert sum(alarm for alarm, _ in got) >= 1
    assert len(compared) < len(values) / 3


def test_one_detector_a_class():
    made = []
    window = d.ByClass(lambda: made.append(1) or d.HoeffdingMean())
    for i in range(60):
        window.step(i, 0.5, "abc"[i % 3])
    assert len(made) == 4
    both = d.EProcessByClass(0.5, 3)
    make, made = both.make, []
    both.make = lambda: made.append(1) or make()
    for i in range(60):
        both.step(0.5, "abc"[i % 3])
    assert len(made) == 3


def test_width_of_alarms_only(spark):
    class Sparing(d.HoeffdingMean):
        """As an e-process, whose width costs a look through all its starts."""

        @property
        def width(self):
            if not self.alarm:
                raise AssertionError("no alarm, no width")
            return self._width

        @width.setter
        def width(self, value):
            self._width = value

    rows = spark.createDataFrame([(0, i, float(i >= 60)) for i in range(120)], "client long, pos long, loss double")
    found = d.detect(rows, Sparing, restart=True).collect()
    assert len(found) == 1 and found[0].width > 0
