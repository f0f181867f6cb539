import math
import random

import pytest

from tidewatch.operators import detectors as d
from tidewatch.sources.streams import stream

SF = "/root/testdata/sf0.01"


def alarms(detector, values):
    return [i for i, v in enumerate(values) if detector.step(v)]


@pytest.mark.parametrize("make", [d.HoeffdingMean, d.WeightedMean])
def test_step_stream(make):
    detector = make()
    assert alarms(detector, [0.1] * 300) == []
    for i in range(200):
        if detector.step(0.9):
            break
    assert detector.alarm and 1 <= detector.width <= 200


@pytest.mark.parametrize("make", [d.HoeffdingMean, d.WeightedMean])
def test_constant_stream_and_range(make):
    assert alarms(make(), [0.2] * 1000) == []
    for bad in (1.1, -0.1):
        with pytest.raises(ValueError):
            make().step(bad)


def test_e_process():
    detector = d.EProcess(0.2, 0.001)
    assert alarms(detector, [0.1] * 200) == []
    found = next(i for i in range(20) if detector.step(0.8))
    assert math.exp(detector.log_e) >= 1000 and 1 <= detector.width <= 20 and found < 20
    assert alarms(d.EProcess(0.2, 0.001, longest=500), [0.2] * 400) == []


def plain_window(values, delta, longest):
    """All cuts by plain loops."""
    window, out = [], []
    for t, v in enumerate(values):
        window = (window + [v])[-longest:]
        n = len(window)
        if n < 10:
            continue
        mean = sum(window) / n
        variance = max(sum(x * x for x in window) / n - mean * mean, 1e-12)
        log_term = math.log(2 * n / delta)
        best = (0.0, None)
        for cut in range(1, n):
            a, b = sum(window[:cut]) / cut, sum(window[cut:]) / (n - cut)
            m = 1 / (1 / cut + 1 / (n - cut))
            excess = abs(a - b) - math.sqrt(2 / m * variance * log_term) - 2 / (3 * m) * log_term
            if excess > best[0] + 1e-12:
                best = (excess, cut)
        if best[1]:
            out.append(t)
            window = window[best[1] :]
    return out


def test_adaptive_window_against_plain_loops():
    rng = random.Random(4)
    values = [min(1, max(0, rng.gauss(m, 0.1))) for m in (0.2, 0.7, 0.3) for _ in range(90)]
    got = alarms(d.AdaptiveWindow(0.05, 150), values)
    assert got == plain_window(values, 0.05, 150) and got


def test_e_process_against_sums_over_starts():
    rng = random.Random(5)
    values = [rng.random() for _ in range(120)]
    detector = d.EProcess(0.45, 0.001, longest=40)
    for t, _ in enumerate(values, 1):
        detector.step(values[t - 1])
        starts = range(max(0, t - 40), t)
        total = sum(sum(math.prod(1 + r * (x / 0.45 - 1) for x in values[s:t]) for r in detector.RATES) / 5 for s in starts)
        assert math.isclose(detector.log_e, math.log(total), rel_tol=1e-9, abs_tol=1e-9)


@pytest.mark.parametrize("kind, n", [("adaptive_window", 45), ("hoeffding", 23), ("weighted", 23)])
def test_alarms_on_the_stream(spark, kind, n):
    events = spark.read.parquet(f"{SF}/events.parquet")
    assert d.detect(stream(events), d.KINDS[kind]).count() == n


def test_partitions_and_row_order_change_nothing(spark):
    s = stream(spark.read.parquet(f"{SF}/events.parquet")).select("client", "pos", "loss").cache()
    want = sorted(map(tuple, d.detect(s, d.HoeffdingMean).collect()))
    for n in (1, 3):
        assert sorted(map(tuple, d.detect(s.orderBy("loss").repartition(n), d.HoeffdingMean).collect())) == want


def test_by_class_finds_a_change_hidden_in_the_mean():
    detector = d.ByClass(lambda: d.AdaptiveWindow(0.05))
    rng = random.Random(3)
    found = None
    for t in range(600):
        label = t % 2
        high = (label == 0) == (t < 300)
        alarm, source, split = detector.step(t, (0.8 if high else 0.1) + rng.random() * 0.05, label)
        if alarm:
            found = (t, source, split)
            break
    assert found and found[0] >= 300 and found[1] == 2 and 250 <= found[2] <= found[0]


def test_e_process_by_class():
    detector = d.EProcessByClass(0.3, 2, overall=None)
    assert not any(detector.step(0.1, t % 2)[0] for t in range(200))
    assert any(detector.step(0.9 if t % 2 else 0.1, t % 2)[0] for t in range(100))
