"""Detectors with feedback, and routers over routers, against plain forms that keep everything."""

import math
import random

import numpy as np
import pytest

from tidewatch.operators import detectors, experts


def losses(seed, n, jumps=(0.1, 0.5, 0.2, 0.8)):
    rng = random.Random(seed)
    return [round(min(1.0, max(0.0, jumps[i * len(jumps) // n] + rng.uniform(-0.1, 0.1))), 6) for i in range(n)]


def plain_window(values, delta=0.05, longest=1000, least=10):
    held, alarms = [], []
    for i, x in enumerate(values):
        held = (held + [x])[-longest:]
        n = len(held)
        if n < least:
            continue
        log_term, best = math.log(2 * n / delta), (0.0, None)
        variance = max(float(np.var(held)), 1e-12)
        sums = np.concatenate([[0.0], np.cumsum(held)])
        for c in range(1, n):
            inverse = 1 / c + 1 / (n - c)
            excess = abs(sums[c] / c - (sums[n] - sums[c]) / (n - c)) - math.sqrt(2 * inverse * variance * log_term) - 2 / 3 * inverse * log_term
            if excess > best[0]:
                best = excess, c
        if best[1]:
            held = held[best[1] :]
            alarms.append((i, len(held)))
    return alarms


@pytest.mark.parametrize("longest", [30, 100, 1000])
def test_the_window_in_its_array(longest):
    values, window = losses(1, 900), detectors.AdaptiveWindow(longest=longest)
    found = [(i, window.width) for i, x in enumerate(values) if window.step(x)]
    assert found == plain_window(values, longest=longest) and (found or longest == 30)
    assert window.values == pytest.approx(values[-window.width :])


@pytest.mark.parametrize("longest", [7, 50, 1000])
def test_capital_of_all_starts(longest):
    values, process, alarms = losses(2, 400, (0.1, 0.3)), detectors.EProcess(0.2, longest=longest), 0
    gains = []
    for x in values:
        gains.append([math.log1p(r * (x / 0.2 - 1)) for r in detectors.EProcess.RATES])
        alarm = process.step(x)
        tails = np.cumsum(np.array(gains[::-1]), axis=0)[:longest]
        want = np.logaddexp.reduce(tails.ravel()) - math.log(5)
        assert process.log_e == pytest.approx(want, abs=1e-8) and alarm == (process.log_e >= -math.log(0.001))
        alarms += alarm
    assert alarms or longest == 7


def plain_insured(values, make, delay, limit):
    """Everything is kept, with where the model's history begins and what has left the buffer."""
    detector, out, begin, first = make(), [], 0, None
    for i, x in enumerate(values):
        before = detector.width
        alarm = detector.step(x)
        width = detector.width or before + 1
        buffered = values[max(begin, i - delay) : i + 1]
        history = (first or []) + values[begin : max(begin, i - delay)]
        wide_enough = delay - 5 <= width <= max(100, 2 * (delay - 5)) and width > 0
        there = len(buffered) >= width
        worse = bool(history) and sum(history) > 0 and there and sum(buffered[-width:]) / width >= sum(history) / len(history) + limit
        if alarm or (wide_enough and there and worse):
            out.append((i, 1 if alarm else 2, width, sum(history) / len(history) if history else None))
            first, begin = buffered[-width:], i + 1
            detector.reset()
    return out


class Deaf(detectors.AdaptiveWindow):
    """A window that never finds a cut, so that the insurance has something to do."""

    def step(self, value):
        super().step(value)
        if self.alarm or self.width > 28:
            self.start = self.end - 26
        self.alarm = False
        return False


@pytest.mark.parametrize("make", [detectors.AdaptiveWindow, lambda: detectors.AdaptiveWindow(delta=1e-9), Deaf])
def test_insurance(make):
    for seed in range(6):
        values = losses(seed, 800, (0.1, 0.45, 0.15, 0.7))
        insured, found = detectors.Insured(make(), 30, 0.1), []
        for i, x in enumerate(values):
            if told := insured.step(x):
                found.append((i, *told))
        want = plain_insured(values, make, 30, 0.1)
        assert [f[:3] for f in found] == [w[:3] for w in want]
        assert [f[3] for f in found] == [None if w[3] is None else pytest.approx(w[3]) for w in want]
    if make is Deaf:
        assert any(f[1] == 2 for f in found)


def test_insurance_needs_all_three():
    insured = detectors.Insured(Deaf(), 30, 0.1)
    for x in [0.1] * 60:
        assert insured.step(x) is None
    assert insured.n == 30 and not insured.insured()  # the window is no worse
    insured.buffer.extend([0.9] * 30)
    assert insured.insured()
    insured.n, insured.total = 5, 0.0
    assert not insured.insured()  # no history
    insured.n, insured.total = 5, 0.5
    insured.buffer = type(insured.buffer)([0.9] * 20)
    assert not insured.insured()  # the buffer holds fewer than the window
    insured.buffer.extend([0.9] * 20)
    insured.detector.reset()
    assert not insured.insured()  # the window is too short


def test_baselines_follow_what_left_the_buffer(spark):
    values = losses(4, 300)
    df = spark.createDataFrame([(c, i, x) for c in (1, 2) for i, x in enumerate(values)], "client long, pos long, loss double")
    got = detectors.reset_baselines(df, 30).orderBy("client", "pos").collect()
    assert got and [tuple(r)[1:] for r in got if r.client == 1] == [tuple(r)[1:] for r in got if r.client == 2]
    for r in got:
        left = values[: max(0, r.pos + 1 - 30)]
        assert r.then == pytest.approx(max(0.01, sum(left) / len(left)) if left else 0.01)


class Slow:
    """Layers with everything in dictionaries and weights by definition."""

    def __init__(self, k):
        self.k, self.data = k, {}

    def hedge(self, name, k):
        return self.data.setdefault(name, {"l": [0.0] * k, "gap": 0.0})

    def weights(self, h):
        low, k = min(h["l"]), len(h["l"])
        raw = [float(x == low) if h["gap"] <= 0 else math.exp(-math.log(k) / h["gap"] * (x - low)) for x in h["l"]]
        return [r / sum(raw) for r in raw]

    def learn(self, h, losses, p):
        mixed, k = sum(a * b for a, b in zip(p, losses)), len(losses)
        if h["gap"] <= 0:
            mix = min(x for x, w in zip(losses, p) if w > 0)
        else:
            eta = math.log(k) / h["gap"]
            mix = -math.log(sum(w * math.exp(-eta * x) for x, w in zip(losses, p))) / eta
        h["gap"] += max(0.0, mixed - mix)
        h["l"] = [a + b for a, b in zip(h["l"], losses)]

    def step(self, y, scores):
        whole = self.hedge("whole", self.k)
        p = self.weights(whole)
        mixed = sum(a * b for a, b in zip(p, scores))
        context = round(mixed, 9) > 0.5
        own, meta = self.hedge(("own", context), self.k), self.hedge(("meta", context), 2)
        q, m = self.weights(own), self.weights(meta)
        lead = max(range(self.k), key=lambda i: (round(q[i], 9), -i))
        said = m[0] * mixed + m[1] * scores[lead]
        losses = [abs(s - y) for s in scores]
        self.learn(whole, losses, p)
        self.learn(own, losses, q)
        self.learn(meta, [float((round(s, 9) > 0.5) != bool(y)) for s in (mixed, scores[lead])], m)
        return context, lead, m[1], said


def test_layers_of_routers():
    rng, layers, slow = random.Random(6), experts.Layers(3), Slow(3)
    contexts = set()
    for _ in range(600):
        y = rng.randint(0, 1)
        scores = np.array([min(1.0, max(0.0, y + s * rng.random())) for s in (-0.6, 0.3, 0.9)]) * 0.98 + 0.01
        got, want = layers.step(y, scores), slow.step(y, scores.tolist())
        assert (bool(got["context"]), got["expert"]) == want[:2]
        assert (got["leader_weight"], got["meta"]) == pytest.approx(want[2:], abs=1e-9)
        contexts.add(want[0])
    assert contexts == {False, True}


def test_evidence_is_carried_on_after_a_replay(spark):
    rng = random.Random(8)
    rows = [(1, i, rng.random() * (0.3 if i < 100 else 0.9), rng.random() * (0.9 if i < 100 else 0.3)) for i in range(200)]
    df = spark.createDataFrame(rows, "client long, pos long, a double, b double")
    got = experts.route_with_replay(df, ["a", "b"], ["client"], "pos", 50, 30).orderBy("round").collect()
    router, replayed = experts.AdaHedge(), []
    for i, (_, _, a, b) in enumerate(rows):
        router.update(np.array([a, b]), router.weights((0, 1)))
        if i % 50 == 49:
            last = np.array([r[2:] for r in rows[i - 29 : i + 1]])
            if (again := int(np.argmin(last.sum(axis=0)))) != int(np.argmin(router.total)):
                router.replay(list(last))
            replayed.append((int(np.argmin(router.total)), *router.weights((0, 1))))
            assert again == replayed[-1][0]
    assert [("ab".index(r.lead), r.w_a, r.w_b) for r in got] == [pytest.approx(x) for x in replayed]
    assert [r.replayed for r in got] == [False, False, True, False]
