import random

import pytest

from tidewatch.operators import matching, resolution


def frame(spark, rows):
    return spark.createDataFrame([(1, p) for p in rows] or [], "client int, pos long")


def greedy(truth, events, tolerance):
    used, out = set(), []
    for t in sorted(truth):
        for i, e in enumerate(sorted(events)):
            if i not in used and t <= e <= t + tolerance:
                used.add(i)
                out.append((t, e))
                break
    return sorted(out)


def matched(spark, truth, events, tolerance):
    m = matching.match_events(frame(spark, truth), frame(spark, events), tolerance)
    return sorted((r.true_pos, r.pos) for r in m.where("true_pos IS NOT NULL").collect())


def test_known_example(spark):
    assert matched(spark, [100, 300], [50, 120, 130, 350], 50) == [(100, 120), (300, 350)]


def test_overlapping_windows_against_greedy(spark):
    rng = random.Random(9)
    for _ in range(6):
        truth, events = (sorted(rng.sample(range(200), 15)) for _ in range(2))
        assert matched(spark, truth, events, 25) == greedy(truth, events, 25)


def test_classes(spark):
    truth = [100, 600]
    got = matching.classify_unmatched(frame(spark, [110, 50, 250, 400, 700, 701, 0]), frame(spark, truth), 100)
    assert {r.pos: r["class"] for r in got.collect()} == {110: "duplicate", 50: "early", 250: "late", 400: "isolated", 700: "duplicate", 701: "late", 0: "early"}


def test_detection_counts_of_nothing(spark):
    m = matching.match_events(frame(spark, [5]), frame(spark, [500]), 10)
    r = matching.detection_counts(m, ["client"]).first()
    assert (r.tp, r.fp, r.fn, r.recall, r.precision, r.f1, r.avg_delay) == (0, 1, 1, 0.0, 0.0, 0.0, 0.0)


@pytest.mark.parametrize("before, after", [(0, 0), (3, 0), (0, 4), (7, 2)])
def test_near_against_plain_loops(spark, before, after):
    rng = random.Random(1)
    left, right = ([(rng.randrange(3), rng.randrange(-20, 60)) for _ in range(50)] for _ in range(2))
    a, b = (spark.createDataFrame(sorted(set(x)), "client int, pos long") for x in (left, right))
    got = sorted(map(tuple, matching.near(a, b, before, after, how="inner").collect()))
    assert got == sorted((c, p, q) for c, p in set(left) for k, q in set(right) if c == k and q - after <= p <= q + before) or got == sorted(
        (c, p, q) for c, p in set(left) for k, q in set(right) if c == k and p - before <= q <= p + after
    )


def test_recovery_mask(spark):
    rows = spark.createDataFrame([(1, i, c) for i, c in enumerate([1, 0, 1, 1, 0])], "client int, pos long, correct int")
    stable = matching.as_of(rows, spark.createDataFrame([(1, 1, 1)], "client int, pos long, ld long"), "client", "pos", "ld")
    masked = stable.withColumn("s", matching.stable_mask(stable.pos, stable.ld, 2))
    means = {r.s: r["avg(correct)"] for r in masked.groupBy("s").avg("correct").collect()}
    assert means == {False: 0.5, True: pytest.approx(2 / 3)}


def test_episodes(spark):
    rows = spark.createDataFrame([(1, 100, True), (1, 120, True), (1, 130, True)], "client int, pos long, act boolean")
    got = [(r.pos, r.episode, r.allowed) for r in resolution.episodes(rows, 30, operate="act").orderBy("pos").collect()]
    assert got == [(100, 0, True), (120, 0, False), (130, 1, True)]


def test_upsert_conflicts(spark):
    a = spark.createDataFrame([(1, None), (2, 2.0), (3, 3.0)], "k int, v double")
    b = spark.createDataFrame([(1, 1.0), (2, 2.0), (3, 9.0), (4, 4.0)], "k int, v double")
    got = {r.k: (r.v, r.conflict) for r in matching.upsert(a, b, ["k"], ["v"]).collect()}
    assert got == {1: (1.0, False), 2: (2.0, False), 3: (3.0, True), 4: (4.0, False)}
