import numpy as np
import pytest

from tidewatch.operators import experts


def test_weights_concentrate():
    router = experts.AdaHedge()
    assert router.weights((0, 1)).tolist() == [0.5, 0.5]
    for _ in range(8):
        router.update(np.array([0.1, 0.9]), router.weights((0, 1)))
    w = router.weights((0, 1))
    assert w[0] > w[1] and w.sum() == pytest.approx(1)


def test_a_new_expert_clears_all():
    router = experts.AdaHedge()
    router.update(np.array([0.1, 0.9]), router.weights((0, 1)))
    assert router.weights((0, 1, 2)).tolist() == pytest.approx([1 / 3] * 3)
    assert router.resets == 1 and router.gap == 0


def test_effective_count():
    assert experts.effective_count(np.array([1.0])) == 1 and experts.effective_count(np.array([0.5, 0.5])) == 2


def test_regret_stays_small():
    rng = np.random.default_rng(1)
    router, total, sums = experts.AdaHedge(), 0.0, np.zeros(3)
    for _ in range(500):
        losses = rng.random(3) * [0.5, 1, 1]
        p = router.weights((0, 1, 2))
        total += p @ losses
        sums += losses
        router.update(losses, p)
    assert total - sums.min() < 2 * np.sqrt(500 * np.log(3))


@pytest.mark.parametrize("early, late, replay, halves", [((0.1, 0.9), (0.1, 0.9), False, False), ((0.9, 0.1), (0.9, 0.1), True, True), ((0.0, 0.1), (0.9, 0.1), True, False)])
def test_recalibration(spark, early, late, replay, halves):
    """The old leader is a, by six earlier losses; the stored losses come in two halves."""
    old = [(1, 0, t, 0.0, 0.9) for t in range(9)]
    now = [(1, 1, 10 + t, *(early if t < 3 else late)) for t in range(6)]
    losses = spark.createDataFrame(old + now, "client int, round int, pos int, a double, b double")
    stored = losses.where("round = 1").selectExpr("*", "cast(pos >= 13 as int) as half")
    got = experts.recalibration(losses, stored, ["a", "b"], "client", "round").collect()
    assert [(r.round, r.old, r.replay, r.both_halves) for r in got] == [(1, "a", replay, halves)]
    assert experts.recalibration(losses, stored.limit(0), ["a", "b"], "client", "round").count() == 0


def test_fixed_share_returns_after_a_switch():
    router = experts.FixedShare(10)
    for t in range(60):
        p = router.weights((0, 1))
        router.update(np.array([0.0, 1.0] if t < 30 else [1.0, 0.0]), p)
    assert router.w[1] > 0.5 and router.switches == 1 and router.w.min() >= 0.05 - 1e-9


def test_routing_over_rows(spark):
    rows = [(1, t, 0.1, 0.9, None if t < 5 else 0.0) for t in range(12)]
    df = spark.createDataFrame(rows, "client int, pos long, a double, b double, c double")
    got = experts.route(df, experts.AdaHedge, ["a", "b", "c"], ["client"], "pos").orderBy("pos").collect()
    assert [r.w_c for r in got[:5]] == [0.0] * 5 and got[5].w_c == pytest.approx(1 / 3)
    assert got[-1].leader == "c" and got[0].mixture == pytest.approx(0.5)
