import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.operators import learning
from tidewatch.sources import generators


def test_gradients_against_differences():
    net = learning.Perceptron(3, (4,), seed=2)
    rng = np.random.default_rng(0)
    x, y = rng.normal(size=(20, 3)), (rng.random(20) > 0.5).astype(float)

    def loss():
        p = net.scores(x)[0]
        return -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))

    grad, flat = np.concatenate([g.ravel() for g in net.gradients(x, y)]), net.vector
    for i in range(0, len(flat), 5):
        up, down = flat.copy(), flat.copy()
        up[i] += 1e-5
        down[i] -= 1e-5
        net.vector = up
        a = loss()
        net.vector = down
        assert (a - loss()) / 2e-5 == pytest.approx(grad[i], abs=1e-6)
        net.vector = flat


def test_clients_learn_and_average(spark):
    rows = generators.generate(spark, "sine2", 0, 1500).withColumns({"client": F.col("id") % 3, "order": F.col("id")}).cache()
    few = rows.where("id < 30").withColumn("client", F.lit(9).cast("long"))
    found = {r.client: r for r in learning.train(rows.unionByName(few), ["client"], 2, epochs=20).collect()}
    assert all(found[c].loss < 0.15 for c in range(3)) and found[9].n == 30 and found[9].loss > 0.3
    kept = learning.train(rows, ["client"], 2, epochs=20, patience=3).first()
    assert kept.loss < 0.3
    shared = learning.federated(rows, "client", 2, rounds=3, epochs=4)
    scored = learning.evaluate(rows, shared, 2)
    assert scored.agg(F.avg("loss")).first()[0] < 0.25


def test_projection(spark):
    rows = spark.createDataFrame([([[1.0, 0.0], [-1.0, 1.0], [0.0, 0.0]],)], "vectors array<array<double>>")
    got = learning.project_conflicts(rows).first().projected
    assert got == [[pytest.approx(0.5), pytest.approx(0.5)], [pytest.approx(0.0), pytest.approx(1.0)], [0.0, 0.0]]
    change = spark.range(1).select(learning.update_change(F.array(F.lit(3.0), F.lit(4.0)), F.array(F.lit(0.0), F.lit(0.0))).alias("c")).first().c
    assert (change.cosine, change.norm_ratio, change.delta_ratio) == (0.0, 0.0, 1.0)


def test_adapter_starts_as_identity():
    f = np.random.default_rng(1).normal(size=(5, 8))
    assert (learning.adapter(f, np.ones((8, 2)), np.zeros((2, 8))) == f).all()
