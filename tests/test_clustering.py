import math

import pytest
from pyspark.sql import functions as F

from tidewatch.functions import statistics as st
from tidewatch.operators import aggregates, clustering, resolution

CHAIN = [(0, 1, 0.05), (0, 2, 0.20), (1, 2, 0.05)]


def edges(spark, rows):
    return spark.createDataFrame(rows or [], "i long, j long, distance double")


def nodes(spark, n):
    return spark.range(n)


def test_chain_connected_and_complete(spark):
    e = edges(spark, CHAIN)
    assert {r.id: r.component for r in clustering.connected(e, nodes(spark, 3), 0.1).collect()} == {0: 0, 1: 0, 2: 0}
    got = clustering.complete_linkage(e.withColumn("s", F.lit(1)), nodes(spark, 3).withColumn("s", F.lit(1)), ["s"], 0.1)
    assert {r.id: r.cluster for r in got.collect()} == {0: 0, 1: 0, 2: 2}


def test_missing_pair_forbids_a_merge(spark):
    e = edges(spark, CHAIN[:1] + CHAIN[2:]).withColumn("s", F.lit(1))
    got = clustering.complete_linkage(e, nodes(spark, 3).withColumn("s", F.lit(1)), ["s"], 1.0)
    assert {r.id: r.cluster for r in got.collect()} == {0: 0, 1: 0, 2: 2}


def test_no_edges(spark):
    assert {r.id: r.component for r in clustering.connected(edges(spark, []), nodes(spark, 2), 1.0).collect()} == {0: 0, 1: 1}
    assert {r.id: (r.nearest, r.distance, r.evaluated) for r in clustering.nearest(edges(spark, []), nodes(spark, 2)).collect()} == {0: (-1, None, 0), 1: (-1, None, 0)}


def test_nearest(spark):
    got = {r.id: (r.nearest, r.distance) for r in clustering.nearest(edges(spark, [(0, 1, 0.08), (0, 2, 0.2), (1, 2, 0.12)]), nodes(spark, 3)).collect()}
    assert got == {0: (1, 0.08), 1: (0, 0.08), 2: (1, 0.12)}


def one(spark, column):
    return spark.range(1).select(column).first()[0]


def stats(values):
    return tuple(F.lit(float(x)) for x in (len(values), sum(values), sum(v * v for v in values)))


def test_standardized_increase(spark):
    high, low = stats([0.3] * 10), stats([0.1] * 10)
    assert one(spark, st.standardized_increase(high, low)) > 1.645
    assert one(spark, st.standardized_increase(low, high)) <= 0
    mixed = [0.1, 0.5, 0.4, 0.2]
    var = sum((x - 0.3) ** 2 for x in mixed) / 3
    assert one(spark, st.standardized_increase(stats(mixed), stats([v - 0.1 for v in mixed]))) == pytest.approx(0.1 / math.sqrt(var / 2))


def test_paired_bound(spark):
    assert one(spark, st.upper_bound(*stats([0.01] * 10))) == pytest.approx(0.01)


def test_log_sum_exp_and_softmax(spark):
    xs = F.array(F.lit(1000.0), F.lit(1000.0))
    assert one(spark, st.log_sum_exp(xs)) == pytest.approx(1000 + math.log(2))
    assert one(spark, st.softmax(xs)) == pytest.approx([0.5, 0.5])


def test_gate_dissolves_failing_clusters(spark):
    members = spark.createDataFrame([(1, 0), (2, 0), (3, 7), (4, 7)], "id long, cluster long")
    d = spark.createDataFrame([(1, 10, 0.1, 0.001), (2, 10, 0.1, 0.001), (3, 10, 5.0, 2.5), (4, 3, 0.0, 0.0)], "id long, n long, total double, squares double")
    assert {r.id: r.cluster for r in clustering.gate(d, members, 0.02).collect()} == {1: 0, 2: 0, 3: 3, 4: 4}


def test_weighted_vectors(spark):
    rows = spark.createDataFrame([(1, 1, 1, [1.0, 2.0]), (1, 2, 3, [5.0, 6.0]), (2, 5, 0, [7.0]), (2, 4, 0, [8.0])], "m int, owner int, w int, v array<double>")
    got = {(r.m, r["at"]): r.value for r in aggregates.weighted_vectors(rows, ["m"], "v", "w").collect()}
    assert got == {(1, 0): 4.0, (1, 1): 5.0, (2, 0): 8.0}


def test_few_samples_have_no_statistics(spark):
    rows = spark.createDataFrame([(1, 0.5), (2, 0.25), (2, 0.75)], "k int, x double")
    got = {r.k: (r.n, r.mean, r.variance) for r in aggregates.running_statistics(rows, ["k"], "x").collect()}
    assert got == {1: (1, 0.0, 0.0), 2: (2, 0.5, 0.125)}


def test_resolution_and_validation(spark):
    fits = spark.createDataFrame([(1, 0, 0.5, 0.2, True), (1, 1, 0.25, 0.2, False), (2, 0, 0.21, 0.2, True), (2, 1, 0.3, 0.0, False), (3, 0, 0.9, 0.1, True)], "a int, model int, loss double, history double, current boolean")
    assert {r.a: (r.action, r.model) for r in resolution.resolve(fits, ["a"], 0.1).collect()} == {1: ("reuse", 1), 2: ("maintain", 0), 3: ("create", None)}
    rows = [(1, i, 0.1, 0.3) for i in range(6)] + [(2, i, 0.1 if i < 3 else 0.5, 0.4) for i in range(6)] + [(3, 0, 0.1, 0.9)] + [(4, i, 0.5, 0.4) for i in range(6)]
    losses = spark.createDataFrame(rows, "a int, i int, candidate double, reference double")
    assert {r.a: r.reason for r in resolution.validation(losses, ["a"], "i").collect()} == {1: "accepted", 2: "recent_interval", 3: "insufficient_data", 4: "full_and_recent"}
    assert {r.a: r.reason for r in resolution.validation(losses, ["a"], "i", disjoint=True).collect()} == {1: "accepted", 2: "second_interval", 3: "insufficient_data", 4: "first_and_second"}


@pytest.mark.parametrize("at_once", [3, 1000])
def test_contracted_edges_connect_the_same(spark, monkeypatch, at_once):
    import random

    from tidewatch.operators import components

    rng = random.Random(at_once)
    rows = [(i, i + 1) for i in range(0, 60) if i % 7] + [(rng.randrange(100, 160), rng.randrange(100, 160)) for _ in range(40)] + [(5, 5)]
    df = spark.createDataFrame(rows, "a long, b long").repartition(3)
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in rows:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    fewer = components.contracted(df)
    assert fewer.where("a <= b").isEmpty() and fewer.count() <= len(rows)
    got = {r.node: r.root for r in components.components(fewer).collect() if r.node != r.root}
    assert got == {x: root(x) for x in parent if root(x) != x}
