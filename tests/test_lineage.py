"""Lineage over rounds and linkage by reciprocal merges, against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from tidewatch.operators import clustering, lineage


def followed(absorbed):
    """Each line step by step."""
    by_model = {}
    for r, m, p in absorbed:
        by_model.setdefault(m, []).append((r, p))
    out = {}
    for r, m, p in absorbed:
        steps, last = 1, r
        while later := [x for x in by_model.get(p, []) if x[0] > last]:
            last, p = min(later)
            steps += 1
        out[r, m] = (p, last, steps)
    return out


@pytest.mark.parametrize("case", ["random", "chain", "none"])
def test_ancestry(spark, case):
    rng = random.Random(3)
    if case == "chain":
        rows = [(i, i, i + 1) for i in range(100)]  # a line of a hundred absorptions
    elif case == "none":
        rows = []
    else:
        rows = sorted({(r, m): (r, m, rng.randrange(m) if m else 0) for r in range(12) for m in rng.sample(range(1, 40), 15)}.values())
    df = spark.createDataFrame(rows, "round long, model long, representative long")
    got = {(r.round, r.model): (r.ancestor, r.last, r.steps) for r in lineage.ancestry(df).collect()}
    assert got == followed(rows)
    if case == "chain":
        assert got[0, 0] == (100, 99, 100)


def test_observations_of_a_round(spark):
    models = spark.createDataFrame([(1, m) for m in range(4)] + [(2, 9)], "round long, model long")
    pairs = spark.createDataFrame([(1, 0, 1, 0.08), (1, 0, 2, 0.2), (1, 1, 2, 0.12)], "round long, i long, j long, distance double")
    clusters = spark.createDataFrame([(1, 0, 0), (1, 1, 0), (1, 2, 2), (1, 3, 3), (2, 9, 9)], "round long, model long, representative long")
    got = {(r.round, r.model): tuple(r)[2:] for r in lineage.observations(models, pairs, clusters).collect()}
    assert got == {
        (1, 0): (1, 0.08, 0, 2, 0.08, 1, 1, False),
        (1, 1): (0, 0.08, 0, 2, 0.08, 1, 1, True),
        (1, 2): (1, 0.12, 2, 1, None, 0, 0, False),
        (1, 3): (-1, None, 3, 1, None, 0, 0, False),
        (2, 9): (-1, None, 9, 1, None, 0, 0, False),
    }


@pytest.mark.parametrize("seed", range(4))
def test_reciprocal_merges_are_complete_linkage(spark, seed):
    rng, rows, nodes = random.Random(seed), [], []
    for s in range(4):
        n = rng.randint(1, 14)
        nodes += [(s, i) for i in range(n)]
        # Few distances, so that there are many ties; some pairs are missing.
        rows += [(s, i, j, rng.randint(1, 6) / 10) for i in range(n) for j in range(i + 1, n) if rng.random() < 0.85]
    edges, nodes = spark.createDataFrame(rows, "s long, i long, j long, distance double"), spark.createDataFrame(nodes, "s long, id long")
    want = sorted(map(tuple, clustering._grouped_linkage(edges, nodes, ["s"], 0.4).collect()))
    assert sorted(map(tuple, clustering.reciprocal_linkage(edges, nodes, ["s"], 0.4).collect())) == want


def test_large_scopes_are_linked_by_joins(spark, monkeypatch):
    monkeypatch.setattr(clustering, "GROUPED_UP_TO", 5)
    called = []
    monkeypatch.setattr(clustering, "reciprocal_linkage", lambda *a, real=clustering.reciprocal_linkage: called.append(1) or real(*a))
    nodes = spark.range(12).select(F.when(F.col("id") < 4, 0).otherwise(1).alias("s"), "id")
    edges = nodes.alias("a").join(nodes.alias("b"), F.expr("a.s = b.s AND a.id < b.id")).selectExpr("a.s", "a.id AS i", "b.id AS j", "abs(a.id - b.id) * 0.1D AS distance")
    got = {r.id: r.cluster for r in clustering.complete_linkage(edges, nodes, ["s"], 0.15).collect()}
    assert called and got == {0: 0, 1: 0, 2: 2, 3: 2, 4: 4, 5: 4, 6: 6, 7: 6, 8: 8, 9: 8, 10: 10, 11: 10}


def test_ten_thousand_models_in_no_single_task(spark):
    n = 10_000
    nodes = spark.range(n).select(F.lit(0).alias("s"), "id")
    place = lambda c: (F.col(c) * 7919 % n).cast("double")
    edges = spark.range(n).select(F.lit(0).alias("s"), F.col("id").alias("i"), F.explode(F.sequence(F.lit(1), F.lit(4))).alias("k")).withColumn("j", F.col("i") + F.col("k"))
    edges = edges.where(F.col("j") < n).select("s", "i", "j", (F.abs(place("i") - place("j")) / n + F.col("k") / 10).alias("distance"))
    linked = clustering.reciprocal_linkage(edges, nodes, ["s"], 0.9)
    sizes = linked.groupBy("cluster").count()
    assert linked.count() == n and 2 <= sizes.agg(F.max("count")).first()[0] <= 5
    # A cluster is told by its smallest member, and all of its pairs are near.
    inside = linked.alias("a").join(linked.alias("b"), F.expr("a.cluster = b.cluster AND a.id < b.id")).selectExpr("a.id AS i", "b.id AS j")
    assert inside.join(edges.where("distance <= 0.9"), ["i", "j"], "left_anti").isEmpty()
