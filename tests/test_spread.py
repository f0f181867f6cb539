"""Queries that no longer run in one task, against plain Python."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tidewatch.operators import numbering
from tidewatch.plans import stream_queries

QUERIES = entry.catalog()[0]
SF = "/root/testdata/sf0.01"


def test_registrations_are_numbered(spark):
    some = sorted((r.s_nationkey, r.s_suppkey) for r in spark.read.parquet(f"{SF}/supplier.parquet").where("s_acctbal > 0").collect())
    got = {r.temporary: r.id for r in QUERIES["lif_5_registrations"](spark, SF).collect()}
    assert got == {s: i for i, (_, s) in enumerate(some, 1)}


@pytest.mark.parametrize("by", [[], ["g"]])
def test_numbers_and_neighbours_over_partitions(spark, by, monkeypatch):
    """One group holds most rows, and null is a group; no task has more than a share of them."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        data = [(None if i % 50 == 0 else 7 if i % 10 else i % 3, i * 7919 % 4001, i) for i in range(4000)]
        rows = spark.createDataFrame(data, "g int, v long, place long")
        key = lambda r: ((r[0] is not None, r[0] or 0) if by else (), r[1], r[2])
        want, before, n, last = {}, {}, 0, "start"
        for r in sorted(data, key=key):
            group = r[0] if by else ""
            n, previous = (n + 1, before) if group == last else (1, None)
            want[r[2]] = (n, previous and previous[2])
            before, last = r, group
        got = numbering.numbered(rows, ["v", "place"], "number", by)
        assert {r.place: r.number for r in got.collect()} == {k: n for k, (n, _) in want.items()}
        assert got.columns == ["g", "v", "place", "number"]
        told = numbering.with_previous(rows, ["v", "place"], {"place": "was", "v": "v_was"}, by)
        assert {r.place: r.was for r in told.collect()} == {k: w for k, (_, w) in want.items()}
        table, _, part = numbering._placed(rows, ["v", "place"], by)
        assert table.groupBy(part).count().agg({"count": "max"}).first()[0] <= 4000 // 4
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.mark.parametrize("n", [0, 49, 50, 120, 200, 333])
def test_blocks_of_a_moving_average(spark, n):
    values = [(i * 37 % 101) / 101 for i in range(n)]
    mean = spark.createDataFrame(list(enumerate(values)), "pos long, a double")
    got = {r.pos: r.average for r in stream_queries._blocked_average(mean, 50, 100).collect()}
    assert got == {p: pytest.approx(sum(values[p - 49 : p + 1]) / 50, abs=2e-6) for p in range(49, n)}


def test_moving_average_of_clients_has_several_blocks(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(stream_queries.F, "explode", lambda x, real=F.explode: seen.append(1) or real(x))
    QUERIES["win_3_moving_average_of_clients"](spark, SF)
    assert seen
