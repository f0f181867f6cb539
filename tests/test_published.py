"""Stored tables extended in place, and events matched in recorded order."""

import random

import pytest
from pyspark.sql import functions as F

from tidewatch.operators import matching
from tidewatch.sources import published, scratch

SCHEMA = "part int, k long, v double, w string"


def rows(spark, data):
    return spark.createDataFrame(data, SCHEMA)


def stored(spark, path):
    return sorted(map(tuple, published.read(spark, path, rows(spark, []).schema).collect()), key=str)


BASE = [(1, 1, 1.0, None), (1, 2, None, "a"), (2, 3, 3.0, "b"), (3, 4, 4.0, "c")]


@pytest.fixture
def place(spark):
    path = scratch.fresh_place(spark, "stored")
    published.store(rows(spark, BASE), path, "part")
    return path


def extend(spark, path, data):
    return published.extend(spark, path, rows(spark, data), ["part", "k"], "part", rows(spark, []).schema)


def files(spark, path, part):
    return sorted(f for f in spark.read.parquet(path).where(f"part = {part}").inputFiles() if f"part={part}/" in f)


def test_blanks_are_filled_and_rows_added(spark, place):
    before = files(spark, place, 3)
    backup = extend(spark, place, [(1, 2, 2.0, "a"), (1, 1, None, None), (2, 9, 9.0, None), (7, 1, 7.0, "n")])
    assert stored(spark, place) == sorted([(1, 1, 1.0, None), (1, 2, 2.0, "a"), (2, 3, 3.0, "b"), (2, 9, 9.0, None), (3, 4, 4.0, "c"), (7, 1, 7.0, "n")], key=str)
    assert files(spark, place, 3) == before  # an untouched partition isn't written again
    assert stored(spark, backup) == sorted(BASE[:3], key=str)


@pytest.mark.parametrize("bad", [[(1, 1, 1.5, None)], [(2, 3, None, "other"), (5, 5, 5.0, "e")], [(6, 1, 1.0, "x"), (6, 1, 1.0, "x")]])
def test_what_contradicts_leaves_the_table_as_it_was(spark, place, bad):
    before = [files(spark, place, p) for p in (1, 2, 3)]
    with pytest.raises(published.NotPublished):
        extend(spark, place, bad)
    assert [files(spark, place, p) for p in (1, 2, 3)] == before and stored(spark, place) == sorted(BASE, key=str)


def test_a_failed_publication_is_put_back(spark, place, monkeypatch):
    calls = []

    def fails_once(new, path, by, real=published._replace):
        calls.append(1)
        real(new, path, by)
        if len(calls) == 1:
            raise OSError("the store is gone")

    monkeypatch.setattr(published, "_replace", fails_once)
    with pytest.raises(OSError):
        extend(spark, place, [(1, 2, 2.0, "a")])
    assert len(calls) == 2 and stored(spark, place) == sorted(BASE, key=str)


def test_a_store_is_never_written_over(spark, place):
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS|already exists"):
        published.store(rows(spark, BASE), place, "part")


def test_made_folders_can_be_forgotten(spark):
    path = scratch.fresh_place(spark, "gone")
    spark.range(3).write.parquet(path)
    kept, scratch._made[:] = scratch._made[:], [path]
    scratch.forget_all(spark)
    scratch._made[:] = [p for p in kept if p != path]
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(path)


def plain(truth, events, tolerance):
    used, out = set(), []
    for t in truth:
        for i, pos in enumerate(events):
            if i not in used and t <= pos <= t + tolerance:
                used.add(i)
                out.append((t, pos, i))
                break
    return out


def test_recorded_order_against_plain_loops(spark):
    rng, truths, events, want = random.Random(5), [], [], {}
    for client in range(40):
        truth = sorted(rng.sample(range(300), rng.randint(0, 12)))
        recorded = [rng.randint(0, 340) for _ in range(rng.randint(0, 25))]
        truths += [(client, t) for t in truth]
        events += [(client, p, i) for i, p in enumerate(recorded)]
        want |= {(client, t): (p, i) for t, p, i in plain(truth, recorded, 30)}
    t, e = spark.createDataFrame(truths, "client long, pos long"), spark.createDataFrame(events, "client long, pos long, seq long")
    got = matching.match_recorded(t, e, 30)
    matched = got.where("true_pos IS NOT NULL").collect()
    assert {(r.client, r.true_pos): (r.pos, r.seq) for r in matched} == want
    assert got.where("kind = 'event'").count() == len(events) and got.where("kind = 'truth'").count() == len(truths)
    assert all(r.delay == r.pos - r.true_pos for r in matched)
    # The example of two truths and events in order.
    t, e = spark.createDataFrame([(1, 100), (1, 300)], "client long, pos long"), spark.createDataFrame([(1, p, i) for i, p in enumerate([50, 120, 130, 350])], "client long, pos long, seq long")
    assert sorted((r.seq, r.delay) for r in matching.match_recorded(t, e, 50).where("true_pos IS NOT NULL").collect()) == [(1, 20), (3, 50)]
    assert matching.match_recorded(t.where(F.lit(False)), e, 50).where("true_pos IS NULL").count() == 4
