"""A client's path: the machine against a form that keeps everything, and the stream against the batch."""

import random

import pytest
from pyspark.sql import functions as F

from tidewatch.operators import detectors, path
from tidewatch.sources.streams import stream
from tidewatch.streaming import client, processors


def plain(rows, rules):
    """All rows are kept; what is buffered, absorbed and validated is told by positions."""
    detector, out = detectors.HoeffdingMean(), []
    current, begin, kept = 0, 0, {}  # where the buffer begins; histories as lists of losses
    session = None
    for i, losses in enumerate(rows):
        if session:
            session["seen"].append(losses[session["model"]] - losses[session["reference"]])
            if len(session["seen"]) == rules.session:
                gaps = session["seen"]
                full, recent = sum(gaps) / len(gaps), gaps[len(gaps) // 2 :]
                good = full < -rules.gain, sum(recent) / len(recent) < -rules.gain
                kind = {(1, 1): "accepted", (0, 1): "full_interval", (1, 0): "recent_interval", (0, 0): "full_and_recent"}[good]
                out.append((i, kind, session["model"], len(gaps), full))
                if kind == "accepted":
                    current = session["model"]
                    detector = detectors.HoeffdingMean()
                session = None
        if not detector.step(losses[current]):
            while i + 1 - begin > rules.delay:
                kept.setdefault(current, []).append(rows[begin][current])
                begin += 1
            continue
        first = max(begin, i + 1 - detector.width)
        kept.setdefault(current, []).extend(rows[j][current] for j in range(begin, first))
        n = i + 1 - first
        if session:
            kept[current].extend(rows[j][current] for j in range(first, i + 1))
            begin = i + 1
            out.append((i, "suppressed", current, n, None))
            continue
        begin = first
        if n < rules.least:
            out.append((i, "insufficient_data", current, n, None))
            continue
        begin = i + 1
        means = {m: sum(rows[j][m] for j in range(first, i + 1)) / n for m in range(2)}
        fits = sorted((means[m], m) for m, h in kept.items() if h and sum(h) and means[m] - sum(h) / len(h) <= rules.limit)
        if fits and fits[0][1] == current:
            out.append((i, "maintain", current, n, means[current]))
            kept[current] = [rows[j][current] for j in range(first, i + 1)]
        elif fits or not kept.get(1 - current):
            model = fits[0][1] if fits else 1 - current
            out.append((i, "reuse" if fits else "create", model, n, means[model]))
            session = {"model": model, "reference": current, "seen": []}
        else:
            out.append((i, "exhausted", -1, n, means[current]))
            kept[current] = [rows[j][current] for j in range(first, i + 1)]
    if session:
        out.append((len(rows) - 1, "insufficient_forward_data", session["model"], len(session["seen"]), None))
    return out


def drawn(seed, n=700):
    rng, level = random.Random(seed), 0.1
    rows = []
    for _ in range(n):
        if rng.random() < 0.015:
            level = rng.choice([0.05, 0.2, 0.4, 0.7])
        a = min(1.0, max(0.0, level + rng.uniform(-0.08, 0.08)))
        rows.append((a, max(0.0, 0.8 - a)))
    return rows


def test_the_machine_against_everything_kept():
    kinds = set()
    for seed in range(30):
        rules = path.Rules(limit=(0.1, 0.4)[seed % 2])
        rows, machine, got = drawn(seed), path.Path(rules), []
        for i, losses in enumerate(rows):
            got += machine.step(i, losses)
            assert len(machine.buffer) <= 31 and len(machine.session) <= 10
        got += machine.finish()
        want = plain(rows, rules)
        assert [g[:4] for g in got] == [w[:4] for w in want]
        assert [g[4] for g in got] == [None if w[4] is None else pytest.approx(w[4]) for w in want]
        kinds |= {g[1] for g in got}
    assert {"create", "reuse", "accepted", "maintain"} <= kinds


@pytest.fixture
def rows(spark):
    s = stream(spark.read.parquet("/root/testdata/sf0.01/events.parquet")).where("client < 4")
    at = F.timestamp_seconds(F.lit(1_600_000_000) + 60 * F.col("pos"))
    return s.select("client", "pos", at.alias("ts"), F.col("loss").alias("a"), F.greatest(F.lit(0.0), 0.8 - F.col("loss")).alias("b"))


def told(df):
    return sorted((r.client, r.pos, r.kind, r.model, r.n, None if r.value is None or r.value != r.value else round(r.value, 9)) for r in df.collect())


def test_stream_equals_batch_over_a_restart(spark, rows, tmp_path):
    rows = rows.cache()
    want = told(path.follow(rows, ["a", "b"]))
    assert len({w[2] for w in want}) >= 2
    where, checkpoint = tmp_path / "in", str(tmp_path / "state")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", client.PROVIDER)
    try:
        for run, parts in enumerate(((0, 1), (2, 3))):  # the second run goes on from the first one's checkpoint
            for i in parts:
                rows.where(f"least(floor(pos / 260), 3) = {i}").coalesce(1).write.mode("append").parquet(str(where))
            if run:  # a row of another key, long after all others: no open session gets any more samples
                end = spark.createDataFrame([(-1, 0, 0.0, 0.0)], "client long, pos long, a double, b double").selectExpr("client", "pos", "timestamp'2100-01-01' AS ts", "a", "b")
                end.coalesce(1).write.mode("append").parquet(str(where))
            read = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(where))
            events = client.follow(read, ["a", "b"])
            running = events.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
            running.awaitTermination(300)
            assert running.exception() is None
        found = told(spark.read.parquet(str(tmp_path / "out")).where("client >= 0"))
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    assert sorted(found, key=str) == sorted(want, key=str)


def test_an_open_session_waits_for_its_timer(spark, tmp_path):
    """Losses that jump and then end: the session is rejected by the timer, in the batch at the end."""
    losses = [0.05] * 100 + [0.75] * 16
    rows = spark.createDataFrame([(1, i, x, 0.8 - x) for i, x in enumerate(losses)], "client long, pos long, a double, b double").withColumn("ts", F.timestamp_seconds(F.lit(1_600_000_000) + F.col("pos")))
    want = told(path.follow(rows, ["a", "b"]))
    assert want and want[-1][2] == "insufficient_forward_data" or want[-1][2] in ("accepted", "insufficient_data")
    where = str(tmp_path / "in")
    rows.coalesce(1).write.parquet(where)
    rows.selectExpr("client + 1 AS client", "pos", "a", "b", "ts + INTERVAL 60 DAYS AS ts").limit(1).write.mode("append").parquet(where)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", client.PROVIDER)
    try:
        read = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(where)
        found = processors.finished(client.follow(read, ["a", "b"]), "ended_sessions", str(tmp_path / "state"))
        assert told(found) == want
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
