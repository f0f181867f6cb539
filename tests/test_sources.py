import gzip
import json
import os
import struct

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tidewatch.plans import metrics, sweep
from tidewatch.sources import files, generators, schedules
from tidewatch.sources.streams import block_of

HEAD = "version,mode,dataset,schedule,seed,series,sweep_parameter,sweep_value,batch,distance,accuracy\n"


def test_blocks_are_dealt_like_an_array_split(spark):
    for n in (9, 23, 100, 1503):
        got = [r[0] for r in spark.range(n).select(block_of(F.col("id"), F.lit(n))).collect()]
        assert got == [i for i, part in enumerate(np.array_split(np.arange(n), 10)) for _ in part]


def test_fixed_schedules(spark):
    rows = schedules.fixed(spark, 4, 10, 5000).collect()
    assert len(rows) == 50000
    assert all(r.concept == int(schedules.PATTERNS[4][r.pos // 500][r.client]) for r in rows)
    assert schedules.fixed(spark, 2, 3, 23).groupBy("client").count().where("count = 23").count() == 3
    for bad in ((3, 10, 10), (2, 11, 10), (2, 3, 0)):
        with pytest.raises(ValueError):
            schedules.fixed(spark, *bad)


def test_random_schedules(spark):
    rows = schedules.random(spark, 4, 5, 800, 50, 0.1).collect()
    for client in range(5):
        seq = [r.concept for r in sorted((r for r in rows if r.client == client), key=lambda r: r.pos)]
        changes = [i for i in range(1, 800) if seq[i] != seq[i - 1]]
        assert seq[0] == 0 and changes and all(b - a > 50 for a, b in zip([0, *changes], changes))


@pytest.mark.parametrize("dataset, size", [("blobs", 2), ("sea4", 3), ("circle2", 2), ("sine2", 2)])
def test_generators(spark, dataset, size):
    rows = generators.generate(spark, dataset, 0, 4000).collect()
    assert all(len(r.x) == size and r.y in (0.0, 1.0) for r in rows)
    assert 0.03 < np.mean([r.y for r in rows]) < 0.97
    x = np.array([r.x for r in rows])
    assert len({tuple(v) for v in x.round(9).tolist()}) > 3990 and abs(np.corrcoef(x.T)[0, 1]) < (1 if dataset == "blobs" else 0.06)
    with pytest.raises(ValueError):
        generators.generate(spark, dataset, 9, 1)


def test_noise_and_swaps(spark):
    rows = generators.generate(spark, "sea4", 2, 5000).collect()
    assert np.mean([(r.x[0] + r.x[1] <= 7) != (r.y == 1) for r in rows]) == pytest.approx(0.1, abs=0.02)
    got = spark.range(8).select(generators.swap_labels(F.col("id"), F.lit(2)).alias("x")).collect()
    assert [r.x for r in got] == [0, 1, 2, 4, 3, 5, 6, 7]


def test_results(spark, tmp_path):
    (tmp_path / "a.csv").write_text(HEAD + "1,m,sine2,random,0,s,delta,0.05,,,0.9\n")
    (tmp_path / "b.csv").write_text(HEAD + "1,m,sine2,fixed,1,s,,,50,,0.8\n1,m,sine2,fixed,1,s,,,50,,0.8\n")
    rows = files.read_results(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")], ["m"])
    assert rows.count() == 3 and rows.where("batch IS NULL").count() == 1
    for bad in ("2,m,sine2,random,0,s,,,,,1", "1,x,sine2,random,0,s,,,,,1", "1,m,sine2,,0,s,,,,,1"):
        (tmp_path / "c.csv").write_text(HEAD + bad + "\n")
        with pytest.raises(PySparkException):
            files.read_results(spark, str(tmp_path / "c.csv"), ["m"]).collect()
    out = str(tmp_path / "out")
    files.write_results(rows, out)
    assert files.read_results(spark, out).count() == 3
    with pytest.raises(PySparkException):
        files.write_results(rows, out)


def test_logs_manifests_archives_and_images(spark, tmp_path):
    (tmp_path / "run.log").write_text("noise\nrun 1 acc=0.5\nrun 2 acc=0.7\nrun 1 acc=0.9\n")
    records = files.read_logs(spark, str(tmp_path / "run.log"), r"run (\d+) acc=([0-9.]+)", ["run", "acc"])
    assert records.count() == 3
    assert {r.run: r.acc for r in files.latest_records(records, ["run"], "acc").collect()} == {"1": "0.9", "2": "0.7"}
    for name, text in {"a": json.dumps({"status": "completed", "n": 1}), "b": "{broken", "c": json.dumps({"status": "running", "n": 2})}.items():
        (tmp_path / name).mkdir()
        (tmp_path / name / "manifest.json").write_text(text)
    assert [r.n for r in files.read_manifests(spark, str(tmp_path), "status string, n int").collect()] == [1]
    np.savez_compressed(tmp_path / "run.npz", accuracy=np.array([1, 0, 1], np.int8), seed=np.array(4))
    (row,) = files.read_archives(spark, str(tmp_path), "accuracy array<int>, seed array<int>, missing array<double>").collect()
    assert (row.accuracy, row.seed, row.missing) == ([1, 0, 1], [4], None)
    pixels = np.arange(8, dtype=np.uint8)
    (tmp_path / "img.gz").write_bytes(gzip.compress(struct.pack(">IIII", 2051, 2, 2, 2) + pixels.tobytes()))
    (tmp_path / "lab").write_bytes(struct.pack(">II", 2049, 2) + b"\x07\x03")
    images = files.read_images(spark, str(tmp_path / "img.gz")).orderBy("at").collect()
    assert np.allclose([r["values"] for r in images], pixels.reshape(2, 4) / 255)
    assert [r["values"] for r in files.read_images(spark, str(tmp_path / "lab")).orderBy("at").collect()] == [[7.0], [3.0]]
    (tmp_path / "short").write_bytes(struct.pack(">II", 2049, 3) + b"\x07")
    with pytest.raises(PySparkException):
        files.read_images(spark, str(tmp_path / "short")).collect()


def test_runs_and_reports(spark, tmp_path):
    df = spark.createDataFrame([("a", 1, 0.5), ("b", 2, None)], "dataset string, seed int, accuracy double")
    files.write_runs(df, str(tmp_path / "runs"), ["dataset", "seed"])
    assert spark.read.parquet(str(tmp_path / "runs")).count() == 2
    assert files.markdown(df.orderBy("seed")).splitlines()[2:] == ["| a | 1 | 0.5 |", "| b | 2 | – |"]
    with pytest.raises(ValueError):
        files.markdown(df, limit=1)


def test_sweep_plans_and_manifests(spark, tmp_path):
    runs = sweep.plan(spark, ["sine2", "mnist2"], [0, 1], {"aw": "window", "fd": "batch", "local": "baseline"})
    assert runs.count() == runs.select("fingerprint").distinct().count() == 2 * 2 * (9 + 8 + 1)
    assert [r.dataset for r in sweep.execution_order(runs).take(32)] == ["mnist2"] * 32
    assert "recalibration" not in sweep.configuration(recalibration="replay") and "recalibration" in sweep.configuration(router="adahedge")
    assert sweep.digest(sweep.configuration(recalibration="replay")) == sweep.digest(sweep.configuration())
    for bad in ({"detector": "x"}, {"nope": 1}):
        with pytest.raises(ValueError):
            sweep.configuration(**bad)
    path = str(tmp_path / "m" / "manifest.json")
    with sweep.Manifest(path, sweep.configuration()) as m:
        assert json.load(open(path))["status"] == "running"
        m.complete(3, "content")
    assert json.load(open(path))["status"] == "completed"
    with pytest.raises(RuntimeError), sweep.Manifest(path, {}):
        raise RuntimeError("no")
    assert json.load(open(path))["error"] == "RuntimeError: no"
    assert all(o in sweep.document() for o in sweep.OPTIONS)


def test_metric_registry(spark):
    every = metrics.registry()
    assert {m.group for m in every.values()} >= {g for p in metrics.PROFILES.values() for g in p}
    alarm = spark.createDataFrame([(1, 52, 50), (1, None, None)], "run int, estimate int, true_pos int")
    proposal = spark.createDataFrame([(1, "accepted", 0.3), (1, "full_interval", -0.1)], "run int, reason string, margin double")
    row = metrics.compute({"alarm": alarm, "proposal": proposal}, ["run"]).first()
    assert (row.alarm_count, row.change_point_count, row.change_point_mae, row.change_point_bias, row.provisional_acceptance_rate) == (2, 1, 2.0, 2.0, 0.5)
    with pytest.raises(ValueError):
        metrics.compute({}, ["run"])


def test_tables_are_forgotten(spark):
    from tidewatch.sources import scratch

    tables = [scratch.written(spark.range(3), "some") for _ in range(2)]
    paths = [t.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0] for t in tables]
    scratch.forget(tables[0])
    assert [os.path.exists(p) for p in paths] == [False, True]
    scratch.forget_all(spark)
    assert not os.path.exists(paths[1])
