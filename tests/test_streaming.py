from pyspark.sql import functions as F

from tidewatch.operators import detectors
from tidewatch.sources.streams import stream
from tidewatch.streaming import processors


def test_batch_and_stream_find_the_same(spark, tmp_path):
    s = stream(spark.read.parquet("/root/testdata/sf0.01/events.parquet")).where("client < 3").select("client", "pos", "loss").cache()
    where = str(tmp_path / "in")
    for i in range(4):
        s.where(f"floor(pos / 260) = {i}").coalesce(1).write.mode("append").parquet(where)
    rows = spark.readStream.schema(s.schema).option("maxFilesPerTrigger", 1).parquet(where)
    for kind in ("hoeffding", "adaptive_window"):
        found = processors.finished(processors.detect(rows, detectors.KINDS[kind]), f"alarms_{kind}", str(tmp_path / kind))
        want = detectors.detect(s, detectors.KINDS[kind]).drop("warning")
        assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect())) and want.count()


def test_event_time_windows(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    where = str(tmp_path / "events")
    events.repartitionByRange(3, "ts").write.parquet(where)
    rows = spark.readStream.schema(events.schema).parquet(where)
    found = processors.finished(processors.tumbling(rows, "ts", "1 hour", "10 minutes", "event_type", "value"), "tumbled", str(tmp_path / "c1"), "complete")
    want = events.groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count("*").alias("n"))
    assert found.count() == want.count() and found.agg(F.sum("n")).first()[0] == events.count()
    again = processors.finished(processors.unique(rows.union(rows), "ts", "1 day", ["event_id"]), "unique_events", str(tmp_path / "c2"))
    assert again.count() == events.count()
    walks = processors.finished(processors.sessions(rows, "ts", "30 minutes", "1 hour", "user_id"), "walks", str(tmp_path / "c3"), "complete")
    assert walks.agg(F.sum("n")).first()[0] == events.count()
