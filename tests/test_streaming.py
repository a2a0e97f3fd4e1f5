"""Stream forms against the batch forms, cut into several micro-batches."""

import os

import pytest
from pyspark.sql import functions as F

from kerbline.plans import event_queries as Q
from kerbline.plans import views as V
from kerbline.streaming import processors as P

FOLDER = "/root/testdata/sf0.001"


def run(spark, folder, name, rows, form, **settings):
    """Rows in time order through a stream of several files; a far later row moves the watermark on."""
    last = rows.limit(1).select(F.lit(-1).cast("bigint").alias("stream_id"), F.to_timestamp(F.lit("2030-01-01")).alias("ts"), F.lit(1).cast("bigint").alias("tick"), F.lit(1).cast("bigint").alias("msg_id"), F.lit('{"speed": 1}').alias("json"))
    last = last.select(*[c for c in last.columns if c in rows.columns])
    every = rows.unionByName(last, allowMissingColumns=True)
    path = str(folder / name)
    every.repartition(1).sortWithinPartitions("ts").write.option("maxRecordsPerFile", 400).parquet(path)
    for i, file in enumerate(sorted(f for f in os.listdir(path) if f.startswith("part"))):
        os.utime(os.path.join(path, file), (1_700_000_000 + i * 10,) * 2)
    stream = spark.readStream.schema(every.schema).option("maxFilesPerTrigger", 1).parquet(path)
    stream = stream.withColumn("stream_id", F.col("stream_id").cast("string"))
    query = (
        form(stream, delay="1 second", **settings).writeStream.format("memory").queryName(name)
        .option("checkpointLocation", str(folder / f"{name}_checkpoint")).trigger(availableNow=True).outputMode("append").start()
    )
    assert query.awaitTermination(240)
    return spark.table(name).filter("stream_id <> '-1'")


@pytest.fixture
def folder(tmp_path):
    return tmp_path


def test_sign_stage(spark, folder):
    ticks = V.ticks(spark, FOLDER)
    seen = Q._sign_detections(spark, FOLDER).join(ticks.select("stream_id", "tick", "ts"), ["stream_id", "tick"])
    rows = seen.select("stream_id", "ts", "tick", "name", F.col("x2").alias("px"), "reading", "conf")
    out = run(spark, folder, "signs", rows, P.sign_stage_stream)
    assert out.count() == ticks.count()  # one row per tick, whatever happens
    got = {(r.stream_id, r.tick, r.sign_seen, r.speed_limit) for r in out.filter("sign_seen is not null").collect()}
    assert got == {(str(r.stream_id), r.tick, r.sign_seen, r.speed_limit) for r in Q.sign_stage(spark, FOLDER).collect()}


def test_another_vote_settles_the_sign_stage(spark, folder):
    """The vote is an argument: with one that settles on the first reading, each session says it at once."""
    ticks = V.ticks(spark, FOLDER)
    seen = Q._sign_detections(spark, FOLDER).join(ticks.select("stream_id", "tick", "ts"), ["stream_id", "tick"])
    rows = seen.select("stream_id", "ts", "tick", "name", F.col("x2").alias("px"), "reading", "conf")
    out = run(spark, folder, "settled", rows, P.sign_stage_stream, settle=lambda votes: next(iter(votes)))
    from kerbline.operators import events as E

    batch = E.sign_stage(Q._sign_detections(spark, FOLDER), ticks.select("stream_id", "tick"), min_votes=1)
    got = {(r.stream_id, r.tick, r.speed_limit) for r in out.filter("speed_limit is not null").collect()}
    assert got and got == {(str(r.stream_id), r.tick, r.speed_limit) for r in batch.filter("speed_limit is not null").collect()}


def test_lane_departure(spark, folder):
    rows = V.ticks(spark, FOLDER).select("stream_id", "ts", "tick", "off")
    out = run(spark, folder, "lane", rows, P.hysteresis_stream, threshold=0.5, up=2, down=2)
    got = {(r.stream_id, r.tick, r.active, r.direction) for r in out.collect()}
    assert got == {(str(r.stream_id), r.tick, r.active, r.direction) for r in Q.lane_departure(spark, FOLDER).collect()}


def test_alerts(spark, folder):
    out = run(spark, folder, "alerts", V.messages(spark, FOLDER), P.alerts_stream, **Q.SPANS)
    got = {(r.stream_id, r.msg_id, r.reason, r.level) for r in out.filter("msg_id is not null").collect()}
    assert got == {(str(r.stream_id), r.msg_id, r.reason, r.level) for r in Q.alerts(spark, FOLDER).collect()}
    assert out.filter("msg_id is null AND reason = 'adas_offline'").count() > 0  # going stale is told without a message


def test_rows_behind_the_watermark_are_counted(spark, folder):
    path, times = folder / "late", ["10:00:00", "10:10:00", "10:20:00", "10:00:01", "10:30:00"]
    for i, time in enumerate(times):
        row = [("s", i, 0.9)]
        frame = spark.createDataFrame(row, "stream_id string, tick bigint, off double").withColumn("ts", F.to_timestamp(F.lit(f"2026-01-01 {time}")))
        frame.coalesce(1).write.mode("append").parquet(str(path))
        for file in os.listdir(path):
            if file.startswith("part") and os.path.getmtime(path / file) > 1_750_000_000:
                os.utime(path / file, (1_700_000_000 + i * 10,) * 2)
    late = P.LateRows()
    spark.streams.addListener(late)
    stream = spark.readStream.schema("stream_id string, tick bigint, off double, ts timestamp").option("maxFilesPerTrigger", 1).parquet(str(path))
    query = (
        P.hysteresis_stream(stream, delay="1 second").writeStream.format("memory").queryName("late_rows")
        .option("checkpointLocation", str(folder / "late_checkpoint")).trigger(availableNow=True).outputMode("append").start()
    )
    assert query.awaitTermination(240)
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    spark.streams.removeListener(late)
    assert late.counts[str(query.id)] == 1


def test_a_streams_state_is_few_values():
    """Each value and each call of a state costs far more than its bytes: 1,000 waiting rows are one value, the rest another."""
    import pandas as pd

    class Handle:
        """A list state and timers, with what is put into them."""

        values, calls, timers = [], 0, []

        def getListState(self, name, schema):  # noqa: N802
            return self

        def get(self):
            self.calls += 1
            return iter(self.values)

        def put(self, values):
            self.calls += 1
            self.values = values

        def registerTimer(self, at):  # noqa: N802
            self.timers = [*self.timers, at]

    class At:
        def __init__(self, ms):
            self.ms = ms

        def getCurrentWatermarkInMs(self):  # noqa: N802
            return self.ms

    handle, stage = Handle(), P.SignStage()
    stage.init(handle)
    rows = pd.DataFrame({"ts_ms": range(1000, 2000), "tick": range(1000), "name": "stop", "px": 40.0, "reading": None, "conf": 0.9})
    assert list(stage.handleInputRows(("s",), iter([rows[::-1]]), At(0))) == []
    assert len(handle.values) == 2 and handle.calls == 2 and handle.timers == [1000]
    first, second = (pd.concat(stage.handleExpiredTimer(("s",), At(ms), None)) for ms in (1499, 5000))
    assert [*first.tick, *second.tick] == list(range(1000)) and handle.timers == [1000, 1500]
    assert first[first.sign_seen.notna()].tick.tolist() == [2] and second.sign_seen.isna().all()
    assert len(handle.values) == 1 and handle.calls == 6
    assert list(stage.handleInputRows(("s",), iter([rows[:3]]), At(5000))) == []  # behind rows already given out
    assert stage.late == 3
