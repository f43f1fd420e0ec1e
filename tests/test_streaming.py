"""The streaming extension against its batch form."""

import os

import pytest

from tessella.streaming import incremental

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def run(spark, df, mode, name):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None
    return spark.table(name)


def source(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet")
    events.repartition(3).write.parquet(f"{tmp_path}/events")
    return spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/events"), events


def test_windowed(spark, tmp_path):
    stream, events = source(spark, tmp_path)
    got = run(spark, incremental.windowed(stream, late="4000 days"), "update", "windowed_out")
    last = {(r["window_start"], r["event_type"]): r["n"] for r in got.orderBy("n").collect()}
    want = {(r["window_start"], r["event_type"]): r["n"] for r in incremental.windowed(events).collect()}
    assert last == want


def test_running(spark, tmp_path):
    stream, events = source(spark, tmp_path)
    got = run(spark, incremental.running(stream), "update", "running_out")
    last = {r["event_type"]: r["n"] for r in got.orderBy("n").collect()}
    assert last == {r["event_type"]: r["count"] for r in events.groupBy("event_type").count().collect()}
