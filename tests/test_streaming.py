"""Streaming counterparts, driven by files."""

import time
from datetime import datetime

from pyspark.sql import functions as F

from tarnwork.streaming import jobs


def _stream(spark, tmp_path, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    return spark.readStream.schema(spark.read.parquet(str(tmp_path / "in")).schema).parquet(str(tmp_path / "in"))


def test_events_of_old_runs_are_ignored(spark, tmp_path):
    rows = [(1, 1, "started", 1), (1, 2, "started", 2), (1, 1, "failed", 3), (2, 1, "started", 1), (2, 1, "finished", 2)]
    stream = _stream(spark, tmp_path, rows, "job_id long, run_id long, event string, ts long")
    query = jobs.job_states(stream).writeStream.outputMode("update").format("memory").queryName("job_states").option("checkpointLocation", str(tmp_path / "c")).start()
    ends = time.time() + 60  # processing-time timeouts keep the query going
    while spark.table("job_states").count() < 2 and time.time() < ends:
        time.sleep(0.2)
    query.stop()
    assert sorted(map(tuple, spark.sql("SELECT * FROM job_states").collect())) == [(1, 2, "PROCESSING"), (2, 1, "COMPLETED")]


def test_a_batch_replaces_its_partitions(spark, tmp_path):
    out = str(tmp_path / "out")
    spark.createDataFrame([(1, "old"), (3, "kept")], "parent long, v string").write.partitionBy("parent").parquet(out)
    stream = _stream(spark, tmp_path, [(1, "new"), (2, "new")], "parent long, v string")
    jobs.write_idempotently(stream, out, str(tmp_path / "c"), by="parent").awaitTermination()
    assert sorted((r.parent, r.v) for r in spark.read.parquet(out).collect()) == [(1, "new"), (2, "new"), (3, "kept")]


def test_progress_is_told_on_new_phases_and_after_two_seconds(spark, tmp_path):
    at = lambda s: datetime(2026, 5, 1, 0, 0, s)
    rows = [(1, "waiting", at(0)), (1, "waiting", at(1)), (1, "thinking", at(1)), (1, "thinking", at(2)), (1, "thinking", at(3)), (2, "waiting", at(2)), (2, None, at(9))]
    stream = _stream(spark, tmp_path, rows, "job_id long, phase string, ts timestamp")
    told = jobs.throttled_progress(stream).select("job_id", "phase", F.second("ts").alias("s"))
    told.writeStream.outputMode("append").format("memory").queryName("told").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination(90)
    assert sorted(map(tuple, spark.table("told").collect())) == [(1, "thinking", 1), (1, "thinking", 3), (1, "waiting", 0), (2, "waiting", 2)]


def test_queued_and_running_jobs_have_their_own_time(spark, tmp_path):
    folder, name = tmp_path / "in", "timed_jobs"
    put = lambda rows, n: spark.createDataFrame(rows, "job_id long, run_id long, event string, ts long").coalesce(1).write.parquet(str(folder / f"n={n}"))
    put([(1, 1, "queued", 1), (2, 1, "started", 1), (3, 1, "queued", 1), (3, 1, "started", 2)], 1)
    stream = spark.readStream.schema("job_id long, run_id long, event string, ts long").parquet(str(folder) + "/n=*")
    for limits, lost in (({"timeout_ms": 500, "queued_ms": 10**8}, {2, 3}), ({"timeout_ms": 10**8, "queued_ms": 500}, {1})):
        name += "x"
        query = jobs.job_states(stream, **limits).writeStream.outputMode("update").format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).start()
        failed = lambda: {r.job_id for r in spark.table(name).where("status = 'FAILED'").collect()}  # noqa: E731,B023
        ends = time.time() + 60  # processing-time timeouts keep the query going
        while failed() != lost and time.time() < ends:
            time.sleep(0.2)
        time.sleep(1)
        query.stop()
        assert failed() == lost
