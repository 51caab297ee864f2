"""Progress of streams and jobs as a table."""

import datetime

import pytest
from pyspark.sql import functions as F

from codequarry.streaming import progress
from codequarry.streaming.progress import ProgressLog


@pytest.fixture
def listened(spark, tmp_path):
    log = ProgressLog(spark, str(tmp_path / "progress"))
    listener = log.listener()
    spark.streams.addListener(listener)
    yield log
    spark.streams.removeListener(listener)


def start(spark, tmp_path, name, check=None):
    stream = spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    stream = stream.withColumn("x", F.expr(check)) if check else stream
    return stream.writeStream.queryName(name).format("noop").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()


def test_streams_are_logged(spark, tmp_path, listened):
    spark.range(0, 90, 1, 3).write.parquet(str(tmp_path / "in"))
    q = start(spark, tmp_path, "good")
    q.awaitTermination()
    assert listened.wait(q.runId)
    bad = start(spark, tmp_path, "bad", "if(id = 50, raise_error('no'), id)")
    with pytest.raises(Exception, match="no"):
        bad.awaitTermination()
    assert listened.wait(bad.runId)
    rows = progress.read(spark, listened.path)
    got = {r.job: r for r in progress.status(rows).collect()}
    assert (got["good"].status, got["good"].batches, got["good"].rows, got["good"].error) == ("completed", 3, 90, None)
    assert got["bad"].status == "failed" and got["bad"].rows < 90 and "no" in got["bad"].error
    lines = [r.line for r in progress.log_lines(rows).where("job = 'good'").collect()]
    assert lines[0].endswith("] Started") and lines[-1].endswith("] Completed") and sum("30 rows" in x for x in lines) == 3
    assert progress.log_lines(rows, 2).count() == 2 and "Failed" in progress.log_lines(rows, 1).first().line


def test_a_restarted_run_and_a_lost_one(spark, tmp_path):
    assert progress.status(progress.read(spark, str(tmp_path / "none"))).count() == 0
    log = ProgressLog(spark, str(tmp_path / "p"), every=3600)
    then = datetime.datetime(2024, 1, 1, tzinfo=datetime.UTC)
    tick = lambda k: then + datetime.timedelta(seconds=k)
    for k, n in enumerate((5, 7)):  # two attempts at one batch
        log.add("a", progress.PROGRESS, "s", tick(k), batch=0, rows=n)
    log.add("a", progress.PROGRESS, "s", tick(3), batch=1, rows=0)
    log.add("b", progress.STARTED, None, tick(100))
    log.flush()
    log.flush()
    rows = progress.read(spark, log.path)
    assert rows.count() == 4
    at = lambda k: {r.run: (r.status, r.batches, r.rows) for r in progress.status(rows, 60, tick(k)).collect()}
    assert at(63) == {"a": ("running", 1, 7), "b": ("running", 0, 0)}
    assert at(64) == {"a": ("failed", 1, 7), "b": ("running", 0, 0)}
    assert {r.status for r in progress.status(rows).collect()} == {"running"}


def test_jobs_have_stages_and_can_be_followed(spark, tmp_path):
    log = ProgressLog(spark, str(tmp_path / "p"))
    with log.job("crawl") as job:
        job.stage("discover", "2 folders")
        job.stage("analyze")
        job.log("found 3")
        running = progress.status(progress.read(spark, log.path)).first()
        assert (running.status, running.stage, running.stage_index, running.detail) == ("running", "analyze", 2, "")
    with pytest.raises(ValueError), log.job("crawl"):
        raise ValueError("lost")
    rows = progress.read(spark, log.path)
    assert sorted((r.status, r.stage, r.error) for r in progress.status(rows).collect()) == [("completed", "analyze", None), ("failed", None, "ValueError: lost")]
    lines = [r.line[11:] for r in progress.log_lines(rows).collect()]
    assert lines == ["Started", "Stage: discover - 2 folders", "Stage: analyze", "found 3", "Completed", "Started", "Failed: ValueError: lost"]
    got = []
    for _ in range(2):  # each row arrives once
        q = progress.follow(spark, log.path).writeStream.foreachBatch(lambda b, _: got.extend(b.collect())).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination()
        assert len(got) == 7
