"""Progress of streams and of batch jobs as a table: what runs, how far it is, and the last lines of its log.

A table of progress is a folder of JSON lines, by day. A listener adds a row for each event of each
streaming query, a job a row for each of its stages; both only append, so that many drivers may write to
one folder and readers may follow it as a stream. Rows of a run are few (one for each trigger or stage)
and are written by the driver that makes them, gathered for `every` seconds.

Defined cases: a folder that does not exist yet has no rows; a query without a name has the null name;
a batch that is run again after a failure has a row for each attempt, of which `status` counts the last.
"""

from __future__ import annotations

import datetime
import itertools
import threading
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

ROWS = "at timestamp, seq bigint, job string, run string, event string, batch bigint, rows bigint, millis bigint, state_rows bigint, late_rows bigint, stage string, message string, day date"
STARTED, PROGRESS, IDLE, STAGE, LOG, ENDED = "started", "progress", "idle", "stage", "log", "ended"
#: The stages of a whole run, in order.
STAGES = ["discover", "clone", "analyze", "output", "reloading"]
LOG_LINES = 200


def _now() -> datetime.datetime:
    return datetime.datetime.now(datetime.UTC)


def _time(s: str | None) -> datetime.datetime:
    return datetime.datetime.fromisoformat(s.replace("Z", "+00:00")) if s else _now()


class ProgressLog:
    """A writer of progress rows into the folder at path."""

    def __init__(self, spark: SparkSession, path: str, every: float = 0):
        self.spark, self.path, self.every = spark, path, every
        self._lock, self._seq, self._rows, self._written = threading.Lock(), itertools.count(), [], 0.0
        self._ended: set[str] = set()
        self._end = threading.Condition()
        self._names: dict[str, str | None] = {}

    def add(self, run: str, event: str, job: str | None = None, at: datetime.datetime | None = None, **more) -> None:
        """One row; written at once at the end of a run, else when `every` seconds have passed since the last time."""
        at = at or _now()
        row = dict.fromkeys(c.split()[0] for c in ROWS.split(", ")) | more
        with self._lock:
            self._rows.append(row | {"at": at, "seq": next(self._seq), "job": job, "run": run, "event": event, "day": at.date()})
            due = event == ENDED or time.monotonic() - self._written >= self.every
        if due:
            self.flush()
        if event == ENDED:
            with self._end:
                self._ended.add(run)
                self._end.notify_all()

    def flush(self) -> None:
        with self._lock:
            if self._rows:
                self.spark.createDataFrame([tuple(r.values()) for r in self._rows], ROWS).coalesce(1).write.mode("append").partitionBy("day").json(self.path)
                self._rows = []
            self._written = time.monotonic()

    def wait(self, run: str, seconds: float = 60) -> bool:
        """Wait till the end of a run stands in the table; events of a stream arrive a little after it has ended."""
        with self._end:
            return self._end.wait_for(lambda: str(run) in self._ended, seconds)

    def listener(self) -> StreamingQueryListener:
        """To be added by spark.streams.addListener: all streaming queries of the session are logged."""
        return _Listener(self)

    @contextmanager
    def job(self, name: str) -> Iterator[Job]:
        """A batch job whose stages and messages are logged; an exception ends it as failed and goes on."""
        run = uuid.uuid4().hex
        self.add(run, STARTED, name)
        try:
            yield Job(self, name, run)
        except BaseException as e:
            self.add(run, ENDED, name, message=f"{type(e).__name__}: {e}")
            raise
        self.add(run, ENDED, name)


class Job:
    """A run of a job in a log."""

    def __init__(self, log: ProgressLog, name: str, run: str):
        self._log, self.name, self.run = log, name, run

    def stage(self, name: str, detail: str = "") -> None:
        self._log.add(self.run, STAGE, self.name, stage=name, message=detail)

    def log(self, message: str) -> None:
        self._log.add(self.run, LOG, self.name, message=message)


class _Listener(StreamingQueryListener):
    def __init__(self, log: ProgressLog):
        self.log = log

    def onQueryStarted(self, event) -> None:
        self.log._names[str(event.runId)] = event.name
        self.log.add(str(event.runId), STARTED, event.name, _time(event.timestamp))

    def onQueryProgress(self, event) -> None:
        p = event.progress
        state = [(s.numRowsTotal, s.numRowsDroppedByWatermark) for s in p.stateOperators]
        self.log.add(str(p.runId), PROGRESS, p.name, _time(p.timestamp), batch=p.batchId, rows=p.numInputRows, millis=p.batchDuration, state_rows=sum(a for a, _ in state), late_rows=sum(b for _, b in state))

    def onQueryIdle(self, event) -> None:
        self.log.add(str(event.runId), IDLE, self.log._names.get(str(event.runId)), _time(event.timestamp))

    def onQueryTerminated(self, event) -> None:
        run = str(event.runId)
        self.log.add(run, ENDED, self.log._names.pop(run, None), message=event.exception)


def read(spark: SparkSession, path: str) -> DataFrame:
    """All rows of a table of progress; none if it does not exist yet."""
    try:
        return spark.read.schema(ROWS).json(path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], ROWS)


def follow(spark: SparkSession, path: str) -> DataFrame:
    """The rows as a stream, each once, as they are written."""
    return spark.readStream.schema(ROWS).json(path)


def status(progress: DataFrame, stale_seconds: int | None = None, now: datetime.datetime | None = None) -> DataFrame:
    """One row for each run: job, run, status (running, completed, failed), stage, batches, rows, times and error.

    A run whose last row is older than stale_seconds has failed: the driver that ran it is gone. A batch counts once,
    with the rows of its last attempt. Aggregated on the map side; a run with very many batches is no burden.
    """
    order = F.struct("at", "seq")
    batches = progress.where(F.col("event") == PROGRESS).groupBy("run", "batch").agg(F.max_by("rows", order).alias("rows"))
    # a trigger without rows that came after a batch is no batch
    done = batches.where("rows > 0").groupBy("run").agg(F.count("*").alias("batches"), F.sum("rows").alias("rows"))
    of = lambda event, c: F.when(F.col("event") == event, F.col(c))
    by_stage = lambda c: F.max_by(c, F.when(F.col("event") == STAGE, order))
    runs = progress.groupBy("run").agg(
        F.max("job").alias("job"), F.min(of(STARTED, "at")).alias("started_at"), F.max("at").alias("last_at"), F.max(of(ENDED, "at")).alias("ended_at"),
        F.max(of(ENDED, "message")).alias("error"), by_stage("stage").alias("stage"), by_stage("message").alias("detail"),
        F.max_by("state_rows", F.when(F.col("event") == PROGRESS, order)).alias("state_rows"),
    )
    at = F.lit(now) if now is not None else F.current_timestamp()
    stale = F.lit(False) if stale_seconds is None else F.col("ended_at").isNull() & (F.col("last_at") < at - F.make_dt_interval(secs=F.lit(stale_seconds)))
    error = F.when(stale, F.lit("no sign of life")).otherwise(F.col("error"))
    state = F.when(error.isNotNull(), "failed").when(F.col("ended_at").isNotNull(), "completed").otherwise("running")
    index = F.when(F.col("stage").isNotNull(), F.array_position(F.array(*map(F.lit, STAGES)), F.col("stage")).cast("int") - 1)
    return runs.join(done, "run", "left").select(
        "job", "run", state.alias("status"), "stage", index.alias("stage_index"), "detail", F.coalesce("batches", F.lit(0)).cast("long").alias("batches"),
        F.coalesce("rows", F.lit(0)).cast("long").alias("rows"), "state_rows", "started_at", "last_at", "ended_at", error.alias("error"),
    )


def log_lines(progress: DataFrame, n: int = LOG_LINES) -> DataFrame:
    """The last n lines, the latest last: at, seq, job, run, line. A top-k, not a sort of the table."""
    what = (
        F.when(F.col("event") == STAGE, F.concat(F.lit("Stage: "), "stage", F.when(F.coalesce("message", F.lit("")) != "", F.concat(F.lit(" - "), "message")).otherwise("")))
        .when(F.col("event") == LOG, F.coalesce("message", F.lit("")))
        .when(F.col("event") == PROGRESS, F.concat(F.lit("Batch "), F.col("batch").cast("string"), F.lit(": "), F.col("rows").cast("string"), F.lit(" rows")))
        .when(F.col("event") == ENDED, F.when(F.col("message").isNotNull(), F.concat(F.lit("Failed: "), "message")).otherwise("Completed"))
        .otherwise(F.initcap("event"))
    )
    last = progress.orderBy(F.desc("at"), F.desc("seq"), F.desc("run")).limit(n)
    line = F.concat(F.lit("["), F.date_format("at", "HH:mm:ss"), F.lit("] "), what)
    return last.select("at", "seq", "job", "run", line.alias("line")).orderBy("at", "seq", "run")
