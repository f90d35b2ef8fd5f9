"""Job events as a stream, in several cuts, against the batch answers over the whole log."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from codefacts.operators import jobs as batch
from codefacts.streaming import jobs

FIELDS = "ts timestamp, seq bigint, worker_id bigint, task_id bigint, subtask bigint, event string"


@pytest.fixture(scope="module")
def log(spark):
    rng, rows = random.Random(7), []
    for i in range(400):
        rows.append((i * 20 + rng.randrange(20), i, rng.randrange(5), rng.randrange(12), rng.randrange(2), rng.choice(["start", "start", "finish", "kill", "other"])))
    table = spark.createDataFrame(rows, "at long, seq bigint, worker_id bigint, task_id bigint, subtask bigint, event string")
    return table.select(F.timestamp_seconds(F.col("at") + 1_700_000_000).alias("ts"), "seq", "worker_id", "task_id", "subtask", "event").cache()


def stream(spark, log, folder, cuts):
    """The log as a stream of files, one a batch, cut at the given numbers."""
    for low, high in zip([0, *cuts], [*cuts, 10**9], strict=True):
        log.where((F.col("seq") >= low) & (F.col("seq") < high)).coalesce(1).write.mode("append").parquet(folder)
    return jobs.read_events(spark, folder, log.schema)


@pytest.mark.parametrize("cuts", [[], [100, 101, 350]])
def test_states_and_late_answers(spark, log, tmp_path, cuts):
    jobs.run_to_end(jobs.job_states(stream(spark, log, f"{tmp_path}/in", cuts)), f"{tmp_path}/out", f"{tmp_path}/check", "update")
    got = jobs.latest(spark.read.parquet(f"{tmp_path}/out"), "task_id", "subtask").collect()
    want = {(r.task_id, r.subtask): (r.event, r.state) for r in batch.latest_state(log).collect()}
    late = {(r.task_id, r.subtask): r.n_late for r in batch.late_answers(log).collect()}
    assert {(r.task_id, r.subtask): (r.event, r.state) for r in got} == want
    assert {(r.task_id, r.subtask): r.n_late for r in got if r.n_late} == late


@pytest.mark.parametrize("cuts", [[200], [3, 100, 101, 350]])
def test_timeouts_of_a_log(spark, log, tmp_path, cuts):
    """Every start that times out is told once; those within the limit of the log's end are still open."""
    events = stream(spark, log, f"{tmp_path}/in", cuts).withWatermark("ts", "0 seconds")
    jobs.run_to_end(jobs.worker_timeouts(events, 60, by_event_time=True), f"{tmp_path}/out", f"{tmp_path}/check", "append")
    got = sorted(r.seq for r in spark.read.parquet(f"{tmp_path}/out").collect())
    end = log.agg(F.max("ts")).first()[0]
    known = [r.seq for r in batch.timeouts(log, 60).collect() if (end - r.ts).total_seconds() > 60]
    assert got == sorted(known) and len(got) > 20


class Handle:
    """A state store of one key, in memory."""

    def __init__(self):
        self.value, self.timers = None, []

    def getValueState(self, name, schema):
        return self

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value

    def clear(self):
        self.value = None

    def listTimers(self):
        return iter(self.timers)

    def deleteTimer(self, at):
        self.timers.remove(at)

    def registerTimer(self, at):
        self.timers.append(at)


class Clock:
    def __init__(self, now):
        self.now = now

    def getCurrentProcessingTimeInMs(self):
        return self.now


def test_timeouts_by_the_clock():
    """A timer counts from when the start was seen; what follows in time takes it away, and a fired one is told once."""
    handle, job = Handle(), jobs.WorkerTimeouts(60, by_event_time=False)
    job.init(handle)
    rows = lambda *own: iter([pd.DataFrame([(pd.Timestamp(t, unit="s"), i, 1, 2, 0, e) for t, i, e in own], columns=["ts", "seq", "worker_id", "task_id", "subtask", "event"])])
    seqs = lambda told: [s for t in told for s in t["seq"].tolist()]
    assert seqs(job.handleInputRows((1,), rows((30, 2, "start"), (0, 1, "start")), Clock(5000))) == [] and handle.timers == [65_000]
    assert seqs(job.handleInputRows((1,), rows((40, 3, "other")), Clock(9000))) == [] and handle.timers == [65_000]
    assert seqs(job.handleInputRows((1,), rows((50, 4, "finish"), (60, 5, "start")), Clock(20_000))) == [] and handle.timers == [80_000]
    handle.timers.clear()
    assert seqs(job.handleExpiredTimer((1,), Clock(80_001), None)) == [5] and not handle.exists()
    assert seqs(job.handleInputRows((1,), rows((500, 6, "finish"), (510, 7, "start")), Clock(90_000))) == [] and handle.exists()
    assert seqs(job.handleInputRows((1,), rows((700, 8, "kill")), Clock(95_000))) == [7] and handle.timers == []


def test_a_call_serves_many_jobs():
    """A group's jobs are told in one call, and the next batch goes on from what is known of each."""
    handle, job = Handle(), jobs.JobStates()
    job.init(handle)
    rows = lambda *own: iter([pd.DataFrame([(pd.Timestamp(t, unit="s"), t, 1, task, 0, e) for t, task, e in own], columns=["ts", "seq", "worker_id", "task_id", "subtask", "event"])])
    told = lambda *own: {(r.task_id, r.event, r.state, r.n_late) for t in job.handleInputRows((3,), rows(*own), Clock(0)) for r in t.itertuples()}
    assert told((1, 7, "start"), (3, 7, "kill"), (2, 8, "finish"), (4, 7, "finish")) == {(7, "finish", "done", 1), (8, "finish", "done", 0)}
    assert told((5, 7, "finish"), (6, 9, "other")) == {(7, "finish", "done", 2), (9, "other", "pending", 0)}
