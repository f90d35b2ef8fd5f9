"""Job states, timeouts and late answers over a stream of job events.

Events (ts, seq, worker_id, task_id, subtask, event) are told in the order in which they happen for each job and each worker, in batches of any size. Each
operator keeps a few numbers a job or a worker, so its state grows with them and not with the events. Jobs and workers are dealt to groups by a hash;
a group's numbers are one value in the store, a table, so a batch costs a step a group and not a step a job.
"""

from __future__ import annotations

import io
import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from codefacts.operators.jobs import latest_state

# The runner of stateful operators doesn't look into the files that Spark ships, so their code goes with them.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

STATES = {"start": "wip", "finish": "done", "kill": "maybe_errored"}
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
COUNTED = ("start", "finish", "kill")
#: Groups of jobs or workers, however many there are.
GROUPS = 512
JOB = ["task_id", "subtask"]


def states(events: DataFrame) -> DataFrame:
    """The running state of each job of a stream (ts, seq, task_id, subtask, event): update or complete mode."""
    return latest_state(events)


def _in_order(tables: Iterator[pd.DataFrame]) -> pd.DataFrame:
    return pd.concat(list(tables)).sort_values(["ts", "seq"], kind="stable", ignore_index=True)


class GroupState:
    """A table of a group, kept as the bytes of a Feather file."""

    def __init__(self, handle: StatefulProcessorHandle, name: str):
        self._state = handle.getValueState(name, "rows binary")

    def get(self) -> pd.DataFrame | None:
        return pd.read_feather(io.BytesIO(bytes(self._state.get()[0]))) if self._state.exists() else None

    def set(self, rows: pd.DataFrame) -> None:
        if rows.empty:
            self._state.clear()
            return
        out = io.BytesIO()
        rows.reset_index(drop=True).to_feather(out)
        self._state.update((out.getvalue(),))


class JobStates(StatefulProcessor):
    """Per job: its last event, whether it has been killed, and how many answers have come after that."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._known = GroupState(handle, "jobs")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        own, known = _in_order(rows)[[*JOB, "event"]], self._known.get()
        if known is not None:
            own = own.merge(known[[*JOB, "killed", "n_late"]], "left", JOB)
        else:
            own = own.assign(killed=False, n_late=0)
        jobs = [own[c] for c in JOB]
        before = own["killed"].eq(True)
        after_kill = (own["event"] == "kill").groupby(jobs, dropna=False).cumsum().gt(0) | before
        own = own.assign(killed=after_kill, late=(after_kill & (own["event"] == "finish")).astype("int64"), n_late=own["n_late"].fillna(0).astype("int64"))
        new = own.groupby(JOB, dropna=False, as_index=False).agg(event=("event", lambda e: e.iloc[-1]), killed=("killed", "max"), n_late=("n_late", "first"), late=("late", "sum"))
        new = new.assign(n_late=new["n_late"] + new["late"]).drop(columns="late")
        self._known.set(new if known is None else pd.concat([known, new], ignore_index=True).drop_duplicates(JOB, keep="last"))
        yield new.assign(state=new["event"].map(STATES).fillna("pending"))[[*JOB, "event", "state", "n_late"]]

    def close(self) -> None:
        pass


class WorkerTimeouts(StatefulProcessor):
    """Per worker: the start that nothing has followed yet. A timer at its limit tells it as timed out; so does a later event that comes after the limit.

    A group has one timer, at the first of its workers' limits.
    """

    def __init__(self, seconds: int, by_event_time: bool):
        self._limit, self._by_event_time = 1000 * seconds, by_event_time

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._open = GroupState(handle, "open")

    def _keep(self, rows: pd.DataFrame) -> None:
        self._open.set(rows)
        wanted = [] if rows.empty else [int(rows["due"].min())]
        timers = list(self._handle.listTimers())
        for at in timers:
            if at not in wanted:
                self._handle.deleteTimer(at)
        for at in wanted:
            if at not in timers:
                self._handle.registerTimer(at)

    def _told(self, rows: pd.DataFrame) -> pd.DataFrame:
        return rows[["worker_id", "ts", "seq", *JOB]].reset_index(drop=True)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        own = _in_order(rows)
        own = own[own["event"].isin(COUNTED)][["worker_id", "ts", "seq", *JOB, "event"]]
        if own.empty:
            return
        begun = own["ts"].astype("datetime64[us]").astype("int64") // 1000 if self._by_event_time else timerValues.getCurrentProcessingTimeInMs()
        own, known = own.assign(due=begun + self._limit), self._open.get()
        seen = own["worker_id"].unique()
        if known is not None:
            own = pd.concat([known[known["worker_id"].isin(seen)].assign(event="start"), own], ignore_index=True)
        follow = own.groupby("worker_id", dropna=False)["ts"].shift(-1)
        yield self._told(own[(own["event"] == "start") & (follow - own["ts"] > pd.Timedelta(milliseconds=self._limit))])
        waiting = own[(own["event"] == "start") & follow.isna()].drop(columns="event")
        self._keep(waiting if known is None else pd.concat([known[~known["worker_id"].isin(seen)], waiting], ignore_index=True))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        known = self._open.get()
        if known is not None:
            now = timerValues.getCurrentWatermarkInMs() if self._by_event_time else timerValues.getCurrentProcessingTimeInMs()
            over = known["due"] <= now
            yield self._told(known[over])
            self._open.set(known[~over])
            if not over.all():  # the timer that fired is taken away by itself
                self._handle.registerTimer(int(known[~over]["due"].min()))

    def close(self) -> None:
        pass


def _dealt(events: DataFrame, *by: str):
    return events.withColumn("_group", F.pmod(F.xxhash64(*by), F.lit(GROUPS))).groupBy("_group")


def job_states(events: DataFrame) -> DataFrame:
    """An update a batch for each job that it tells of: last event, state, late answers so far. Update mode."""
    kinds = "task_id bigint, subtask bigint, event string, state string, n_late bigint"
    return _dealt(events, *JOB).transformWithStateInPandas(JobStates(), kinds, "Update", "None")


def worker_timeouts(events: DataFrame, seconds: int, by_event_time: bool = False) -> DataFrame:
    """The starts that the next event of their worker doesn't follow within the limit, each told once, as soon as that is known. Append mode.

    Timers go by the clock, for a live stream (which then never ends by itself: Spark waits for the timers); or, for a log that is told again, by the time of events, which the watermark of the stream (set one
    on ts) moves on. A start within the limit of the last event is still open when a log ends.
    """
    kinds = "worker_id bigint, ts timestamp, seq bigint, task_id bigint, subtask bigint"
    mode = "EventTime" if by_event_time else "ProcessingTime"
    return _dealt(events, "worker_id").transformWithStateInPandas(WorkerTimeouts(seconds, by_event_time), kinds, "Append", mode)


def read_events(spark: SparkSession, path: str, schema, files_per_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def write_states(states: DataFrame, checkpoint: str, name: str):
    """Keep the states of a stream in a table in memory, for tests and dashboards; returns the running query."""
    return states.writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_to_end(rows: DataFrame, path: str, checkpoint: str, mode: str) -> None:
    """Run a stream over what is there and write its rows as Parquet, a folder a batch (batch_id=...), so a batch that is repeated replaces itself."""
    spark = rows.sparkSession
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)  # operators of this kind need it
    try:
        query = rows.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
        query.foreachBatch(lambda batch, batch_id: batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")).start().awaitTermination()
    finally:
        if before is None:
            spark.conf.unset(PROVIDER)
        else:
            spark.conf.set(PROVIDER, before)


def replayed(events: DataFrame, path: str, batches: int = 4) -> DataFrame:
    """A log of events as a stream of that many batches of about equal length, in the order of time; written to path first."""
    spark, at = events.sparkSession, F.col("ts").cast("timestamp").cast("double")
    cuts = sorted(set(events.agg(F.percentile_approx(at, [i / batches for i in range(1, batches)])).first()[0] or []))
    for low, high in zip([None, *cuts], [*cuts, None], strict=True):
        inside = F.lit(True) if low is None else at > low
        events.where(inside if high is None else inside & (at <= high)).coalesce(1).write.mode("append").parquet(path)  # a stretch of time is a batch, and a batch is a file
    return read_events(spark, path, events.schema)


def latest(updates: DataFrame, *keys: str) -> DataFrame:
    """The last update (by batch_id) of each key."""
    names = [c for c in updates.columns if c not in (*keys, "batch_id")]
    last = updates.groupBy(*keys).agg(F.max_by(F.struct(*names), "batch_id").alias("u"))
    return last.select(*keys, "u.*")
