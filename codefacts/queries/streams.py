"""Queries of job states that run as streams, over a log that is told again in batches."""

from __future__ import annotations

from pyspark.sql import functions as F

from codefacts.operators.tables import fresh_path
from codefacts.queries import query
from codefacts.sources.adapters import job_event
from codefacts.streaming import jobs


def _log(spark, sf_dir):
    own = job_event(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))
    return own.select("ts", "seq", *[F.col(c).cast("bigint").alias(c) for c in ("worker_id", "task_id", "subtask")], "event")


def _told(spark, rows, mode):
    path = fresh_path(spark, "stream")
    jobs.run_to_end(rows, f"{path}/out", f"{path}/checkpoint", mode)
    return spark.read.parquet(f"{path}/out")


@query("""SELECT task_id, subtask, arg_max(event, (ts, seq)) AS event, CASE arg_max(event, (ts, seq)) WHEN 'start' THEN 'wip' WHEN 'finish' THEN 'done' WHEN 'kill' THEN 'maybe_errored' ELSE 'pending' END AS state,
    count(*) FILTER (event = 'finish' AND (ts, seq) > k) AS n_late
    FROM (SELECT *, min(CASE WHEN event = 'kill' THEN (ts, seq) END) OVER (PARTITION BY task_id, subtask) AS k FROM job_event) x GROUP BY task_id, subtask""")
def t03_stream_states(spark, sf_dir):
    """Last event, state and late answers of each job, from a stream of four batches."""
    updates = _told(spark, jobs.job_states(jobs.replayed(_log(spark, sf_dir), fresh_path(spark, "events"))), "update")
    return jobs.latest(updates, "task_id", "subtask")


@query("""SELECT worker_id, seq FROM (SELECT *, lead(ts) OVER (PARTITION BY worker_id ORDER BY ts, seq) AS nts FROM job_event WHERE event IN ('start', 'finish', 'kill')) x
    WHERE event = 'start' AND (nts IS NULL OR nts > ts + INTERVAL 300 SECOND) AND (SELECT max(ts) FROM job_event) > ts + INTERVAL 300 SECOND""")
def t02_stream_timeouts(spark, sf_dir):
    """Starts that time out, each told once, from a stream of four batches; those within the limit of the log's end are still open."""
    events = jobs.replayed(_log(spark, sf_dir), fresh_path(spark, "events")).withWatermark("ts", "0 seconds")
    return _told(spark, jobs.worker_timeouts(events, 300, by_event_time=True), "append").select("worker_id", "seq")
