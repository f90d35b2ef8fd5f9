"""What a log of job events tells: states, timeouts, late answers, totals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codefacts.functions.units import seconds


def latest_state(events: DataFrame) -> DataFrame:
    """The state of each job (task_id, subtask) after its last event. One partial maximum per job."""
    last = F.max_by("event", F.struct("ts", "seq"))
    state = F.when(F.col("event") == "start", "wip").when(F.col("event") == "finish", "done").when(F.col("event") == "kill", "maybe_errored").otherwise("pending")
    return events.groupBy("task_id", "subtask").agg(last.alias("event")).withColumn("state", state)


def timeouts(events: DataFrame, seconds: int) -> DataFrame:
    """Starts that the next start, finish or kill of their worker doesn't follow within the limit."""
    own = events.where("event IN ('start', 'finish', 'kill')")
    follow = F.lead("ts").over(Window.partitionBy("worker_id").orderBy("ts", "seq"))
    limit = F.expr(f"ts + INTERVAL {seconds} SECONDS")
    return own.withColumn("next_ts", follow).where("event = 'start'").where(F.col("next_ts").isNull() | (F.col("next_ts") > limit))


def late_answers(events: DataFrame) -> DataFrame:
    """Finishes of jobs that were killed before: per job, its first kill and the finishes after that."""
    kills = events.where("event = 'kill'").groupBy("task_id", "subtask").agg(F.min(F.struct("ts", "seq")).alias("k"))
    late = events.where("event = 'finish'").join(kills, ["task_id", "subtask"]).where(F.struct("ts", "seq") > F.col("k"))
    return late.groupBy("task_id", "subtask").agg(F.count("*").alias("n_late"))


def errored(events: DataFrame) -> DataFrame:
    """Jobs that started and never finished."""
    done = events.where("event = 'finish'").select("task_id", "subtask").distinct()
    return events.where("event = 'start'").select("task_id", "subtask").distinct().join(done, ["task_id", "subtask"], "left_anti")


def both_phases(events: DataFrame) -> DataFrame:
    """Tasks with a finished analysis (subtask 0), and whether their second phase has finished too."""
    done = events.where("event = 'finish'").groupBy("task_id").agg(F.max((F.col("subtask") == 0).cast("int")).alias("first"), F.max((F.col("subtask") == 1).cast("int")).alias("second"))
    return done.where("first = 1").select("task_id", (F.col("second") == 1).alias("emitted"))


def summary(commands: DataFrame, events: DataFrame) -> DataFrame:
    """One row: commands, skipped ones by reason, jobs done, jobs in error."""
    zero = F.lit(0).cast("long")
    names = ["n_commands", "n_not_main", "n_no_file", "n_done", "n_errored"]
    own = commands.agg(F.count("*"), F.count_if(F.col("skipped") == "not-main"), F.count_if(F.col("skipped") == "no-file"), zero, zero)
    done = events.where("event = 'finish'").agg(zero, zero, zero, F.count_distinct("task_id", "subtask"), zero)
    wrong = errored(events).agg(zero, zero, zero, zero, F.count("*"))
    return own.toDF(*names).union(done).union(wrong).agg(*[F.sum(n).alias(n) for n in names])


def phase_times(events: DataFrame) -> DataFrame:
    """Per phase (subtask), the seconds from its first start to its last finish, and its finished jobs."""
    own = events.where("event IN ('start', 'finish')").groupBy("subtask")
    ends = own.agg(F.min(F.when(F.col("event") == "start", F.col("ts"))).alias("first"), F.max(F.when(F.col("event") == "finish", F.col("ts"))).alias("last"), F.count_distinct(F.when(F.col("event") == "finish", F.col("task_id"))).alias("n_done"))
    return ends.select("subtask", (F.unix_micros(F.col("last").cast("timestamp")) - F.unix_micros(F.col("first").cast("timestamp"))).alias("micros"), "n_done").select("subtask", seconds(F.col("micros"), 3).alias("seconds"), "n_done")


def stats_of_jobs(stats: DataFrame, jobs: DataFrame) -> DataFrame:
    """Statistics of second phases with the file of their task's first phase."""
    return stats.join(jobs.where("subtask = 0").select("task_id", "filepath").distinct(), "task_id")
