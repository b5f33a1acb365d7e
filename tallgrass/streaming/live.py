"""Progress, jobs and re-analysis over time: latest state by key in batch and as a stream, expiry, due jobs, file streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallgrass.sources.corpus import SCHEMA

FINISHED = ("complete", "failed")
DAY = "INTERVAL 24 HOURS"


def percent(step: Column, total: Column) -> Column:
    """0 to 100; 0 where there is no total."""
    return F.when(total > 0, F.least(F.lit(100.0), F.greatest(F.lit(0.0), step / total * 100))).otherwise(F.lit(0.0))


def latest(events: DataFrame, key: str = "repository_id", order: tuple[str, ...] = ("last_updated", "event_id")) -> DataFrame:
    """The last event of each key: one aggregate, in batch or over a stream (complete or update mode)."""
    rest = [c for c in events.columns if c != key]
    best = F.max_by(F.struct(*rest), F.struct(*order))
    return events.groupBy(key).agg(best.alias("e")).select(key, *[F.col(f"e.{c}").alias(c) for c in rest])


def expired(events: DataFrame, now: Column, seconds: int, status: str = "status", key: str = "repository_id") -> DataFrame:
    """Latest states that are finished and older than so many seconds."""
    age = F.unix_timestamp(now) - F.unix_timestamp("last_updated")
    return latest(events, key).where(F.col(status).isin(*FINISHED) & (age > seconds))


def due_jobs(schedules: DataFrame, now: Column) -> DataFrame:
    """Enabled schedules whose time has come or that never ran, with the next time."""
    due = schedules.where(F.col("enabled") & (F.col("next_run").isNull() | (F.col("next_run") <= now)))
    return due.withColumn("following_run", now + F.expr(DAY))


def next_pending(jobs: DataFrame, k: int = 1) -> DataFrame:
    """The first pending jobs by creation time, then id."""
    return latest(jobs, "job_id", ("updated_at", "seq")).where(F.col("status") == "pending").orderBy("created_at", "job_id").limit(k)


def job_counts(jobs: DataFrame) -> DataFrame:
    now = latest(jobs, "job_id", ("updated_at", "seq"))
    return now.agg(F.count_if(F.col("status") == "pending").alias("pending"), F.count_if(F.col("status") == "running").alias("running"), F.count("*").alias("total"))


EVENTS = "repository_id string, event_id long, kind string, step int, total_steps int, step_name string, message string, at timestamp"
#: What a job may become from what it is.
TRANSITIONS = {"pending": ("running", "cancelled"), "running": ("completed", "failed", "cancelled")}


def progress_state(events: DataFrame, key: str = "repository_id") -> DataFrame:
    """The state of each run from its events (kind start, update, message, complete, fail or clear), in the order of (at, event_id).

    One aggregate: total steps come from the latest start, the step from the latest start or update. Runs that never
    started, or were cleared since, aren't there; so are events after a clear.
    """
    order = F.struct("at", "event_id")

    def last(value: Column, *kinds: str) -> Column:
        return F.max_by(F.when(F.col("kind").isin(*kinds), value), F.when(F.col("kind").isin(*kinds), order))

    state = events.groupBy(key).agg(
        last(F.col("kind"), "start", "clear").alias("open"),
        last(F.struct("total_steps", F.col("at").alias("started_at")), "start").alias("begun"),
        last(F.struct("step", "step_name"), "start", "update").alias("now"),
        last(F.struct("kind", "message", F.col("at").alias("last_updated")), "start", "update", "message", "complete", "fail").alias("last"),
        last(F.col("kind"), "start", "update", "complete", "fail").alias("said"),
    )
    done, failed, total = F.col("said") == "complete", F.col("said") == "fail", F.col("begun.total_steps")
    step = F.when(done, total).otherwise(F.coalesce("now.step", F.lit(0)))
    return state.where("open = 'start'").select(
        key,
        step.alias("current_step"),
        total.alias("total_steps"),
        F.when(done, F.lit("Complete")).when(failed, F.lit("Failed")).otherwise(F.col("now.step_name")).alias("step_name"),
        F.when(done, F.lit(100.0)).otherwise(percent(step, total)).alias("progress_percent"),
        F.col("last.message").alias("status_message"),
        "begun.started_at",
        "last.last_updated",
        F.when(done, F.lit("complete")).when(failed, F.lit("failed")).otherwise(F.lit("running")).alias("status"),
    )


def job_states(events: DataFrame) -> DataFrame:
    """The state of each job from events (job_id, seq, status), in order of seq: those that its state doesn't allow are passed over.

    A job is in the first state that it can be in, then in the first that this one allows, and so on: an aggregate for each of these
    steps, so that a job of many events is never gathered.
    """
    at = F.struct("seq", "status")
    now = events.where("status = 'pending'").groupBy("job_id").agg(F.min(at).alias("now"))
    allowed = F.create_map(*[x for k, v in TRANSITIONS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    for _ in range(_longest("pending")):
        may = F.array_contains(F.coalesce(F.try_element_at(allowed, F.col("now.status")), F.array().cast("array<string>")), F.col("status"))
        then = events.join(now, "job_id").where(may & (at > F.col("now"))).groupBy("job_id").agg(F.min(at).alias("then"))
        now = now.join(then, "job_id", "left").select("job_id", F.coalesce("then", "now").alias("now"))
    return now.select("job_id", "now.status")


def _longest(status: str) -> int:
    """Transitions at most from a status on."""
    return max((1 + _longest(x) for x in TRANSITIONS.get(status, ())), default=0)


def progress_stream(spark: SparkSession, path: str, schema, files_per_trigger: int = 1) -> DataFrame:
    """Latest state over a stream of event files; state is one row for each key."""
    events = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
    return latest(events)


def windowed_activity(events: DataFrame, size: str = "10 minutes", late: str = "30 minutes", time: str = "last_updated") -> DataFrame:
    """Events by window and step; a watermark bounds the state."""
    counted = events.withWatermark(time, late).groupBy(F.window(time, size).alias("w"), "step_name").agg(F.count("*").alias("n"))
    return counted.select(F.col("w.start").alias("window_start"), "step_name", "n")


def analyse_stream(spark: SparkSession, path: str, analyse: Callable[[DataFrame, int], None], checkpoint: str):
    """Snapshots of files (repository_id, path, content as Parquet) are analysed as they come; a batch that is run again replaces its own rows."""
    files = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 8).parquet(path)
    return files.writeStream.foreachBatch(analyse).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
