"""State of running evaluation jobs, as batch queries.

Keys: ``run`` names a run directory, ``job_id`` a slice of it, ``cluster`` one attempt.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from trajmill import constants as C
from trajmill.functions.numbers import elapsed_seconds


def attempt_elapsed(events: DataFrame, keys: list[str], order: str = "line_no", ts: str = "ts", code: str = "code") -> DataFrame:
    """Seconds from the first executing line to the last line; 0 if it never executed.

    First and last follow the log's line order, not the time stamps.
    """
    started = F.when(F.col(code) == C.EXECUTING_CODE, F.col(order))
    ends = events.groupBy(*keys).agg(
        F.min_by(ts, started).alias("_start"), F.max_by(ts, order).alias("_end")
    )
    return ends.select(
        *keys,
        F.when(F.col("_start").isNull(), F.lit(0)).otherwise(elapsed_seconds(F.col("_start"), F.col("_end"))).cast("bigint").alias("elapsed"),
    )


def latest_attempt(attempts: DataFrame, keys: list[str]) -> DataFrame:
    """The highest held attempt if any is held, else the highest recorded one."""
    held = F.max(F.when(F.col("held"), F.col("cluster")))
    return attempts.groupBy(*keys).agg(
        F.coalesce(held, F.max("cluster")).alias("cluster"), F.coalesce(F.bool_or("held"), F.lit(False)).alias("held")
    )


def attempt_history(seen: DataFrame) -> DataFrame:
    """Known attempts per slice; each attempt counts once."""
    once = seen.groupBy("run", "job_id", "cluster").agg(F.count(F.lit(1)).alias("_n"))
    return once.groupBy("run", "job_id").agg(
        F.count(F.lit(1)).alias("n_attempts"), F.min("cluster").alias("first_cluster"), F.max("cluster").alias("last_cluster")
    )


def coverage(trajectories: DataFrame, keys: list[str]) -> DataFrame:
    """Files and distinct instances; the first step collapses repeats before the shuffle."""
    once = trajectories.groupBy(*keys, "instance_id").agg(F.count(F.lit(1)).alias("_n"))
    return once.groupBy(*keys).agg(F.sum("_n").alias("n_files"), F.count(F.lit(1)).alias("n_instances"))


def work_status(slices: DataFrame, active: DataFrame, recorded: DataFrame, done: DataFrame, elapsed: DataFrame) -> DataFrame:
    """One row per slice with everything the decision needs.

    ``slices``: run, job_id, expected, resubmits.  ``active``: run, job_id, cluster, status.
    ``recorded``: run, job_id, cluster.  ``done``: run, cluster, coverage.
    ``elapsed``: cluster, elapsed.
    """
    busy = active.groupBy("run", "job_id").agg(
        F.bool_or(F.col("status").isin(C.QUEUE_IDLE, C.QUEUE_RUNNING)).alias("inflight")
    )
    held = active.where(F.col("status") == C.QUEUE_HELD).select("run", "job_id", "cluster", F.lit(True).alias("held"))
    known = recorded.select("run", "job_id", "cluster", F.lit(False).alias("held")).unionByName(held)
    latest = latest_attempt(known, ["run", "job_id"])
    return (
        slices.join(busy, ["run", "job_id"], "left")
        .join(latest, ["run", "job_id"], "left")
        .join(done, ["run", "cluster"], "left")
        .join(elapsed, "cluster", "left")
        .select(
            "run",
            "job_id",
            "expected",
            "resubmits",
            F.coalesce("inflight", F.lit(False)).alias("inflight"),
            "cluster",
            F.coalesce("held", F.lit(False)).alias("held"),
            F.coalesce("coverage", F.lit(0)).alias("coverage"),
            "elapsed",
        )
    )


def outcome(
    inflight: Column,
    coverage: Column,
    expected: Column,
    elapsed: Column,
    resubmits: Column,
    late_seconds: int = C.LATE_SECONDS,
    max_resubmits: int = C.MAX_RESUBMITS,
) -> Column:
    """The decision for a slice; an unknown elapsed time goes on to the retry tests."""
    return (
        F.when(inflight, "inflight")
        .when(coverage >= expected, "done")
        .when(F.coalesce(elapsed >= late_seconds, F.lit(False)), "ended_late")
        .when(resubmits >= max_resubmits, "gave_up")
        .otherwise("needs_retry")
    )


def classify(status: DataFrame, **limits: int) -> DataFrame:
    return status.withColumn(
        "outcome",
        outcome(*[F.col(c) for c in ("inflight", "coverage", "expected", "elapsed", "resubmits")], **limits),
    )


def releases(classified: DataFrame) -> DataFrame:
    """Held attempts whose slot is to be freed: all that are not waited for."""
    return classified.where(F.col("held") & (F.col("outcome") != "inflight"))


def next_state(classified: DataFrame) -> DataFrame:
    """Slice state after a cycle: a retry counts as one more resubmission."""
    retry = F.col("outcome") == "needs_retry"
    return classified.select(
        "run",
        "job_id",
        F.when(retry, "resubmitting").otherwise(F.col("outcome")).alias("status"),
        (F.col("resubmits") + F.when(retry, 1).otherwise(0)).alias("resubmits"),
        "coverage",
        F.col("elapsed").alias("last_elapsed"),
    )


def status_summary(classified: DataFrame, unique: DataFrame) -> DataFrame:
    """Slices per outcome and unique instance coverage of each run."""
    names = {"done": "done", "inflight": "inflight", "needs_retry": "resubmitted", "ended_late": "late", "gave_up": "gave_up"}
    counts = classified.groupBy("run").agg(*[F.count_if(F.col("outcome") == o).alias(n) for o, n in names.items()])
    return counts.join(unique.select("run", F.col("n_instances").alias("unique_coverage")), "run", "left").na.fill(
        0, ["unique_coverage"]
    )


def hold_cause(held: DataFrame, log_lines: DataFrame, mark: str = C.FINISHED_MARK) -> DataFrame:
    """A held attempt whose output has the finish mark was done; otherwise it really failed."""
    marks = log_lines.groupBy("cluster").agg(F.bool_or(F.contains("value", F.lit(mark))).alias("_done"))
    return held.join(marks, "cluster", "left").select(
        *held.columns, F.when(F.coalesce("_done", F.lit(False)), "finished").otherwise("failed").alias("cause")
    )
