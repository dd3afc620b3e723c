"""Stream queries: the tables are read as streams to their end and the final state is compared."""

from __future__ import annotations

from pyspark.sql import functions as F

from trajmill import scratch
from trajmill.functions.numbers import whole_div
from trajmill.operators import predictions
from trajmill.plans import files as FILES, staging as S, views as V
from trajmill.plans.registry import query
from trajmill.streaming import cycles, ingest, jobs, streams as T


def _events(spark, sf):
    schema = V.table(spark, sf, "events").schema
    return T.read_table(spark, f"{sf}/events.parquet", schema).withColumn("ts", F.col("ts").cast("timestamp"))


@query(
    "stream_ingest",
    "SELECT conv_id, turn, role, md5(text) AS text_md5 FROM conversations",
)
def _(spark, sf):
    schema = V.conversations(spark, sf).schema
    landed = T.append_to_table(T.read_table(spark, f"{sf}/conversations.parquet", schema), "ingested")
    return landed.select("conv_id", "turn", "role", F.md5(F.col("text").cast("binary")).alias("text_md5"))


@query(
    "stream_coverage",
    "SELECT CAST(event_id % 5 + 1 AS BIGINT) AS run, count(DISTINCT user_id) AS n_instances FROM events WHERE event_type = 'purchase' GROUP BY 1",
)
def _(spark, sf):
    done = _events(spark, sf).where("event_type = 'purchase'").select(
        (F.col("event_id") % 5 + 1).alias("run"), F.col("user_id").alias("instance_id")
    )
    seen = T.upsert_to_table(T.distinct_coverage(done), ["run", "instance_id"], "coverage")
    return seen.groupBy("run").agg(F.count(F.lit(1)).alias("n_instances"))


@query(
    "stream_cycle_counts",
    """SELECT strftime(time_bucket(INTERVAL '20 minutes', ts), '%Y-%m-%d %H:%M:%S') AS cycle_start, event_type, count(*) AS n
       FROM events GROUP BY 1, 2""",
)
def _(spark, sf):
    """Counts of closed and of open cycles, and late rows, make up all events."""
    found = cycles.watermarked_cycles(_events(spark, sf), "ts", ["event_type"], "1 hour")
    late = found.late.groupBy(F.window("ts", "20 minutes")["start"].alias("cycle_start"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    counts = found.counted().unionByName(late).groupBy("cycle_start", "event_type").agg(F.sum("n").alias("n"))
    return counts.select(F.date_format("cycle_start", "yyyy-MM-dd HH:mm:ss").alias("cycle_start"), "event_type", "n")


@query(
    "stream_late_events",
    """WITH newest AS (SELECT max(ts) - INTERVAL 6 HOURS AS w FROM events WHERE event_id % 11 <> 5),
            judged AS (SELECT *, time_bucket(INTERVAL '20 minutes', ts) AS c,
                              event_id % 11 = 5 AND time_bucket(INTERVAL '20 minutes', ts) + INTERVAL 20 MINUTES <= w AS late FROM events, newest)
       SELECT strftime(c, '%Y-%m-%d %H:%M:%S') AS cycle_start, event_type, count(*) FILTER (WHERE NOT late) AS n_on_time,
              count(*) FILTER (WHERE late) AS n_late FROM judged GROUP BY 1, 2""",
)
def _(spark, sf):
    """One row in eleven lands after the others, and the stream goes on where it stopped."""
    events = V.table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    source, path = scratch.new_path(spark, "landing"), scratch.new_path(spark, "cycles")
    delayed = F.col("event_id") % 11 == 5
    for part in (~delayed, delayed):
        events.where(part).write.mode("append").parquet(source)
        found = cycles.watermarked_cycles(T.read_files(spark, source, events.schema), "ts", ["event_type"], "6 hours", path)
    late = found.late.groupBy(F.window("ts", "20 minutes")["start"].alias("cycle_start"), "event_type")
    late = late.agg(F.lit(0).cast("bigint").alias("n"), F.count(F.lit(1)).alias("late"))
    counts = found.counted().withColumn("late", F.lit(0).cast("bigint")).unionByName(late)
    counts = counts.groupBy("cycle_start", "event_type").agg(F.sum("n").alias("n_on_time"), F.sum("late").alias("n_late"))
    return counts.withColumn("cycle_start", F.date_format("cycle_start", "yyyy-MM-dd HH:mm:ss"))


LATE = 25 * 86400
EXPECTED = 14


@query(
    "stream_attempt_state",
    f"""SELECT cluster, coverage, elapsed, CASE WHEN coverage >= {EXPECTED} THEN 'done' WHEN elapsed >= {LATE} THEN 'ended_late'
              WHEN cluster % 5 >= 3 THEN 'gave_up' ELSE 'needs_retry' END AS outcome
       FROM (SELECT cluster, count(*) FILTER (WHERE code = '100') AS coverage,
               CASE WHEN min(line_no) FILTER (WHERE code = '001') IS NULL THEN 0 ELSE greatest(0, CAST(
                 floor(epoch(arg_max(ts, line_no))) - floor(epoch(arg_min(ts, line_no) FILTER (WHERE code = '001'))) AS BIGINT)) END AS elapsed
             FROM job_events GROUP BY 1)""",
    "job_events",
)
def _(spark, sf):
    """The number of earlier resubmissions comes from the attempt's number."""
    log = _events(spark, sf).select(
        F.col("user_id").alias("cluster"), F.col("event_id").alias("line_no"), "ts", V.event_code(F.col("event_type")).alias("code")
    )
    states = T.attempt_states(log, ["cluster"], "line_no", F.col("code") == "100")
    decided = T.attempt_decisions(states, ["cluster"], F.lit(EXPECTED), F.col("cluster") % 5, late_seconds=LATE)
    return T.upsert_to_table(decided, ["cluster"], "attempts")


@query(
    "stream_latest_pred",
    """SELECT instance_id, event_id, model_patch FROM preds WHERE starts_with(model_patch, 'diff --git')
       QUALIFY row_number() OVER (PARTITION BY instance_id ORDER BY mtime DESC, event_id DESC) = 1""",
    "preds",
)
def _(spark, sf):
    """Each batch is reduced by itself; the merged table holds one row per instance."""
    e = _events(spark, sf).select(
        F.col("user_id").alias("instance_id"),
        F.col("ts").alias("mtime"),
        "event_id",
        F.when(F.col("event_type").isin("error", "signup"), "").otherwise(F.concat(F.lit("diff --git "), F.col("event_id").cast("string"))).alias("model_patch"),
    )
    latest = ingest.merge_newest(predictions.valid_predictions(e), ["instance_id"], ["mtime", "event_id"], "predictions")
    return latest.select("instance_id", "event_id", "model_patch")


JOB_LATE = 4 * 86400
JOB_EXPECTED = 3
JOB_DELAY_HOURS = 12


@query(
    "stream_attempt_timers",
    f"""WITH RECURSIVE job_events AS ({V.VIEWS["job_events"]}), mark AS (
          SELECT max(epoch_us(ts)) // 1000 - {JOB_DELAY_HOURS * 3_600_000} AS w FROM events
        ), line AS (
          SELECT cluster, epoch_us(ts) AS us, code, row_number() OVER (PARTITION BY cluster ORDER BY epoch_us(ts), line_no) AS k
          FROM job_events, mark WHERE code IN ('001', '100', '012') AND epoch_us(ts) // 1000 < w
        ), job AS (
          SELECT DISTINCT cluster, CAST(0 AS BIGINT) AS k, CAST(0 AS BIGINT) AS resubmits, CAST(NULL AS BIGINT) AS started, CAST(0 AS BIGINT) AS coverage,
                 CAST(NULL AS BIGINT) AS late_start, CAST(0 AS BIGINT) AS late_coverage, CAST(0 AS BIGINT) AS late_resubmits,
                 CAST(NULL AS VARCHAR) AS outcome, CAST(NULL AS BIGINT) AS us, CAST(0 AS BIGINT) AS elapsed, CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS r
          FROM line
          UNION ALL
          SELECT cluster, k, CASE outcome WHEN 'done' THEN 0 WHEN 'gave_up' THEN 0 WHEN 'needs_retry' THEN r + 1 ELSE r END,
                 CASE WHEN outcome IS NOT NULL THEN NULL WHEN began IS NULL AND code = '001' THEN us ELSE began END,
                 CASE WHEN outcome IS NOT NULL THEN 0 ELSE n END, CASE WHEN over THEN started END, coverage, resubmits,
                 outcome, us, (us - began) // 1000000, n, r
          FROM (SELECT *, CASE WHEN began IS NULL THEN NULL WHEN code = '100' AND n >= {JOB_EXPECTED} THEN 'done'
                               WHEN code = '012' THEN CASE WHEN r >= 3 THEN 'gave_up' ELSE 'needs_retry' END END AS outcome
                FROM (SELECT *, CASE WHEN began IS NULL THEN 0 WHEN code = '100' THEN c + 1 ELSE c END AS n
                      FROM (SELECT *, CASE WHEN NOT over THEN started END AS began, CASE WHEN over THEN 0 ELSE coverage END AS c,
                                   CASE WHEN over THEN 0 ELSE resubmits END AS r
                            FROM (SELECT job.cluster, line.k, line.us, line.code, job.resubmits, job.started, job.coverage,
                                         COALESCE(job.started + {JOB_LATE}000000 <= line.us, FALSE) AS over
                                  FROM job JOIN line ON line.cluster = job.cluster AND line.k = job.k + 1))))
        ), last AS (
          SELECT * FROM job QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY k DESC) = 1
        ), decided AS (
          SELECT cluster, outcome, us, n AS coverage, elapsed, r AS resubmits FROM job WHERE outcome IS NOT NULL
          UNION ALL
          SELECT cluster, 'ended_late', late_start + {JOB_LATE}000000, late_coverage, {JOB_LATE}, late_resubmits FROM job WHERE late_start IS NOT NULL
          UNION ALL
          SELECT cluster, 'ended_late', started + {JOB_LATE}000000, coverage, {JOB_LATE}, resubmits FROM last, mark WHERE (started + {JOB_LATE}000000) // 1000 < w
        )
        SELECT cluster, outcome, strftime(make_timestamp(us), '%Y-%m-%d %H:%M:%S.%f') AS decided_at, coverage, elapsed, resubmits FROM decided""",
)
def _(spark, sf):
    """Users as jobs: sign-ups start attempts, purchases finish instances, errors hold them."""
    log = _events(spark, sf).select(
        F.col("user_id").alias("cluster"), F.col("event_id").alias("line_no"), "ts", V.event_code(F.col("event_type")).alias("code"), F.lit(JOB_EXPECTED).alias("expected")
    )
    decided = jobs.job_decisions(log, ["cluster"], f"{JOB_DELAY_HOURS} hours", JOB_LATE)
    rows = T.append_to_table(decided, "decisions")
    return rows.select(
        "cluster", "outcome", F.date_format("decided_at", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("decided_at"), "coverage", "elapsed", F.col("resubmits").cast("bigint").alias("resubmits")
    )


# --- documents as they land ------------------------------------------------------------------


def _cut_short(content):
    """Some files are empty, and some stop in the middle of their document."""
    number = F.col("conv_id") + F.col("turn")
    return F.when(number % 11 == 0, "").when(number % 5 == 0, F.substring(content, 1, 15)).otherwise(content)


def _landed_trajectories(spark, sf):
    """A fourth of the files per batch, so that the stream takes several."""
    root = S.trajectory_files(spark, sf, _cut_short)
    return ingest.ingest_trajectories(spark, root, files_per_batch=max(1, V.conversations(spark, sf).count() // 4))


@query(
    "stream_ingest_files",
    """SELECT conv_id || '-' || turn AS instance_id, CASE WHEN conv_id % 3 <> 0 THEN 'Submitted' ELSE '' END AS exit_status, role, md5(text) AS content_md5
       FROM conversations WHERE (conv_id + turn) % 11 <> 0 AND (conv_id + turn) % 5 <> 0""",
)
def _(spark, sf):
    """Nested documents in several batches; damaged files do not come through."""
    rows = ingest.trajectory_rows(_landed_trajectories(spark, sf).documents)
    message = F.get("messages", F.lit(0))
    return rows.select("instance_id", "exit_status", message["role"].alias("role"), F.md5(message["content"].cast("binary")).alias("content_md5"))


@query(
    "stream_quarantine",
    """SELECT format('job_{}/{}/{}-{}.traj.json', conv_id % 4, conv_id, conv_id, turn) AS file,
              CASE WHEN (conv_id + turn) % 11 = 0 THEN CAST(0 AS BIGINT) ELSE CAST(15 AS BIGINT) END AS n_bytes
       FROM conversations WHERE (conv_id + turn) % 11 = 0 OR (conv_id + turn) % 5 = 0""",
)
def _(spark, sf):
    """Empty and cut files with their path and bytes."""
    bad = _landed_trajectories(spark, sf).quarantine
    return bad.select(F.regexp_extract("path", r"(job_\d+/.*)$", 1).alias("file"), F.octet_length("content").cast("bigint").alias("n_bytes"))


@query("stream_merged_preds", FILES.MERGED_PREDS_SQL, "preds")
def _(spark, sf):
    """Prediction files as they land, and the newest valid prediction of each instance from what has landed.

    An eighth of the files per batch, 20 at least: a batch takes about a second whatever is in it.
    """
    files = V.preds(spark, sf).select(whole_div(F.col("instance_id"), 25), F.col("event_id") % 3).distinct().count()
    landed = ingest.ingest_predictions(spark, S.prediction_files(spark, sf), files_per_batch=max(20, files // 8))
    rows = ingest.prediction_rows(ingest.landed_stream(landed))
    rows = rows.select("instance_id", "model_patch", F.regexp_extract("path", r"job_(\d+)/", 1).cast("bigint").alias("file"))
    merged = ingest.merge_newest(predictions.valid_predictions(rows), ["instance_id"], ["file"], "merged-predictions")
    return merged.select("instance_id", "model_patch")
