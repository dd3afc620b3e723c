"""Evaluation queries: graded runs, predictions, publishing, attempts, reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from trajmill import constants as C
from trajmill.functions import text as X
from trajmill.functions.numbers import elapsed_seconds, log_time, whole_div
from trajmill.operators import attempts, audit, grades, periodic, predictions, publish
from trajmill.plans import views as V
from trajmill.plans.corpus import REDACTION, _redact_sql
from trajmill.plans.registry import query

RUNS = [(m, r) for m in ("A", "B") for r in range(1, 6)]
N_RUNS = 5

# --- joins -----------------------------------------------------------------------


@query(
    "join_resolved_flag",
    """SELECT p.model, p.run, p.event_id, (r.instance_id IS NOT NULL) AS resolved
       FROM (SELECT CASE WHEN (event_id // 5) % 2 = 0 THEN 'A' ELSE 'B' END AS model, CAST(event_id % 5 + 1 AS INTEGER) AS run,
                    event_id, 'repo' || CAST(user_id % 7 AS VARCHAR) || '__' || CAST(user_id AS VARCHAR) AS instance_id FROM events) p
       LEFT JOIN (SELECT DISTINCT model, run, instance_id FROM graded WHERE resolved) r USING (model, run, instance_id)""",
    "graded",
)
def _(spark, sf):
    return grades.with_resolved_flag(
        _attempt_rows(spark, sf), grades.resolved_rows(V.graded(spark, sf)), ["model", "run", "instance_id"]
    ).select("model", "run", "event_id", "resolved")


def _attempt_rows(spark, sf):
    """Every event as one finished trajectory of a (model, run, instance)."""
    e = V.table(spark, sf, "events")
    return e.select(
        F.when(whole_div(F.col("event_id"), 5) % 2 == 0, "A").otherwise("B").alias("model"),
        (F.col("event_id") % 5 + 1).cast("int").alias("run"),
        F.concat(F.lit("repo"), (F.col("user_id") % 7).cast("string"), F.lit("__"), F.col("user_id").cast("string")).alias("instance_id"),
        "event_id",
        "event_type",
        "value",
        "props",
        "ts",
    )


@query(
    "join_pool_intersect",
    """SELECT r.model, r.run, count(g.instance_id) AS n_in_pool
       FROM (SELECT DISTINCT model, run FROM graded) r
       LEFT JOIN (SELECT * FROM graded WHERE resolved AND instance_id IN (SELECT instance_id FROM pool)) g USING (model, run)
       GROUP BY 1, 2""",
    "graded",
    "pool",
)
def _(spark, sf):
    return grades.pool_intersection(V.graded(spark, sf), V.pool(spark, sf), ["model"])


@query(
    "join_run_config",
    """SELECT n.n_name AS label, n.n_nationkey AS max_steps, COALESCE(g.n_graded, 0) AS n_graded,
              round(COALESCE(g.mean_resolved, -1), 6) AS mean_resolved, g.n_graded IS NULL AS absent
       FROM nation n LEFT JOIN (
         SELECT tag, count(*) AS n_graded, avg(n) AS mean_resolved FROM (
           SELECT user_id % 20 AS tag, event_id % 5 AS run, count(DISTINCT user_id) FILTER (WHERE event_type = 'purchase' AND value > 60) AS n
           FROM events GROUP BY 1, 2) GROUP BY 1) g ON n.n_nationkey = g.tag""",
)
def _(spark, sf):
    """Nations stand for configurations; the last five have no graded run."""
    e = V.table(spark, sf, "events").withColumn("tag", F.col("user_id") % 20).withColumn("run", F.col("event_id") % 5)
    solved = e.groupBy("tag", "run", "user_id").agg(
        F.bool_or((F.col("event_type") == "purchase") & (F.col("value") > 60)).alias("resolved")
    )
    means = grades.resolved_mean(solved, ["tag"])
    configs = V.table(spark, sf, "nation").select(
        F.col("n_nationkey").cast("bigint").alias("tag"), F.col("n_name").alias("label"), F.col("n_nationkey").alias("max_steps")
    )
    return configs.join(means, "tag", "left").select(
        "label",
        "max_steps",
        F.coalesce("n_runs", F.lit(0)).alias("n_graded"),
        F.round(F.coalesce("mean_resolved", F.lit(-1.0)), 6).alias("mean_resolved"),
        F.col("n_runs").isNull().alias("absent"),
    )


@query(
    "join_missing_as_failure",
    """SELECT p.instance_id, m.model, r.run, COALESCE(g.resolved, FALSE) AS resolved
       FROM pool p, (VALUES ('A'), ('B')) m(model), (SELECT unnest([1, 2, 3, 4, 5])::INTEGER AS run) r
       LEFT JOIN graded g ON g.instance_id = p.instance_id AND g.model = m.model AND g.run = r.run""",
    "graded",
    "pool",
)
def _(spark, sf):
    return grades.missing_as_failure(V.pool(spark, sf), RUNS, V.graded(spark, sf))


# Slices are blocks of 25 users; each (user, event type) is one attempt ("cluster").
_WORK_SQL = """
    attempts_seen AS (
        SELECT 'run' || CAST(event_id % 3 AS VARCHAR) AS run, user_id // 25 AS job_id,
               user_id * 10 + CASE event_type WHEN 'click' THEN 1 WHEN 'error' THEN 2 WHEN 'purchase' THEN 3 WHEN 'signup' THEN 4 ELSE 5 END AS cluster,
               event_id, ts, value, event_type FROM events),
    slices AS (SELECT run, job_id, count(DISTINCT cluster) // 3 AS resubmits, 60 + job_id AS expected FROM attempts_seen GROUP BY 1, 2),
    active AS (SELECT DISTINCT run, job_id, cluster, CAST(CASE WHEN cluster % 50 = 15 THEN 2 ELSE 5 END AS INTEGER) AS status
               FROM attempts_seen WHERE cluster % 10 = 5 AND (cluster % 50 = 15 AND job_id % 5 = 0 OR cluster % 30 = 5)),
    latest AS (SELECT run, job_id, COALESCE(max(cluster) FILTER (WHERE held), max(cluster)) AS cluster, bool_or(held) AS held FROM (
                 SELECT run, job_id, cluster, FALSE AS held FROM attempts_seen
                 UNION ALL SELECT run, job_id, cluster, TRUE FROM active WHERE status = 5) GROUP BY 1, 2),
    done AS (SELECT run, cluster, count(DISTINCT event_id) AS coverage FROM attempts_seen GROUP BY 1, 2),
    elapsed AS (SELECT cluster, CASE WHEN min(event_id) FILTER (WHERE value > 20) IS NULL THEN 0 ELSE greatest(0,
                  CAST(floor(epoch(arg_max(ts, event_id))) - floor(epoch(arg_min(ts, event_id) FILTER (WHERE value > 20))) AS BIGINT)) END AS elapsed
                FROM attempts_seen GROUP BY 1),
    status AS (SELECT s.run, s.job_id, s.expected, s.resubmits, COALESCE(b.inflight, FALSE) AS inflight, l.cluster,
                      COALESCE(l.held, FALSE) AS held, COALESCE(d.coverage, 0) AS coverage, e.elapsed
               FROM slices s LEFT JOIN (SELECT run, job_id, bool_or(status IN (1, 2)) AS inflight FROM active GROUP BY 1, 2) b USING (run, job_id)
               LEFT JOIN latest l USING (run, job_id) LEFT JOIN done d ON d.run = s.run AND d.cluster = l.cluster
               LEFT JOIN elapsed e ON e.cluster = l.cluster),
    classified AS (SELECT *, CASE WHEN inflight THEN 'inflight' WHEN coverage >= expected THEN 'done' WHEN elapsed >= 1900000 THEN 'ended_late'
                     WHEN resubmits >= 35 THEN 'gave_up' ELSE 'needs_retry' END AS outcome FROM status)"""
LIMITS = {"late_seconds": 1_900_000, "max_resubmits": 35}


def _seen_attempts(spark, sf):
    kind = (
        F.when(F.col("event_type") == "click", 1).when(F.col("event_type") == "error", 2)
        .when(F.col("event_type") == "purchase", 3).when(F.col("event_type") == "signup", 4).otherwise(5)
    )
    return V.table(spark, sf, "events").select(
        F.concat(F.lit("run"), (F.col("event_id") % 3).cast("string")).alias("run"),
        whole_div(F.col("user_id"), 25).alias("job_id"),
        (F.col("user_id") * 10 + kind).alias("cluster"),
        "event_id",
        "ts",
        "value",
        "event_type",
    )


def _work_status(spark, sf):
    seen = _seen_attempts(spark, sf)
    pairs = seen.groupBy("run", "job_id", "cluster").agg(F.count(F.lit(1)).alias("n_rows"))
    slices = pairs.groupBy("run", "job_id").agg(F.count(F.lit(1)).alias("n")).select(
        "run", "job_id", (F.lit(60) + F.col("job_id")).alias("expected"), whole_div(F.col("n"), 3).alias("resubmits")
    )
    active = pairs.where(
        (F.col("cluster") % 10 == 5)
        & (((F.col("cluster") % 50 == 15) & (F.col("job_id") % 5 == 0)) | (F.col("cluster") % 30 == 5))
    ).select("run", "job_id", "cluster", F.when(F.col("cluster") % 50 == 15, C.QUEUE_RUNNING).otherwise(C.QUEUE_HELD).alias("status"))
    done = attempts.coverage(seen.withColumnRenamed("event_id", "instance_id"), ["run", "cluster"]).select(
        "run", "cluster", F.col("n_instances").alias("coverage")
    )
    log = seen.select("cluster", "ts", F.col("event_id").alias("line_no"), F.when(F.col("value") > 20, "001").otherwise("006").alias("code"))
    spent = attempts.attempt_elapsed(log, ["cluster"])
    return attempts.work_status(slices, active, pairs, done, spent)


@query("join_work_status", f"WITH {_WORK_SQL} SELECT * FROM status")
def _(spark, sf):
    return _work_status(spark, sf)


@query("attempt_outcomes", f"WITH {_WORK_SQL} SELECT run, job_id, cluster, outcome FROM classified")
def _(spark, sf):
    return attempts.classify(_work_status(spark, sf), **LIMITS).select("run", "job_id", "cluster", "outcome")


@query(
    "attempt_next_state",
    f"""WITH {_WORK_SQL} SELECT run, job_id, CASE WHEN outcome = 'needs_retry' THEN 'resubmitting' ELSE outcome END AS status,
        resubmits + CASE WHEN outcome = 'needs_retry' THEN 1 ELSE 0 END AS resubmits, coverage, elapsed AS last_elapsed FROM classified""",
)
def _(spark, sf):
    return attempts.next_state(attempts.classify(_work_status(spark, sf), **LIMITS))


@query(
    "attempt_releases",
    f"WITH {_WORK_SQL} SELECT run, job_id, cluster, outcome FROM classified WHERE held AND outcome <> 'inflight'",
)
def _(spark, sf):
    return attempts.releases(attempts.classify(_work_status(spark, sf), **LIMITS)).select("run", "job_id", "cluster", "outcome")


@query(
    "agg_status_summary",
    f"""WITH {_WORK_SQL} SELECT run, count(*) FILTER (WHERE outcome = 'done') AS done, count(*) FILTER (WHERE outcome = 'inflight') AS inflight,
        count(*) FILTER (WHERE outcome = 'needs_retry') AS resubmitted, count(*) FILTER (WHERE outcome = 'ended_late') AS late,
        count(*) FILTER (WHERE outcome = 'gave_up') AS gave_up, any_value(u.n) AS unique_coverage
        FROM classified JOIN (SELECT run, count(DISTINCT event_id) AS n FROM attempts_seen GROUP BY 1) u USING (run) GROUP BY run""",
)
def _(spark, sf):
    unique = attempts.coverage(_seen_attempts(spark, sf).withColumnRenamed("event_id", "instance_id"), ["run"])
    return attempts.status_summary(attempts.classify(_work_status(spark, sf), **LIMITS), unique)


@query("win_latest_attempt", f"WITH {_WORK_SQL} SELECT run, job_id, cluster, held FROM latest")
def _(spark, sf):
    status = _work_status(spark, sf)
    return status.select("run", "job_id", "cluster", "held")


@query(
    "agg_attempt_history",
    f"""WITH {_WORK_SQL} SELECT run, job_id, count(DISTINCT cluster) AS n_attempts, min(cluster) AS first_cluster,
        max(cluster) AS last_cluster FROM attempts_seen GROUP BY 1, 2""",
)
def _(spark, sf):
    return attempts.attempt_history(_seen_attempts(spark, sf))


@query(
    "agg_coverage",
    f"WITH {_WORK_SQL} SELECT run, cluster, count(*) AS n_files, count(DISTINCT value) AS n_instances FROM attempts_seen GROUP BY 1, 2",
)
def _(spark, sf):
    return attempts.coverage(_seen_attempts(spark, sf).withColumnRenamed("value", "instance_id"), ["run", "cluster"])


@query(
    "win_attempt_elapsed",
    """SELECT cluster, CASE WHEN min(line_no) FILTER (WHERE code = '001') IS NULL THEN 0 ELSE greatest(0, CAST(
         floor(epoch(arg_max(ts, line_no))) - floor(epoch(arg_min(ts, line_no) FILTER (WHERE code = '001'))) AS BIGINT)) END AS elapsed
       FROM job_events GROUP BY cluster""",
    "job_events",
)
def _(spark, sf):
    return attempts.attempt_elapsed(V.job_events(spark, sf), ["cluster"])


@query(
    "dt_elapsed",
    """SELECT o_orderkey, greatest(0, date_diff('day', o_orderdate::DATE, l_shipdate::DATE)) * 86400 AS seconds, l_linenumber
       FROM orders JOIN lineitem ON o_orderkey = l_orderkey""",
)
def _(spark, sf):
    o, l = V.table(spark, sf, "orders"), V.table(spark, sf, "lineitem")
    text = lambda c: F.date_format(F.col(c).cast("timestamp"), "yyyy-MM-dd HH:mm:ss")
    spent = elapsed_seconds(log_time(text("o_orderdate")), log_time(text("l_shipdate")))
    return o.join(l, o["o_orderkey"] == l["l_orderkey"]).select("o_orderkey", spent.cast("bigint").alias("seconds"), "l_linenumber")


# --- predictions --------------------------------------------------------------------


@query(
    "win_latest_valid",
    """SELECT instance_id, event_id, model_patch FROM preds WHERE starts_with(model_patch, 'diff --git')
       QUALIFY row_number() OVER (PARTITION BY instance_id ORDER BY mtime DESC, event_id DESC) = 1""",
    "preds",
)
def _(spark, sf):
    return predictions.latest_valid(V.preds(spark, sf), ["instance_id"], ["mtime", "event_id"], ["event_id", "model_patch"])


# --- graded runs ----------------------------------------------------------------------

_PER_RUN = "(SELECT model, run, count(*) FILTER (WHERE resolved) AS n FROM graded GROUP BY 1, 2)"


@query("agg_resolved_mean", f"SELECT model, count(*) AS n_runs, round(avg(n), 6) AS mean_resolved FROM {_PER_RUN} GROUP BY 1", "graded")
def _(spark, sf):
    return _rounded(grades.resolved_mean(V.graded(spark, sf), ["model"]), "mean_resolved")


def _rounded(df, *columns):
    return df.withColumns({c: F.round(c, 6) for c in columns})


@query("agg_passk_union", "SELECT DISTINCT model, instance_id FROM graded WHERE resolved", "graded")
def _(spark, sf):
    return grades.passk_union(V.graded(spark, sf), ["model"])


@query(
    "agg_passk_count",
    "SELECT model, count(DISTINCT instance_id) FILTER (WHERE resolved) AS union_count FROM graded GROUP BY 1",
    "graded",
)
def _(spark, sf):
    return grades.passk_count(V.graded(spark, sf), ["model"])


@query(
    "agg_completion_mean",
    """SELECT model, round(avg(n), 6) AS mean_completed FROM (SELECT model, run, count(*) AS n FROM graded GROUP BY 1, 2) GROUP BY 1""",
    "graded",
)
def _(spark, sf):
    completed = V.graded(spark, sf).groupBy("model", "run").agg(F.count(F.lit(1)).alias("completed_instances"))
    return _rounded(grades.completion_mean(completed, ["model"]), "mean_completed")


@query(
    "agg_solve_frequency",
    "SELECT instance_id, count(*) AS n_solves FROM graded WHERE resolved GROUP BY 1",
    "graded",
)
def _(spark, sf):
    return grades.solve_frequency(V.graded(spark, sf))


@query(
    "agg_repo_breakdown",
    """SELECT c.model, r.repo, count(u.instance_id) AS n_instances
       FROM (SELECT DISTINCT model FROM graded) c, (SELECT DISTINCT split_part(instance_id, '__', 1) AS repo FROM graded WHERE resolved) r
       LEFT JOIN (SELECT DISTINCT model, instance_id FROM graded WHERE resolved) u
         ON u.model = c.model AND split_part(u.instance_id, '__', 1) = r.repo GROUP BY 1, 2""",
    "graded",
)
def _(spark, sf):
    return grades.repo_breakdown(V.graded(spark, sf), ["model"])


REPOS = [f"repo{i}" for i in range(7)]


@query(
    "agg_repo_pivot",
    "SELECT model, "
    + ", ".join(f"count(DISTINCT instance_id) FILTER (WHERE resolved AND split_part(instance_id, '__', 1) = '{r}') AS {r}" for r in REPOS)
    + " FROM graded GROUP BY 1",
    "graded",
)
def _(spark, sf):
    return grades.repo_pivot(V.graded(spark, sf), ["model"], REPOS)


@query(
    "agg_pass1_estimator",
    """SELECT model, n_resolved, round(n_resolved / (5.0::DOUBLE * (SELECT count(DISTINCT instance_id) FROM graded)), 6) AS pass_at_1
       FROM (SELECT model, count(*) FILTER (WHERE resolved) AS n_resolved FROM graded GROUP BY 1)""",
    "graded",
)
def _(spark, sf):
    rows = V.graded(spark, sf)
    n = rows.agg(F.countDistinct("instance_id")).scalar()
    return _rounded(grades.pass1(rows, ["model"], N_RUNS, n), "pass_at_1")


@query(
    "agg_passk_estimator",
    """SELECT model, round(sum(CASE WHEN c > 2 THEN 1.0 ELSE 1.0 - (5 - c) / 5.0::DOUBLE * (4 - c) / 4.0::DOUBLE * (3 - c) / 3.0::DOUBLE END)
                / (SELECT count(DISTINCT instance_id) FROM graded), 6) AS pass_at_3
       FROM (SELECT model, instance_id, count(*) FILTER (WHERE resolved) AS c FROM graded GROUP BY 1, 2) GROUP BY 1""",
    "graded",
)
def _(spark, sf):
    rows = V.graded(spark, sf)
    n = rows.agg(F.countDistinct("instance_id")).scalar()
    return _rounded(grades.pass_at_k_mean(rows, ["model"], N_RUNS, 3, n), "pass_at_3")


@query(
    "agg_pass1_std",
    f"""SELECT m.model, COALESCE(r.n_runs, 0) AS n_runs, round(COALESCE(r.mean, 13) / 446.0::DOUBLE * 100, 6) AS pass1_pct,
               round(COALESCE(r.std, 0) / 446.0::DOUBLE * 100, 6) AS std_pp, r.n_runs IS NULL AS pending
        FROM (VALUES ('A'), ('B'), ('C')) m(model)
        LEFT JOIN (SELECT model, count(*) AS n_runs, avg(n) AS mean, stddev_samp(n) AS std FROM {_PER_RUN} GROUP BY 1) r USING (model)""",
    "graded",
)
def _(spark, sf):
    """Model C is planned but has no graded run yet."""
    rows = V.graded(spark, sf)
    planned = rows.select("model").unionByName(rows.select(F.lit("C").alias("model")))
    return _rounded(grades.pass1_spread(planned, rows), "pass1_pct", "std_pp")


@query(
    "agg_pass1_pct",
    f"""SELECT model, count(*) AS n_runs, round(avg(n), 6) AS mean_resolved, round(avg(n) / 446 * 100, 6) AS pass1_pct FROM {_PER_RUN} GROUP BY 1""",
    "graded",
)
def _(spark, sf):
    return _rounded(grades.pass1_percent(V.graded(spark, sf), ["model"], C.POOL_SIZE), "mean_resolved", "pass1_pct")


@query("agg_ever_resolved_subset", "SELECT instance_id, count(*) AS freq FROM graded WHERE resolved GROUP BY 1", "graded")
def _(spark, sf):
    return grades.subset_of_resolved(V.graded(spark, sf))


@query(
    "agg_sweep_summary",
    f"""SELECT a.model, round(a.mean, 6) AS pass1_mean, u.n AS passk_count, a.n_runs AS n_graded, 42 AS eval_pool
        FROM (SELECT model, avg(n) AS mean, count(*) AS n_runs FROM {_PER_RUN} GROUP BY 1) a
        JOIN (SELECT model, count(DISTINCT instance_id) FILTER (WHERE resolved) AS n FROM graded GROUP BY 1) u USING (model)
        UNION ALL SELECT '*', -1, count(DISTINCT instance_id) FILTER (WHERE resolved), -1, 42 FROM graded""",
    "graded",
)
def _(spark, sf):
    flat = grades.sweep_summary(V.graded(spark, sf), "model", 42)
    return _rounded(flat, "pass1_mean").na.fill(-1.0, ["pass1_mean"]).na.fill(-1, ["n_graded"])


@query(
    "agg_publish_totals",
    """SELECT model, run, n_rows, n_resolved, CAST(sum(n_resolved) OVER (PARTITION BY model ORDER BY run) AS BIGINT) AS resolved_so_far
       FROM (SELECT model, run, count(*) AS n_rows, count(*) FILTER (WHERE resolved) AS n_resolved FROM graded GROUP BY 1, 2)""",
    "graded",
)
def _(spark, sf):
    return grades.publish_totals(V.graded(spark, sf))


@query("agg_config_sample", "SELECT arg_min(props, (event_id % 5, event_id)) AS props FROM events WHERE props IS NOT NULL")
def _(spark, sf):
    rows = V.table(spark, sf, "events").withColumn("run", F.col("event_id") % 5)
    return grades.config_sample(rows, "props", ["run", "event_id"])


@query(
    "agg_scaling_series",
    f"""SELECT CAST(steps AS BIGINT) * 524288 AS tokens, round(avg(n) / 446 * 100, 6) AS pass1_pct FROM (
          SELECT CASE run WHEN 1 THEN 20 WHEN 2 THEN 70 ELSE 200 END AS steps, n FROM {_PER_RUN} WHERE model = 'A'
          UNION ALL SELECT 2000, n FROM {_PER_RUN} WHERE model = 'B') GROUP BY 1""",
    "graded",
)
def _(spark, sf):
    """Runs 1, 2 and 3.. of model A stand for three sweep configurations, model B for the full run."""
    rows = V.graded(spark, sf)
    steps = F.when(F.col("run") == 1, 20).when(F.col("run") == 2, 70).otherwise(200)
    sweep = grades.pass1_percent(rows.where("model = 'A'").withColumn("max_steps", steps), ["max_steps"], C.POOL_SIZE)
    full = grades.pass1_percent(rows.where("model = 'B'").withColumn("max_steps", F.lit(2000)), ["max_steps"], C.POOL_SIZE)
    return _rounded(grades.scaling_series(sweep, full), "pass1_pct")


@query(
    "str_repo",
    "SELECT DISTINCT instance_id, split_part(instance_id, '__', 1) AS repo FROM traj_rows",
    "traj_rows",
)
def _(spark, sf):
    return V.traj_rows(spark, sf).select("instance_id", X.repo(F.col("instance_id")).alias("repo")).distinct()


@query("str_run_tag", "SELECT o_orderkey, regexp_extract(o_orderpriority, '([^-]*)$', 1) AS tag FROM orders")
def _(spark, sf):
    return V.table(spark, sf, "orders").select("o_orderkey", X.run_tag(F.col("o_orderpriority")).alias("tag"))


# --- publishing and reports on finished trajectories -------------------------------------


def _published(spark, sf):
    rows = _attempt_rows(spark, sf).select(
        "model",
        "run",
        "instance_id",
        F.when(F.col("event_type") == "error", F.lit(None)).otherwise(F.col("event_type")).alias("exit_status"),
        F.when(F.col("value") > 40, F.concat(F.lit("diff --git a/"), "props")).alias("submission"),
        F.array(F.struct(F.lit("user").alias("role"), F.col("props").alias("content"))).alias("messages"),
    )
    resolved = grades.resolved_rows(V.graded(spark, sf))
    return publish.published_rows(rows, resolved, REDACTION)


@query(
    "project_published",
    f"""SELECT e.instance_id, e.model, e.run, COALESCE(NULLIF(e.event_type, 'error'), '') AS exit_status, g.resolved,
              CASE WHEN e.value > 40 THEN 'diff --git a/' || e.props ELSE '' END AS submission, 1 AS n_turns,
              md5({_redact_sql('e.props')}) AS content_md5,
              'Evaluation data: do not train on these rows.' AS warning
       FROM (SELECT *, CASE WHEN (event_id // 5) % 2 = 0 THEN 'A' ELSE 'B' END AS model, CAST(event_id % 5 + 1 AS INTEGER) AS run,
                    'repo' || CAST(user_id % 7 AS VARCHAR) || '__' || CAST(user_id AS VARCHAR) AS instance_id FROM events) e
       JOIN graded g USING (model, run, instance_id)""",
    "graded",
)
def _(spark, sf):
    rows = _published(spark, sf)
    return rows.select(
        "instance_id", "model", "run", "exit_status", "resolved", "submission", "n_turns",
        F.md5(F.get("messages", F.lit(0))["content"].cast("binary")).alias("content_md5"), "warning",
    )


@query(
    "audit_exit_status",
    """SELECT CASE WHEN (event_id // 5) % 2 = 0 THEN 'A' ELSE 'B' END AS model, CAST(event_id % 5 + 1 AS INTEGER) AS run,
              COALESCE(NULLIF(event_type, 'error'), '') AS exit_status, count(*) AS n FROM events GROUP BY 1, 2, 3""",
)
def _(spark, sf):
    return audit.exit_status_counts(_published(spark, sf), ["model", "run"])


@query(
    "audit_empty_submission",
    """SELECT CASE WHEN (event_id // 5) % 2 = 0 THEN 'A' ELSE 'B' END AS model, count(*) AS n_submitted,
              count(*) FILTER (WHERE value <= 40) AS n_empty,
              count(*) FILTER (WHERE value <= 40 AND event_type = 'signup') AS n_out_of_context,
              count(*) FILTER (WHERE value <= 40 AND event_type <> 'signup') AS n_no_edit,
              round(count(*) FILTER (WHERE value <= 40) / count(*)::DOUBLE * 100, 6) AS empty_pct
       FROM events WHERE event_type <> 'error' GROUP BY 1""",
)
def _(spark, sf):
    rows = _published(spark, sf).where(F.col("exit_status") != "")
    return _rounded(audit.empty_submissions(rows, ["model"], F.col("exit_status") == "signup"), "empty_pct")


@query(
    "audit_forbidden_paths",
    """SELECT lang, count(*) AS n_patches, count(*) FILTER (WHERE doc_id % 7 IN (1, 3)) AS n_forbidden,
              round(count(*) FILTER (WHERE doc_id % 7 IN (1, 3)) / count(*)::DOUBLE * 100, 6) AS forbidden_pct
       FROM documents WHERE doc_id % 5 <> 0 GROUP BY 1""",
)
def _(spark, sf):
    """Patches name a source file and, for some rows, a test file or a project file."""
    extra = (
        F.when(F.col("doc_id") % 7 == 1, "\ndiff --git a/pkg/test_x.py b/pkg/test_x.py")
        .when(F.col("doc_id") % 7 == 3, "\ndiff --git a/pyproject.toml b/pyproject.toml")
        .otherwise("\ndiff --git a/contest_x.py b/contest_x.py")
    )
    patch = F.when(F.col("doc_id") % 5 == 0, "").otherwise(F.concat(F.lit("diff --git a/src/m.py b/src/m.py"), extra))
    rows = V.table(spark, sf, "documents").select("lang", patch.alias("submission"))
    return _rounded(audit.forbidden_paths(rows, ["lang"], "submission"), "forbidden_pct")


@query(
    "audit_repeated_action",
    """SELECT conv_id, turn, COALESCE(substr(text, 1, 1) = lag(substr(text, 1, 1)) OVER (PARTITION BY conv_id ORDER BY turn), FALSE) AS repeated
       FROM conversations WHERE role = 'assistant'""",
)
def _(spark, sf):
    """The first letter of a turn stands for its action; there are no action blocks in the tables."""
    found = audit.repeated_actions(V.conversations(spark, sf), "conv_id", "turn", F.substring("text", 1, 1))
    return found.select("conv_id", "turn", "repeated")


@query(
    "audit_prompt_parity",
    """SELECT COALESCE(t.role, e.role) AS role, COALESCE(t.d, e.d) AS digest, COALESCE(t.n, 0) AS n_train, COALESCE(e.n, 0) AS n_eval,
              t.d IS NOT NULL AND e.d IS NOT NULL AS parity
       FROM (SELECT role, sha256(text) AS d, count(*) AS n FROM conversations WHERE turn = 0 AND conv_id % 2 = 0 GROUP BY 1, 2) t
       FULL JOIN (SELECT role, sha256(text) AS d, count(*) AS n FROM conversations WHERE turn = 0 AND conv_id % 2 = 1 GROUP BY 1, 2) e
         ON t.role = e.role AND t.d = e.d""",
)
def _(spark, sf):
    first = V.conversations(spark, sf).where("turn = 0")
    return audit.prompt_parity(
        first.where("conv_id % 2 = 0"), first.where("conv_id % 2 = 1"), ["role"], F.col("text")
    )


@query(
    "audit_hold_cause",
    """SELECT cluster, CASE WHEN bool_or(props LIKE '%"k": 7%') THEN 'finished' ELSE 'failed' END AS cause FROM (
         SELECT user_id AS cluster, props FROM events) GROUP BY 1 HAVING cluster % 3 = 0""",
)
def _(spark, sf):
    e = V.table(spark, sf, "events").select(F.col("user_id").alias("cluster"), F.col("props").alias("value"))
    held = e.where("cluster % 3 = 0").select("cluster").distinct()
    return attempts.hold_cause(held, e, '"k": 7')


@query(
    "audit_resolved_only",
    """SELECT event_id, model, run, p.instance_id FROM (
         SELECT event_id, CASE WHEN (event_id // 5) % 2 = 0 THEN 'A' ELSE 'B' END AS model, CAST(event_id % 5 + 1 AS INTEGER) AS run,
                'repo' || CAST(user_id % 7 AS VARCHAR) || '__' || CAST(user_id AS VARCHAR) AS instance_id FROM events) p
       SEMI JOIN (SELECT * FROM graded WHERE resolved) g USING (model, run, instance_id)""",
    "graded",
)
def _(spark, sf):
    """Every event is an attempt; those of a resolved (model, run, instance) stay."""
    attempts = V.table(spark, sf, "events").select(
        "event_id",
        F.when(F.expr("event_id div 5 % 2 = 0"), "A").otherwise("B").alias("model"),
        (F.col("event_id") % 5 + 1).cast("int").alias("run"),
        F.concat(F.lit("repo"), (F.col("user_id") % 7).cast("string"), F.lit("__"), F.col("user_id").cast("string")).alias("instance_id"),
    )
    return audit.resolved_only(attempts, V.graded(spark, sf).where("resolved"), ["model", "run", "instance_id"]).select("event_id", "model", "run", "instance_id")


@query(
    "audit_degenerate_text",
    """SELECT doc_id, round(line_share, 6) AS line_share, round(stutter_share, 6) AS stutter_share,
              greatest(line_share, stutter_share) >= 0.3 AS degenerate
       FROM (SELECT doc_id, 1 - len(list_distinct(l)) / len(l)::DOUBLE AS line_share,
                    len(list_filter(range(2, len(w) + 1), lambda i: w[i] = w[i - 1])) / len(w)::DOUBLE AS stutter_share
             FROM (SELECT doc_id, string_split(text, chr(10)) AS l, string_split(text, ' ') AS w FROM documents))""",
)
def _(spark, sf):
    rows = V.table(spark, sf, "documents").select("doc_id", "text")
    return audit.degenerate_texts(rows, "text").select(
        "doc_id", F.round("line_share", 6).alias("line_share"), F.round("stutter_share", 6).alias("stutter_share"), "degenerate"
    )


def _leads(lo, hi):
    return ", ".join(f"CASE WHEN lead(ch, {p}) OVER w = ch THEN {p} END" for p in range(lo, hi + 1))


_LOOPING = "text || repeat(substr(text, 1, CAST(doc_id % 25 AS INTEGER)), CAST(doc_id % 13 AS INTEGER))"


@query(
    "audit_periodic_text",
    f"""WITH looping AS (SELECT doc_id, {_LOOPING} AS t FROM documents),
             places AS (SELECT doc_id, unnest(range(1, length(t) + 1)) AS i, unnest(string_split(t, '')) AS ch FROM looping),
             equal AS (SELECT doc_id, i, unnest(list_filter(m, lambda x: x IS NOT NULL)) AS p
                       FROM (SELECT doc_id, i, [{_leads(*periodic.PERIODS)}] AS m FROM places WINDOW w AS (PARTITION BY doc_id ORDER BY i))),
             run AS (SELECT doc_id, p, min(i) AS start, count(*) + p AS len
                     FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, p ORDER BY i) AS island FROM equal)
                     GROUP BY doc_id, p, island HAVING count(*) + p >= {periodic.REPEATS} * p),
             best AS (SELECT run.* FROM run JOIN looping USING (doc_id) WHERE substr(t, start, p) <> repeat(substr(t, start, 1), CAST(p AS INTEGER))
                      QUALIFY row_number() OVER (PARTITION BY run.doc_id ORDER BY len DESC, p, start) = 1)
        SELECT doc_id, CAST(coalesce(p, 0) AS BIGINT) AS period, CAST(coalesce(start - 1, -1) AS BIGINT) AS run_start, CAST(coalesce(len, 0) AS BIGINT) AS run_length,
               round(coalesce(len / length(t)::DOUBLE, 0), 6) AS run_share
        FROM looping LEFT JOIN best USING (doc_id)""",
)
def _(spark, sf):
    """Every text, with its first characters repeated up to twelve times at its end."""
    again = F.repeat(F.substring("text", F.lit(1), (F.col("doc_id") % 25).cast("int")), (F.col("doc_id") % 13).cast("int"))
    rows = V.table(spark, sf, "documents").select("doc_id", F.concat("text", again).alias("text"))
    found = periodic.periodic_texts(rows, "text")
    whole = lambda c, none: F.coalesce(c, F.lit(none)).cast("bigint").alias(c)
    return found.select("doc_id", whole("period", 0), whole("run_start", -1), whole("run_length", 0), F.round("run_share", 6).alias("run_share"))
