"""Published numbers as golden values, and the estimators against their definition."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from trajmill.functions.numbers import to_bf16
from trajmill.operators import attempts, audit, embeddings, grades

# Unions of a sweep of five configurations, and one graded run of 446 instances.
UNIONS = {
    "s20_e3": [],
    "d251_e10": ["django__django-7530", "pydata__xarray-4629"],
    "s70_e3": ["django__django-16527", "django__django-7530"],
    "s200_e3": [
        "django__django-10914", "django__django-11163", "django__django-12050", "django__django-14855", "django__django-15467",
        "django__django-16527", "django__django-16569", "django__django-7530", "pydata__xarray-4629", "pytest-dev__pytest-5809",
        "pytest-dev__pytest-6202",
    ],
}


def sweep(spark):
    """Union members spread over five runs; every run also has an unresolved instance."""
    rows = [(label, run, "none__0", False) for label in UNIONS for run in range(1, 6)]
    rows += [(label, k % 5 + 1, iid, True) for label, ids in UNIONS.items() for k, iid in enumerate(ids)]
    return spark.createDataFrame(rows, "label string, run int, instance_id string, resolved boolean")


def test_sweep(spark):
    graded = sweep(spark)
    assert {r.label: r.union_count for r in grades.passk_count(graded, ["label"]).collect()} == {k: len(v) for k, v in UNIONS.items()}
    flat = {r.label: r for r in grades.sweep_summary(graded, "label", 42).collect()}
    assert flat["*"].passk_count == 11 and flat["s20_e3"].pass1_mean == 0.0 and flat["s200_e3"].pass1_mean == 11 / 5
    assert flat["s20_e3"].n_graded == 5
    table = {r.label: r.asDict() for r in grades.repo_pivot(graded, ["label"], ["django", "pydata", "pytest-dev"]).collect()}
    assert table["s200_e3"] == {"label": "s200_e3", "django": 8, "pydata": 1, "pytest-dev": 2}
    assert table["s20_e3"]["django"] == 0
    configs = spark.createDataFrame([(k, 20, 3, 251) for k in UNIONS], "label string, max_steps int, epochs int, examples int")
    long = {(r.label, r.repo): r.n_instances for r in grades.repo_breakdown(graded, ["label"], configs).collect()}
    assert len(long) == 12 and long["d251_e10", "django"] == 1 and long["s70_e3", "pydata"] == 0
    top = grades.solve_frequency(graded).orderBy(F.desc("n_solves"), "instance_id").first()
    assert (top.instance_id, top.n_solves) == ("django__django-7530", 3)


def test_one_run_in_percent(spark):
    rows = [("m", 1, f"i{k}", k < 23) for k in range(328)]
    graded = spark.createDataFrame(rows, "model string, run int, instance_id string, resolved boolean")
    r = grades.pass1_percent(graded, ["model"], 446).first()
    assert round(r.pass1_pct, 2) == 5.16
    s = grades.pass1_spread(spark.createDataFrame([("m",), ("later",)], "model string"), graded).orderBy("model").collect()
    assert (s[0].pending, round(s[0].pass1_pct, 4), s[0].std_pp) == (True, round(13 / 446 * 100, 4), 0.0)
    assert (s[1].n_runs, s[1].std_pp, s[1].pending) == (1, 0.0, False)


def test_spread_is_the_sample_deviation(spark):
    counts = [20, 23, 17]
    rows = [("m", run + 1, f"i{k}", k < n) for run, n in enumerate(counts) for k in range(30)]
    graded = spark.createDataFrame(rows, "model string, run int, instance_id string, resolved boolean")
    r = grades.pass1_spread(graded.select("model"), graded).first()
    assert math.isclose(r.std_pp, 3.0 / 446 * 100) and math.isclose(r.pass1_pct, 20 / 446 * 100)
    assert math.isclose(grades.pass1(graded, ["model"], 3, 446).first().pass_at_1, 60 / (3 * 446))


@pytest.mark.parametrize("n,k", [(5, 1), (5, 3), (5, 5), (10, 4)])
def test_estimator(spark, n, k):
    df = spark.range(n + 1).select(grades.pass_at_k(F.col("id"), n, k).alias("p"), "id")
    for r in df.collect():
        assert math.isclose(r.p, 1 - math.comb(n - r.id, k) / math.comb(n, k), abs_tol=1e-12)


def test_missing_counts_as_failure(spark):
    graded = spark.createDataFrame([("m", 1, "a", True), ("m", 2, "b", False)], "model string, run int, instance_id string, resolved boolean")
    pool = spark.createDataFrame([("a",), ("b",), ("c",)], "instance_id string")
    full = grades.missing_as_failure(pool, [("m", 1), ("m", 2)], graded)
    assert full.count() == 6 and full.where("resolved").count() == 1
    inside = {r.run: r.n_in_pool for r in grades.pool_intersection(graded, pool, ["model"]).collect()}
    assert inside == {1: 1, 2: 0}


def test_series_and_steps(spark):
    points = lambda *p: spark.createDataFrame(list(p), "max_steps int, pass1_pct double")
    got = sorted(tuple(r) for r in grades.scaling_series(points((20, 0.0), (200, 0.9)), points((2000, 4.48))).collect())
    assert got == [(20 * 524288, 0.0), (200 * 524288, 0.9), (2000 * 524288, 4.48)]
    r = grades.steps_plan(spark.range(17)).first()
    assert (r.n_packs, r.steps, r.tokens) == (17, 3, 3 * 524288)


def test_decisions(spark):
    rows = [
        (True, 23, 23, 9000, 3, "inflight"), (False, 23, 23, 9000, 3, "done"), (False, 5, 23, 5400, 3, "ended_late"),
        (False, 5, 23, 5399, 3, "gave_up"), (False, 5, 23, None, 2, "needs_retry"), (False, 0, 0, None, 9, "done"), (False, 0, 23, None, 3, "gave_up"),
    ]
    df = spark.createDataFrame(rows, "inflight boolean, coverage int, expected int, elapsed int, resubmits int, want string")
    for r in attempts.classify(df).collect():
        assert r.outcome == r.want


def test_work_status(spark):
    slices = spark.createDataFrame([("r", j, 2, 0) for j in range(5)], "run string, job_id int, expected int, resubmits int")
    active = spark.createDataFrame([("r", 0, 10, 2), ("r", 1, 11, 5), ("r", 1, 9, 5)], "run string, job_id int, cluster int, status int")
    recorded = spark.createDataFrame([("r", 1, 20), ("r", 2, 12), ("r", 2, 30), ("r", 3, 13)], "run string, job_id int, cluster int")
    done = spark.createDataFrame([("r", 11, 2), ("r", 30, 1)], "run string, cluster int, coverage int")
    elapsed = spark.createDataFrame([(30, 6000), (13, 10)], "cluster int, elapsed int")
    status = attempts.classify(attempts.work_status(slices, active, recorded, done, elapsed))
    got = {r.job_id: (r.cluster, r.held, r.outcome) for r in status.collect()}
    assert got == {
        0: (None, False, "inflight"), 1: (11, True, "done"), 2: (30, False, "ended_late"), 3: (13, False, "needs_retry"), 4: (None, False, "needs_retry"),
    }
    assert [r.cluster for r in attempts.releases(status).collect()] == [11]
    nxt = {r.job_id: (r.status, r.resubmits) for r in attempts.next_state(status).collect()}
    assert nxt[3] == ("resubmitting", 1) and nxt[1] == ("done", 0)
    unique = spark.createDataFrame([("r", 7)], "run string, n_instances int")
    r = attempts.status_summary(status, unique).first()
    assert (r.done, r.inflight, r.resubmitted, r.late, r.gave_up, r.unique_coverage) == (1, 1, 2, 1, 0, 7)


def test_history_and_coverage(spark):
    seen = spark.createDataFrame([("r", 1, 5), ("r", 1, 5), ("r", 1, 9)], "run string, job_id int, cluster int")
    r = attempts.attempt_history(seen).first()
    assert (r.n_attempts, r.first_cluster, r.last_cluster) == (2, 5, 9)
    files = spark.createDataFrame([("r", "a"), ("r", "a"), ("r", "b")], "run string, instance_id string")
    r = attempts.coverage(files, ["run"]).first()
    assert (r.n_files, r.n_instances) == (3, 2)


def test_reports_on_trajectories(spark):
    rows = [("m", "Submitted", "diff --git a/pkg/test_a.py b/x"), ("m", "Submitted", "diff --git a/src/a.py b/x\ndiff --git a/setup.cfg b/x"), ("m", "Submitted", "diff --git a/src/latest_a.py b/x"), ("m", "ContextWindowExceededError", None), ("m", "Submitted", "")]
    df = spark.createDataFrame(rows, "model string, exit_status string, submission string")
    r = audit.forbidden_paths(df, ["model"], "submission").first()
    assert (r.n_patches, r.n_forbidden) == (3, 2)
    r = audit.empty_submissions(df, ["model"], F.col("exit_status") == "ContextWindowExceededError").first()
    assert (r.n_submitted, r.n_empty, r.n_out_of_context, r.n_no_edit) == (5, 2, 1, 1)
    assert {r.exit_status: r.n for r in audit.exit_status_counts(df, ["model"]).collect()} == {"Submitted": 4, "ContextWindowExceededError": 1}
    turns = spark.createDataFrame([(1, 0, "assistant", "ls"), (1, 1, "user", "out"), (1, 2, "assistant", "ls"), (1, 4, "assistant", "cd")], "c int, t int, role string, text string")
    assert [r.repeated for r in audit.repeated_actions(turns, "c", "t", F.col("text")).orderBy("t").collect()] == [False, True, False]
    held = spark.createDataFrame([(1,), (2,), (3,)], "cluster int")
    log = spark.createDataFrame([(1, "x exit=0"), (1, "y"), (2, "exit=1")], "cluster int, value string")
    assert {r.cluster: r.cause for r in attempts.hold_cause(held, log).collect()} == {1: "finished", 2: "failed", 3: "failed"}


def test_centroid(spark):
    df = spark.createDataFrame([([1.0, 2.0],), ([3.0, 6.0],)], "v array<float>")
    assert embeddings.centroid_row(df, "v").first().centroid == [2.0, 4.0]


def test_mean_of_vectors_with_nulls(spark):
    df = spark.createDataFrame([([1.0, None],), (None,), ([2.0, 5.0],), ([6.0, None],)], "v array<float>")
    assert embeddings.centroid_row(df, "v").first().centroid == [3.0, 5.0]
    assert [(r.pos, r["mean"]) for r in embeddings.centroid(df, "v").collect()] == [(0, 3.0), (1, 5.0)]
    assert embeddings.centroid(df.where("v is null"), "v").collect() == []
    assert embeddings.centroid_row(spark.createDataFrame([([None, 1.0],)], "v array<float>"), "v").first().centroid == [None, 1.0]


def test_mean_shuffles_one_row_per_task(spark):
    df = spark.range(0, 1000, 1, 7).selectExpr("transform(sequence(1, 300), x -> cast(x * id as float)) v")
    found = embeddings.mean_vector(df, "v")
    assert found.first()["mean"] == pytest.approx([499.5 * k for k in range(1, 301)])
    plan = found._jdf.queryExecution().executedPlan()
    found.collect()
    text = plan.toString()
    assert "Generate" not in text and "ObjectHashAggregate" in text or "SortAggregate" in text


def bf16_of(x):
    """The same on the bits."""
    bits = int(np.float32(x).view(np.uint32))
    if np.isnan(x) or np.isinf(np.float32(x)):
        return float(np.float32(x))
    rounded = (bits + 0x7FFF + ((bits >> 16) & 1)) & 0xFFFF0000
    return float(np.uint32(rounded).view(np.float32))


def test_bf16(spark):
    rng = np.random.default_rng(0)
    values = [0.0, -0.0, 1.0, -1.0, 1.00390625, 1.01171875, 255.0, 256.0, 257.0, 2.0**-126, 2.0**-133, 3 * 2.0**-134, 1e-45, 3.3895e38, 3.4e38, float("inf"), float("-inf"), float("nan")]
    values += [float(2.0**k) for k in range(-149, 128, 3)] + [float(np.nextafter(np.float32(2.0**k), np.float32(0))) for k in range(-120, 127, 7)]
    with np.errstate(all="ignore"):
        values += [float(np.uint32(b).view(np.float32)) for b in rng.integers(0, 2**32, 3000)]
        values += [float(np.uint32((int(b) & 0xFFFF0000) | 0x8000).view(np.float32)) for b in rng.integers(0, 2**32, 500)]  # ties
        want = [bf16_of(v) for v in values]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double").select("i", to_bf16(F.col("v")).alias("b"))
    got = [r.b for r in df.orderBy("i").collect()]
    for v, a, b in zip(values, got, want, strict=True):
        assert a == b or (np.isnan(a) and np.isnan(b)), (v, a, b)
