"""Repeated graded runs: counts, pass@1, unions, frequencies and tables.

``graded`` has one row per (model, run, instance_id) with a boolean ``resolved``.
``long_form`` turns grade reports into resolved rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from trajmill import constants as C
from trajmill.functions.text import repo



def long_form(reports: DataFrame, keys: list[str]) -> DataFrame:
    """One row per resolved instance of a report."""
    return reports.select(*keys, F.explode("resolved_ids").alias("instance_id")).distinct()


def resolved_rows(graded: DataFrame) -> DataFrame:
    return graded.where(F.col("resolved"))


def per_run(graded: DataFrame, keys: list[str]) -> DataFrame:
    """Resolved count per run.  Runs that resolved nothing stay, with 0."""
    return graded.groupBy(*keys, "run").agg(F.count_if("resolved").alias("n_resolved"))


def resolved_mean(graded: DataFrame, keys: list[str]) -> DataFrame:
    """Mean over graded runs only."""
    return per_run(graded, keys).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_runs"), F.avg("n_resolved").alias("mean_resolved")
    )


def passk_union(graded: DataFrame, keys: list[str]) -> DataFrame:
    """Instances that any run resolved, in long form."""
    return resolved_rows(graded).select(*keys, "instance_id").distinct()


def passk_count(graded: DataFrame, keys: list[str]) -> DataFrame:
    """Size of the union, 0 for configurations that resolved nothing."""
    hit = graded.groupBy(*keys, "instance_id").agg(F.bool_or("resolved").alias("any"))
    return hit.groupBy(*keys).agg(F.count_if("any").alias("union_count"))


def completion_mean(reports: DataFrame, keys: list[str]) -> DataFrame:
    return reports.groupBy(*keys).agg(F.avg("completed_instances").alias("mean_completed"))


def solve_frequency(graded: DataFrame) -> DataFrame:
    """Solves per instance over all configurations and runs."""
    return resolved_rows(graded).groupBy("instance_id").agg(F.count(F.lit(1)).alias("n_solves"))


def repo_breakdown(graded: DataFrame, keys: list[str], configs: DataFrame | None = None) -> DataFrame:
    """Union instances per configuration and repository, long form, 0-filled.

    Every configuration of ``configs`` (by default those of ``graded``) is paired with every
    repository that occurs in one of their unions.
    """
    (key,) = keys
    labels = (graded if configs is None else configs).select(key).distinct()
    counts = passk_union(graded, keys).groupBy(key, repo(F.col("instance_id")).alias("repo")).agg(
        F.count(F.lit(1)).alias("n_instances")
    )
    if configs is not None:
        counts = counts.join(labels, key, "left_semi")
    every = labels.agg(F.sort_array(F.collect_set(key))).scalar()  # the configurations of one sweep
    grid = counts.select("repo").distinct().select("repo", F.explode(every).alias(key))
    return grid.join(counts, [key, "repo"], "left").na.fill(0, ["n_instances"]).select(key, "repo", "n_instances")


def repo_pivot(graded: DataFrame, keys: list[str], repos: list[str]) -> DataFrame:
    """The same as a table: one row per configuration, one column per repository."""
    flags = passk_union(graded, keys).withColumn("repo", repo(F.col("instance_id")))
    columns = [F.count_if(F.col("repo") == r).alias(r) for r in repos]
    base = graded.select(*keys).distinct()
    return base.join(flags.groupBy(*keys).agg(*columns), keys, "left").na.fill(0, repos)


def repos_of(graded: DataFrame) -> DataFrame:
    return resolved_rows(graded).select(repo(F.col("instance_id")).alias("repo")).distinct()


def pass1(graded: DataFrame, keys: list[str], runs: int, pool: int | Column) -> DataFrame:
    """``resolved / (runs * pool)``: an absent sample is a failure.  The pool may be a scalar subquery."""
    return graded.groupBy(*keys).agg(F.count_if("resolved").alias("n_resolved")).withColumn(
        "pass_at_1", F.col("n_resolved") / F.lit(runs * pool)
    )


def pass_at_k(correct: Column, samples: int, k: int) -> Column:
    """Unbiased estimator ``1 - C(n-c, k) / C(n, k)`` for one instance."""
    if not 1 <= k <= samples:
        raise ValueError("k must be between 1 and the number of samples")
    miss = F.lit(1.0)
    for i in range(k):
        miss = miss * (F.lit(samples - i) - correct) / F.lit(samples - i)
    return F.when(correct > samples - k, F.lit(1.0)).otherwise(1.0 - miss)


def pass_at_k_mean(graded: DataFrame, keys: list[str], samples: int, k: int, pool: int | Column) -> DataFrame:
    """Mean of the estimator over a pool; instances without any sample add 0."""
    correct = graded.groupBy(*keys, "instance_id").agg(F.count_if("resolved").alias("c"))
    return correct.groupBy(*keys).agg((F.sum(pass_at_k(F.col("c"), samples, k)) / F.lit(pool)).alias(f"pass_at_{k}"))


def pass1_percent(graded: DataFrame, keys: list[str], pool: int) -> DataFrame:
    return resolved_mean(graded, keys).withColumn("pass1_pct", F.col("mean_resolved") / F.lit(pool) * 100)


def pass1_spread(
    models: DataFrame, graded: DataFrame, pool: int = C.POOL_SIZE, fallback: int = C.SINGLE_ATTEMPT_RESOLVED
) -> DataFrame:
    """Percent and run-to-run sample deviation per model.

    One run has deviation 0; a model without graded runs takes the single attempt.
    """
    runs = per_run(graded, ["model"]).groupBy("model").agg(
        F.count(F.lit(1)).alias("n_runs"), F.avg("n_resolved").alias("mean"), F.stddev_samp("n_resolved").alias("std")
    )
    joined = models.select("model").distinct().join(runs, "model", "left")
    pending = F.col("n_runs").isNull()
    return joined.select(
        "model",
        F.coalesce("n_runs", F.lit(0)).alias("n_runs"),
        (F.when(pending, F.lit(float(fallback))).otherwise(F.col("mean")) / pool * 100).alias("pass1_pct"),
        (F.when(pending | (F.col("n_runs") == 1), F.lit(0.0)).otherwise(F.col("std")) / pool * 100).alias("std_pp"),
        pending.alias("pending"),
    )


def subset_of_resolved(graded: DataFrame) -> DataFrame:
    """An evaluation subset: every instance that a graded run resolved, with its frequency."""
    return solve_frequency(graded).withColumnRenamed("n_solves", "freq")


def with_resolved_flag(rows: DataFrame, resolved: DataFrame, keys: list[str]) -> DataFrame:
    """``resolved`` is true if the row's key is in the resolved list of its run.

    ``resolved`` holds each key once.
    """
    hits = resolved.select(*keys, F.lit(True).alias("_hit"))
    return rows.join(hits, keys, "left").withColumn("resolved", F.col("_hit").isNotNull()).drop("_hit")


def pool_intersection(graded: DataFrame, pool: DataFrame, keys: list[str]) -> DataFrame:
    """Resolved instances inside a pool per run; runs without any stay with 0."""
    runs = graded.select(*keys, "run").distinct()
    inside = resolved_rows(graded).join(pool.select("instance_id").distinct(), "instance_id", "left_semi")
    counts = inside.groupBy(*keys, "run").agg(F.count(F.lit(1)).alias("n_in_pool"))
    return runs.join(counts, [*keys, "run"], "left").na.fill(0, ["n_in_pool"])


def missing_as_failure(
    pool: DataFrame, runs: list[tuple[str, int]], graded: DataFrame
) -> DataFrame:
    """Every pool instance in every planned run; an absent grade is a failure.

    The planned runs are parameters, so the grid is an explode and not a join.
    """
    grid = pool.select("instance_id").distinct().select(
        "instance_id",
        F.inline(F.array(*[F.struct(F.lit(m).alias("model"), F.lit(r).alias("run")) for m, r in runs])),
    )
    found = graded.groupBy("model", "run", "instance_id").agg(F.bool_or("resolved").alias("_resolved"))
    return grid.join(found, ["model", "run", "instance_id"], "left").select(
        "instance_id", "model", "run", F.coalesce("_resolved", F.lit(False)).alias("resolved")
    )


def with_run_config(configs: DataFrame, reports: DataFrame) -> DataFrame:
    """Configurations with their report aggregates; one without a report is marked absent."""
    found = reports.groupBy("tag").agg(
        F.count(F.lit(1)).alias("n_graded"),
        F.avg(F.size("resolved_ids")).alias("pass1_mean"),
        F.avg("completed_instances").alias("mean_completed"),
    )
    return configs.join(found, "tag", "left").withColumn("n_graded", F.coalesce("n_graded", F.lit(0))).withColumn(
        "absent", F.col("n_graded") == 0
    )


def sweep_summary(graded: DataFrame, key: str, pool: int) -> DataFrame:
    """Flat sweep summary: one row per configuration and one row ``*`` for the whole sweep."""
    means, unions = resolved_mean(graded, [key]), passk_count(graded, [key])
    rows = means.join(unions, key).select(
        key, F.col("mean_resolved").alias("pass1_mean"), F.col("union_count").alias("passk_count"), F.col("n_runs").alias("n_graded")
    )
    whole = graded.groupBy("instance_id").agg(F.bool_or("resolved").alias("any")).agg(F.count_if("any").alias("n"))
    total = whole.select(
        F.lit("*").alias(key), F.lit(None).cast("double").alias("pass1_mean"), F.col("n").alias("passk_count"), F.lit(None).cast("bigint").alias("n_graded")
    )
    return rows.unionByName(total).withColumn("eval_pool", F.lit(pool))


def publish_totals(published: DataFrame) -> DataFrame:
    """Rows and resolved per (model, run), and the resolved total of the model so far."""
    runs = published.groupBy("model", "run").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if("resolved").alias("n_resolved")
    )
    upto = Window.partitionBy("model").orderBy("run").rowsBetween(Window.unboundedPreceding, 0)
    return runs.withColumn("resolved_so_far", F.sum("n_resolved").over(upto))


def config_sample(rows: DataFrame, config: str, order: list[str]) -> DataFrame:
    """The first non-null configuration in the given order."""
    return rows.where(F.col(config).isNotNull()).agg(F.min_by(config, F.struct(*order)).alias(config))


def scaling_series(sweep: DataFrame, full: DataFrame, tokens_per_step: int = C.TOKENS_PER_STEP) -> DataFrame:
    """(tokens, pass@1 percent) points of the sweep and the full run."""
    points = sweep.select("max_steps", "pass1_pct").unionByName(full.select("max_steps", "pass1_pct"))
    return points.select((F.col("max_steps").cast("bigint") * tokens_per_step).alias("tokens"), "pass1_pct")


def steps_plan(packs: DataFrame, packs_per_step: int = C.PACKS_PER_STEP, tokens_per_step: int = C.TOKENS_PER_STEP) -> DataFrame:
    """Steps of one epoch and the tokens they cover."""
    return packs.agg(F.count(F.lit(1)).alias("n_packs")).select(
        "n_packs", F.ceil(F.col("n_packs") / packs_per_step).alias("steps")
    ).withColumn("tokens", F.col("steps") * tokens_per_step)

