"""Whole jobs from files to files, made of the operators.

``spark-submit ... -m trajmill.jobs <job> [arguments]`` or call the functions.
"""

from __future__ import annotations

import argparse
import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from trajmill import constants as C, scratch
from trajmill.functions.text import ENDPOINT_RULE, Rule, home_rules, host_rule, json_line
from trajmill.operators import attempts, curate, grades, ordering, pack, predictions, publish
from trajmill.operators.chat import IM_LAYOUT, ROLE_TOKEN_LAYOUT, Layout
from trajmill.operators.encode import ByteEncoder, Encoder, rank_encoder, tokenize_rows
from trajmill.sources import readers as R, writers as W


def source_rows(spark: SparkSession, path: str, id_col: str | None = None) -> DataFrame:
    """Trajectory rows of a JSON-lines file or a saved dataset with a fixed ``row_id``.

    A source without an id is numbered in file order, whatever the splits of the run.
    """
    rows = R.read_jsonl(spark, path) if path.rstrip("/").endswith(".jsonl") else R.read_saved(spark, path)
    if id_col:
        return rows.withColumnRenamed(id_col, "row_id")
    return R.with_source_position(rows)


def sample(spark: SparkSession, source: str, target: str, rows: int = C.SAMPLE_ROWS, seed: int = C.SHARD_SEED) -> None:
    """A uniform sample of a corpus in shuffled order."""
    found = source_rows(spark, source)
    taken = ordering.sample_rows(found, rows, seed, "row_id")
    W.write_jsonl(ordering.shuffled(taken.drop("shuffle_key"), seed, "row_id").drop("row_id", "shuffle_key"), target)


def verified(spark: SparkSession, source: str, target: str, cap: int = C.MAX_ROWS_PER_KEY) -> DataFrame:
    """Verified rows with a cap per instance; returns the counters."""
    rows = source_rows(spark, source)
    W.write_jsonl(curate.training_columns(curate.cap_per_key(curate.verified_rows(rows), ["row_id"], cap)), target)
    return curate.build_counters(rows, ["row_id"], cap)


def mix(
    spark: SparkSession, source: str, target: str, fraction: tuple[int, int] = C.EXTRA_FRACTION, seed: int = C.MIX_SEED,
    max_size: int = C.MAX_LINE_LENGTH,
) -> DataFrame:
    """Verified rows plus unverified rows of other instances under the budget; returns the report.

    The size of a row is the length of its line, with the line feed.
    """
    rows = source_rows(spark, source)
    line = json_line("instance_id", "messages", "patch", "model", "verified")
    sized = rows.withColumn("n_chars", F.char_length(line) + 1)
    found = curate.mix_under_budget(sized, ["row_id"], "n_chars", fraction, max_size, seed)
    W.write_jsonl(curate.training_columns(found.rows()), target)
    return found.report()


def tokenized(
    rows: DataFrame,
    encoder: Encoder,
    shards: int = 1,
    max_length: int = C.PACK_LENGTH,
    layout: Layout = IM_LAYOUT,
    drop_too_long: bool = False,
    compat: bool = False,
    seed: int = C.SHARD_SEED,
    finished: DataFrame | None = None,
) -> DataFrame:
    """Shuffled, sharded and tokenized rows with ``row_id`` and ``shard``.

    Shards are cut before short conversations are dropped, so every shard may lose rows.
    Shards in ``finished`` are left out before any text is tokenized.
    """
    n = rows.count()
    placed = ordering.seeded_position(rows.select("row_id", "messages"), seed, "row_id", "position")
    sharded = placed.withColumn("shard", ordering.floor_shard(F.col("position"), n, shards))
    if finished is not None:
        sharded = sharded.join(F.broadcast(finished), "shard", "left_anti")  # bounded: one row per shard
    tokens = tokenize_rows(curate.with_min_messages(sharded), encoder, max_length, layout)
    return curate.within_length(tokens, max_length, compat) if drop_too_long else tokens


def packed(tokens: DataFrame, capacity: int, batch_rows: int = C.PACK_BATCH_ROWS) -> DataFrame:
    """Packed rows of tokenized shards.  Batches count the rows of a shard in order."""
    tokens = scratch.materialize(tokens, "tokens")
    lengths = tokens.select("row_id", "shard", "position", F.get("seq_lengths", F.lit(0)).alias("length"))
    dense = ordering.position_by(lengths, ["position"], "at")
    starts = dense.groupBy("shard").agg(F.min("at").alias("first"))
    per_group = batch_rows * pack.BATCHES_PER_GROUP
    stride = -(-max(1, lengths.count()) // per_group) * per_group
    # Shards start at multiples of the stride, so that no batch holds rows of two shards.
    spaced = dense.join(F.broadcast(starts), "shard").withColumn(  # bounded: one row per shard
        "at", F.col("shard").cast("bigint") * stride + F.col("at") - F.col("first")
    )
    plan = pack.plan_packs(spaced, "row_id", "length", "at", capacity, batch_rows)
    packs = pack.build_packs(tokens, plan, "row_id", capacity)
    per_shard = stride // batch_rows
    return packs.withColumn("shard", F.floor(F.shiftright("pack_id", 20) / per_shard).cast("int"))


def tokenize(
    spark: SparkSession, source: str, target: str, encoder: Encoder, shards: int = 1, pack_rows: bool = False,
    max_length: int = C.PACK_LENGTH, **options: object,
) -> None:
    """Tokenize a corpus once, for all shards; finished shards are left alone."""
    rows = source_rows(spark, source)
    finished = W.finished_keys(rows, target, ["shard"])
    tokens = tokenized(rows, encoder, shards, max_length, finished=finished, **options)
    rows = packed(tokens, max_length) if pack_rows else tokens
    W.write_pending(rows.select("shard", "input_ids", "completion_mask", "seq_lengths"), target, ["shard"])


def training_rows(spark: SparkSession, path: str, fraction: tuple[int, int] = (1, 1), seed: int | None = None) -> DataFrame:
    """Rows for training: a prefix of all shards in order, then shuffled."""
    rows = R.with_source_position(R.read_shards(spark, path))
    part = ordering.prefix_rows(rows, fraction, "row_id") if fraction != (1, 1) else rows
    return part if seed is None else ordering.shuffled(part, seed, "row_id")


def merge(spark: SparkSession, base: str, target: str) -> None:
    """Latest valid prediction per instance over all prediction files of a run."""
    rows = R.read_predictions(spark, f"{base}/*/preds.json")
    W.write_merged_predictions(
        predictions.latest_valid(rows, ["instance_id"], ["mtime", "path"], ["model_patch"]), target, mode="overwrite"
    )


def sweep(spark: SparkSession, reports: str, configs: DataFrame) -> dict[str, DataFrame]:
    """Summary, frequencies and repository table of a sweep.

    ``configs`` has ``label`` and ``tag``; its labels are the rows of the tables.
    """
    found = R.read_reports(spark, reports)
    resolved = grades.long_form(found.join(configs.select("label", "tag"), "tag"), ["label", "run"])
    solved = resolved.withColumn("resolved", F.lit(True))
    return {
        "summary": grades.with_run_config(configs, found),
        "union": grades.passk_count(solved, ["label"]),
        "frequency": grades.solve_frequency(solved),
        "repositories": grades.repo_breakdown(solved, ["label"], configs.select("label")),
    }


def publish_runs(
    spark: SparkSession, runs: Sequence[tuple[str, int, str, str]], target: str, rules: Sequence[Rule], files_per_run: int = 1
) -> DataFrame:
    """Publish ``(model, run, trajectory directory, report)`` runs; returns the totals."""
    parts = []
    for model, run, folder, report in runs:
        rows = R.read_trajectory_files(spark, folder).withColumns({"model": F.lit(model), "run": F.lit(run)})
        found = R.read_reports(spark, report).select(
            F.lit(model).alias("model"), F.lit(run).alias("run"), "resolved_ids"
        )
        parts.append(publish.published_rows(rows, grades.long_form(found, ["model", "run"]), rules))
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    W.write_published(whole, target, files_per_run)
    return grades.publish_totals(spark.read.parquet(target))


def watch(
    spark: SparkSession, slices: str, queue: str, recorded: DataFrame, trajectories: DataFrame, logs: str, resubmits: DataFrame
) -> DataFrame:
    """One monitoring cycle: the decision for every slice.

    ``recorded``: run, job_id, cluster.  ``trajectories``: run, cluster, instance_id.
    ``resubmits``: run, job_id, resubmits.  Nothing is submitted or removed.
    """
    specs = R.read_slice_specs(spark, slices).select("run", "job_id", "expected")
    counted = specs.join(resubmits, ["run", "job_id"], "left").na.fill(0, ["resubmits"])
    active = R.read_active_jobs(spark, queue).select("run", "job_id", "cluster", "status")
    seen = recorded.select("run", "job_id", "cluster").unionByName(active.select("run", "job_id", "cluster")).distinct()
    done = attempts.coverage(trajectories, ["run", "cluster"]).select("run", "cluster", F.col("n_files").alias("coverage"))
    elapsed = attempts.attempt_elapsed(R.read_job_logs(spark, logs), ["cluster"])
    return attempts.classify(attempts.work_status(counted, active, seen, done, elapsed))


def main(arguments: Sequence[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="trajmill.jobs")
    jobs = parser.add_subparsers(dest="job", required=True)
    for name in ("sample", "verified", "mix", "tokenize"):
        job = jobs.add_parser(name)
        job.add_argument("source")
        job.add_argument("target")
    jobs.choices["sample"].add_argument("--rows", type=int, default=C.SAMPLE_ROWS)
    jobs.choices["sample"].add_argument("--seed", type=int, default=C.SHARD_SEED)
    jobs.choices["verified"].add_argument("--cap", type=int, default=C.MAX_ROWS_PER_KEY)
    jobs.choices["mix"].add_argument("--percent", type=int, default=40)
    job = jobs.choices["tokenize"]
    job.add_argument("--vocab", help="rank table; without it tokens are bytes")
    job.add_argument("--shards", type=int, default=1)
    job.add_argument("--max-length", type=int, default=C.PACK_LENGTH)
    job.add_argument("--pack", action="store_true")
    job.add_argument("--drop-too-long", action="store_true")
    job.add_argument("--role-tokens", action="store_true", help="one token per role instead of marked turns")
    job = jobs.add_parser("merge")
    job.add_argument("base")
    job.add_argument("target")
    job = jobs.add_parser("publish")
    job.add_argument("runs", help="JSON file: [[model, run, trajectory directory, report], ...]")
    job.add_argument("target")
    job.add_argument("--user", help="hide the home directories of this user")
    job.add_argument("--host", help="hide this host name")
    args = parser.parse_args(arguments)

    spark = SparkSession.builder.appName(f"trajmill-{args.job}").getOrCreate()
    with scratch.cleaned(spark):
        run(spark, args)


def run(spark: SparkSession, args: argparse.Namespace) -> None:
    if args.job == "sample":
        sample(spark, args.source, args.target, args.rows, args.seed)
    elif args.job == "verified":
        verified(spark, args.source, args.target, args.cap).show()
    elif args.job == "mix":
        mix(spark, args.source, args.target, (args.percent, 100)).show()
    elif args.job == "tokenize":
        encoder = rank_encoder(R.read_vocab(spark, args.vocab)) if args.vocab else ByteEncoder()
        tokenize(
            spark, args.source, args.target, encoder, args.shards, args.pack, args.max_length,
            layout=ROLE_TOKEN_LAYOUT if args.role_tokens else IM_LAYOUT, drop_too_long=args.drop_too_long,
        )
    elif args.job == "merge":
        merge(spark, args.base, args.target)
    elif args.job == "publish":
        with open(args.runs, encoding="utf-8") as found:
            runs = [tuple(r) for r in json.load(found)]
        rules = [*(home_rules(args.user) if args.user else []), *([host_rule(args.host)] if args.host else []), ENDPOINT_RULE]
        publish_runs(spark, runs, args.target, rules).show()


if __name__ == "__main__":
    main()
