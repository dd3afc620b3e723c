"""The given tables in the file layouts that the readers take.

Files are written by tasks into the shared folder, each with bounded content: a document
holds one conversation or a fixed block of instances, never everything of a key.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from trajmill import scratch
from trajmill.functions.numbers import whole_div
from trajmill.plans import views as V


def write_documents(df: DataFrame, root: str) -> str:
    """Write each row ``(path, content)`` as one file below ``root``; a repeated task rewrites it.

    A path without a scheme means the default file system, for tasks as for Spark's readers.
    """
    context = df.sparkSession.sparkContext
    target = context._jvm.org.apache.hadoop.fs.Path(root)
    root = target.getFileSystem(context._jsc.hadoopConfiguration()).makeQualified(target).toString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if root.startswith("file:"):
            store, base = fs.LocalFileSystem(), "/" + root.removeprefix("file:").lstrip("/")
        else:
            store, base = fs.FileSystem.from_uri(root)
        made = None
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                target = f"{base}/{path}"
                if os.path.dirname(target) != made:  # files of one folder mostly follow each other
                    store.create_dir(made := os.path.dirname(target), recursive=True)
                with store.open_output_stream(target) as out:
                    out.write(content.encode("utf-8"))
            yield pa.RecordBatch.from_arrays([batch.column("path")], ["path"])

    df.select("path", "content").mapInArrow(run, "path string").write.format("noop").mode("overwrite").save()
    return root


def instance_name(user):
    return F.concat(F.lit("repo"), (user % 7).cast("string"), F.lit("__"), user.cast("string"))


def trajectory_files(spark: SparkSession, sf: str, damage: Callable[[Column], Column] = lambda content: content) -> str:
    """One document per turn of a conversation; odd ones name no instance."""
    turns = V.conversations(spark, sf)
    message = F.array(F.struct("role", F.col("text").alias("content")))
    named = F.when(F.col("turn") % 2 == 0, F.concat(F.col("conv_id"), F.lit("-"), F.col("turn")))
    info = F.when(F.col("conv_id") % 3 != 0, F.struct(F.lit("Submitted").alias("exit_status"), F.col("role").alias("submission")))
    return write_documents(
        turns.select(
            F.format_string("job_%d/%d/%d-%d.traj.json", F.col("conv_id") % 4, "conv_id", "conv_id", "turn").alias("path"),
            damage(F.to_json(F.struct(named.alias("instance_id"), info.alias("info"), message.alias("messages")))).alias("content"),
        ),
        scratch.new_path(spark, "trajectory-files"),
    )


def prediction_files(spark: SparkSession, sf: str) -> str:
    """Blocks of 25 instances and three attempts; every seventh file is damaged."""
    e = V.preds(spark, sf)
    newest = e.groupBy("instance_id", (F.col("event_id") % 3).alias("attempt")).agg(
        F.max_by("model_patch", "event_id").alias("model_patch")
    )
    entry = F.struct(
        F.col("instance_id").cast("string").alias("key"),
        F.struct("model_patch", F.col("instance_id").cast("string").alias("instance_id")).alias("value"),
    )
    files = newest.groupBy(whole_div(F.col("instance_id"), 25).alias("block"), "attempt").agg(
        F.to_json(F.map_from_entries(F.collect_list(entry))).alias("json")
    )
    number = F.col("block") * 3 + F.col("attempt")
    return write_documents(
        files.select(
            F.format_string("job_%d/preds.json", number).alias("path"),
            F.when(number % 7 == 0, F.substring("json", 1, 20)).otherwise(F.col("json")).alias("content"),
        ),
        scratch.new_path(spark, "prediction-files"),
    )


def report_files(spark: SparkSession, sf: str) -> str:
    """Grade reports per (model, run) and block of 500 instances; run 5 of model B is damaged."""
    rows = V.graded(spark, sf).withColumn("block", whole_div(F.substring_index("instance_id", "__", -1).cast("bigint"), 500))
    files = rows.groupBy("model", "run", "block").agg(
        F.count(F.lit(1)).alias("submitted_instances"),
        F.count(F.lit(1)).alias("completed_instances"),
        F.count_if("resolved").alias("resolved_instances"),
        F.sort_array(F.collect_list(F.when(F.col("resolved"), F.col("instance_id")))).alias("ids"),
    )
    # A report of a run that resolved little has no list at all.
    ids = F.when(F.size("ids") > 0, F.col("ids"))
    text = F.to_json(
        F.struct("submitted_instances", "completed_instances", "resolved_instances", ids.alias("resolved_ids"))
    )
    damaged = (F.col("model") == "B") & (F.col("run") == 5)
    return write_documents(
        files.select(
            F.format_string("model%s-pass5-run%d.%d.json", "model", "run", "block").alias("path"),
            F.when(damaged, F.lit("{not json")).otherwise(text).alias("content"),
        ),
        scratch.new_path(spark, "report-files"),
    )


def subset_files(spark: SparkSession, sf: str) -> str:
    """The even users as subset documents of at most 500 instances with their solve counts."""
    solved = V.graded(spark, sf).groupBy("instance_id").agg(F.count_if("resolved").alias("n"))
    members = V.pool(spark, sf).join(solved, "instance_id", "left")
    block = whole_div(F.substring_index("instance_id", "__", -1).cast("bigint"), 500).alias("block")
    pair = F.struct(F.col("instance_id").alias("key"), F.col("n").alias("value"))
    files = members.groupBy(block).agg(
        F.count(F.lit(1)).alias("n_instances"), F.collect_list("instance_id").alias("ids"), F.map_from_entries(F.collect_list(pair)).alias("freq")
    )
    text = F.to_json(F.struct("n_instances", F.col("ids").alias("instance_ids"), "freq"))
    return write_documents(
        files.select(F.format_string("subset-%d.json", "block").alias("path"), text.alias("content")), scratch.new_path(spark, "subset-files")
    )


def slice_files(spark: SparkSession, sf: str) -> str:
    """Submit files of 25-user slices; files of every eighth slice have no slice line."""
    blocks = V.table(spark, sf, "events").select(whole_div(F.col("user_id"), 25).alias("b"), (F.col("event_id") % 3 + 1).alias("run")).distinct()
    line = F.format_string(
        'executable = run.sh\n\nenvironment = "MODEL_DIR=/m JOB_ID=%d START=%d END=%d NUM_WORKERS=5"\n\nqueue\n', "b", F.col("b") * 25, F.col("b") * 25 + 25
    )
    return write_documents(
        blocks.select(
            F.format_string("base-pass3-run%d/job_%d.sub", "run", "b").alias("path"),
            F.when(F.col("b") % 8 == 7, F.lit("queue\n")).otherwise(line).alias("content"),
        ),
        scratch.new_path(spark, "slice-files"),
    )


def write_lines(lines: DataFrame, name: str) -> str:
    path = scratch.new_path(lines.sparkSession, name)
    lines.select("value").write.text(path)
    return path
