"""Readers with explicit schemas.  Each returns a lazy DataFrame."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from trajmill import constants as C, schemas, scratch
from trajmill.functions.numbers import log_time
from trajmill.operators.spread import broadcast_if_small


def _decoded(name: Column) -> Column:
    """File metadata is percent-encoded except for the plus sign."""
    return F.url_decode(F.replace(name, F.lit("+"), F.lit("%2B")))


def read_jsonl(spark: SparkSession, path: str, schema: str = schemas.TRAJECTORY) -> DataFrame:
    """Trajectory rows, one JSON object per line."""
    return spark.read.schema(schema).json(path)


def read_chat_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """Chat rows whose assistant messages may call tools, as ``{function: {..}}`` or flat.

    Arguments that are JSON objects keep their text.
    """
    rows = spark.read.schema(f"instance_id string, messages {schemas.RAW_TOOL_MESSAGES}").json(path)
    return rows.withColumn(
        "messages",
        F.transform(
            "messages",
            lambda m: F.struct(
                m["role"].alias("role"),
                m["content"].alias("content"),
                F.transform(
                    m["tool_calls"],
                    lambda c: F.struct(
                        F.coalesce(c["function"]["name"], c["name"]).alias("name"),
                        F.coalesce(c["function"]["arguments"], c["arguments"]).alias("arguments"),
                    ),
                ).alias("tool_calls"),
            ),
        ),
    )


def with_source_position(df: DataFrame, name: str = "row_id") -> DataFrame:
    """Number the rows of a scan by file path and place in the file, from 0 without gaps.

    The numbers depend on the files alone, not on how a run splits them.  Rows are written once
    with their split; a table with one row per split then says how many rows lie before it.
    """
    place = F.struct("_metadata.file_path", "_metadata.file_block_start")
    placed = scratch.materialize(df.select("*", place.alias("_split"), F.monotonically_increasing_id().alias("_at")), "source")
    splits = placed.groupBy("_split").agg(F.count(F.lit(1)).alias("_rows"), F.min("_at").alias("_first"))
    earlier = Window.orderBy("_split").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.select("_split", "_first", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_before"))
    numbered = placed.join(broadcast_if_small(splits), "_split")
    return numbered.withColumn(name, F.col("_before") + F.col("_at") - F.col("_first")).drop("_split", "_at", "_first", "_before")


def path_exists(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


@contextmanager
def listing_tasks(spark: SparkSession, per_core: int = 4) -> Iterator[None]:
    """Folders are listed by so many tasks a core inside; by itself Spark starts a task for nearly every folder."""
    name = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(int(before), per_core * spark.sparkContext.defaultParallelism)))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def read_saved(spark: SparkSession, path: str, split: str = "train") -> DataFrame:
    """A saved columnar dataset; its train split if it has splits."""
    inner = f"{path.rstrip('/')}/{split}"
    return spark.read.parquet(inner if path_exists(spark, inner) else path)


def read_shards(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """A tokenized dataset: one directory, or one directory per shard.

    Shard directories named ``shard=<n>`` become a partition column; others are read together.
    """
    found = spark.read.option("recursiveFileLookup", "false").parquet(path)
    return found.select(*columns) if columns else found


def read_shard_dirs(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Bag concatenation of datasets with the same columns, in one scan."""
    return spark.read.parquet(*paths)


def read_trajectory_files(spark: SparkSession, root: str, pattern: str = "*.traj.json") -> DataFrame:
    """Every trajectory document below a directory, with ``file`` for ordering.

    A missing id is the file name without its extension; missing parts become empty.
    """
    reader = spark.read.schema(schemas.TRAJECTORY_FILE).option("multiLine", True).option("recursiveFileLookup", True)
    with listing_tasks(spark):
        raw = reader.option("pathGlobFilter", pattern).json(root)
    stem = F.regexp_replace(F.regexp_replace("_metadata.file_name", r"\.json$", ""), r"\.traj$", "")
    no_messages = F.array().cast(schemas.MESSAGES)
    return raw.select(
        F.coalesce(F.when(F.col("instance_id") != "", F.col("instance_id")), _decoded(stem)).alias("instance_id"),
        F.coalesce("info.exit_status", F.lit("")).alias("exit_status"),
        F.coalesce("info.submission", F.lit("")).alias("submission"),
        F.col("info.config").alias("config"),
        F.transform(
            F.coalesce("messages", no_messages),
            lambda m: F.struct(
                F.coalesce(m["role"], F.lit("")).alias("role"), F.coalesce(m["content"], F.lit("")).alias("content")
            ),
        ).alias("messages"),
        F.col("_metadata.file_path").alias("file"),
    )


def read_predictions(spark: SparkSession, glob: str) -> DataFrame:
    """One row per (file, instance).  Files that are not valid JSON drop out."""
    files = spark.read.option("wholetext", True).text(glob).select(
        F.from_json("value", schemas.PREDICTIONS).alias("preds"),
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_modification_time").alias("mtime"),
    )
    return files.select("path", "mtime", F.explode("preds").alias("instance_id", "rec")).select(
        "path", "mtime", "instance_id", F.coalesce("rec.model_patch", F.lit("")).alias("model_patch")
    )


def read_reports(spark: SparkSession, glob: str) -> DataFrame:
    """Grade reports with ``tag`` and ``run`` from the file name ``<tag>-run<n>...json``.

    Unreadable files are left out; missing counts are 0 and missing ids an empty list.
    """
    raw = (
        spark.read.schema(f"{schemas.REPORT}, _bad string")
        .option("multiLine", True)
        .option("columnNameOfCorruptRecord", "_bad")
        .json(glob)
        .where(F.col("_bad").isNull())
    )
    name = F.col("_metadata.file_name")
    return raw.select(
        F.regexp_extract(name, r"^(.*)-run\d+", 1).alias("tag"),
        F.regexp_extract(name, r"-run(\d+)", 1).cast("int").alias("run"),
        *[F.coalesce(c, F.lit(0)).alias(c) for c in schemas.REPORT_COUNTS],
        F.coalesce("resolved_ids", F.array().cast("array<string>")).alias("resolved_ids"),
    )


def read_subset(spark: SparkSession, path: str) -> DataFrame:
    """Instances of an evaluation subset with the pool size and their frequency."""
    doc = spark.read.schema(schemas.SUBSET).option("multiLine", True).json(path)
    return doc.select("n_instances", "freq", F.explode("instance_ids").alias("instance_id")).select(
        "instance_id", "n_instances", F.coalesce(F.try_element_at("freq", F.col("instance_id")), F.lit(0)).alias("freq")
    )


def parse_slice_specs(lines: DataFrame, keep: list[str]) -> DataFrame:
    """``job_id, start, end_at, expected`` from submit-file lines; other lines drop out."""
    part = [F.try_to_number(F.regexp_extract("value", C.SLICE_PATTERN, i), F.lit("999999999999")).cast("bigint") for i in (1, 2, 3)]
    return (
        lines.where(F.col("value").rlike(C.SLICE_PATTERN))
        .select(*keep, part[0].cast("int").alias("job_id"), part[1].alias("start"), part[2].alias("end_at"))
        .withColumn("expected", F.col("end_at") - F.col("start"))
    )


def read_slice_specs(spark: SparkSession, glob: str) -> DataFrame:
    """Slice specs of all runs; ``run`` is the name of the directory of the submit file."""
    folder = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/[^/]+$", 1)
    return parse_slice_specs(spark.read.text(glob).withColumn("run", _decoded(folder)), ["run"])


def parse_job_log(lines: DataFrame, keep: list[str]) -> DataFrame:
    """``code, job, ts`` of event lines; all other lines are ignored."""
    pick = [F.regexp_extract("value", C.LOG_LINE_PATTERN, i) for i in (1, 2, 3)]
    return lines.where(F.col("value").rlike(C.LOG_LINE_PATTERN)).select(
        *keep, pick[0].alias("code"), pick[1].alias("job"), log_time(pick[2]).alias("ts")
    )


def read_job_logs(spark: SparkSession, glob: str) -> DataFrame:
    """Event lines of all logs with ``cluster`` and a ``line_no`` that grows along a file."""
    lines = spark.read.text(glob).select(
        "value",
        F.regexp_extract(F.col("_metadata.file_name"), r"(\d+)\.log$", 1).cast("bigint").alias("cluster"),
        F.struct(
            F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line")
        ).alias("line_no"),
    )
    return parse_job_log(lines, ["cluster", "line_no"])


def parse_active_jobs(lines: DataFrame) -> DataFrame:
    """``cluster, status, run_dir, run, job_id`` from a captured queue listing."""
    number = lambda pattern, group: F.regexp_extract("value", pattern, group)
    return lines.where(
        F.col("value").rlike(C.QUEUE_HEAD_PATTERN)
        & F.col("value").rlike(C.QUEUE_RUN_PATTERN)
        & F.col("value").rlike(C.QUEUE_JOB_PATTERN)
    ).select(
        number(C.QUEUE_HEAD_PATTERN, 1).cast("bigint").alias("cluster"),
        number(C.QUEUE_HEAD_PATTERN, 2).cast("int").alias("status"),
        number(C.QUEUE_RUN_PATTERN, 1).alias("run_dir"),
        F.substring_index(number(C.QUEUE_RUN_PATTERN, 1), "/", -1).alias("run"),
        number(C.QUEUE_JOB_PATTERN, 1).cast("int").alias("job_id"),
    )


def read_active_jobs(spark: SparkSession, path: str) -> DataFrame:
    return parse_active_jobs(spark.read.text(path))


def read_vocab(spark: SparkSession, path: str, limit: int = C.VOCAB_RANK_LIMIT) -> DataFrame:
    """``token binary, rank int`` from lines of exactly two fields with a small enough rank."""
    fields = F.split(F.rtrim(F.ltrim("value")), r"\s+")
    return (
        spark.read.text(path)
        .select(fields.alias("f"))
        .where(F.size("f") == 2)
        .select(F.unbase64(F.get("f", F.lit(0))).alias("token"), F.get("f", F.lit(1)).try_cast("int").alias("rank"))
        .where(F.col("rank") < limit)
    )
