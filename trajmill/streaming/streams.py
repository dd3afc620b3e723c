"""Continuous forms of the ingest, coverage, cycle, attempt and prediction queries.

Aggregations are built-in streaming aggregates with partial aggregation before the state
store; decisions are stateless expressions over their result.  Results go to keyed tables in
the shared folder, which take a batch once and keep their files few.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from trajmill import constants as C, scratch
from trajmill.functions.numbers import elapsed_seconds
from trajmill.operators.attempts import outcome
from trajmill.operators.predictions import latest_valid
from trajmill.streaming.keyed_table import KeyedTable, upsert_stream


def read_files(
    spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet", pattern: str | None = None, **options: object
) -> DataFrame:
    """A stream of files as they land."""
    reader = spark.readStream.format(fmt).schema(schema).options(**{k: str(v) for k, v in options.items()})
    return (reader.option("pathGlobFilter", pattern) if pattern else reader).load(path)


def read_table(spark: SparkSession, path: str, schema: T.StructType, **options: object) -> DataFrame:
    """A stream of a table that is one file or a folder of files."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(target).isDirectory():
        return read_files(spark, path, schema, **options)
    folder, name = path.rstrip("/").rsplit("/", 1)  # a stream takes folders only
    return read_files(spark, folder, schema, pattern=name, **options)


def append_to_table(stream: DataFrame, name: str, path: str | None = None, partition_by: list[str] | None = None) -> DataFrame:
    """Process what is there and return the appended table (exactly-once file sink).

    With a ``path`` a later call goes on where the last one stopped.
    """
    spark = stream.sparkSession
    path = path or scratch.new_path(spark, name)
    writer = stream.writeStream.partitionBy(*partition_by) if partition_by else stream.writeStream
    query = (
        writer.queryName(name)
        .format("parquet")
        .option("checkpointLocation", f"{path}-checkpoint")
        .outputMode("append")
        .trigger(availableNow=True)
        .start(path)
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def upsert_to_table(stream: DataFrame, keys: list[str], name: str, path: str | None = None) -> DataFrame:
    """Process what is there and return the newest row per key of an update-mode stream.

    With a ``path`` a later call goes on where the last one stopped.
    """
    spark = stream.sparkSession
    table = KeyedTable(spark, path or scratch.new_path(spark, name), stream.schema, keys)
    return upsert_stream(stream, table, name)


def distinct_coverage(trajectories: DataFrame) -> DataFrame:
    """Each (run, instance) with its number of files; the distinct pairs are the coverage.

    An aggregate instead of a deduplication, so that repeats collapse before the shuffle.
    """
    return trajectories.groupBy("run", "instance_id").agg(F.count(F.lit(1)).alias("n_files"))


def cycle_counts(events: DataFrame, ts: str, keys: list[str], cycle: str = C.CYCLE, late: str | None = None) -> DataFrame:
    """Counts per cycle.

    Without ``late`` every event counts, however late its file lands; the state holds one
    row per cycle and key.  With ``late`` older cycles leave the state and later events of
    theirs are dropped.
    """
    timed = events.withWatermark(ts, late) if late else events
    return (
        timed.groupBy(F.window(ts, cycle).alias("w"), *keys)
        .agg(F.count(F.lit(1)).alias("n"))
        .select(F.col("w.start").alias("cycle_start"), *keys, "n")
    )


def attempt_states(events: DataFrame, keys: list[str], order: str, finished: Column) -> DataFrame:
    """Running start, end and finished instances per attempt."""
    started = F.when(F.col("code") == C.EXECUTING_CODE, F.col(order))
    return events.groupBy(*keys).agg(
        F.min_by("ts", started).alias("started_at"),
        F.max_by("ts", order).alias("last_at"),
        F.count_if(finished).alias("coverage"),
    )


def attempt_decisions(
    states: DataFrame, keys: list[str], expected: Column, resubmits: Column, active: DataFrame | None = None, **limits: int
) -> DataFrame:
    """The decision after each update.  Attempts in ``active`` (the listing of the batch, by key) are in flight."""
    running = F.lit(False)
    if active is not None:
        states = states.join(active.select(*keys).distinct().withColumn("_running", F.lit(True)), keys, "left")
        running = F.col("_running").isNotNull()
    spent = F.when(F.col("started_at").isNull(), F.lit(0)).otherwise(elapsed_seconds(F.col("started_at"), F.col("last_at")))
    return states.select(
        *keys,
        F.col("coverage").cast("bigint").alias("coverage"),
        spent.cast("bigint").alias("elapsed"),
        outcome(running, F.col("coverage"), expected, spent, resubmits, **limits).alias("outcome"),
    )


def latest_predictions(stream: DataFrame, keys: list[str], newest: list[str], keep: list[str]) -> DataFrame:
    """Running latest valid prediction per key."""
    return latest_valid(stream, keys, newest, keep)

