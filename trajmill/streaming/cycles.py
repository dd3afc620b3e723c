"""Counts per cycle with a watermark: closed cycles leave the state, late rows go to a table.

Two streams, one after the other.  The first splits each batch by the watermark of the batches
before it: rows whose cycle is over are kept as late rows, the others become one count per
cycle and key.  The second adds these counts up in a windowed aggregate in append mode.  Its
watermark follows the same rows and is never ahead of the first one's, so it drops nothing.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from trajmill import constants as C, scratch

_BATCH = "batch"


@dataclass
class Cycles:
    """``closed`` and ``open``: ``cycle_start``, the keys, ``n``; ``late``: rows as they came."""

    closed: DataFrame
    open: DataFrame
    late: DataFrame
    progress: list

    def counted(self) -> DataFrame:
        return self.closed.unionByName(self.open)


def _run(query) -> StreamingQuery:
    started = query.trigger(availableNow=True).start()
    started.awaitTermination()
    return started


def _remove(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def split_late(stream: DataFrame, ts: str, keys: list[str], delay: str, path: str, cycle: str = C.CYCLE) -> None:
    """Append the batches of a stream to ``path``: ``late`` rows, and counts of the others as ``parts``.

    A batch is written by its number and judged by the batches before it, so a repeated batch
    gives the same files.  Rows without a time stamp belong to no cycle and are left out.
    """
    schema = stream.schema
    ends = F.window(ts, cycle)["end"]

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        seen = f"{path}/seen"
        if batch_id:
            before = spark.read.schema(f"newest timestamp, {_BATCH} bigint").parquet(seen).where(F.col(_BATCH) < batch_id)
            newest = before.agg(F.max("newest").alias("newest"))
        else:
            newest = spark.createDataFrame([(None,)], "newest timestamp")
        newest = newest.first()["newest"]
        limit = F.lit(newest).cast("timestamp") - F.expr(f"INTERVAL {delay}")
        rows = batch.where(F.col(ts).isNotNull())
        over = F.coalesce(ends <= limit, F.lit(False))
        rows.where(over).select(*schema.names).write.mode("overwrite").parquet(f"{path}/late/{_BATCH}={batch_id}")
        counts = rows.where(~over).groupBy(F.window(ts, cycle).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"), F.max(ts).alias("ts"))
        counts.select(*keys, "n", "ts").write.mode("overwrite").parquet(f"{path}/parts/{_BATCH}={batch_id}")
        newest_here = spark.read.parquet(f"{path}/parts/{_BATCH}={batch_id}").agg(F.max("ts").alias("newest"))
        newest_here.select(F.greatest("newest", F.lit(newest).cast("timestamp")).alias("newest")).write.mode("overwrite").parquet(f"{seen}/{_BATCH}={batch_id}")
        _remove(spark, f"{seen}/{_BATCH}={batch_id - 2}")  # the batch before may be repeated, none earlier

    _run(stream.writeStream.queryName("split").foreachBatch(write).option("checkpointLocation", f"{path}/split-checkpoint"))


def parts_schema(schema: T.StructType, keys: list[str]) -> T.StructType:
    return T.StructType([*(schema[k] for k in keys), T.StructField("n", T.LongType()), T.StructField("ts", T.TimestampType())])


def windowed_counts(parts: DataFrame, keys: list[str], delay: str, cycle: str = C.CYCLE) -> DataFrame:
    """Counts of closed cycles, each once, from counts of parts of cycles."""
    sums = parts.withWatermark("ts", delay).groupBy(F.window("ts", cycle).alias("w"), *keys).agg(F.sum("n").alias("n"))
    return sums.select(F.col("w.start").alias("cycle_start"), *keys, "n")


def open_cycles(spark: SparkSession, checkpoint: str, keys: list[str]) -> DataFrame:
    """The counts that wait in the state of ``windowed_counts`` for their cycle to close."""
    rows = spark.read.format("statestore").load(checkpoint)
    return rows.select(F.col("key.window.start").alias("cycle_start"), *[F.col(f"key.{k}").alias(k) for k in keys], F.col("value.sum").alias("n"))


def watermarked_cycles(stream: DataFrame, ts: str, keys: list[str], delay: str, path: str | None = None, cycle: str = C.CYCLE) -> Cycles:
    """Process what is there.  With a ``path`` a later call goes on where the last one stopped."""
    spark = stream.sparkSession
    path = path or scratch.new_path(spark, "cycles")
    split_late(stream, ts, keys, delay, path, cycle)
    parts = spark.readStream.schema(parts_schema(stream.schema, keys)).option("recursiveFileLookup", True).parquet(f"{path}/parts")
    counts = windowed_counts(parts, keys, delay, cycle)
    query = _run(counts.writeStream.queryName("cycles").format("parquet").outputMode("append").option("path", f"{path}/closed").option("checkpointLocation", f"{path}/checkpoint"))
    late = spark.read.schema(stream.schema).option("recursiveFileLookup", True).parquet(f"{path}/late")
    closed = spark.read.schema(counts.schema).parquet(f"{path}/closed")
    return Cycles(closed, open_cycles(spark, f"{path}/checkpoint", keys), late, query.recentProgress)
