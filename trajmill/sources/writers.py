"""Writers.  Layouts keep one hot shard or run from becoming one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from trajmill import scratch
from trajmill.operators.spread import broadcast_if_small
from trajmill.sources.readers import path_exists

ROWS_PER_FILE = 1_000_000


def write_jsonl(df: DataFrame, path: str, mode: str = "error") -> None:
    """One JSON object per line, UTF-8 kept as it is."""
    df.write.mode(mode).option("ignoreNullFields", "false").json(path)


def write_tokenized(
    df: DataFrame, path: str, mode: str = "error", spread_by: str | None = None, files_per_shard: int = 1
) -> None:
    """Token columns under one directory per shard.

    With ``spread_by`` (an id column) the rows of a shard are gathered into about that many files,
    instead of one file per task and shard.  Large files are cut by the adaptive planner, so no
    task reads more of a shard than its advisory size.
    """
    rows = df
    if spread_by:
        part = F.pmod(F.xxhash64(spread_by), F.lit(files_per_shard))
        rows = df.withColumn("_part", part).hint("rebalance", "shard", "_part")
    rows.select("shard", "input_ids", "completion_mask", "seq_lengths").write.mode(mode).partitionBy("shard").parquet(path)


def write_published(df: DataFrame, path: str, files_per_run: int = 1, mode: str = "error") -> None:
    """zstd Parquet under ``model=/run=``.

    ``files_per_run`` spreads a large run over that many tasks by instance.
    """
    part = F.pmod(F.xxhash64("instance_id"), F.lit(files_per_run))
    # The count is explicit, so that tasks do not merge runs again after the shuffle.
    tasks = max(1, files_per_run) * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    (
        df.withColumn("_part", part)
        .repartition(tasks, "model", "run", "_part")
        .drop("_part")
        .write.mode(mode)
        .option("compression", "zstd")
        .option("maxRecordsPerFile", ROWS_PER_FILE)
        .partitionBy("model", "run")
        .parquet(path)
    )


def write_merged_predictions(df: DataFrame, path: str, mode: str = "error") -> None:
    """Merged predictions, one row per instance."""
    df.select("instance_id", "model_patch").write.mode(mode).parquet(path)


def merged_document(df: DataFrame) -> DataFrame:
    """The merged map as JSON text, one document per entry at any size; ``read_predictions`` reads them."""
    entry = F.struct(
        F.col("instance_id").alias("key"), F.struct("model_patch", "instance_id").alias("value")
    )
    return df.select(F.to_json(F.map_from_entries(F.array(entry))).alias("value"))


COMMITS = "_commits"


def _content(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows and digest of each shard; the digest does not depend on the order of the rows."""
    rest = [c for c in df.columns if c not in keys]
    # Maps have no hash, their JSON has one.
    parts = [F.to_json(F.struct(c)) if "map<" in df.schema[c].dataType.simpleString() else F.col(c) for c in rest]
    # A null adds nothing to a hash, so its place is hashed too.
    digest = F.xxhash64(*parts, *[F.isnull(c) for c in rest]) if parts else F.lit(0).cast("long")
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"), F.sum(digest.cast("decimal(20,0)")).cast("decimal(38,0)").alias("digest"))


def commits(spark: SparkSession, path: str, keys: list[str]) -> DataFrame | None:
    """The last commit of each shard: the keys, ``n_rows, digest``; None if nothing was committed."""
    if not path_exists(spark, f"{path}/{COMMITS}"):
        return None
    found = spark.read.parquet(f"{path}/{COMMITS}").groupBy(*keys).agg(F.max_by(F.struct("n_rows", "digest"), "committed_us").alias("c"))
    return found.select(*keys, "c.n_rows", "c.digest")


def damaged_shards(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """Committed shards whose files no longer hold what was committed."""
    there = _content(spark.read.parquet(path), keys).withColumnsRenamed({"n_rows": "_rows", "digest": "_digest"})
    same = F.col("n_rows").eqNullSafe(F.col("_rows")) & F.col("digest").eqNullSafe(F.col("_digest"))
    return commits(spark, path, keys).join(there, keys, "left").where(~same).select(*keys)


def finished_keys(df: DataFrame, path: str, keys: list[str], verify: bool = False) -> DataFrame | None:
    """Keys that an earlier attempt has committed, or None if there are none.

    Output without a commit is unfinished, whatever is there: the job may have died while
    writing it.  With ``verify`` a shard also has to hold what its commit says.
    """
    spark = df.sparkSession
    done = commits(spark, path, keys)
    if done is None:
        return None
    done = done.select(*keys)
    return done.join(damaged_shards(spark, path, keys), keys, "left_anti") if verify else done


def pending(df: DataFrame, path: str, keys: list[str], verify: bool = False) -> DataFrame:
    """Rows of shards or runs that have no finished output yet."""
    done = finished_keys(df, path, keys, verify)
    return df if done is None else df.join(done, keys, "left_anti")


def write_pending(df: DataFrame, path: str, keys: list[str], verify: bool = False) -> None:
    """Idempotent write: finished keys are skipped, unfinished ones are replaced.

    Shards are committed after all their files are in place, by a row with the number of rows and a
    digest of what can be read back.
    """
    spark = df.sparkSession
    done = finished_keys(df, path, keys, verify)
    done = None if done is None else scratch.materialize(done, "finished")  # as it was before this write
    rows = df if done is None else df.join(done, keys, "left_anti")
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)
    there = spark.read.schema(df.schema).parquet(path)
    # Only key columns are read to find the new shards, and only those shards are read for their digests.
    new = there.select(*keys).distinct()
    new = new if done is None else new.join(done, keys, "left_anti")
    written = _content(there.join(broadcast_if_small(new), keys, "left_semi"), keys)
    stamped = written.withColumn("committed_us", F.unix_micros(F.current_timestamp()))
    stamped.write.mode("append").parquet(f"{path}/{COMMITS}")
