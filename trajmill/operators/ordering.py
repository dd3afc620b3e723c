"""Order without a single task: seeded order, budget cuts, row positions, samples, shards.

The seeded order sorts by ``md5(seed:id)``.  Its first hex digits split the rows into
equal buckets that are a property of the row, so a recomputed task finds the same
buckets again.  Questions of the form "which rows come before the running total reaches
X" need per-bucket totals plus one look into the one bucket where X falls.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from trajmill import scratch
from trajmill.functions.numbers import whole_div

BUCKET_DIGITS = 3  # 4096 buckets
EDGE_ROWS = 100_000


def seed_hash(seed: int, row_id: Column | str) -> Column:
    row_id = F.col(row_id) if isinstance(row_id, str) else row_id
    return F.md5(F.concat(F.lit(f"{seed}:"), row_id.cast("string")).cast("binary"))


def _bucket(hash_col: Column, digits: int) -> Column:
    return F.substring(hash_col, 1, digits)


def bucket_offsets(df: DataFrame, value: Column, hash_col: str, digits: int = BUCKET_DIGITS) -> DataFrame:
    """Total per bucket and total of all earlier buckets.

    At most ``16**digits`` rows, or that many of the last digits if all rows share a prefix.
    """
    totals = df.groupBy(_bucket(F.col(hash_col), digits).alias("bucket")).agg(
        F.sum(value).cast("bigint").alias("total"), F.count(F.lit(1)).alias("n_rows")
    )
    # The window input is already aggregated, so its size is bounded by the digits.
    earlier = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    return totals.withColumn("before", F.coalesce(F.sum("total").over(earlier), F.lit(0)))


@dataclass(frozen=True)
class Cut:
    """The row at which a running total reaches its limit."""

    hash: str | None = None
    row_id: object = None
    keeps: str = "cut"  # or "all" / "none"

    def covers(self, hash_col: str, id_col: str) -> Column:
        """True for rows up to and including the crossing row."""
        if self.keeps != "cut":
            return F.lit(self.keeps == "all")
        row = F.struct(F.col(hash_col).alias("h"), F.col(id_col).alias("i"))
        return row <= F.struct(F.lit(self.hash).alias("h"), F.lit(self.row_id).alias("i"))


def find_cut(
    df: DataFrame,
    value: Column,
    limit: int,
    hash_col: str,
    id_col: str,
    digits: int = BUCKET_DIGITS,
    edge_rows: int = EDGE_ROWS,
) -> Cut:
    """First row in seeded order whose inclusive running total of ``value`` reaches ``limit``.

    Narrow passes: totals per bucket, again inside the bucket where the limit falls until
    it holds few rows, then a look at those rows.  Only scalars come back to the driver.
    """
    if limit <= 0:
        return Cut(keeps="none")
    prefix, before = "", 0
    inside = df
    while len(prefix) < 32:
        offsets = bucket_offsets(inside, value, hash_col, len(prefix) + digits)
        edge = (
            offsets.where((F.col("before") + before < limit) & (F.col("before") + before + F.col("total") >= limit))
            .agg(F.min_by(F.struct("bucket", "before", "n_rows"), "bucket").alias("edge"))
            .first()["edge"]
        )
        if edge is None:
            return Cut(keeps="all")
        prefix, before = edge["bucket"], before + edge["before"]
        inside = df.where(F.startswith(hash_col, F.lit(prefix)))
        if edge["n_rows"] <= edge_rows:
            break
    running = Window.orderBy(hash_col, id_col).rowsBetween(Window.unboundedPreceding, 0)
    at = (
        inside.select(hash_col, id_col, value.alias("_value"))
        .withColumn("_sum", F.sum("_value").over(running) + before)
        .where(F.col("_sum") >= limit)
        .agg(F.min(F.struct(hash_col, id_col)).alias("at"))
        .first()["at"]
    )
    return Cut(hash=at[hash_col], row_id=at[id_col])


def sample_rows(df: DataFrame, n: int, seed: int, id_col: str, order_col: str = "shuffle_key") -> DataFrame:
    """Uniform sample of exactly ``min(n, rows)`` rows; ``order_col`` gives their shuffled order.

    The input is scanned twice, at any size.  The first scan counts the rows per bucket of the
    seeded order, which brackets the last row of the sample by one bucket.  The second writes
    the rows up to that bucket; what is too many is found among those.  No sort and no
    shuffle of the payload.
    """
    keyed = df.withColumn(order_col, seed_hash(seed, id_col))
    counts = bucket_offsets(keyed.select(order_col), F.lit(1), order_col)
    edge = counts.where(F.col("before") < n).agg(F.max("bucket").alias("bucket"), F.max(F.col("before") + F.col("total")).alias("rows")).first()
    if edge["bucket"] is None:
        return keyed.where(F.lit(False))
    rows = scratch.materialize(keyed.where(_bucket(F.col(order_col), BUCKET_DIGITS) <= edge["bucket"]), "sample")
    if edge["rows"] <= n:
        return rows
    cut = find_cut(rows.select(order_col, id_col), F.lit(1), n, order_col, id_col)
    return rows.where(cut.covers(order_col, id_col))


def seeded_position(df: DataFrame, seed: int, id_col: str, position: str, digits: int = BUCKET_DIGITS) -> DataFrame:
    """Dense 0-based position in seeded order, one shuffle of the rows by bucket."""
    keyed = df.withColumn("_hash", seed_hash(seed, id_col)).withColumn("_bucket", _bucket(F.col("_hash"), digits))
    offsets = bucket_offsets(
        df.select(seed_hash(seed, id_col).alias("_hash")), F.lit(1), "_hash", digits
    ).select(F.col("bucket").alias("_bucket"), F.col("before").alias("_before"))
    inside = Window.partitionBy("_bucket").orderBy("_hash", id_col)
    return (
        keyed.withColumn("_rank", F.row_number().over(inside))
        .join(F.broadcast(offsets), "_bucket")  # bounded: 16**digits rows
        .withColumn(position, F.col("_before") + F.col("_rank") - 1)
        .drop("_hash", "_bucket", "_before", "_rank")
    )


def position_by(df: DataFrame, order: list[str], position: str, partitions: int | None = None) -> DataFrame:
    """Dense 0-based position in the order of the given columns, which must identify a row.

    Rows are range-partitioned and sorted once and written; the written row numbers fix
    partition and place, so reading them again cannot move a boundary.
    """
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = scratch.materialize(
        df.repartitionByRange(n, *order)
        .sortWithinPartitions(*order)
        .withColumn("_at", F.monotonically_increasing_id()),
        "positions",
    )
    part, place = F.shiftright("_at", 33), F.col("_at").bitwiseAND((1 << 33) - 1)
    counts = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_rows"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_part", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_before"))
    return (
        placed.withColumn("_part", part)
        .join(F.broadcast(offsets), "_part")  # bounded: one row per written partition
        .withColumn(position, F.col("_before") + place)
        .drop("_at", "_part", "_before")
    )


def shuffled(df: DataFrame, seed: int, id_col: str, partitions: int | None = None) -> DataFrame:
    """Globally shuffled rows, ready to be written: sorted ranges of the seeded order."""
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = df.withColumn("shuffle_key", seed_hash(seed, id_col))
    return keyed.repartitionByRange(n, "shuffle_key", id_col).sortWithinPartitions("shuffle_key", id_col)


def id_cut(df: DataFrame, n: int, id_col: str, fanout: int = 4096, edge_rows: int = EDGE_ROWS):
    """The n-th smallest value of a unique whole-number column, or None if there are fewer rows.

    Each pass counts equal slices of the id interval and continues in the slice that holds
    the n-th row, so gaps and dense stretches in the ids only cost passes, never one big task.
    """
    if n <= 0:
        return None
    bounds = df.agg(F.min(id_col).alias("lo"), F.max(id_col).alias("hi"), F.count(id_col).alias("n")).first()
    if bounds["n"] < n:
        return None
    low, high, rows, skipped = bounds["lo"], bounds["hi"], bounds["n"], 0
    while rows > edge_rows and high > low:
        width = max(1, math.ceil((high - low + 1) / fanout))
        inside = df.where(F.col(id_col).between(low, high))
        counts = inside.groupBy(whole_div(F.col(id_col) - low, width).alias("slot")).agg(F.count(F.lit(1)).alias("rows"))
        earlier = Window.orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)  # at most fanout rows
        hit = (
            counts.withColumn("before", F.coalesce(F.sum("rows").over(earlier), F.lit(0)) + skipped)
            .where((F.col("before") < n) & (F.col("before") + F.col("rows") >= n))
            .first()
        )
        low, high = low + hit["slot"] * width, min(high, low + (hit["slot"] + 1) * width - 1)
        rows, skipped = hit["rows"], hit["before"]
    rank = Window.orderBy(id_col)
    return (
        df.where(F.col(id_col).between(low, high))
        .select(id_col, F.row_number().over(rank).alias("_rank"))
        .where(F.col("_rank") == n - skipped)
        .first()[id_col]
    )


def prefix_rows(df: DataFrame, fraction: tuple[int, int], id_col: str) -> DataFrame:
    """The first ``floor(rows * num / den)`` rows by id; a larger fraction contains a smaller one."""
    num, den = fraction
    n = df.select(F.count(F.lit(1)).alias("n")).first()["n"] * num // den
    if n <= 0:
        return df.where(F.lit(False))
    last = id_cut(df.select(id_col), n, id_col)
    return df.where(F.col(id_col) <= last)


def floor_shard(position: Column, rows: Column | int, jobs: int) -> Column:
    """Shards of ``rows // jobs``; the last one takes the rest, and all rows if there are too few."""
    rows = F.lit(rows) if isinstance(rows, int) else rows
    per_job = whole_div(rows.cast("bigint"), jobs)
    return F.when(per_job == 0, F.lit(jobs - 1)).otherwise(
        F.least(whole_div(position.cast("bigint"), F.greatest(per_job, F.lit(1))), F.lit(jobs - 1))
    ).cast("int")


def ceil_shard(position: Column, rows: int, jobs: int) -> Column:
    """Slices of ``ceil(rows / jobs)``; the last one is short and empty ones do not occur."""
    return whole_div(position.cast("bigint"), max(1, -(-rows // jobs))).cast("int")


def ceil_slices(df: DataFrame, rows: int, jobs: int) -> DataFrame:
    """The slice table ``job_id, start, end`` for a pool of known size."""
    per_job = max(1, -(-rows // jobs))
    spark = df.sparkSession
    return (
        spark.range(jobs)
        .select(
            F.col("id").cast("int").alias("job_id"),
            (F.col("id") * per_job).alias("start"),
            F.least((F.col("id") + 1) * per_job, F.lit(rows)).alias("end"),
        )
        .where(F.col("start") < F.col("end"))
    )
