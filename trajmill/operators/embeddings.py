"""Rows of an embedding matrix."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, functions as F

from trajmill.functions.arrays import l2_norm, norm_state
from trajmill.functions.numbers import to_bf16


def mean_vector(df: DataFrame, vector: str) -> DataFrame:
    """Element-wise mean as one row ``mean`` (array of doubles); no row without vectors.

    The aggregate buffer is a vector: a task adds its rows to it and sends it once.  The
    vectors have one length.  A null vector counts nowhere, a null entry not in its dimension,
    and a dimension without any entry has no mean.
    """
    values = F.transform(vector, lambda x: F.coalesce(x.cast("double"), F.lit(0.0)))
    there = F.transform(vector, lambda x: x.isNotNull().cast("double"))
    sums = df.where(F.col(vector).isNotNull()).select(array_to_vector(F.concat(values, there)).alias("v"))
    # Grouped by a constant, so that no rows give no group.
    both = sums.groupBy(F.lit("all")).agg(vector_to_array(Summarizer.mean(F.col("v"))).alias("m"))
    n = (F.size("m") / 2).cast("int")
    of_entries = F.zip_with(F.slice("m", F.lit(1), n), F.slice("m", n + 1, n), lambda a, b: F.when(b > 0, a / b))
    return both.select(of_entries.alias("mean"))


def centroid(df: DataFrame, vector: str) -> DataFrame:
    """Element-wise mean as ``pos, mean``."""
    return mean_vector(df, vector).select(F.posexplode("mean").alias("pos", "mean"))


def centroid_row(df: DataFrame, vector: str, bf16: bool = False) -> DataFrame:
    """The same as one vector of floats, if asked for rounded to bfloat16 as new rows of a bf16 matrix are."""
    mean = F.transform("mean", lambda x: to_bf16(x) if bf16 else x.cast("float"))
    return mean_vector(df, vector).select(mean.alias("centroid"))


def norm_audit(df: DataFrame, vector: str, gain: Column) -> DataFrame:
    """Norm, gain-scaled norm and state of each row."""
    return df.withColumn("norm", l2_norm(F.col(vector))).withColumn("scaled", F.col("norm") * gain).withColumn(
        "state", norm_state(F.col("scaled"))
    )
