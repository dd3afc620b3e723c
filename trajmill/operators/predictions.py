"""Merging prediction files."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from trajmill import constants as C


def valid_predictions(df: DataFrame) -> DataFrame:
    """A missing patch is not valid; the bare prefix test reaches the scan."""
    return df.where(F.col("model_patch").startswith(C.PATCH_PREFIX))


def latest_valid(df: DataFrame, keys: list[str], newest: list[str], keep: list[str]) -> DataFrame:
    """Per key the prediction of the newest file among the valid ones.

    An aggregate, so that each map task reduces a hot key to one row.  A newer empty patch
    does not hide an older valid one.  The last column of ``newest`` breaks ties.
    """
    best = valid_predictions(df).groupBy(*keys).agg(F.max_by(F.struct(*keep), F.struct(*newest)).alias("_best"))
    return best.select(*keys, *[F.col(f"_best.{c}").alias(c) for c in keep])
