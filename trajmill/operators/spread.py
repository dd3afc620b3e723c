"""Parallelism for inputs in too few pieces, and broadcasts of checked size."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

BROADCAST_ROWS = 500_000


def spread(scan: DataFrame, key: str) -> DataFrame:
    """Hash-distribute a scan with fewer splits than cores; larger inputs stay as they are.

    Worth it before work that costs far more than the shuffle of its input, such as
    tokenizing.  ``scan`` is a plain scan: its split count is known without running it.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    if scan.rdd.getNumPartitions() >= cores:
        return scan
    return scan.repartition(cores, key)


def broadcast_if_small(keys: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast a narrow key table of at most ``rows`` rows; a larger one joins by shuffle.

    For joins against wide rows: without the hint the wide side would be shuffled before
    the adaptive planner sees that the keys are few.
    """
    return F.broadcast(keys) if keys.limit(rows + 1).count() <= rows else keys
