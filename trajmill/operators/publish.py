"""From trajectory files to published rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from trajmill.functions.text import Rule, redact, redact_messages
from trajmill.operators.grades import with_resolved_flag
from trajmill.operators.spread import broadcast_if_small

WARNING = "Evaluation data: do not train on these rows."


def published_rows(
    trajectories: DataFrame, resolved: DataFrame, rules: Sequence[Rule], warning: str = WARNING
) -> DataFrame:
    """Rows ready to publish from ``model, run`` and the columns of the trajectory reader."""
    keys = ["model", "run", "instance_id"]
    flagged = with_resolved_flag(trajectories, broadcast_if_small(resolved.select(*keys).distinct()), keys)
    return flagged.select(
        "instance_id",
        "model",
        F.col("run").cast("int").alias("run"),
        F.coalesce("exit_status", F.lit("")).alias("exit_status"),
        "resolved",
        F.coalesce("submission", F.lit("")).alias("submission"),
        F.coalesce(F.size("messages"), F.lit(0)).alias("n_turns"),
        redact_messages(F.col("messages"), rules).alias("messages"),
        F.lit(warning).alias("warning"),
    )


def redacted_config(sample: DataFrame, column: str, rules: Sequence[Rule]) -> DataFrame:
    """The configuration sample as JSON text without private paths and hosts."""
    return sample.select(redact(F.col(column), rules).alias(column))
