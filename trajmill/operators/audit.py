"""Reports on finished trajectories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from trajmill import constants as C
from trajmill.functions.text import patch_files
from trajmill.operators.blocks import in_key_context


def exit_status_counts(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys, "exit_status").agg(F.count(F.lit(1)).alias("n"))


def empty_submissions(rows: DataFrame, keys: list[str], out_of_context: Column) -> DataFrame:
    """Share of submitted rows with an empty patch, split by cause."""
    empty = F.coalesce("submission", F.lit("")) == ""
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_submitted"),
        F.count_if(empty).alias("n_empty"),
        F.count_if(empty & out_of_context).alias("n_out_of_context"),
        F.count_if(empty & ~out_of_context).alias("n_no_edit"),
    ).withColumn("empty_pct", F.col("n_empty") / F.col("n_submitted") * 100)


def forbidden_paths(rows: DataFrame, keys: list[str], patch: str, pattern: str = C.FORBIDDEN_PATH_PATTERN) -> DataFrame:
    """Share of patches that touch a test or project file."""
    touched = F.exists(patch_files(F.col(patch)), lambda f: f.rlike(pattern))
    return (
        rows.where(F.coalesce(F.col(patch), F.lit("")).startswith(C.PATCH_PREFIX))
        .groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("n_patches"), F.count_if(touched).alias("n_forbidden"))
        .withColumn("forbidden_pct", F.col("n_forbidden") / F.col("n_patches") * 100)
    )


def repeated_actions(turns: DataFrame, key: str, position: str, action: Column) -> DataFrame:
    """Assistant turns and whether their action equals that of the assistant turn before.

    Actions are compared by digest, so that the windows move short rows.
    """
    acted = turns.where(F.col("role") == "assistant").select(key, position, F.md5(action.cast("binary")).alias("action_md5"))
    seen = in_key_context(acted, key, position, previous={"previous_md5": F.col("action_md5")})
    return seen.withColumn("repeated", F.coalesce(F.col("action_md5") == F.col("previous_md5"), F.lit(False)))


def prompt_digests(rows: DataFrame, name: str, keys: list[str], text: Column) -> DataFrame:
    """Distinct prompts of one side with their digest and row count."""
    return rows.groupBy(*keys, F.sha2(text.cast("binary"), 256).alias("digest")).agg(F.count(F.lit(1)).alias(name))


def prompt_parity(train: DataFrame, evaluation: DataFrame, keys: list[str], text: Column) -> DataFrame:
    """Prompts of both sides; a prompt is at parity if it occurs in both."""
    left = prompt_digests(train, "n_train", keys, text)
    right = prompt_digests(evaluation, "n_eval", keys, text)
    return (
        left.join(right, [*keys, "digest"], "full_outer")
        .na.fill(0, ["n_train", "n_eval"])
        .withColumn("parity", (F.col("n_train") > 0) & (F.col("n_eval") > 0))
    )


def resolved_only(rows: DataFrame, resolved: DataFrame, keys: list[str]) -> DataFrame:
    """The rows whose instance (and configuration, run ..) was resolved; a null key never is."""
    return rows.join(resolved.select(*keys).distinct(), keys, "left_semi")


def repeated_line_share(text: Column) -> Column:
    """Share of the lines of a text that repeat an earlier one; null for a null text."""
    lines = F.split(text, "\n")
    return 1 - F.size(F.array_distinct(lines)) / F.size(lines)


def stutter_share(text: Column) -> Column:
    """Share of the space-separated words that equal the word before them; null for a null text."""
    words = F.split(text, " ")
    repeats = F.zip_with(words, F.slice(words, 2, F.size(words)), lambda a, b: F.when(a == b, 1))
    return F.size(F.array_compact(repeats)) / F.size(words)


def degenerate_texts(rows: DataFrame, text: str, at_least: float = C.DEGENERATE_SHARE) -> DataFrame:
    """Adds both shares and whether one of them is at least ``at_least``; a null text is not degenerate."""
    shares = rows.withColumns({"line_share": repeated_line_share(F.col(text)), "stutter_share": stutter_share(F.col(text))})
    return shares.withColumn("degenerate", F.coalesce(F.greatest("line_share", "stutter_share") >= at_least, F.lit(False)))
