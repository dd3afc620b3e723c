"""Best-fit-decreasing packing.

The plan is made on (row, length) only; token arrays move once, when packs are built.
"""

from __future__ import annotations

import bisect

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from trajmill import constants as C, scratch
from trajmill.functions.numbers import whole_div
from trajmill.operators.spread import broadcast_if_small

BATCHES_PER_GROUP = 16
MAX_BATCH_ROWS = 1 << 20


def best_fit(lengths: list[int], capacity: int) -> list[int]:
    """Bin of each row: longest first, into the open bin with the least sufficient room."""
    order = sorted(range(len(lengths)), key=lambda i: (-lengths[i], i))
    bins, room = [0] * len(lengths), []  # room: sorted (free, bin)
    opened = 0
    for i in order:
        n = min(lengths[i], capacity)
        at = bisect.bisect_left(room, (n, -1))
        if at < len(room):
            free, b = room.pop(at)
        else:
            free, b, opened = capacity, opened, opened + 1
        bins[i] = b
        bisect.insort(room, (free - n, b))
    return bins


def pieces(n: Column, capacity: int) -> Column:
    """Numbers of the pieces of at most ``capacity`` tokens that ``n`` tokens are cut into; a row without tokens is one piece."""
    return F.sequence(F.lit(0), F.greatest(F.ceil(n / capacity).cast("int"), F.lit(1)) - 1)


def plan_packs(df: DataFrame, id_col: str, length: str, position: str, capacity: int, batch_rows: int = C.PACK_BATCH_ROWS) -> DataFrame:
    """``id, piece, batch, bin, slot`` for each row, or each piece of a row of more than ``capacity`` tokens.

    ``position`` is the row's dense place in the input.  Bins never mix batches.  A group holds
    a fixed number of batches, so its size does not depend on the number of rows.
    """
    if batch_rows > MAX_BATCH_ROWS:
        raise ValueError(f"a batch has at most {MAX_BATCH_ROWS} rows, which keeps pack ids apart")
    per_group = batch_rows * BATCHES_PER_GROUP
    rows = df.select(
        F.col(id_col).cast("bigint").alias("id"),
        F.col(length).cast("bigint").alias("length"),
        F.col(position).cast("bigint").alias("position"),
        whole_div(F.col(position).cast("bigint"), per_group).alias("group"),
        F.explode(pieces(F.col(length), capacity)).alias("piece"),
    )
    rows = rows.withColumn("length", F.least(F.col("length") - F.col("piece").cast("bigint") * capacity, F.lit(capacity)).cast("bigint"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for batch, part in pdf.sort_values(["position", "piece"]).groupby(pdf["position"] // batch_rows):
            part = part.assign(batch=batch, bin=best_fit(part["length"].tolist(), capacity))
            # Inside a bin, rows keep the order in which they were placed.
            part = part.sort_values(["bin", "length", "position", "piece"], ascending=[True, False, True, True])
            out.append(part.assign(slot=part.groupby("bin").cumcount()))
        return pd.concat(out)[["id", "piece", "length", "batch", "bin", "slot"]]

    return rows.groupBy("group").applyInPandas(run, "id bigint, piece int, length bigint, batch bigint, bin bigint, slot bigint")


def with_pack_id(plan: DataFrame) -> DataFrame:
    """One number per (batch, bin); a batch has fewer bins than 2^20."""
    return plan.withColumn("pack_id", F.shiftleft("batch", 20) + F.col("bin"))


def build_packs(tokens: DataFrame, plan: DataFrame, id_col: str, capacity: int) -> DataFrame:
    """Packed rows: member arrays concatenated by slot, ``seq_lengths`` with one entry each.

    A pack holds at most ``capacity`` tokens, which bounds what one group gathers.  Longer rows are
    cut into pieces as in the plan, so every token is packed once.  The plan is written once; if
    it is small it is broadcast and tokens move by pack only.
    """
    numbered = scratch.materialize(with_pack_id(plan).select("id", "piece", "pack_id", "slot"), "pack-plan")
    rows = tokens.select(F.col(id_col).cast("bigint").alias("id"), F.explode(pieces(F.size("input_ids"), capacity)).alias("piece"), "input_ids", "completion_mask")
    first = F.col("piece") * capacity + 1
    cut = rows.select("id", "piece", *[F.slice(c, first, capacity).alias(c) for c in ("input_ids", "completion_mask")])
    member = F.struct("slot", "input_ids", "completion_mask")
    packs = cut.join(broadcast_if_small(numbered), ["id", "piece"]).groupBy("pack_id").agg(F.sort_array(F.collect_list(member)).alias("m"))
    return packs.select(
        "pack_id",
        F.flatten("m.input_ids").alias("input_ids"),
        F.flatten("m.completion_mask").alias("completion_mask"),
        F.transform("m.input_ids", lambda x: F.size(x)).alias("seq_lengths"),
    )


def token_columns(df: DataFrame) -> DataFrame:
    return df.select("input_ids", "completion_mask", "seq_lengths")


def token_stats(df: DataFrame, order: str, rows: int | None = None) -> DataFrame:
    """Length statistics of all rows, or of the first ``rows`` in the given order."""
    narrow = df.select(
        order,
        F.size("input_ids").alias("n"),
        F.aggregate("completion_mask", F.lit(0), lambda a, m: a + m.cast("int")).alias("u"),
    )
    return stats_of_lengths(narrow, order, F.col("n"), F.col("u"), rows)


def stats_of_lengths(df: DataFrame, order: str, length: Column, unmasked: Column, rows: int | None = None) -> DataFrame:
    head = df.select(order, length.alias("n"), unmasked.alias("u"))
    if rows is not None:
        head = head.orderBy(order).limit(rows)
    return head.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.avg("n").alias("avg_len"),
        F.min("n").alias("min_len"),
        F.max("n").alias("max_len"),
        F.avg("u").alias("avg_unmasked"),
    ).withColumn("unmasked_pct", F.col("avg_unmasked") / F.greatest("avg_len", F.lit(1)) * 100)
