"""Array expressions on token rows.  Nothing here explodes a token array.

Masks are long and their runs are few, so everything that depends on the mask works on
``[{value, start, len}]`` runs and moves tokens by slices.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, functions as F

from trajmill import constants as C

RUNS = "array<struct<value:int,start:int,len:int>>"


def truncate(values: Column, length: int) -> Column:
    return F.slice(values, 1, length)


def pick_by_runs(ids: Column, runs: Column, flag: int) -> Column:
    """Ids whose mask equals the flag: 1 gives targets, 0 gives the prompt."""
    mine = F.filter(runs, lambda r: r["value"] == flag)
    return F.flatten(F.transform(mine, lambda r: F.slice(ids, r["start"] + 1, r["len"])))


def masked_count(runs: Column, flag: int = 1) -> Column:
    """Number of positions with the flag."""
    return F.aggregate(runs, F.lit(0), lambda a, r: a + F.when(r["value"] == flag, r["len"]).otherwise(0))


def labels(ids: Column, runs: Column) -> Column:
    """The id at targets and the ignored label elsewhere."""
    return F.flatten(
        F.transform(
            runs,
            lambda r: F.when(r["value"] == 1, F.slice(ids, r["start"] + 1, r["len"])).otherwise(
                F.array_repeat(F.lit(C.IGNORED_LABEL), r["len"])
            ),
        )
    )


def chat_labels(label_ids: Column, keep: tuple[int, ...] = C.CHAT_TOKEN_IDS) -> Column:
    """Keep the loss only on the chat tokens."""
    return F.transform(label_ids, lambda t: F.when(t.isin(*keep), t).otherwise(F.lit(C.IGNORED_LABEL)))


def mask_of_spans(spans: Column) -> Column:
    """0/1 vector from an array of ``{flag, len}``."""
    return F.flatten(F.transform(spans, lambda s: F.array_repeat(s["flag"], s["len"].cast("int"))))


def runs_of_lists(masks: pa.ListArray) -> pa.ListArray:
    """Run-length form of each mask of an Arrow batch."""
    sizes = masks.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    values = masks.flatten().to_numpy(zero_copy_only=False)
    opens = np.ones(len(values), bool)  # the only array per token besides the values
    np.not_equal(values[1:], values[:-1], out=opens[1:])
    opens[(np.cumsum(sizes) - sizes)[sizes > 0]] = True
    at = np.flatnonzero(opens)
    return runs_of_spans(values[at], np.diff(np.append(at, len(values))), sizes)


def runs_of_spans(values: np.ndarray, lens: np.ndarray, sizes: np.ndarray) -> pa.ListArray:
    """Runs from spans of one value that follow each other, in rows of ``sizes`` positions."""
    ends = np.cumsum(sizes)
    values, at, lens = values[lens > 0], (np.cumsum(lens) - lens)[lens > 0], lens[lens > 0]
    row = np.searchsorted(ends, at, side="right")
    opens = np.ones(len(values), bool)
    opens[1:] = (values[1:] != values[:-1]) | (row[1:] != row[:-1])
    first = np.flatnonzero(opens)
    lens = np.add.reduceat(lens, first) if len(first) else lens
    row, at = row[first], at[first]
    counts = np.bincount(row, minlength=len(sizes))
    runs = pa.StructArray.from_arrays(
        [pa.array(values[first].astype(np.int32)), pa.array((at - (ends - sizes)[row]).astype(np.int32)), pa.array(lens.astype(np.int32))],
        ["value", "start", "len"],
    )
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)).astype(np.int32)), runs)


def mask_runs(mask: Column) -> Column:
    """Run-length form ``[{value, start, len}]`` of a mask, found in Arrow batches."""

    def find(masks: pa.Array) -> pa.Array:
        return runs_of_lists(masks)

    return F.arrow_udf(find, RUNS)(mask)


def boundaries_clean(ids: Column, runs: Column, end_id: int) -> Column:
    """Each target run that a prompt run follows ends with the end token.

    Runs alternate, so every target run but a last one is followed by a prompt run.
    """
    inner = F.slice(runs, 1, F.greatest(F.size(runs) - 1, F.lit(0)))
    return F.forall(inner, lambda r: (r["value"] == 0) | (F.get(ids, r["start"] + r["len"] - 1) == end_id))


def target_count(ids: Column, runs: Column, token_id: int) -> Column:
    """How often the token is a loss target."""
    targets = pick_by_runs(ids, runs, 1)
    return F.size(targets) - F.size(F.array_remove(targets, token_id))


def cu_seqlens(seq_lengths: Column) -> Column:
    """Member starts followed by the total.

    A member of length 0 has no first position, so it adds no start.
    """
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts"))
    walked = F.aggregate(
        seq_lengths,
        start,
        lambda acc, n: F.struct(
            (acc["at"] + n).cast("int").alias("at"),
            F.when(n > 0, F.array_append(acc["starts"], acc["at"])).otherwise(acc["starts"]).alias("starts"),
        ),
        lambda acc: F.array_append(acc["starts"], acc["at"]),
    )
    return walked


def position_ids(seq_lengths: Column) -> Column:
    """Positions that restart at 0 for each member."""
    empty = F.array().cast("array<int>")
    return F.flatten(
        F.transform(seq_lengths, lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(empty))
    )


def l2_norm(vector: Column) -> Column:
    return F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def norm_state(scaled: Column) -> Column:
    """Collapsed, healthy, or between the two known ranges."""
    return (
        F.when(scaled < C.COLLAPSED_NORM, "collapsed").when(scaled >= C.HEALTHY_NORM, "healthy").otherwise("between")
    )


def special_token_id(token: Column, table: dict[str, int] = C.SPECIAL_TOKENS) -> Column:
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), token)
