"""Checks on tokenized rows."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from trajmill.functions.arrays import boundaries_clean, mask_runs, pick_by_runs, target_count
from trajmill.operators.chat import IM_LAYOUT, Layout, mask_pieces
from trajmill.operators.encode import Encoder, decode_columns


def with_runs(df: DataFrame) -> DataFrame:
    """Add ``mask_runs`` to token rows that do not bring it."""
    return df if "mask_runs" in df.columns else df.withColumn("mask_runs", mask_runs(F.col("completion_mask")))


def verify_tokens(df: DataFrame, end_id: int) -> DataFrame:
    """Row flags: equal lengths, clean boundaries, number of end tokens in the loss."""
    ids, runs = F.col("input_ids"), F.col("mask_runs")
    return with_runs(df).withColumns(
        {
            "lengths_equal": F.size("input_ids") == F.size("completion_mask"),
            "boundaries_clean": boundaries_clean(ids, runs, end_id),
            "n_end_targets": target_count(ids, runs, end_id),
        }
    )


def decoded_views(df: DataFrame, encoder: Encoder) -> DataFrame:
    """``text``, ``prompt_text`` and ``target_text`` of each row."""
    ids, runs = F.col("input_ids"), F.col("mask_runs")
    kept = [c for c in df.columns if c not in ("input_ids", "completion_mask", "mask_runs", "seq_lengths")]
    parts = with_runs(df).select(
        *kept, ids.alias("_all"), pick_by_runs(ids, runs, 0).alias("_prompt"), pick_by_runs(ids, runs, 1).alias("_target")
    )
    return decode_columns(parts, {"_all": "text", "_prompt": "prompt_text", "_target": "target_text"}, encoder)


# --- decoded text against the rendered one ----------------------------------------------


def rendered_pieces(messages: Column, layout: Layout = IM_LAYOUT, with_calls: bool = False) -> Column:
    """``[{text, target}]``: what a conversation renders to, cut where its mask may change.

    The header of an assistant turn that follows another kind of turn is a piece of the
    prompt, and a conversation that ends on another kind of turn ends with a header.
    """
    pieces = mask_pieces(messages, layout, with_calls)
    header = F.lit(layout.generation)
    piece = lambda text, target: F.struct(text.alias("text"), target.alias("target"))
    prompt = F.lit(False)

    def cut(p: Column, i: Column) -> Column:
        target = F.coalesce(p["target"], prompt)
        asked = (i > 0) & ~F.coalesce(F.get(pieces, i - 1)["target"], prompt)
        rest = F.substring(p["text"], F.length(header) + 1, F.length(p["text"]))
        return F.when(target & asked, F.array(piece(header, prompt), piece(rest, target))).otherwise(F.array(piece(p["text"], target)))

    shown = F.flatten(F.transform(pieces, cut))
    open_end = (F.size(pieces) > 0) & ~F.coalesce(F.try_element_at(pieces, F.lit(-1))["target"], prompt)
    return F.when(open_end, F.array_append(shown, piece(header, prompt))).otherwise(shown)


_CHECK = "text_equal boolean, first_bad_run int, bad_kind string, n_runs int"


def run_digests(parts: Iterable[tuple[bytes, bool]]) -> Iterator[tuple[bool, bytes]]:
    """Flag and digest of each run of parts of one flag; parts without text are part of no run."""
    flag, digest = None, None
    for data, target in parts:
        if not data:
            continue
        if target != flag:
            if digest is not None:
                yield flag, digest.digest()
            flag, digest = target, hashlib.blake2b(digest_size=16)
        digest.update(data)
    if digest is not None:
        yield flag, digest.digest()


def _first_difference(want: list[tuple[bool, bytes]], got: list[tuple[bool, bytes]]) -> tuple[bool, int | None, str | None, int]:
    bad = next((i for i, (a, b) in enumerate(zip(want, got)) if a != b), None)
    if bad is None and len(want) != len(got):
        bad = min(len(want), len(got))
    if bad is None:
        return True, None, None, len(got)
    flag = (want if bad < len(want) else got)[bad][0]
    return False, bad, "target" if flag else "prompt", len(got)


def verify_text(df: DataFrame, pieces: str, encoder: Encoder, drop: bool = True) -> DataFrame:
    """Whether the ids of each run of the mask decode to what was rendered.

    ``pieces`` is the column of ``rendered_pieces``.  Adds ``text_equal``, the number and kind (``prompt`` or
    ``target``, as rendered) of the first run that differs, and the number of runs found.  Both
    sides are digested run by run, so no text is put together.  The rows are whole: one that
    was cut to a length differs in its last run.  So does, at its boundary, a row in which one
    token holds the end of a header and the beginning of the answer.
    """
    shared = encoder.shared(df.sparkSession)

    @F.arrow_udf(_CHECK)
    def check(rendered: pa.Array, ids: pa.Array, runs: pa.Array) -> pa.Array:
        task, found = shared.open(), []
        for want, own, spans in zip(rendered, ids, runs, strict=True):
            want, spans = want.as_py() or [], spans.as_py() or []
            flat = own.values if own.is_valid else pa.array([], pa.int32())
            slices = [flat.slice(s["start"], s["len"]) for s in spans]
            decoded = task.decode_bytes(slices)
            rendered_runs = list(run_digests((p["text"].encode(), p["target"]) for p in want))
            token_runs = list(run_digests(zip(decoded, (s["value"] == 1 for s in spans), strict=True)))
            found.append(_first_difference(rendered_runs, token_runs))
        columns = list(zip(*found, strict=True)) or [()] * 4
        types = [pa.bool_(), pa.int32(), pa.string(), pa.int32()]
        return pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["text_equal", "first_bad_run", "bad_kind", "n_runs"])

    checked = with_runs(df).withColumn("_check", check(F.col(pieces), F.col("input_ids"), F.col("mask_runs")))
    kept = [c for c in df.columns if not (drop and c == pieces)]
    return checked.select(*kept, "_check.*")
