"""Rendering conversations and masking assistant turns.

Two forms of input are served: trajectory rows with a ``messages`` array (handled inside
the row) and turn tables with one row per message (handled with blocked windows, so that
one very long conversation is not one task).

A *segment* is what one message adds to the rendered text.  A run of tool messages forms
one user block, so its opening and closing marks depend on the neighbours' roles.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from trajmill.functions.arrays import mask_of_spans
from trajmill.operators.blocks import BLOCK_ROWS, in_key_context


@dataclass(frozen=True)
class Layout:
    """Marks around a turn.  ``{role}`` is replaced by the role."""

    open: str
    close: str
    generation: str
    tool_open: str
    tool_item: tuple[str, str]


# The two chat layouts.
IM_LAYOUT = Layout(
    open="<|im_start|>{role}\n",
    close="<|im_end|>\n",
    generation="<|im_start|>assistant\n",
    tool_open="<|im_start|>user",
    tool_item=("\n<tool_response>\n", "\n</tool_response>"),
)
ROLE_TOKEN_LAYOUT = Layout(
    open="<|{role}|>",
    close="<|end|>",
    generation="<|assistant|>",
    tool_open="<|user|>",
    tool_item=("\n<tool_response>\n", "\n</tool_response>"),
)


def _opening(role: Column, layout: Layout) -> Column:
    before, _, after = layout.open.partition("{role}")
    return F.concat(F.lit(before), role, F.lit(after))


def tool_call_text(content: Column, tool_calls: Column) -> Column:
    """Calls of one assistant turn, each on its own line after any content."""
    parts = F.transform(
        tool_calls,
        lambda call, i: F.concat(
            F.when((i > 0) | (content != ""), F.lit("\n")).otherwise(F.lit("")),
            F.lit('<tool_call>\n{"name": "'),
            F.coalesce(call["name"], F.lit("")),
            F.lit('", "arguments": '),
            F.coalesce(call["arguments"], F.lit("")),
            F.lit("}\n</tool_call>"),
        ),
    )
    return F.coalesce(F.array_join(parts, ""), F.lit(""))


def segment(
    role: Column,
    content: Column,
    previous_role: Column,
    next_role: Column,
    layout: Layout = IM_LAYOUT,
    tool_calls: Column | None = None,
) -> Column:
    """The text that one message adds.  Null content is ''; unknown roles add nothing."""
    content = F.coalesce(content, F.lit(""))
    calls = tool_call_text(content, tool_calls) if tool_calls is not None else F.lit("")
    opening, close = _opening(role, layout), F.lit(layout.close)
    head, tail = layout.tool_item
    starts_run = F.coalesce(previous_role, F.lit("")) != "tool"
    ends_run = F.coalesce(next_role, F.lit("")) != "tool"
    tool = F.concat(
        F.when(starts_run, F.lit(layout.tool_open)).otherwise(F.lit("")),
        F.lit(head),
        content,
        F.lit(tail),
        F.when(ends_run, close).otherwise(F.lit("")),
    )
    return (
        F.when(role == "assistant", F.concat(opening, content, calls, close))
        .when(role.isin("user", "system"), F.concat(opening, content, close))
        .when(role == "tool", tool)
        .otherwise(F.lit(""))
    )


# --- trajectory rows ---------------------------------------------------------


def segments(messages: Column, layout: Layout = IM_LAYOUT, with_calls: bool = False) -> Column:
    """``[{text, target}]`` per message."""
    return F.transform(
        messages,
        lambda m, i: F.struct(
            segment(
                m["role"],
                m["content"],
                F.get(messages, i - 1)["role"],
                F.get(messages, i + 1)["role"],
                layout,
                m["tool_calls"] if with_calls else None,
            ).alias("text"),
            (m["role"] == "assistant").alias("target"),
        ),
    )


def render(messages: Column, layout: Layout = IM_LAYOUT, with_calls: bool = False, generation: bool = False) -> Column:
    text = F.array_join(F.transform(segments(messages, layout, with_calls), lambda s: s["text"]), "")
    return F.concat(text, F.lit(layout.generation)) if generation else text


def mask_pieces(messages: Column, layout: Layout = IM_LAYOUT, with_calls: bool = False) -> Column:
    """``[{text, target}]``: the text to tokenize, cut only where special tokens start.

    Tool runs become one piece, because there is no special token inside a run.  The
    generation header is moved from an assistant turn to the turn before it, unless that
    turn is an assistant turn as well; a last non-assistant turn keeps a trailing header.
    """
    marked = segments(messages, layout, with_calls)
    empty = F.array().cast("array<struct<text:string,target:boolean,role:string>>")
    pieces = F.aggregate(
        F.zip_with(marked, messages, lambda s, m: F.struct(s["text"].alias("text"), s["target"].alias("target"), m["role"].alias("role"))),
        empty,
        lambda acc, s: F.when(
            (s["role"] == "tool") & (F.try_element_at(acc, F.lit(-1))["role"] == "tool"),
            F.concat(
                F.slice(acc, 1, F.size(acc) - 1),
                F.array(
                    F.struct(
                        F.concat(F.element_at(acc, -1)["text"], s["text"]).alias("text"),
                        s["target"].alias("target"),
                        s["role"].alias("role"),
                    )
                ),
            ),
        ).otherwise(F.concat(acc, F.array(s))),
    )
    return F.transform(pieces, lambda p: F.struct(p["text"].alias("text"), p["target"].alias("target")))


# --- turn tables ---------------------------------------------------------------


def turn_segments(
    turns: DataFrame, key: str, position: str, role: str, content: str, layout: Layout = IM_LAYOUT, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Turns with ``segment``, ``target``, ``previous_role`` and ``next_role``."""
    seen = in_key_context(
        turns,
        key,
        position,
        previous={"previous_role": F.coalesce(F.col(role), F.lit(""))},  # null only before the first turn
        following={"next_role": F.col(role)},
        block_rows=block_rows,
    )
    return seen.withColumn(
        "segment", segment(F.col(role), F.col(content), F.col("previous_role"), F.col("next_role"), layout)
    ).withColumn("target", F.coalesce(F.col(role) == "assistant", F.lit(False)))


def turn_spans(
    turns: DataFrame,
    key: str,
    position: str,
    role: str,
    content_size: Column,
    layout: Layout = IM_LAYOUT,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Mask span of each turn: ``span_start``, ``span_len`` and ``target``, sized in bytes.

    Narrow rows only: the size of a segment is that of its content plus that of its marks.
    The length up to a turn includes the generation header unless the turn is an assistant
    turn, so a header joins the span of the turn before an assistant turn.  Sizes have to
    add up along a conversation, as bytes do; a rank encoder needs a run of tool turns as
    one text, see ``tokenize_rows``.
    """
    narrow = turns.select(key, position, F.col(role).alias("role"), content_size.cast("bigint").alias("_content"))
    seen = in_key_context(
        narrow,
        key,
        position,
        previous={"previous_role": F.coalesce("role", F.lit(""))},  # null only before the first turn
        following={"next_role": F.col("role")},
        block_rows=block_rows,
        keep_block=True,
    )
    marks = F.octet_length(segment(F.col("role"), F.lit(""), F.col("previous_role"), F.col("next_role"), layout))
    size = F.when(marks > 0, marks + F.coalesce("_content", F.lit(0))).otherwise(F.lit(0))
    sized = seen.withColumn("_size", size.cast("bigint")).withColumn(
        "target", F.coalesce(F.col("role") == "assistant", F.lit(False))
    )
    summed = in_key_context(sized, key, position, sums={"_upto": F.col("_size")})
    header = F.lit(len(layout.generation.encode()))
    tail = F.when(F.col("target"), F.lit(0)).otherwise(header)
    lead = F.when(F.col("previous_role").isNull() | (F.col("previous_role") == "assistant"), F.lit(0)).otherwise(header)
    start = (F.col("_upto") - F.col("_size") + lead).cast("bigint")
    return summed.select(
        key, position, "role", "target", start.alias("span_start"), (F.col("_upto") + tail - start).cast("bigint").alias("span_len")
    )


def conversation_masks(spans: DataFrame, key: str, position: str, max_length: int) -> DataFrame:
    """One row per conversation: mask spans cut to ``max_length`` and the length before the cut.

    Only turns that start before the cut are gathered and every span holds at least one
    token, so a group is never longer than ``max_length``.
    """
    kept = (F.col("span_start") < max_length) & (F.col("span_len") > 0)
    span = F.struct(
        F.col(position).alias("at"),
        F.col("target").cast("int").alias("flag"),
        F.least("span_len", F.lit(max_length) - F.col("span_start")).alias("len"),
    )
    found = spans.groupBy(key).agg(
        F.max(F.col("span_start") + F.col("span_len")).alias("orig_len"),
        F.sort_array(F.collect_list(F.when(kept, span))).alias("spans"),
    )
    return found.withColumn("completion_mask", mask_of_spans(F.col("spans")))
