"""Text expressions.  All stay inside the JVM."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from trajmill import constants as C

Rule = tuple[str, str]

ENDPOINT_RULE: Rule = C.ENDPOINT_RULE


def home_rules(user: str, roots: Sequence[str] = C.HOME_ROOTS) -> list[Rule]:
    """Hide everything below ``<root>/<user>/``.  Longer roots go before their suffixes."""
    pattern, label = C.HOME_RULE
    fill = lambda text, root, name: text.replace("{root}", root).replace("{user}", name)
    return [(fill(pattern, r, re.escape(user)), fill(label, r, user)) for r in roots]


def host_rule(host: str, label: str = C.HOST_LABEL) -> Rule:
    return (re.escape(host), label)


def redact(text: Column, rules: Sequence[Rule]) -> Column:
    """Apply the rules in order; null stays null."""
    for pattern, label in rules:
        text = F.regexp_replace(text, pattern, label.replace("\\", "\\\\").replace("$", "\\$"))
    return text


def redact_messages(messages: Column, rules: Sequence[Rule]) -> Column:
    """Rebuild ``{role, content}`` with redacted content; missing fields become ''."""
    return F.transform(
        F.coalesce(messages, F.array().cast("array<struct<role:string,content:string>>")),
        lambda m: F.struct(
            F.coalesce(m["role"], F.lit("")).alias("role"),
            redact(F.coalesce(m["content"], F.lit("")), rules).alias("content"),
        ),
    )


def repo(instance_id: Column) -> Column:
    return F.substring_index(instance_id, "__", 1)


def run_tag(path: Column) -> Column:
    return F.substring_index(path, "-", -1)


def elide(text: Column, length: int = C.ELIDE_LENGTH, keep: int = C.ELIDE_KEEP) -> Column:
    """Short output in full; long output as head, count of hidden characters and tail."""
    n = F.char_length(text)
    whole = F.concat(F.lit("<output>\n"), text, F.lit("\n</output>"))
    cut = F.concat(
        F.lit(f"<warning>\n{C.ELIDE_WARNING}\n</warning>\n<output_head>\n"),
        F.substring(text, 1, keep),
        F.lit("\n</output_head>\n<elided_chars>\n"),
        (n - F.lit(length)).cast("string"),
        F.lit(" characters elided\n</elided_chars>\n<output_tail>\n"),
        F.right(text, F.lit(keep)),
        F.lit("\n</output_tail>"),
    )
    return F.when(n < length, whole).otherwise(cut)


def actions(text: Column, pattern: str = C.ACTION_PATTERN) -> Column:
    """Contents of the action blocks of one assistant turn."""
    return F.regexp_extract_all(text, F.lit(f"(?s){pattern}"), F.lit(1))


def action_count(text: Column, pattern: str = C.ACTION_PATTERN) -> Column:
    return F.size(actions(text, pattern))


def is_valid_action(text: Column, pattern: str = C.ACTION_PATTERN) -> Column:
    return action_count(text, pattern) == 1


def pretokenize(text: Column, pattern: str = C.PRETOKEN_PATTERN) -> Column:
    """Pieces whose concatenation is the text; white space and letters are Unicode's."""
    return F.regexp_extract_all(text, F.lit(f"(?U){pattern}"), F.lit(0))


def json_line(*columns: str) -> Column:
    """One row as one JSON object."""
    return F.to_json(F.struct(*columns))


def text_size(text: Column, unit: str = "chars") -> Column:
    if unit == "chars":
        return F.char_length(text)
    if unit == "bytes":
        return F.octet_length(text)
    raise ValueError(f"unit must be 'chars' or 'bytes', not {unit!r}")


def is_patch(patch: Column) -> Column:
    return F.coalesce(patch, F.lit("")).startswith(C.PATCH_PREFIX)


def patch_files(patch: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(patch, F.lit("")), F.lit(C.PATCH_FILE_PATTERN), F.lit(1))
