"""The text expressions for people who write SQL."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import SparkSession

from trajmill import constants as C
from trajmill.functions.text import Rule


def _quote(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def register_sql_functions(spark: SparkSession, rules: Sequence[Rule] = ()) -> None:
    """Create the temporary SQL functions ``repo_of``, ``run_tag_of``, ``redacted`` and ``elided``.

    They are SQL expressions that the optimizer inlines, not Python functions.
    """
    redacted = "s"
    for pattern, label in rules:
        label = label.replace("\\", "\\\\").replace("$", "\\$")
        redacted = f"regexp_replace({redacted}, {_quote(pattern)}, {_quote(label)})"
    head = _quote(f"<warning>\n{C.ELIDE_WARNING}\n</warning>\n<output_head>\n")
    bodies = {
        "repo_of(s STRING)": "substring_index(s, '__', 1)",
        "run_tag_of(s STRING)": "substring_index(s, '-', -1)",
        "redacted(s STRING)": redacted,
        "elided(s STRING)": (
            f"CASE WHEN char_length(s) < {C.ELIDE_LENGTH} THEN concat('<output>\\n', s, '\\n</output>') "
            f"ELSE concat({head}, substring(s, 1, {C.ELIDE_KEEP}), '\\n</output_head>\\n<elided_chars>\\n', "
            f"CAST(char_length(s) - {C.ELIDE_LENGTH} AS STRING), "
            f"' characters elided\\n</elided_chars>\\n<output_tail>\\n', right(s, {C.ELIDE_KEEP}), "
            "'\\n</output_tail>') END"
        ),
    }
    for signature, body in bodies.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURNS STRING RETURN {body}")
