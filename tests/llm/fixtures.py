"""Rows that every operator must take: nulls, empty and long texts, ties, repeats, clashing column names."""

from pyspark.sql import types as T

SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        # Names that the operators use themselves.
        *(T.StructField(name, T.StringType()) for name in ("key", "row", "n", "kept", "ids", "score", "size", "h", "r", "fp", "toxic", "words")),
    ]
)
PROSE = "One two three four five six seven eight nine ten eleven twelve.\nA second line of this text that has many words in it.\nLast."
LONG = " ".join(f"word{i % 997} and{i % 13}" for i in range(30_000))


def row(doc_id, text, source="a"):
    return (doc_id, text, "en", source, None if text is None else len(text), *["x"] * 12)


ROWS = [
    row(1, PROSE), row(2, PROSE, "b"), row(2, PROSE, "b"), row(3, None, None), row(4, ""), row(5, " \n\t "), row(None, PROSE), row(None, None),
    row(6, LONG), row(7, "é ü 漢字 \x00 𝒳 no-break"), row(8, "token = \"24be64439e3e49cf46b2d7c90f3602a3d0b907ff\""), row(9, "\n\n\n"),
]


def odd(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def documents(spark, texts, sources=None):
    rows = [(i, t, "en", (sources or {}).get(i, "a"), None if t is None else len(t)) for i, t in texts.items()]
    return spark.createDataFrame(rows, T.StructType(SCHEMA.fields[:5]))
