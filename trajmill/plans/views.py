"""The given tables in the shapes the operators take, and the same views as SQL text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from trajmill.functions.numbers import whole_div
from trajmill.operators.spread import spread


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def documents(spark: SparkSession, sf: str) -> DataFrame:
    """Document texts for work that costs more than a shuffle of its input."""
    return spread(table(spark, sf, "documents").select("doc_id", "text"), "doc_id")


def traj_rows(spark: SparkSession, sf: str, heavy: bool = False) -> DataFrame:
    """Trajectory rows for corpus building.  The label join is left to the optimizer."""
    docs = table(spark, sf, "documents").select("doc_id", "source", "lang", "text")
    docs, marks = spread(docs, "doc_id") if heavy else docs, table(spark, sf, "labels").select("doc_id", "quality")
    patch = F.when(F.col("doc_id") % 5 == 0, "").otherwise(
        F.concat(F.lit("diff --git a/f"), (F.col("doc_id") % 7).cast("string"), F.lit(".py"))
    )
    return docs.join(marks, "doc_id", "left").select(
        F.col("doc_id").alias("row_id"),
        F.concat("source", F.lit("__"), whole_div(F.col("doc_id"), 120).cast("string")).alias("instance_id"),
        (F.coalesce("quality", F.lit(0)) == 1).alias("verified"),
        F.col("lang").alias("model"),
        F.col("text").alias("body"),
        F.char_length("text").cast("bigint").alias("n_len"),
        patch.alias("patch"),
    )


def with_messages(rows: DataFrame) -> DataFrame:
    """Trajectory rows with a messages array: the body asked for, the patch answered."""
    message = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    return rows.withColumn("messages", F.array(message("user", F.col("body")), message("assistant", F.col("patch"))))


def graded(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "events")
    return events.groupBy(
        F.when(whole_div(F.col("event_id"), 5) % 2 == 0, "A").otherwise("B").alias("model"),
        (F.col("event_id") % 5 + 1).cast("int").alias("run"),
        F.concat(F.lit("repo"), (F.col("user_id") % 7).cast("string"), F.lit("__"), F.col("user_id").cast("string")).alias("instance_id"),
    ).agg(F.bool_or((F.col("event_type") == "purchase") & (F.col("value") > 60)).alias("resolved"))


def pool(spark: SparkSession, sf: str) -> DataFrame:
    users = table(spark, sf, "events").where(F.col("user_id") % 2 == 0)
    return users.select(
        F.concat(F.lit("repo"), (F.col("user_id") % 7).cast("string"), F.lit("__"), F.col("user_id").cast("string")).alias("instance_id")
    ).distinct()


def preds(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(
        (F.col("event_id") % 20).alias("shard"),
        F.col("user_id").alias("instance_id"),
        F.col("ts").alias("mtime"),
        "event_id",
        F.when(F.col("event_type").isin("error", "signup"), "")
        .otherwise(F.concat(F.lit("diff --git "), F.col("event_id").cast("string")))
        .alias("model_patch"),
    )


def event_code(event_type):
    return (
        F.when(event_type == "signup", "001").when(event_type == "purchase", "100").when(event_type == "error", "012").otherwise("006")
    )


def job_events(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(
        F.col("user_id").alias("cluster"), F.col("event_id").alias("line_no"), "ts", event_code(F.col("event_type")).alias("code")
    )


def embeddings(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(
        "vec_id", "label", ((F.col("label") + 1) / 10.0).cast("double").alias("gain"), "embedding"
    )


def conversations(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations")


# The same views for the SQL side.
VIEWS = {
    "traj_rows": """
        SELECT d.doc_id AS row_id, d.source || '__' || CAST(d.doc_id // 120 AS VARCHAR) AS instance_id,
               COALESCE(l.quality, 0) = 1 AS verified, d.lang AS model, d.text AS body, length(d.text) AS n_len,
               CASE WHEN d.doc_id % 5 = 0 THEN '' ELSE 'diff --git a/f' || CAST(d.doc_id % 7 AS VARCHAR) || '.py' END AS patch
        FROM documents d LEFT JOIN labels l USING (doc_id)""",
    "graded": """
        SELECT CASE WHEN (event_id // 5) % 2 = 0 THEN 'A' ELSE 'B' END AS model,
               CAST(event_id % 5 + 1 AS INTEGER) AS run,
               'repo' || CAST(user_id % 7 AS VARCHAR) || '__' || CAST(user_id AS VARCHAR) AS instance_id,
               bool_or(event_type = 'purchase' AND value > 60) AS resolved
        FROM events GROUP BY 1, 2, 3""",
    "pool": """
        SELECT DISTINCT 'repo' || CAST(user_id % 7 AS VARCHAR) || '__' || CAST(user_id AS VARCHAR) AS instance_id
        FROM events WHERE user_id % 2 = 0""",
    "preds": """
        SELECT event_id % 20 AS shard, user_id AS instance_id, ts AS mtime, event_id,
               CASE WHEN event_type IN ('error', 'signup') THEN ''
                    ELSE 'diff --git ' || CAST(event_id AS VARCHAR) END AS model_patch
        FROM events""",
    "job_events": """
        SELECT user_id AS cluster, event_id AS line_no, ts,
               CASE event_type WHEN 'signup' THEN '001' WHEN 'purchase' THEN '100' WHEN 'error' THEN '012' ELSE '006' END AS code
        FROM events""",
    "emb": "SELECT vec_id, label, (label + 1) / 10.0::DOUBLE AS gain, embedding FROM embeddings",
    # The mix: capped verified rows, candidates in seeded order, and the walk as sets.
    "kept_verified": """
        SELECT * FROM traj_rows WHERE verified
        QUALIFY row_number() OVER (PARTITION BY instance_id ORDER BY row_id) <= 3""",
    "target": "SELECT CAST(COALESCE(sum(n_len), 0) AS BIGINT) * 1 // 20 AS chars FROM kept_verified",
    "candidates": """
        SELECT t.*, md5('42:' || CAST(row_id AS VARCHAR)) AS h, n_len <= 8000 AS fits
        FROM traj_rows t WHERE NOT verified AND instance_id NOT IN (SELECT instance_id FROM kept_verified)""",
    "ranked": """
        SELECT *, COALESCE(count(*) FILTER (WHERE fits) OVER (
            PARTITION BY instance_id ORDER BY h, row_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead
        FROM candidates""",
    "walked": """
        SELECT *, fits AND ahead < 3 AS eligible, COALESCE(sum(n_len) FILTER (WHERE fits AND ahead < 3) OVER (
            ORDER BY h, row_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS so_far
        FROM ranked""",
    "seen": "SELECT walked.* FROM walked, target WHERE so_far < chars",
    # Rendered turns: role context, segment, and the span of each turn in bytes.
    "turns": """
        SELECT conv_id, turn, role, text,
               '<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10) AS segment,
               role = 'assistant' AS target,
               lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS previous_role,
               lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS next_role
        FROM conversations""",
    "spans_cum": """
        SELECT *, CAST(sum(strlen(segment)) OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT)
                  + CASE WHEN target THEN 0 ELSE 22 END AS cum_len
        FROM turns""",
    "spans": """
        SELECT *, COALESCE(lag(cum_len) OVER (PARTITION BY conv_id ORDER BY turn), 0) AS span_start,
               cum_len - COALESCE(lag(cum_len) OVER (PARTITION BY conv_id ORDER BY turn), 0) AS span_len
        FROM spans_cum""",
}

_NEEDS = {
    "kept_verified": ["traj_rows"],
    "target": ["kept_verified"],
    "candidates": ["traj_rows", "kept_verified"],
    "ranked": ["candidates"],
    "walked": ["ranked"],
    "seen": ["walked", "target"],
    "spans_cum": ["turns"],
    "spans": ["spans_cum"],
}


def oracle(body: str, *views: str) -> str:
    """SQL text with the named views, and the views they need, in front."""
    order: list[str] = []

    def add(name: str) -> None:
        for need in _NEEDS.get(name, []):
            add(need)
        if name not in order:
            order.append(name)

    for name in views:
        add(name)
    if not order:
        return body
    return "WITH " + ",\n".join(f"{n} AS ({VIEWS[n]})" for n in order) + "\n" + body
