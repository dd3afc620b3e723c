"""Corpus queries: filters, projections, caps, mixing, sampling, sharding, sets."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from trajmill.functions import text as X
from trajmill.functions.numbers import budget, percent
from trajmill.operators import curate, grades, ordering, predictions
from trajmill.plans import views as V
from trajmill.plans.registry import query

FRACTION = (1, 20)
MAX_LEN = 8000
SEED = 42

# --- filters and projections ---------------------------------------------------


@query("filter_verified", "SELECT row_id, instance_id, model FROM traj_rows WHERE verified", "traj_rows")
def _(spark, sf):
    return curate.verified_rows(V.traj_rows(spark, sf)).select("row_id", "instance_id", "model")


@query(
    "filter_min_turns",
    "SELECT conv_id, count(*) AS n_messages FROM conversations GROUP BY conv_id HAVING count(*) >= 3",
)
def _(spark, sf):
    turns = V.conversations(spark, sf).groupBy("conv_id").agg(F.collect_list("turn").alias("messages"))
    return curate.with_min_messages(turns).select("conv_id", F.size("messages").cast("bigint").alias("n_messages"))


@query("filter_oversize", "SELECT row_id, n_len FROM traj_rows WHERE n_len <= 8000", "traj_rows")
def _(spark, sf):
    rows = V.traj_rows(spark, sf)
    return curate.within_size(rows, X.text_size(F.col("body")), MAX_LEN).select("row_id", "n_len")


@query(
    "filter_too_long",
    """SELECT row_id, CAST(strlen(body) AS BIGINT) AS orig_len FROM traj_rows WHERE strlen(body) <= 4096""",
    "traj_rows",
)
def _(spark, sf):
    rows = V.traj_rows(spark, sf).select("row_id", F.octet_length("body").cast("bigint").alias("orig_len"))
    return curate.within_length(rows, 4096)


@query("filter_valid_patch", "SELECT shard, event_id FROM preds WHERE starts_with(model_patch, 'diff --git')", "preds")
def _(spark, sf):
    return predictions.valid_predictions(V.preds(spark, sf)).select("shard", "event_id")


@query(
    "filter_subset",
    """SELECT model, run, instance_id, resolved FROM graded
       WHERE instance_id IN (SELECT instance_id FROM pool)""",
    "graded",
    "pool",
)
def _(spark, sf):
    return V.graded(spark, sf).join(V.pool(spark, sf), "instance_id", "left_semi").select("model", "run", "instance_id", "resolved")


@query(
    "filter_slice",
    """SELECT instance_id, pos FROM (
         SELECT instance_id, row_number() OVER (ORDER BY instance_id) - 1 AS pos FROM pool) WHERE pos >= 23 AND pos < 46""",
    "pool",
)
def _(spark, sf):
    """The slice 23:46 of the pool in id order."""
    return ordering.position_by(V.pool(spark, sf), ["instance_id"], "pos").where((F.col("pos") >= 23) & (F.col("pos") < 46))


@query("filter_labels", "SELECT model, run, instance_id, resolved FROM graded WHERE run IN (1, 3)", "graded")
def _(spark, sf):
    return V.graded(spark, sf).where(F.col("run").isin(1, 3)).select("model", "run", "instance_id", "resolved")


@query(
    "project_training",
    """SELECT instance_id, model, verified, patch, 2 AS n_messages, md5(body) AS body_md5 FROM traj_rows""",
    "traj_rows",
)
def _(spark, sf):
    rows = curate.training_columns(V.with_messages(V.traj_rows(spark, sf)))
    return rows.select(
        "instance_id",
        "model",
        "verified",
        "patch",
        F.size("messages").alias("n_messages"),
        F.md5(F.get("messages", F.lit(0))["content"].cast("binary")).alias("body_md5"),
    )


# Fixed rules of the test tables: mail addresses, IPv4 addresses, 16-digit numbers.
REDACTION = [
    (r"[A-Za-z0-9._]+@[A-Za-z0-9.]+", "<mail>"),
    (r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+", "<ip>"),
    (r"[0-9]{16}", "<number>"),
]


def _redact_sql(column: str) -> str:
    for pattern, label in REDACTION:
        column = f"regexp_replace({column}, '{pattern}', '{label}', 'g')"
    return column


@query(
    "str_redact",
    f"""SELECT doc_id, length({_redact_sql('text')}) AS n_left, md5({_redact_sql('text')}) AS redacted_md5 FROM documents""",
)
def _(spark, sf):
    docs = V.documents(spark, sf).select("doc_id", X.redact(F.col("text"), REDACTION).alias("r"))
    return docs.select("doc_id", F.char_length("r").cast("bigint").alias("n_left"), F.md5(F.col("r").cast("binary")).alias("redacted_md5"))


@query(
    "project_messages",
    f"""SELECT conv_id, turn, role, md5({_redact_sql('text')}) AS content_md5 FROM conversations""",
)
def _(spark, sf):
    message = F.array(F.struct("role", F.col("text").alias("content")))
    turns = V.conversations(spark, sf).select("conv_id", "turn", X.redact_messages(message, REDACTION).alias("m"))
    return turns.select("conv_id", "turn", F.inline("m")).select(
        "conv_id", "turn", "role", F.md5(F.col("content").cast("binary")).alias("content_md5")
    )


# --- joins -----------------------------------------------------------------------


@query(
    "join_uncovered",
    """SELECT row_id, instance_id FROM traj_rows
       WHERE NOT verified AND instance_id NOT IN (SELECT instance_id FROM traj_rows WHERE verified)""",
    "traj_rows",
)
def _(spark, sf):
    rows = V.traj_rows(spark, sf).select("row_id", "instance_id", "verified")
    return curate.uncovered_rows(rows, curate.verified_rows(rows)).select("row_id", "instance_id")


# --- counters ----------------------------------------------------------------------


@query(
    "agg_build_counters",
    """SELECT (SELECT count(*) FROM traj_rows) AS n_scanned, (SELECT count(*) FROM traj_rows WHERE verified) AS n_verified,
              count(*) AS n_written, count(DISTINCT instance_id) AS n_instances FROM kept_verified""",
    "kept_verified",
)
def _(spark, sf):
    return curate.build_counters(V.traj_rows(spark, sf), ["row_id"])


@query(
    "agg_corpus_size",
    """SELECT count(*) AS n_rows, CAST(sum(n_len) AS BIGINT) AS n_chars, count(DISTINCT instance_id) AS n_instances
       FROM traj_rows""",
    "traj_rows",
)
def _(spark, sf):
    return curate.corpus_size(V.traj_rows(spark, sf), F.col("n_len"))


@query(
    "num_budget",
    """SELECT instance_id, CAST(sum(n_len) AS BIGINT) * 2 // 5 AS extra_target,
              round(count(*) FILTER (WHERE verified) / greatest(count(*), 1)::DOUBLE * 100, 6) AS verified_pct
       FROM traj_rows GROUP BY instance_id""",
    "traj_rows",
)
def _(spark, sf):
    sums = V.traj_rows(spark, sf).groupBy("instance_id").agg(
        F.sum("n_len").alias("chars"), F.count_if("verified").alias("ok"), F.count(F.lit(1)).alias("n")
    )
    return sums.select(
        "instance_id",
        budget(F.col("chars"), (2, 5)).alias("extra_target"),
        F.round(percent(F.col("ok"), F.col("n")), 6).alias("verified_pct"),
    )


# --- caps and the mix --------------------------------------------------------------


@query("win_cap_per_key", "SELECT row_id, instance_id, n_len, md5(body) AS body_md5 FROM kept_verified", "kept_verified")
def _(spark, sf):
    rows = curate.cap_per_key(curate.verified_rows(V.traj_rows(spark, sf)), ["row_id"])
    return rows.select("row_id", "instance_id", "n_len", F.md5(F.col("body").cast("binary")).alias("body_md5"))


def _mix(spark, sf) -> curate.Mix:
    return curate.mix_under_budget(V.traj_rows(spark, sf), ["row_id"], "n_len", FRACTION, MAX_LEN, SEED)


@query(
    "win_mix_budget",
    "SELECT row_id, instance_id, n_len, h AS shuffle_key, md5(body) AS body_md5 FROM seen WHERE eligible",
    "seen",
)
def _(spark, sf):
    return _mix(spark, sf).extra().select(
        "row_id", "instance_id", "n_len", "shuffle_key", F.md5(F.col("body").cast("binary")).alias("body_md5")
    )


@query(
    "set_union_mix",
    """SELECT 0 AS origin, row_id, instance_id, verified, n_len FROM kept_verified
       UNION ALL SELECT 1, row_id, instance_id, verified, n_len FROM seen WHERE eligible""",
    "seen",
)
def _(spark, sf):
    return _mix(spark, sf).rows().select("origin", "row_id", "instance_id", "verified", "n_len")


@query(
    "agg_mix_report",
    """SELECT v.verified_rows, v.verified_chars, t.chars AS target_chars, s.extra_rows, s.extra_chars, s.n_oversize, s.n_capped,
              v.verified_rows + s.extra_rows AS final_rows, v.verified_chars + s.extra_chars AS final_chars,
              round(s.extra_chars / greatest(v.verified_chars, 1)::DOUBLE * 100, 6) AS extra_pct
       FROM (SELECT count(*) AS verified_rows, CAST(sum(n_len) AS BIGINT) AS verified_chars FROM kept_verified) v, target t,
            (SELECT count(*) FILTER (WHERE eligible) AS extra_rows,
                    CAST(COALESCE(sum(n_len) FILTER (WHERE eligible), 0) AS BIGINT) AS extra_chars,
                    count(*) FILTER (WHERE ahead >= 3) AS n_capped,
                    count(*) FILTER (WHERE ahead < 3 AND NOT fits) AS n_oversize FROM seen) s""",
    "seen",
)
def _(spark, sf):
    return _mix(spark, sf).report()


# --- order, samples and shards -------------------------------------------------------


@query(
    "samp_reservoir",
    """SELECT row_id, instance_id, md5('0:' || CAST(row_id AS VARCHAR)) AS shuffle_key, md5(body) AS body_md5
       FROM traj_rows ORDER BY shuffle_key, row_id LIMIT 300""",
    "traj_rows",
)
def _(spark, sf):
    rows = ordering.sample_rows(V.traj_rows(spark, sf), 300, 0, "row_id")
    return rows.select("row_id", "instance_id", "shuffle_key", F.md5(F.col("body").cast("binary")).alias("body_md5"))


@query(
    "samp_shuffle",
    """SELECT row_id, row_number() OVER (ORDER BY md5('42:' || CAST(row_id AS VARCHAR)), row_id) - 1 AS pos FROM traj_rows""",
    "traj_rows",
)
def _(spark, sf):
    return ordering.seeded_position(V.traj_rows(spark, sf).select("row_id"), SEED, "row_id", "pos")


@query(
    "samp_prefix",
    """SELECT row_id, md5('42:' || CAST(row_id AS VARCHAR)) AS shuffle_key FROM traj_rows
       QUALIFY row_number() OVER (ORDER BY row_id) <= (SELECT count(*) FROM traj_rows) * 1 // 40""",
    "traj_rows",
)
def _(spark, sf):
    rows = ordering.prefix_rows(V.traj_rows(spark, sf), (1, 40), "row_id")
    return ordering.shuffled(rows.select("row_id"), SEED, "row_id")


@query("limit_head", "SELECT doc_id, lang, n_chars FROM documents ORDER BY doc_id LIMIT 50")
def _(spark, sf):
    return V.table(spark, sf, "documents").select("doc_id", "lang", "n_chars").orderBy("doc_id").limit(50)


@query(
    "shard_floor",
    """SELECT row_id, n_len, CAST(CASE WHEN n // 7 = 0 THEN 6 ELSE least(pos // (n // 7), 6) END AS INTEGER) AS shard FROM (
         SELECT row_id, n_len, count(*) OVER () AS n,
                row_number() OVER (ORDER BY md5('0:' || CAST(row_id AS VARCHAR)), row_id) - 1 AS pos FROM traj_rows)""",
    "traj_rows",
)
def _(spark, sf):
    rows = V.traj_rows(spark, sf).select("row_id", "n_len")
    placed = ordering.seeded_position(rows, 0, "row_id", "pos")
    n = rows.count()
    return placed.select("row_id", "n_len", ordering.floor_shard(F.col("pos"), n, 7).alias("shard"))


@query(
    "shard_ceil",
    """SELECT instance_id, CAST(pos // ((n + 19) // 20) AS INTEGER) AS job_id FROM (
         SELECT instance_id, count(*) OVER () AS n, row_number() OVER (ORDER BY instance_id) - 1 AS pos FROM pool)""",
    "pool",
)
def _(spark, sf):
    placed = ordering.position_by(V.pool(spark, sf), ["instance_id"], "pos")
    return placed.select("instance_id", ordering.ceil_shard(F.col("pos"), placed.count(), 20).alias("job_id"))


@query(
    "shard_ceil_table",
    """SELECT job_id, job_id * per AS start, least((job_id + 1) * per, n) AS "end" FROM (
         SELECT CAST(unnest(range(20)) AS INTEGER) AS job_id, n, (n + 19) // 20 AS per FROM (SELECT count(*) AS n FROM pool))
       WHERE job_id * per < n""",
    "pool",
)
def _(spark, sf):
    members = V.pool(spark, sf)
    return ordering.ceil_slices(members, members.count(), 20)


@query(
    "win_row_index",
    """SELECT conv_id, turn, row_number() OVER (ORDER BY conv_id, turn) - 1 AS row_index FROM conversations""",
)
def _(spark, sf):
    return ordering.position_by(V.conversations(spark, sf).select("conv_id", "turn"), ["conv_id", "turn"], "row_index")


@query(
    "sort_topk",
    """SELECT instance_id, n_solves, row_number() OVER (ORDER BY n_solves DESC, instance_id) AS place FROM (
         SELECT instance_id, count(*) AS n_solves FROM graded WHERE resolved GROUP BY instance_id)
       ORDER BY place LIMIT 20""",
    "graded",
)
def _(spark, sf):
    top = grades.solve_frequency(V.graded(spark, sf)).orderBy(F.desc("n_solves"), "instance_id").limit(20)
    # The window sees the 20 rows of the report only.
    return top.withColumn("place", F.row_number().over(Window.orderBy(F.desc("n_solves"), "instance_id")).cast("bigint"))


# --- set operations --------------------------------------------------------------------


@query(
    "set_concat_shards",
    """SELECT CAST(doc_id % 4 AS INTEGER) AS shard, doc_id, n_chars FROM documents""",
)
def _(spark, sf):
    docs = V.table(spark, sf, "documents").select((F.col("doc_id") % 4).cast("int").alias("shard"), "doc_id", "n_chars")
    parts = [docs.where(F.col("shard") == s) for s in range(4)]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part, allowMissingColumns=False)
    return whole


@query("set_union_distinct", "SELECT DISTINCT instance_id FROM graded WHERE resolved", "graded")
def _(spark, sf):
    found = grades.resolved_rows(V.graded(spark, sf))
    by_model = [found.where(F.col("model") == m).select("instance_id") for m in ("A", "B")]
    return by_model[0].union(by_model[1]).distinct()


@query("set_intersect", "SELECT instance_id FROM graded WHERE resolved INTERSECT SELECT instance_id FROM pool", "graded", "pool")
def _(spark, sf):
    return grades.resolved_rows(V.graded(spark, sf)).select("instance_id").intersect(V.pool(spark, sf))


@query(
    "set_except",
    """SELECT instance_id FROM traj_rows WHERE NOT verified EXCEPT SELECT instance_id FROM traj_rows WHERE verified""",
    "traj_rows",
)
def _(spark, sf):
    rows = V.traj_rows(spark, sf)
    return curate.unverified_rows(rows).select("instance_id").subtract(curate.verified_rows(rows).select("instance_id"))


# --- training rows against evaluations ------------------------------------------


@query(
    "join_exclude_eval",
    """SELECT r.row_id, r.instance_id FROM traj_rows r
       WHERE r.instance_id NOT IN (SELECT instance_id FROM traj_rows JOIN labels ON doc_id = row_id WHERE toxic = 1)
         AND md5(lower(trim(regexp_replace(body, '[ \\t\\r\\n]+', ' ', 'g')))) NOT IN
             (SELECT md5(lower(trim(regexp_replace(text, '[ \\t\\r\\n]+', ' ', 'g')))) FROM benchmark)""",
    "traj_rows",
)
def _(spark, sf):
    """Instances of rows with a toxic label stand for the evaluated ones."""
    rows = V.traj_rows(spark, sf)
    toxic = V.table(spark, sf, "labels").where("toxic = 1").select(F.col("doc_id").alias("row_id"))
    kept = curate.without_evaluated(rows, rows.join(toxic, "row_id", "left_semi"))
    return curate.without_test_texts(kept, V.table(spark, sf, "benchmark"), "body").select("row_id", "instance_id")
