"""Source and sink queries: the tables go out in the file layouts and come back through the readers."""

from __future__ import annotations

from pyspark.sql import functions as F

from trajmill import scratch
from trajmill.operators import curate, encode, grades, predictions, publish
from trajmill.plans import staging as S, views as V
from trajmill.plans.corpus import REDACTION
from trajmill.plans.registry import query
from trajmill.sources import readers as R, writers as W


def _md5(column):
    return F.md5(column.cast("binary"))


# --- row sources and sinks -----------------------------------------------------------


@query(
    "scan_jsonl",
    "SELECT instance_id, model, verified, patch, 2 AS n_messages, md5(body) AS body_md5 FROM traj_rows",
    "traj_rows",
)
def _(spark, sf):
    path = scratch.new_path(spark, "jsonl")
    W.write_jsonl(curate.training_columns(V.with_messages(V.traj_rows(spark, sf))), path)
    rows = R.read_jsonl(spark, path)
    return rows.select(
        "instance_id", "model", "verified", "patch", F.size("messages").alias("n_messages"),
        _md5(F.get("messages", F.lit(0))["content"]).alias("body_md5"),
    )


@query(
    "sink_jsonl",
    """SELECT doc_id, md5(text) AS text_md5, TRUE AS verbatim FROM documents""",
)
def _(spark, sf):
    """Lines are read back as plain text: letters beyond ASCII are not escaped."""
    path = scratch.new_path(spark, "jsonl")
    W.write_jsonl(V.table(spark, sf, "documents").select("doc_id", "text"), path)
    lines = spark.read.text(path).select("value", F.from_json("value", "doc_id bigint, text string").alias("r"))
    return lines.select("r.doc_id", _md5(F.col("r.text")).alias("text_md5"), (~F.contains("value", F.lit("\\u00"))).alias("verbatim"))


@query("scan_saved", "SELECT row_id, instance_id, verified FROM traj_rows", "traj_rows")
def _(spark, sf):
    path = scratch.new_path(spark, "saved")
    V.traj_rows(spark, sf).select("row_id", "instance_id", "verified").write.parquet(f"{path}/train")
    return R.read_saved(spark, path)


def _shards(spark, sf):
    docs = V.table(spark, sf, "documents")
    rows = docs.select("doc_id", (F.col("doc_id") % 5).cast("int").alias("shard"), "text")
    encoded = encode.encode_column(rows, "text", encode.ByteEncoder())
    tokens = encoded.select(
        "doc_id", "shard", "input_ids", F.array_repeat(F.lit(1), F.size("input_ids")).alias("completion_mask"), F.array(F.size("input_ids")).alias("seq_lengths")
    )
    path = scratch.new_path(spark, "shards")
    W.write_tokenized(tokens, path, spread_by="doc_id", files_per_shard=2)
    return path


@query(
    "sink_tokenized",
    "SELECT CAST(doc_id % 5 AS BIGINT) AS shard, count(*) AS n_rows, CAST(sum(strlen(text)) AS BIGINT) AS n_ids FROM documents GROUP BY 1",
)
def _(spark, sf):
    rows = spark.read.parquet(_shards(spark, sf))
    return rows.groupBy(F.col("shard").cast("bigint").alias("shard")).agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum(F.size("input_ids")).alias("n_ids")
    )


@query(
    "scan_shards",
    "SELECT CAST(doc_id % 5 AS BIGINT) AS shard, CAST(strlen(text) AS BIGINT) AS n_ids FROM documents",
)
def _(spark, sf):
    """Only the length column is read; the arrays stay on disk."""
    rows = R.read_shards(spark, _shards(spark, sf), ["shard", "seq_lengths"])
    return rows.select(F.col("shard").cast("bigint").alias("shard"), F.get("seq_lengths", F.lit(0)).cast("bigint").alias("n_ids"))


@query(
    "sink_skip_existing",
    """SELECT CAST(shard AS BIGINT) AS shard, count(*) AS n_rows, CAST(sum(stamp) AS BIGINT) AS stamps
       FROM (SELECT doc_id % 12 AS shard, CASE WHEN doc_id % 12 < 5 THEN 1 ELSE 2 END AS stamp FROM documents) GROUP BY 1""",
)
def _(spark, sf):
    """A second run fills the missing shards and leaves the finished ones alone."""
    docs = V.table(spark, sf, "documents").select("doc_id", (F.col("doc_id") % 12).cast("int").alias("shard"))
    path = scratch.new_path(spark, "resumed")
    W.write_pending(docs.where("shard < 5").withColumn("stamp", F.lit(1)), path, ["shard"])
    W.write_pending(docs.withColumn("stamp", F.lit(2)), path, ["shard"])
    return spark.read.parquet(path).groupBy(F.col("shard").cast("bigint").alias("shard")).agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("stamp").alias("stamps")
    )


# --- trajectory files and publishing ----------------------------------------------------


@query(
    "scan_traj_files",
    """SELECT conv_id || '-' || turn AS instance_id, CASE WHEN conv_id % 3 <> 0 THEN 'Submitted' ELSE '' END AS exit_status,
              CASE WHEN conv_id % 3 <> 0 THEN role ELSE '' END AS submission, role, md5(text) AS content_md5 FROM conversations""",
)
def _(spark, sf):
    rows = R.read_trajectory_files(spark, S.trajectory_files(spark, sf))
    message = F.get("messages", F.lit(0))
    return rows.select("instance_id", "exit_status", "submission", message["role"].alias("role"), _md5(message["content"]).alias("content_md5"))


@query(
    "sink_published",
    """SELECT CASE WHEN conv_id % 2 = 0 THEN 'A' ELSE 'B' END AS model, CAST(conv_id % 3 + 1 AS BIGINT) AS run, count(*) AS n_rows,
              count(*) FILTER (WHERE conv_id % 4 = 0) AS n_resolved FROM conversations GROUP BY 1, 2""",
)
def _(spark, sf):
    """From trajectory files to partitioned Parquet and back."""
    rows = R.read_trajectory_files(spark, S.trajectory_files(spark, sf))
    conv = F.substring_index("instance_id", "-", 1).cast("bigint")
    keyed = rows.withColumn("model", F.when(conv % 2 == 0, "A").otherwise("B")).withColumn("run", (conv % 3 + 1).cast("int"))
    resolved = keyed.where(conv % 4 == 0).select("model", "run", "instance_id")
    path = scratch.new_path(spark, "published")
    W.write_published(publish.published_rows(keyed, resolved, REDACTION), path, files_per_run=2)
    return spark.read.parquet(path).groupBy("model", F.col("run").cast("bigint").alias("run")).agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if("resolved").alias("n_resolved")
    )


# --- predictions, reports, subsets ---------------------------------------------------------

_NEWEST = """(SELECT instance_id, event_id % 3 AS attempt, (instance_id // 25) * 3 + event_id % 3 AS file,
                     arg_max(model_patch, event_id) AS model_patch FROM preds GROUP BY 1, 2, 3)"""


@query("scan_preds", f"SELECT CAST(instance_id AS VARCHAR) AS instance_id, model_patch, CAST(file AS BIGINT) AS file FROM {_NEWEST} WHERE file % 7 <> 0", "preds")
def _(spark, sf):
    rows = R.read_predictions(spark, f"{S.prediction_files(spark, sf)}/*/preds.json")
    return rows.select("instance_id", "model_patch", F.regexp_extract("path", r"job_(\d+)/", 1).cast("bigint").alias("file"))


MERGED_PREDS_SQL = f"""SELECT CAST(instance_id AS VARCHAR) AS instance_id, model_patch FROM {_NEWEST}
        WHERE file % 7 <> 0 AND starts_with(model_patch, 'diff --git')
        QUALIFY row_number() OVER (PARTITION BY instance_id ORDER BY file DESC) = 1"""


@query("sink_merged_preds", MERGED_PREDS_SQL, "preds")
def _(spark, sf):
    """The merge over files; file numbers stand in for file times, which a fast writer may repeat."""
    rows = R.read_predictions(spark, f"{S.prediction_files(spark, sf)}/*/preds.json")
    numbered = rows.withColumn("file", F.regexp_extract("path", r"job_(\d+)/", 1).cast("bigint"))
    merged = predictions.latest_valid(numbered, ["instance_id"], ["file", "path"], ["model_patch"])
    path = scratch.new_path(spark, "merged")
    W.write_merged_predictions(merged, path)
    return spark.read.parquet(path)


@query(
    "scan_reports",
    """SELECT 'model' || model || '-pass5' AS tag, CAST(run AS BIGINT) AS run, CAST(count(*) AS BIGINT) AS submitted,
              count(*) FILTER (WHERE resolved) AS n_resolved, count(*) FILTER (WHERE resolved) AS n_ids, CAST(0 AS BIGINT) AS n_errors
       FROM graded WHERE NOT (model = 'B' AND run = 5) GROUP BY 1, 2""",
    "graded",
)
def _(spark, sf):
    reports = R.read_reports(spark, f"{S.report_files(spark, sf)}/*.json")
    return reports.groupBy("tag", F.col("run").cast("bigint").alias("run")).agg(
        F.sum("submitted_instances").alias("submitted"),
        F.sum("resolved_instances").alias("n_resolved"),
        F.sum(F.size("resolved_ids")).alias("n_ids"),
        F.sum("error_instances").alias("n_errors"),
    )


@query(
    "scan_reports_long",
    """SELECT 'model' || model || '-pass5' AS tag, CAST(run AS BIGINT) AS run, instance_id FROM graded
       WHERE resolved AND NOT (model = 'B' AND run = 5)""",
    "graded",
)
def _(spark, sf):
    reports = R.read_reports(spark, f"{S.report_files(spark, sf)}/*.json")
    return grades.long_form(reports, ["tag", "run"]).withColumn("run", F.col("run").cast("bigint"))


@query(
    "scan_subset",
    """SELECT p.instance_id, CAST(COALESCE(s.n, 0) AS BIGINT) AS freq FROM pool p
       LEFT JOIN (SELECT instance_id, count(*) FILTER (WHERE resolved) AS n FROM graded GROUP BY 1) s USING (instance_id)""",
    "graded",
    "pool",
)
def _(spark, sf):
    return R.read_subset(spark, S.subset_files(spark, sf)).select("instance_id", "freq")


# --- job files ------------------------------------------------------------------------------


@query(
    "scan_slice_specs",
    """SELECT DISTINCT CAST(event_id % 3 + 1 AS VARCHAR) AS run, CAST(user_id // 25 AS BIGINT) AS job_id, user_id // 25 * 25 AS start,
              CAST(25 AS BIGINT) AS expected FROM events WHERE (user_id // 25) % 8 <> 7""",
)
def _(spark, sf):
    specs = R.read_slice_specs(spark, f"{S.slice_files(spark, sf)}/*/job_*.sub")
    return specs.select(
        F.substring_index("run", "run", -1).alias("run"), F.col("job_id").cast("bigint").alias("job_id"), "start", "expected"
    )


@query(
    "scan_job_log",
    """SELECT cluster, code, strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S') AS stamp FROM job_events""",
    "job_events",
)
def _(spark, sf):
    """Event lines of all attempts between other output lines."""
    e = V.job_events(spark, sf)
    line = F.concat(
        "code", F.lit(" ("), F.col("cluster").cast("string"), F.lit(".000.000) "),
        F.date_format(F.date_trunc("second", "ts"), "yyyy-MM-dd HH:mm:ss"), F.lit(" Job event"),
    )
    noise = F.concat(F.lit("\t"), "code", F.lit(" of "), F.col("cluster").cast("string"))
    path = S.write_lines(e.select(F.explode(F.array(line, noise, F.lit("..."))).alias("value")), "job-log")
    rows = R.parse_job_log(spark.read.text(path), [])
    return rows.select(
        F.substring_index("job", ".", 1).cast("bigint").alias("cluster"), "code", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("stamp")
    )


@query(
    "scan_active_jobs",
    """SELECT event_id AS cluster, CAST(CASE event_id % 3 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 5 END AS BIGINT) AS status,
              '/base/m-pass3-run' || CAST(event_id % 3 + 1 AS VARCHAR) AS run_dir, CAST(user_id // 25 AS BIGINT) AS job_id
       FROM events WHERE event_id % 10 <> 4""",
)
def _(spark, sf):
    """A captured queue listing; some lines have no job id."""
    e = V.table(spark, sf, "events")
    status = F.when(F.col("event_id") % 3 == 0, 1).when(F.col("event_id") % 3 == 1, 2).otherwise(5)
    job = F.when(F.col("event_id") % 10 == 4, "").otherwise(F.format_string(" JOB_ID=%d", whole(F.col("user_id"))))
    line = F.concat(
        F.format_string(" %d %d MODEL_DIR=/m BASE_OUTPUT_DIR=/base/m-pass3-run%d", "event_id", status, F.col("event_id") % 3 + 1), job, F.lit(" START=0 END=5")
    )
    rows = R.read_active_jobs(spark, S.write_lines(e.select(line.alias("value")), "queue"))
    return rows.select("cluster", F.col("status").cast("bigint").alias("status"), "run_dir", F.col("job_id").cast("bigint").alias("job_id"))


def whole(user):
    return S.whole_div(user, 25)


@query(
    "scan_vocab",
    """SELECT word, CAST(rank AS BIGINT) AS rank FROM (
         SELECT word, (length(word) * 7919 + ascii(word) * 977) % 70000 AS rank FROM (
           SELECT DISTINCT unnest(string_split(text, ' ')) AS word FROM documents) WHERE regexp_full_match(word, '[A-Za-z]+'))
       WHERE rank < 65535 AND rank % 5 <> 0""",
)
def _(spark, sf):
    """Vocabulary lines of all words; some lines have a third field and some no number."""
    words = (
        V.table(spark, sf, "documents").select(F.explode(F.split("text", " ")).alias("word")).where(F.col("word").rlike("^[A-Za-z]+$")).distinct()
    )
    rank = (F.char_length("word") * 7919 + F.ascii("word") * 977) % 70000
    field = F.when(rank % 10 == 0, F.concat(rank.cast("string"), F.lit(" x"))).when(rank % 5 == 0, "none").otherwise(rank.cast("string"))
    path = S.write_lines(words.select(F.concat(F.base64(F.col("word").cast("binary")), F.lit(" "), field).alias("value")), "vocab")
    vocab = R.read_vocab(spark, path)
    return vocab.select(F.col("token").cast("string").alias("word"), F.col("rank").cast("bigint").alias("rank"))
