"""Streams over several batches end in the state of the batch query."""

import json

from pyspark.sql import functions as F

from trajmill import schemas
from trajmill.operators import attempts, predictions
from trajmill.plans import views as V
from trajmill.plans.catalog import QUERIES
from trajmill.streaming import streams as T

FILES = 6


def parts(spark, sf, tmp_path):
    """The events in several files, so that a stream takes several batches."""
    path = str(tmp_path / "events")
    df = spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    df.repartitionByRange(FILES, "event_id").sortWithinPartitions("event_id").write.parquet(path)
    return T.read_files(spark, path, spark.read.parquet(path).schema, maxFilesPerTrigger=1), spark.read.parquet(path)


def same(a, b):
    cols = sorted(a.columns)
    assert sorted(a.select(cols).collect(), key=str) == sorted(b.select(cols).collect(), key=str)


def test_attempts(spark, sf, tmp_path):
    shape = lambda df: df.select(F.col("user_id").alias("cluster"), F.col("event_id").alias("line_no"), "ts", V.event_code(F.col("event_type")).alias("code"))
    stream, batch = map(shape, parts(spark, sf, tmp_path))
    finished = F.col("code") == "100"
    decide = lambda df: T.attempt_decisions(T.attempt_states(df, ["cluster"], "line_no", finished), ["cluster"], F.lit(14), F.lit(0), late_seconds=25 * 86400)
    got = T.upsert_to_table(decide(stream), ["cluster"], "attempts")
    same(got, decide(batch))
    spent = attempts.attempt_elapsed(batch, ["cluster"])
    same(got.select("cluster", "elapsed"), spent)


def test_predictions(spark, sf, tmp_path):
    shape = lambda df: df.select(F.col("user_id").alias("instance_id"), F.col("ts").alias("mtime"), "event_id", F.when(F.col("value") > 20, "diff --git x").otherwise("").alias("model_patch"))
    stream, batch = map(shape, parts(spark, sf, tmp_path))
    args = (["instance_id"], ["mtime", "event_id"], ["event_id", "model_patch"])
    same(T.upsert_to_table(T.latest_predictions(stream, *args), ["instance_id"], "predictions"), predictions.latest_valid(batch, *args))


def test_coverage_and_cycles(spark, sf, tmp_path):
    stream, batch = parts(spark, sf, tmp_path)
    shape = lambda df: df.select((F.col("event_id") % 3).alias("run"), F.col("user_id").alias("instance_id"))
    same(T.upsert_to_table(T.distinct_coverage(shape(stream)), ["run", "instance_id"], "coverage"), T.distinct_coverage(shape(batch)))
    counts = T.upsert_to_table(T.cycle_counts(stream, "ts", ["event_type"]), ["cycle_start", "event_type"], "cycles")
    want = batch.groupBy(F.window("ts", "20 minutes")["start"].alias("cycle_start"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    same(counts, want)


def test_ingest_of_trajectory_files(spark, tmp_path):
    for i in range(3):
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / f"a{i}.traj.json").write_text(json.dumps({"instance_id": f"a{i}", "messages": [{"role": "user", "content": "x"}]}, indent=1))
    (tmp_path / "in" / "preds.json").write_text("{}")
    stream = T.read_files(spark, str(tmp_path / "in"), schemas.TRAJECTORY_FILE, "json", "*.traj.json", multiLine=True, maxFilesPerTrigger=1)
    landed = T.append_to_table(stream.select("instance_id", F.size("messages").alias("n")), "landed")
    assert sorted(tuple(r) for r in landed.collect()) == [("a0", 1), ("a1", 1), ("a2", 1)]


def test_streams_go_on_where_they_stopped(spark, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    rows = [("r", "a", 1), ("r", "b", 1), ("r", "a", 2), ("q", "a", 2)]
    for part in (1, 2):
        df = spark.createDataFrame([r for r in rows if r[2] == part], "run string, instance_id string, part int")
        df.coalesce(1).write.mode("append").parquet(source)
        stream = T.read_files(spark, source, df.schema)
        found = T.upsert_to_table(T.distinct_coverage(stream), ["run", "instance_id"], "coverage", target)
        landed = T.append_to_table(stream, "landed", f"{target}-rows")
    assert {tuple(r) for r in found.collect()} == {("r", "a", 2), ("r", "b", 1), ("q", "a", 1)}
    assert sorted(tuple(r) for r in landed.collect()) == sorted(rows)


def test_tables_in_one_file_and_in_a_folder(spark, sf, tmp_path):
    """Tables that several tasks wrote are folders; their streams hold the same rows."""
    spark.range(100).selectExpr("id AS conv_id", "id % 3 AS turn", "'user' AS role", "concat('t', id) AS text").repartition(3).write.parquet(str(tmp_path / "many" / "conversations.parquet"))
    spark.range(5).write.parquet(str(tmp_path / "many" / "other.parquet"))
    whole = spark.read.parquet(str(tmp_path / "many" / "conversations.parquet"))
    (tmp_path / "one").mkdir()
    whole.toPandas().to_parquet(tmp_path / "one" / "conversations.parquet")
    for folder in ("many", "one"):
        assert QUERIES["stream_ingest"](spark, str(tmp_path / folder)).count() == 100
