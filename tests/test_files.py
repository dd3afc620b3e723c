"""Readers and writers on small files with damaged and missing parts."""

import base64
import json
import os

import pytest
from pyspark.sql import functions as F

from trajmill import constants as C
from trajmill.functions.text import home_rules
from trajmill.operators import chat, grades, predictions, publish
from trajmill.sources import readers as R, writers as W


def put(root, name, content, mtime=None):
    path = root / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(content if isinstance(content, str) else json.dumps(content), encoding="utf-8")
    if mtime:
        os.utime(path, (mtime, mtime))
    return str(path)


def test_trajectory_files(spark, tmp_path):
    put(tmp_path, "job_0/a/a.traj.json", {"instance_id": "a__1", "info": {"exit_status": "Submitted", "submission": "diff --git", "config": {"k": [1, 2]}}, "messages": [{"role": "user", "content": "in /home/ada/x", "extra": 1}, {"content": None}]})
    put(tmp_path, "job_0/b/b 2+%41.traj.json", {"info": {"exit_status": None}, "messages": [{"role": "assistant"}]})
    put(tmp_path, "job_1/deep/er/c__3.traj.json", {"instance_id": ""})
    put(tmp_path, "job_1/preds.json", {"instance_id": "no"})
    rows = {r.instance_id: r for r in R.read_trajectory_files(spark, str(tmp_path)).collect()}
    assert set(rows) == {"a__1", "b 2+%41", "c__3"}
    assert [tuple(m) for m in rows["a__1"].messages] == [("user", "in /home/ada/x"), ("", "")]
    assert json.loads(rows["a__1"].config) == {"k": [1, 2]}
    assert (rows["b 2+%41"].exit_status, rows["b 2+%41"].submission, rows["c__3"].messages) == ("", "", [])
    df = R.read_trajectory_files(spark, str(tmp_path)).withColumns({"model": F.lit("m"), "run": F.lit(1)})
    resolved = spark.createDataFrame([("m", 1, "a__1"), ("m", 2, "b 2+%41")], "model string, run int, instance_id string")
    out = publish.published_rows(df, resolved, home_rules("ada"))
    path = str(tmp_path / "published")
    W.write_published(out, path, files_per_run=3)
    back = {r.instance_id: r for r in spark.read.parquet(path).collect()}
    assert {k: (r.resolved, r.n_turns) for k, r in back.items()} == {"a__1": (True, 2), "b 2+%41": (False, 1), "c__3": (False, 0)}
    assert back["a__1"].messages[0].content == "in /home/<user>/<redacted>" and back["b 2+%41"].warning == publish.WARNING
    sample = grades.config_sample(df, "config", ["run", "file"])
    assert json.loads(sample.first().config) == {"k": [1, 2]}
    hidden = publish.redacted_config(spark.createDataFrame([('{"p": "/home/ada/x"}',)], "config string"), "config", home_rules("ada"))
    assert json.loads(hidden.first().config) == {"p": "/home/<user>/<redacted>"}


def test_predictions(spark, tmp_path):
    put(tmp_path, "job_0/preds.json", {"i1": {"model_patch": "diff --git old"}, "i2": {"model_patch": "diff --git b"}, "i4": {}}, 1000)
    put(tmp_path, "job_1/preds.json", {"i1": {"model_patch": "diff --git new"}, "i2": {"model_patch": ""}, "i3": {"model_patch": "text"}}, 2000)
    put(tmp_path, "job_2/preds.json", '{"i1": {"model_pat', 3000)
    put(tmp_path, "job_3/preds.json", {"i5": {"model_patch": "diff --git x"}}, 4000)
    put(tmp_path, "job_4/preds.json", {"i5": {"model_patch": "diff --git y"}}, 4000)
    rows = R.read_predictions(spark, f"{tmp_path}/*/preds.json")
    assert rows.count() == 8
    merged = predictions.latest_valid(rows, ["instance_id"], ["mtime", "path"], ["model_patch"])
    assert {r.instance_id: r.model_patch for r in merged.collect()} == {"i1": "diff --git new", "i2": "diff --git b", "i5": "diff --git y"}
    parts = [json.loads(r.value) for r in W.merged_document(merged).collect()]
    assert {k for p in parts for k in p} == {"i1", "i2", "i5"} and len(parts) == 3
    assert {"i1": {"model_patch": "diff --git new", "instance_id": "i1"}} in parts


def test_reports(spark, tmp_path):
    put(tmp_path, "tag-a-run1.json", {"submitted_instances": 4, "completed_instances": 3, "resolved_instances": 2, "resolved_ids": ["r__1", "r__2"]})
    put(tmp_path, "tag-a-run2.json", {"submitted_instances": 4})
    put(tmp_path, "tag-a-run3.json", "{broken")
    rows = {r.run: r for r in R.read_reports(spark, f"{tmp_path}/*.json").collect()}
    assert set(rows) == {1, 2} and rows[1].tag == "tag-a"
    assert rows[2].resolved_ids == [] and rows[2].completed_instances == 0
    configs = spark.createDataFrame([("A", "tag-a"), ("B", "tag-b")], "label string, tag string")
    joined = {r.label: r for r in grades.with_run_config(configs, R.read_reports(spark, f"{tmp_path}/*.json")).collect()}
    assert (joined["A"].n_graded, joined["A"].pass1_mean, joined["A"].mean_completed, joined["A"].absent) == (2, 1.0, 1.5, False)
    assert (joined["B"].n_graded, joined["B"].absent) == (0, True)


def test_subset(spark, tmp_path):
    path = put(tmp_path, "s.json", {"description": "d", "n_instances": 2, "instance_ids": ["a", "b"], "freq": {"a": 3}})
    assert sorted(tuple(r) for r in R.read_subset(spark, path).collect()) == [("a", 2, 3), ("b", 2, 0)]


def test_slices_queue_and_logs(spark, tmp_path):
    put(tmp_path, "x-pass3-run1/job_3.sub", 'executable = a\nenvironment = "MODEL_DIR=/m JOB_ID=3 START=69 END=92 NUM_WORKERS=5"\n')
    put(tmp_path, "x-pass3-run1/job_4.sub", 'environment = "JOB_ID=x START=69"\n')
    specs = R.read_slice_specs(spark, f"{tmp_path}/*/job_*.sub").collect()
    assert [(r.job_id, r.start, r.end_at, r.expected) for r in specs] == [(3, 69, 92, 23)] and specs[0].run == "x-pass3-run1"
    queue = put(tmp_path, "queue.txt", " 12 2 MODEL_DIR=/m BASE_OUTPUT_DIR=/o/x-pass3-run1 JOB_ID=3 START=1\n13 5 JOB_ID=4\nbad line\n14 1 BASE_OUTPUT_DIR=/o/x-pass3-run2 JOB_ID=0\n")
    assert sorted(tuple(r) for r in R.read_active_jobs(spark, queue).collect()) == [(12, 2, "/o/x-pass3-run1", "x-pass3-run1", 3), (14, 1, "/o/x-pass3-run2", "x-pass3-run2", 0)]
    put(tmp_path, "logs/sub.12.log", "000 (12.000.000) 2026-01-01 09:00:00 Job submitted\n    detail\n001 (12.000.000) 2026-01-01 10:00:00 Job executing\n...\n012 (12.000.000) 2026-01-01 11:00:00 Job held\n005 (12.000.000) 2026-01-01 10:30:00 Job ended\n")
    put(tmp_path, "logs/sub.13.log", "000 (13.000.000) 2026-01-01 09:00:00 Job submitted\n")
    from trajmill.operators.attempts import attempt_elapsed

    log = R.read_job_logs(spark, f"{tmp_path}/logs/sub.*.log")
    assert log.count() == 5
    # The last line counts, although an earlier line is later in time.
    assert {r.cluster: r.elapsed for r in attempt_elapsed(log, ["cluster"]).collect()} == {12: 1800, 13: 0}


def test_vocab(spark, tmp_path):
    b = lambda t: base64.b64encode(t.encode()).decode()
    path = put(tmp_path, "vocab.txt", f"{b('a')} 0\n{b('é ')} 65534\n{b('x')} 65535\n{b('y')} z\n{b('q')} 1 2\n\n  {b('w')}   7  \n")
    assert sorted((bytes(r.token).decode(), r.rank) for r in R.read_vocab(spark, path).collect()) == [("a", 0), ("w", 7), ("é ", 65534)]


def test_jsonl_round_trip(spark, tmp_path):
    rows = [("i", [("user", "漢字 é \"q\" \n")], None, "m", None)]
    df = spark.createDataFrame(rows, "instance_id string, messages array<struct<role:string,content:string>>, patch string, model string, verified boolean")
    path = str(tmp_path / "o.jsonl")
    W.write_jsonl(df, path)
    assert R.read_jsonl(spark, path).collect() == df.collect()
    assert "漢字 é" in spark.read.text(path).first().value
    assert R.with_source_position(R.read_jsonl(spark, path)).first().row_id == 0


def test_tool_calls(spark, tmp_path):
    path = put(tmp_path, "t.jsonl", json.dumps({"instance_id": "i", "messages": [{"role": "assistant", "content": "c", "tool_calls": [{"function": {"name": "f", "arguments": "{}"}}, {"name": "g", "arguments": {"x": 1}}]}]}))
    text = R.read_chat_jsonl(spark, path).select(chat.render(F.col("messages"), with_calls=True).alias("t")).first().t
    assert text.count("<tool_call>") == 2 and '{"name": "f", "arguments": {}}' in text and '{"name": "g", "arguments": {"x": 1}}' in text


def test_saved_splits_and_resume(spark, tmp_path):
    df = spark.range(10).withColumn("shard", (F.col("id") % 3).cast("int"))
    df.write.parquet(str(tmp_path / "plain"))
    df.where("id < 4").write.parquet(str(tmp_path / "split" / "train"))
    assert R.read_saved(spark, str(tmp_path / "plain")).count() == 10 and R.read_saved(spark, str(tmp_path / "split")).count() == 4
    assert R.read_shard_dirs(spark, [str(tmp_path / "plain"), str(tmp_path / "split" / "train")]).count() == 14
    out = str(tmp_path / "out")
    W.write_pending(df.where("shard = 1").withColumn("v", F.lit(1)), out, ["shard"])
    W.write_pending(df.withColumn("v", F.lit(2)), out, ["shard"])
    assert {(r.shard, r.v) for r in spark.read.parquet(out).select("shard", "v").collect()} == {(0, 2), (1, 1), (2, 2)}
    assert W.pending(df, out, ["shard"]).count() == 0


def shards(spark, out):
    return {(r.shard, r.v): r["count"] for r in spark.read.parquet(out).groupBy("shard", "v").count().collect()}


def test_half_written_shard_is_written_again(spark, tmp_path):
    df = spark.range(30).withColumn("shard", (F.col("id") % 3).cast("int"))
    out = str(tmp_path / "out")
    W.write_pending(df.where("shard = 0").withColumn("v", F.lit(1)), out, ["shard"])
    # A job that died: files of shard 1 are there, but no commit.
    df.where("shard = 1 and id < 9").withColumn("v", F.lit(1)).write.mode("append").partitionBy("shard").parquet(out)
    assert shards(spark, out) == {(0, 1): 10, (1, 1): 3}
    W.write_pending(df.withColumn("v", F.lit(2)), out, ["shard"])
    assert shards(spark, out) == {(0, 1): 10, (1, 2): 10, (2, 2): 10}
    done = {r.shard: r.n_rows for r in W.commits(spark, out, ["shard"]).collect()}
    assert done == {0: 10, 1: 10, 2: 10}
    W.write_pending(df.withColumn("v", F.lit(3)), out, ["shard"])
    assert shards(spark, out) == {(0, 1): 10, (1, 2): 10, (2, 2): 10}


def test_shard_that_changed_after_its_commit(spark, tmp_path):
    df = spark.range(20).select("id", (F.col("id") % 2).cast("int").alias("shard"), F.create_map(F.lit("a"), "id").alias("m"), F.lit(None).cast("string").alias("s"))
    out = str(tmp_path / "out")
    W.write_pending(df.withColumn("v", F.lit(1)), out, ["shard"])
    assert W.damaged_shards(spark, out, ["shard"]).collect() == []
    name = next(f for f in os.listdir(f"{out}/shard=1") if f.endswith(".parquet"))
    os.remove(f"{out}/shard=1/{name}")
    df.where("shard = 1").withColumn("v", F.lit(7)).drop("shard").coalesce(1).write.mode("append").parquet(f"{out}/shard=1")
    assert [r.shard for r in W.damaged_shards(spark, out, ["shard"]).collect()] == [1]
    W.write_pending(df.withColumn("v", F.lit(2)), out, ["shard"])  # trusts the commits
    assert shards(spark, out).get((1, 7))
    W.write_pending(df.withColumn("v", F.lit(2)), out, ["shard"], verify=True)
    assert shards(spark, out) == {(0, 1): 10, (1, 2): 10}
    assert W.damaged_shards(spark, out, ["shard"]).collect() == []


@pytest.mark.parametrize("name", ["PRETOKEN_PATTERN", "LOG_LINE_PATTERN", "SLICE_PATTERN"])
def test_patterns_compile_in_the_jvm(spark, name):
    spark.range(1).select(F.lit("x").rlike(getattr(C, name))).collect()


def test_folders_are_listed_by_few_tasks(spark, tmp_path):
    cores, folders = spark.sparkContext.defaultParallelism, 5 * spark.sparkContext.defaultParallelism + 33
    for i in range(folders):
        put(tmp_path, f"{i}/{i}.traj.json", {"instance_id": f"a__{i}"})
    name = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before = spark.conf.get(name)
    spark.sparkContext.setJobGroup("listing", "listing")
    rows = R.read_trajectory_files(spark, str(tmp_path))
    spark.sparkContext.setJobGroup("reading", "reading")
    tracker = spark.sparkContext.statusTracker()
    stages = [tracker.getStageInfo(s) for j in tracker.getJobIdsForGroup("listing") for s in tracker.getJobInfo(j).stageIds]
    assert stages and max(s.numTasks for s in stages) <= 4 * cores and spark.conf.get(name) == before
    assert rows.select("instance_id").distinct().count() == folders


def test_large_shards_are_cut(spark, tmp_path):
    """A shard's files are as many as its bytes ask for, and rows stay whole."""
    ids = F.transform(F.sequence(F.lit(1), F.lit(50)), lambda i: F.hash("id", i))
    rows = spark.range(0, 8000, 1, 8).select("id", (F.col("id") % 2).cast("int").alias("shard"), ids.alias("input_ids"), F.array_repeat(F.lit(1), 50).alias("completion_mask"), F.array(F.lit(50)).alias("seq_lengths"))
    name, path = "spark.sql.adaptive.advisoryPartitionSizeInBytes", str(tmp_path / "shards")
    before = spark.conf.get(name)
    spark.conf.set(name, "100kb")
    try:
        W.write_tokenized(rows, path, spread_by="id", files_per_shard=2)
    finally:
        spark.conf.set(name, before)
    found = R.read_shards(spark, path)
    assert sorted(r[0] for r in found.select("shard").distinct().collect()) == [0, 1]
    assert found.exceptAll(rows.select(*found.columns)).isEmpty() and found.count() == 8000
    assert min(len([f for f in os.listdir(f"{path}/shard={i}") if f.endswith(".parquet")]) for i in (0, 1)) > 2
