"""Whole jobs from files to files."""

import json

import pytest
from pyspark.sql import functions as F

from trajmill import jobs
from trajmill.functions.text import home_rules
from trajmill.operators.encode import ByteEncoder
from trajmill.sources import readers as R

N = 90


@pytest.fixture(scope="module")
def corpus(tmp_path_factory):
    path = tmp_path_factory.mktemp("corpus") / "rows.jsonl"
    with open(path, "w", encoding="utf-8") as out:
        for i in range(N):
            turns = [{"role": "user", "content": f"ask {i}"}, {"role": "assistant", "content": "x" * (i % 40)}, {"role": "user", "content": "ok"}]
            row = {"instance_id": f"r__{i // 5 if i < 60 else 99 + i // 10}", "messages": turns[: 2 if i % 9 == 0 else 3], "patch": "p", "model": "m", "verified": i < 60 and i % 2 == 0}
            out.write(json.dumps(row) + "\n")
    return str(path)


def test_sample_and_verified(spark, corpus, tmp_path):
    jobs.sample(spark, corpus, str(tmp_path / "s.jsonl"), 10)
    assert R.read_jsonl(spark, str(tmp_path / "s.jsonl")).count() == 10
    counters = jobs.verified(spark, corpus, str(tmp_path / "v.jsonl"), 2).first()
    written = R.read_jsonl(spark, str(tmp_path / "v.jsonl"))
    assert counters.n_scanned == N and counters.n_verified == 30 and counters.n_written == written.count() == 24
    assert written.where("not verified").count() == 0


def test_mix(spark, corpus, tmp_path):
    report = jobs.mix(spark, corpus, str(tmp_path / "m.jsonl"), (2, 5)).first()
    rows = R.read_jsonl(spark, str(tmp_path / "m.jsonl"))
    assert rows.count() == report.final_rows and report.extra_rows > 0
    lines = sum(len(r.value) + 1 for r in spark.read.text(str(tmp_path / "m.jsonl")).collect())
    assert lines == report.final_chars


@pytest.mark.parametrize("shards", [1, 4])
def test_tokenize_and_load(spark, corpus, tmp_path, shards):
    out = str(tmp_path / "t")
    jobs.tokenize(spark, corpus, out, ByteEncoder(), shards, max_length=200)
    rows = R.read_shards(spark, out)
    assert rows.count() == N - 10 and rows.select("shard").distinct().count() == shards
    assert rows.where(F.size("input_ids") != F.get("seq_lengths", F.lit(0))).count() == 0
    half = jobs.training_rows(spark, out, (1, 2), seed=3)
    assert half.count() == (N - 10) // 2
    # A second run finds every shard finished.
    jobs.tokenize(spark, corpus, out, ByteEncoder(), shards, max_length=100)
    assert R.read_shards(spark, out).agg(F.max(F.size("input_ids"))).first()[0] > 100


def test_packs_stay_inside_shards(spark, corpus):
    tokens = jobs.tokenized(jobs.source_rows(spark, corpus), ByteEncoder(), 3, 300)
    packs = jobs.packed(tokens, 300, batch_rows=7).collect()
    sizes = {r.shard: [] for r in packs}
    for r in packs:
        assert len(r.input_ids) == sum(r.seq_lengths) <= 300
        sizes[r.shard] += r.seq_lengths
    want = {s: [] for s in sizes}
    for r in tokens.select("shard", "seq_lengths").collect():
        want[r.shard] += r.seq_lengths
    assert {s: sorted(v) for s, v in sizes.items()} == {s: sorted(v) for s, v in want.items()}


def test_too_long_rows(spark, corpus):
    rows = jobs.source_rows(spark, corpus)
    assert jobs.tokenized(rows, ByteEncoder(), max_length=130, drop_too_long=True).count() < N - 10
    assert jobs.tokenized(rows, ByteEncoder(), max_length=130, drop_too_long=True, compat=True).count() == N - 10


def test_merge_publish_and_sweep(spark, tmp_path):
    base = tmp_path / "x-run1"
    for j, patches in enumerate([{"a__1": "diff --git x", "b__2": ""}, {"b__2": "diff --git y"}]):
        (base / f"job_{j}").mkdir(parents=True)
        (base / f"job_{j}" / "preds.json").write_text(json.dumps({k: {"model_patch": v} for k, v in patches.items()}))
        for k in patches:
            (base / f"job_{j}" / f"{k}{j}.traj.json").write_text(json.dumps({"instance_id": k if j == 0 else f"{k}x", "messages": [{"role": "user", "content": "/home/ada/q"}]}))
    (tmp_path / "x-run1.json").write_text(json.dumps({"resolved_ids": ["a__1"], "completed_instances": 2}))
    jobs.merge(spark, str(base), str(tmp_path / "merged"))
    assert spark.read.parquet(str(tmp_path / "merged")).count() == 2
    totals = jobs.publish_runs(spark, [("m", 1, str(base), str(tmp_path / "x-run1.json"))], str(tmp_path / "pub"), home_rules("ada")).first()
    assert (totals.n_rows, totals.n_resolved, totals.resolved_so_far) == (3, 1, 1)
    configs = spark.createDataFrame([("A", "x"), ("B", "y")], "label string, tag string")
    tables = jobs.sweep(spark, str(tmp_path / "*-run*.json"), configs)
    assert {r.label: r.absent for r in tables["summary"].collect()} == {"A": False, "B": True}
    assert {(r.label, r.repo, r.n_instances) for r in tables["repositories"].collect()} == {("A", "a", 1), ("B", "a", 0)}


def test_watch(spark, tmp_path):
    run = tmp_path / "x-pass3-run1"
    run.mkdir()
    for j in range(3):
        (run / f"job_{j}.sub").write_text(f'environment = "JOB_ID={j} START={j * 2} END={j * 2 + 2} X=1"\n')
    (tmp_path / "queue").write_text(f"7 2 BASE_OUTPUT_DIR={run} JOB_ID=0\n8 5 BASE_OUTPUT_DIR={run} JOB_ID=1\n")
    (tmp_path / "sub.9.log").write_text("001 (9.000.000) 2026-01-01 10:00:00 Job executing\n005 (9.000.000) 2026-01-01 11:30:00 Job ended\n")
    recorded = spark.createDataFrame([("x-pass3-run1", 2, 9)], "run string, job_id int, cluster bigint")
    files = spark.createDataFrame([("x-pass3-run1", 8, "a"), ("x-pass3-run1", 8, "b")], "run string, cluster bigint, instance_id string")
    resubmits = spark.createDataFrame([("x-pass3-run1", 2, 1)], "run string, job_id int, resubmits int")
    got = jobs.watch(spark, f"{tmp_path}/*/job_*.sub", str(tmp_path / "queue"), recorded, files, f"{tmp_path}/sub.*.log", resubmits)
    assert {r.job_id: r.outcome for r in got.collect()} == {0: "inflight", 1: "done", 2: "ended_late"}
