"""Caps and the budget mix against a sequential walk, with one key that holds a third of the rows."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from trajmill.operators import curate, predictions

SCHEMA = "row_id bigint, instance_id string, verified boolean, n_len bigint"


def make_rows(seed, n=240, keys=30, nulls=True):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        key = "hot" if rng.random() < 1 / 3 else f"k{rng.randrange(keys)}"
        if nulls and rng.random() < 0.02:
            key = None
        rows.append((i, key, rng.choice([True, False, False, False, None]) if key != "hot" else rng.choice([False, None]), rng.choice([5, 50, 120, 400, 5000])))
    rng.shuffle(rows)
    return rows


def walk(rows, num, den, max_size, seed, cap):
    """The sequential form: file order for verified rows, seeded order for the extras."""
    count, verified = {}, []
    for r in sorted(rows):
        if r[2] and count.get(r[1], 0) < cap:
            count[r[1]] = count.get(r[1], 0) + 1
            verified.append(r)
    covered = {r[1] for r in verified}
    target = sum(r[3] for r in verified) * num // den
    order = sorted((r for r in rows if not r[2] and r[1] not in covered), key=lambda r: (hashlib.md5(f"{seed}:{r[0]}".encode()).hexdigest(), r[0]))
    seen, extra, total, capped, oversize = {}, [], 0, 0, 0
    for r in order:
        if total >= target:
            break
        if seen.get(r[1], 0) >= cap:
            capped += 1
        elif r[3] > max_size:
            oversize += 1
        else:
            seen[r[1]] = seen.get(r[1], 0) + 1
            extra.append(r[0])
            total += r[3]
    return [r[0] for r in verified], sorted(extra), target, total, capped, oversize


@pytest.mark.parametrize(
    "seed,fraction,max_size",
    [(1, (2, 5), 1000), (2, (1, 20), 1000), (3, (50, 1), 1000), (4, (0, 1), 1000), (5, (2, 5), 100), (6, (1, 1), 10_000), (7, (9, 10), 130)],
)
def test_mix_equals_walk(spark, seed, fraction, max_size):
    rows = make_rows(seed)
    df = spark.createDataFrame(rows, SCHEMA)
    verified, extra, target, total, capped, oversize = walk(rows, *fraction, max_size, 42, 3)
    mix = curate.mix_under_budget(df, ["row_id"], "n_len", fraction, max_size)
    assert mix.target == target
    got = mix.rows().select("origin", "row_id").collect()
    assert sorted(r.row_id for r in got if r.origin == 0) == sorted(verified)
    assert sorted(r.row_id for r in got if r.origin == 1) == extra
    report = mix.report().first()
    assert (report.extra_rows, report.extra_chars, report.n_capped, report.n_oversize) == (len(extra), total, capped, oversize)
    assert report.final_rows == len(verified) + len(extra)


def test_counters(spark):
    rows = make_rows(11)
    df = spark.createDataFrame(rows, SCHEMA)
    verified = walk(rows, 0, 1, 10, 42, 3)[0]
    got = curate.build_counters(df, ["row_id"]).first()
    assert got.n_scanned == len(rows)
    assert got.n_verified == sum(bool(r[2]) for r in rows)
    assert got.n_written == len(verified)
    assert got.n_instances == len({r[1] for r in rows if r[2]})
    assert sorted(r.row_id for r in curate.cap_per_key(curate.verified_rows(df), ["row_id"]).collect()) == sorted(verified)


def test_empty_input(spark):
    df = spark.createDataFrame([], SCHEMA)
    mix = curate.mix_under_budget(df, ["row_id"], "n_len")
    assert mix.rows().count() == 0 and mix.report().first().final_rows == 0


def test_null_key_rules(spark):
    df = spark.createDataFrame([(1, None, False, 1), (2, "a", None, 1), (3, "a", True, 1), (4, "b", False, 1)], SCHEMA)
    left = curate.uncovered_rows(df, curate.verified_rows(df))
    assert sorted(r.row_id for r in left.collect()) == [1, 4]
    covered = spark.createDataFrame([(None,), ("b",)], "instance_id string")
    assert [r.row_id for r in curate.uncovered_rows(df, covered).collect()] == [2]


def test_message_and_length_filters(spark):
    rows = [(1, [("user", "a")] * 2), (2, [("user", "a")] * 3), (3, [])]
    df = spark.createDataFrame(rows, "id int, messages array<struct<role:string,content:string>>")
    assert [r.id for r in curate.with_min_messages(df).collect()] == [2]
    lens = spark.createDataFrame([(1, 9, [8]), (2, 8, [8])], "id int, orig_len int, seq_lengths array<int>")
    assert [r.id for r in curate.within_length(lens, 8).collect()] == [2]
    assert curate.within_length(lens, 8, compat=True).count() == 2


def test_hot_key_is_limited_before_the_shuffle(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet").withColumn("verified", F.col("doc_id") % 2 == 0)
    plan = curate.cap_per_key(df, ["doc_id"], key="source")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_filters_reach_the_scan(spark, tmp_path):
    def pushed(df):
        return df._jdf.queryExecution().executedPlan().toString().split("PushedFilters: [")[1].split("]")[0]

    spark.createDataFrame([(1, "a", True, 1)], SCHEMA).write.parquet(str(tmp_path / "t"))
    rows = spark.read.parquet(str(tmp_path / "t"))
    assert "verified" in pushed(curate.verified_rows(rows))
    assert "IsNull(verified)" in pushed(curate.unverified_rows(rows))
    spark.createDataFrame([("i", "diff --git")], "instance_id string, model_patch string").write.parquet(str(tmp_path / "p"))
    assert "StringStartsWith(model_patch" in pushed(predictions.valid_predictions(spark.read.parquet(str(tmp_path / "p"))))
