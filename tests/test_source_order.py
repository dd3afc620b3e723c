"""Rows are numbered by file and place, whatever the splits of a run; null keys stay; Unicode white space."""

import pytest
import regex
from pyspark.sql import functions as F

from trajmill import constants as C, jobs, scratch
from trajmill.functions.text import pretokenize
from trajmill.operators import audit, curate, pack
from trajmill.operators.blocks import in_key_context
from trajmill.sources import readers as R


def _files(tmp_path):
    at = 0
    for name, rows in (("part-1", 50), ("part-2", 5000), ("part-3", 700)):
        lines = "".join(f'{{"instance_id": "i{i}", "patch": "p{i % 7}", "model": "m", "verified": true}}\n' for i in range(at, at + rows))
        (tmp_path / f"{name}.jsonl").write_text(lines)
        at += rows
    return f"{tmp_path}/*.jsonl", at


def test_numbers_follow_files_under_any_split(spark, tmp_path):
    path, n = _files(tmp_path)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("4k", "64m"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            rows = jobs.source_rows(spark, path).select("row_id", "instance_id").collect()
            assert len(rows) == n and all(r.instance_id == f"i{r.row_id}" for r in rows)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert R.with_source_position(R.read_jsonl(spark, path)).where("row_id = 0").first().instance_id == "i0"


def test_a_resumed_job_keeps_each_row_once(spark, tmp_path):
    from trajmill.operators.encode import ByteEncoder

    (tmp_path / "in").mkdir()
    at = 0
    for name, rows in (("a", 20), ("b", 900), ("c", 200)):
        lines = "".join(f'{{"instance_id": "i{i}", "messages": [{{"role": "user", "content": "q"}}, {{"role": "assistant", "content": "row {i}"}}, {{"role": "user", "content": "ok"}}]}}\n' for i in range(at, at + rows))
        (tmp_path / "in" / f"{name}.jsonl").write_text(lines)
        at += rows
    source, whole, part = f"{tmp_path}/in/*.jsonl", f"{tmp_path}/whole", f"{tmp_path}/part"
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    jobs.tokenize(spark, source, whole, ByteEncoder(), 4, pack_rows=False)
    # An earlier run that got as far as two shards.
    spark.read.parquet(whole).where("shard < 2").write.partitionBy("shard").parquet(part)
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
        jobs.tokenize(spark, source, part, ByteEncoder(), 4, pack_rows=False)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    ids = lambda p: sorted(tuple(r.input_ids) for r in spark.read.parquet(p).select("input_ids").collect())
    assert len(set(ids(part))) == at and ids(part) == ids(whole)


def test_null_keys_keep_their_rows(spark):
    rows = spark.createDataFrame([("k", 0, 1), (None, 0, 2), (None, 1, 3)], "key string, at int, n int")
    got = in_key_context(rows, "key", "at", sums={"total": F.col("n")}).collect()
    assert sorted((r.key or "", r.at, r.total) for r in got) == [("", 0, 2), ("", 1, 5), ("k", 0, 1)]


def test_pieces_with_unicode_white_space(spark):
    texts = ["a\u2003\u2003d", "a\u00a0b", "x\u3000\u3000y", "a\u0085b", "plain words, 123  and\n\n more", "\u2003\n é"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", pretokenize(F.col("t")).alias("p")).collect()
    for r in rows:
        assert r.p == regex.findall(C.PRETOKEN_PATTERN, r.t), r.t
    assert rows[0].p == ["a", "\u2003", "\u2003d"]


def test_batches_beyond_the_pack_ids_are_refused(spark):
    rows = spark.createDataFrame([(0, 1, 0)], "id int, n int, at int")
    with pytest.raises(ValueError):
        pack.plan_packs(rows, "id", "n", "at", 8, batch_rows=(1 << 20) + 1)


def test_long_rows_are_packed_whole(spark):
    tokens = spark.createDataFrame([(0, list(range(12)), [1] * 12), (1, [1, 2], [0, 1])], "id int, input_ids array<int>, completion_mask array<int>")
    placed = spark.createDataFrame([(0, 12, 0), (1, 2, 1)], "id int, n int, at int")
    packs = pack.build_packs(tokens, pack.plan_packs(placed, "id", "n", "at", 8), "id", 8).collect()
    assert sorted(t for r in packs for t in r.input_ids) == sorted([*range(12), 1, 2]) and all(len(r.input_ids) <= 8 for r in packs)


def test_evaluated_instances_and_test_texts_leave_the_training_set(spark):
    rows = spark.createDataFrame([(1, "a", "One  text"), (2, "b", "other"), (3, None, None)], "id int, instance_id string, body string")
    kept = curate.without_evaluated(rows, spark.createDataFrame([("b",)], "instance_id string"))
    assert {r.id for r in kept.collect()} == {1, 3}
    tests = spark.createDataFrame([("ONE text",), (None,)], "text string")
    assert {r.id for r in curate.without_test_texts(rows, tests, "body").collect()} == {2, 3}


def test_degenerate_texts(spark):
    rows = spark.createDataFrame([(1, "la la la la"), (2, "a\na\na"), (3, "all fine here"), (4, None), (5, "")], "id int, text string")
    assert {r.id: r.degenerate for r in audit.degenerate_texts(rows, "text").collect()} == {1: True, 2: True, 3: False, 4: False, 5: False}


def test_scratch_tables_are_removed_with_their_job(spark, tmp_path):
    path, n = _files(tmp_path)
    with scratch.cleaned(spark):
        rows = jobs.source_rows(spark, path)
        assert rows.count() == n
        made = [p for p in scratch._open[-1] if R.path_exists(spark, p)]
    assert made and not any(R.path_exists(spark, p) for p in made)


def test_running_attempts_are_in_flight(spark):
    from trajmill.streaming.streams import attempt_decisions

    states = spark.createDataFrame([(1, 3, None, None), (2, 3, None, None)], "cluster int, coverage long, started_at timestamp, last_at timestamp")
    active = spark.createDataFrame([(1,)], "cluster int")
    got = {r.cluster: r.outcome for r in attempt_decisions(states, ["cluster"], F.lit(9), F.lit(0), active).collect()}
    assert got[1] == "inflight" and got[2] != "inflight"
