"""Watermarked cycles: closed, open and late add up, and closed cycles leave the state."""

import random
from collections import Counter
from datetime import datetime, timedelta

from trajmill.streaming import cycles, streams as T

SCHEMA = "ts timestamp, kind string, n int, w string"
START = datetime(2024, 3, 1)


def land(spark, folder, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def run(spark, folder, target, **options):
    return cycles.watermarked_cycles(T.read_files(spark, folder, spark.read.parquet(folder).schema, **options), "ts", ["kind"], "30 minutes", target)


def counts(df):
    return {(r.cycle_start, r.kind): r.n for r in df.collect()}


def floor(ts):
    return START + timedelta(minutes=20 * ((ts - START) // timedelta(minutes=20)))


def test_parts_add_up(spark, tmp_path):
    rng, source, target = random.Random(2), str(tmp_path / "in"), str(tmp_path / "out")
    rows, newest, late, state = [], None, Counter(), []
    for k in range(5):
        part = [(START + timedelta(minutes=90 * k + rng.uniform(-120 if i % 9 == 0 else 0, 90)), rng.choice(["a", "b", None]), i, "x") for i in range(120)]
        land(spark, source, part)
        found = run(spark, source, target)
        if newest:
            late.update((floor(r[0]), r[1]) for r in part if floor(r[0]) + timedelta(minutes=20) <= newest - timedelta(minutes=30))
        rows += part
        newest = max(r[0] for r in rows)
        state.append([p["stateOperators"][0] for p in found.progress if p["stateOperators"]][-1])
        closed, open_ = counts(found.closed), counts(found.open)
        limit = newest - timedelta(minutes=30)
        # Every cycle that the watermark has passed is closed and has left the state, no other.
        assert all(c + timedelta(minutes=20) <= limit for c, _ in closed)
        assert all(c + timedelta(minutes=20) > limit for c, _ in open_)
        assert state[-1]["numRowsTotal"] == len(open_)
        got_late = Counter((floor(r.ts), r.kind) for r in found.late.collect())
        assert got_late == late
        assert Counter(closed) + Counter(open_) + got_late == Counter((floor(r[0]), r[1]) for r in rows)
    assert late and sum(s["numRowsDroppedByWatermark"] for s in state) == 0
    assert found.late.columns == ["ts", "kind", "n", "w"]


def test_several_batches_in_one_call(spark, tmp_path):
    source = str(tmp_path / "in")
    for k in (0, 300, 100):
        land(spark, source, [(START + timedelta(minutes=k + i), "a", i, "x") for i in range(10)])
    found = run(spark, source, str(tmp_path / "out"), maxFilesPerTrigger=1)
    assert found.late.count() == 10 and sum(counts(found.counted()).values()) == 20
    # Called again without new files, nothing changes.
    again = run(spark, source, str(tmp_path / "out"), maxFilesPerTrigger=1)
    assert again.late.count() == 10 and counts(again.counted()) == counts(found.counted())


def test_rows_without_a_time(spark, tmp_path):
    land(spark, str(tmp_path / "in"), [(None, "a", 1, "x"), (START, "a", 2, "x")])
    found = run(spark, str(tmp_path / "in"), str(tmp_path / "out"))
    assert counts(found.counted()) == {(START, "a"): 1} and found.late.count() == 0
