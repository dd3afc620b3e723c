"""The keyed table: newest row per key, whole versions, bounded files."""

import os
import random

import pytest
from pyspark.sql import types as T

from trajmill.streaming import keyed_table
from trajmill.streaming.keyed_table import KeyedTable, Run

SCHEMA = T.StructType([T.StructField("k", T.StringType()), T.StructField("n", T.LongType()), T.StructField("s", T.StringType())])


def batch(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_newest_batch_wins_and_files_stay_few(spark, tmp_path):
    rng = random.Random(1)
    table, want = KeyedTable(spark, str(tmp_path / "t"), SCHEMA, ["k"]), {}
    for i in range(24):
        part = {rng.choice([None, *map(str, range(60))]): (rng.randint(0, 9), f"{i}") for _ in range(rng.choice([1, 5, 30]))}
        want |= part
        version = table.upsert(batch(spark, [(k, *v) for k, v in part.items()]), i)
        sizes = [r.rows for r in version.runs]
        assert all(a > keyed_table.GROWTH * b for a, b in zip(sizes, sizes[1:], strict=False))
        assert sum(sizes) <= 2 * len(want)
    assert rows(table.read()) == rows(batch(spark, [(k, *v) for k, v in want.items()]))
    # What no kept version names is gone.
    folders = [f for f in os.listdir(tmp_path / "t") if f.startswith("run-")]
    kept = {r.path for n in table._numbers() for r in table.version(n).runs}
    assert set(folders) == kept and len(table._numbers()) == keyed_table.KEEP


def test_order_columns_win_over_batches(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "t"), SCHEMA, ["k"], ["n", "s"])
    table.upsert(batch(spark, [("a", 5, "x"), ("a", 7, "y"), ("b", 1, "z")]), 0)
    table.upsert(batch(spark, [("a", 6, "late"), ("b", 1, "zz"), ("c", None, None)]), 1)
    assert rows(table.read()) == [("a", 7, "y"), ("b", 1, "zz"), ("c", None, None)]


def test_repeated_batch_changes_nothing(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "t"), SCHEMA, ["k"])
    table.upsert(batch(spark, [("a", 1, "x")]), 0)
    before = table.upsert(batch(spark, [("a", 2, "x")]), 1)
    assert table.upsert(batch(spark, [("a", 3, "other")]), 1) == before == table.version()
    assert table.upsert(batch(spark, [("a", 3, "other")]), 0) == before
    assert rows(table.read()) == [("a", 2, "x")]
    assert rows(KeyedTable(spark, str(tmp_path / "t"), SCHEMA, ["k"]).read()) == [("a", 2, "x")]


def test_reader_keeps_its_version(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "t"), SCHEMA, ["k"])
    old = table.upsert(batch(spark, [("a", 1, "x"), ("b", 1, "x")]), 0)
    reader = table.read()
    for i in range(1, 4):
        table.upsert(batch(spark, [("a", i, "y"), ("b", i, "y")]), i)  # merges all runs each time
    assert rows(reader) == [("a", 1, "x"), ("b", 1, "x")] == rows(table.read(old))
    assert rows(table.read()) == [("a", 3, "y"), ("b", 3, "y")]


def test_job_that_dies_leaves_the_version(spark, tmp_path, monkeypatch):
    table = KeyedTable(spark, str(tmp_path / "t"), SCHEMA, ["k"])
    before = table.upsert(batch(spark, [("a", 1, "x")]), 0)
    with monkeypatch.context() as m:
        m.setattr(KeyedTable, "_publish", lambda *_: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            table.upsert(batch(spark, [("a", 2, "y")]), 1)
    assert table.version() == before and rows(table.read()) == [("a", 1, "x")]
    table.upsert(batch(spark, [("a", 2, "y")]), 1)
    assert rows(table.read()) == [("a", 2, "y")]
    assert len([f for f in os.listdir(tmp_path / "t") if f.startswith("run-")]) == 3 - 1


def test_second_writer_fails(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "t"), SCHEMA, ["k"])
    first = table.upsert(batch(spark, [("a", 1, "x")]), 0)
    with pytest.raises(Exception, match="[Ee]xist"):
        table._publish(first)
    assert table.version() == first


def test_empty(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "t"), SCHEMA, ["k"])
    assert rows(table.read()) == [] and table.read().schema.names == SCHEMA.names
    table.upsert(batch(spark, []), 0)
    assert rows(table.read()) == [] and table.version().batch == 0


def test_merge_rule():
    together = lambda *sizes: KeyedTable._together([Run("", n) for n in sizes])
    assert together(5) == 1 and together(11, 5) == 1 and together(10, 5) == 2
    assert together(31, 10, 5) == 2 and together(30, 10, 5) == 3 and together(100, 3, 1) == 1 and together(7, 0) == 1
