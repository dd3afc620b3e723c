"""What the stages of the pipeline take of an executor's memory."""

import random
import re
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.fixtures import documents
from trajmill.llm import arrow, decontaminate, simhash

SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


@pytest.fixture
def session(spark):
    yield spark
    spark.conf.unset(SETTING)


def test_stages_send_workers_few_rows_at_once(session):
    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], names=["size"])

    stage = corpus_pipeline.in_small_batches(lambda spark, docs, sf: docs.mapInArrow(sizes, "size long"))
    docs = session.range(0, 2000, 1, 1).select(F.repeat(F.lit("text "), 1000).alias("text"))
    sent = [r.size for r in stage(session, docs, "").collect()]
    assert sum(sent) > 4 * arrow.BATCH_BYTES and max(sent) < 1.2 * arrow.BATCH_BYTES
    for _, stage in corpus_pipeline.STAGES:
        session.conf.unset(SETTING)
        with pytest.raises((AttributeError, AnalysisException)):  # there are no tables
            stage(session, None, "")
        assert int(session.conf.get(SETTING).rstrip("b")) == arrow.BATCH_BYTES


def test_seeds_are_built_in_little_more_than_they_hold():
    draw = random.Random(3)
    items = ["".join(draw.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(200)) for _ in range(60)]
    tracemalloc.start()
    seeds = decontaminate.Seeds(items, decontaminate.EDITS)
    held, most = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    # All strings within one edit of a piece are in the tables, those that come twice only once.
    assert sum(len(t.keys) for t in seeds.tables.values()) > 100 * sum(map(len, items)) / 4
    assert all((t.keys[1:] > t.keys[:-1]).all() for t in seeds.tables.values())
    assert most < 1.5 * held + (2 << 20)


def test_tables_of_hashes_find_what_is_in_them(monkeypatch):
    monkeypatch.setattr(decontaminate, "KEYS", 7)  # parts end within runs of equal keys
    draw, low = np.random.default_rng(5), np.uint64((1 << 20) - 1)
    known = draw.integers(0, 1 << 63, size=40, dtype=np.uint64) & ~low
    keys = np.repeat(known, 3) | np.tile(np.array([1, 1, 2], dtype=np.uint64), 40)
    table = decontaminate._Table(keys, low)
    asked = np.concatenate([known, draw.integers(0, 1 << 63, size=500, dtype=np.uint64)])
    place, piece = table.find(asked)
    assert sorted(zip(place.tolist(), piece.tolist(), strict=True)) == [(at, p) for at in range(40) for p in (1, 2)]


def test_leaks_are_sought_without_another_kind_of_worker(spark):
    docs = spark.range(3).selectExpr("id AS doc_id", "'some text' AS text")
    items = spark.range(3).selectExpr("id AS item_id", "'five words are in this' AS text")
    for benchmark in (items, items.limit(0)):
        found = decontaminate.find_leaks(docs, benchmark)
        assert "ExistingRDD" not in found._jdf.queryExecution().executedPlan().toString()
        assert found.count() == 0 and found.columns == ["doc_id", "item_id", "distance", "item_chars", "start", "end", "similarity"]


def test_texts_of_pairs_go_to_workers_once(spark, monkeypatch):
    plans, write = [], simhash.scratch.materialize

    def seen(df, name, *options):
        if name == "similar":
            plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(df, name, *options)

    monkeypatch.setattr(simhash.scratch, "materialize", seen)
    words = [f"word{i}" for i in range(100)]
    texts = {0: " ".join(words), 1: " ".join([*words, "end"]), 2: " ".join(w + "x" for w in words)}
    assert {r.doc_id for r in simhash.without_near_duplicates(documents(spark, texts)).collect()} == {0, 2}
    assert plans and all(len(re.findall("MapInArrow|ArrowEvalPython", plan)) == 1 for plan in plans)
