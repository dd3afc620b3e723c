import pytest
from pyspark.sql import functions as F

from tests.llm.fixtures import ROWS, documents, empty, odd
from trajmill.llm import exact, sharding


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("key_bits, capacity", [(64, 8192), (64, 2), (3, 2)])
def test_exact_dedup_equals_a_dictionary(spark, key_bits, capacity):
    texts = {i: f"text {i % 37}" * (i % 5) for i in range(300)}
    got = {r.doc_id: r for r in exact.deduplicate(documents(spark, texts), capacity=capacity, key_bits=key_bits).collect()}
    groups = {}
    for i, t in texts.items():
        groups.setdefault(t, []).append(i)
    assert len(got) == len(texts)
    for i, t in texts.items():
        assert (got[i].keep_id, got[i].group_size, got[i].kept) == (max(groups[t]), len(groups[t]), i == max(groups[t]))


def test_buckets_split_until_they_fit_and_chains_number_collisions(spark):
    docs = documents(spark, {i: f"t{i}" for i in range(500)})
    index = exact.build_index(docs, capacity=4)
    assert index.entries.groupBy("bucket").count().agg(F.max("count")).first()[0] <= 4
    assert index.directory.agg(F.max("level")).first()[0] >= 8
    chained = exact.build_index(docs, capacity=4, key_bits=3)
    sizes = {r["key"]: r for r in chained.entries.groupBy("key").agg(F.count("*").alias("n"), F.max("chain").alias("c")).collect()}
    assert len(sizes) == 8 and all(r.n == r.c for r in sizes.values())


@pytest.mark.parametrize("key_bits", [64, 3])
def test_rows_of_another_table_find_equal_bytes_only(spark, key_bits):
    index = exact.build_index(documents(spark, {i: f"t{i % 50}" for i in range(200)}), capacity=4, key_bits=key_bits)
    got = {r.doc_id: r for r in index.lookup(documents(spark, {i: f"t{i}" for i in range(100)})).collect()}
    assert len(got) == 100
    for i, row in got.items():
        assert (row.keep_id, row.group_size) == ((i + 150, 4) if i < 50 else (None, None))


def test_a_wrong_directory_gives_wrong_results(spark):
    """Rows reach their entries through the directory alone."""
    docs = documents(spark, {i: f"t{i % 400}" for i in range(500)})
    index = exact.build_index(docs, capacity=4)
    assert index.indexed().count() == 500 and index.lookup(docs).filter("keep_id IS NULL").count() == 0
    wrong = index.directory.withColumn("depth", F.when(F.col("slot") % 2 == 0, F.lit(64)).otherwise(F.col("depth")))
    broken = exact.ExactIndex(index.entries, wrong, index.key_bits, index.rows)
    assert broken.indexed().count() < 400 and broken.lookup(docs).filter("keep_id IS NULL").count() > 100


def test_a_deep_directory_is_joined_in_copies(spark):
    docs = documents(spark, {i: f"t{i % 400}" for i in range(500)})
    index = exact.build_index(docs, capacity=1)
    deep = index.directory.agg(F.max("level")).first()[0]
    assert deep > 2 * exact.STRIDE or index.entries.groupBy("bucket").count().agg(F.max("count")).first()[0] == 1
    assert index.indexed().count() == 500 and index.indexed().agg(F.sum("group_size")).first()[0] == 100 * 4 + 300


def test_exact_dedup_of_odd_rows(spark):
    rows = exact.deduplicate(odd(spark)).collect()
    assert len(rows) == len(ROWS)
    prose = [r for r in rows if r.group_size == 4]
    assert len(prose) == 4 and {r.keep_id for r in prose} == {2} and sum(r.kept for r in prose) == 2
    blank = [r for r in rows if r.text_sha256.startswith("e3b0c442")]
    assert len(blank) == 3 and {r.keep_id for r in blank} == {4}
    assert exact.deduplicate(empty(spark)).count() == 0


def test_exact_and_sharding_stay_in_the_jvm(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for df in (exact.deduplicate(docs), sharding.shard_documents(docs, 40)[0]):
        assert not any(word in _plan(df) for word in ("Python", "Pandas", "Arrow", "Cartesian", "NestedLoop"))


def test_shards_are_near_equal_and_places_have_no_gaps(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    placed, _ = sharding.shard_documents(docs, 8)
    rows = placed.collect()
    by = {}
    for r in rows:
        by.setdefault(r.shard, []).append(r)
    assert sorted(by) == list(range(8)) and len(rows) == docs.count()
    loads = [sum(r["size"] for r in part) for part in by.values()]
    assert max(loads) <= 1.01 * min(loads)
    assert all(sorted(r.place for r in part) == list(range(len(part))) for part in by.values())
    same = {}
    for r in rows:
        same.setdefault(r.text_crc32, []).append(r)
    small = [g for g in same.values() if sum(r["size"] for r in g) <= sharding.WHOLE_SHARE * sum(loads) / 8]
    assert all(len({r.shard for r in g}) == 1 for g in small) and sum(len(g) > 1 for g in small) > 5


def test_a_group_of_a_third_of_all_rows_is_spread(spark):
    texts = {i: "copy" * 50 if i % 3 == 0 else f"own {i} " * 20 for i in range(3000)}
    rows = sharding.shard_documents(documents(spark, texts), 10)[0].groupBy("shard").agg(F.sum("size").alias("s")).collect()
    assert max(r.s for r in rows) <= 1.1 * min(r.s for r in rows)


def test_rebalancing_writes_a_version_and_moves_little(spark):
    docs = documents(spark, {i: f"row {i} " * (1 + i % 7) for i in range(2000)})
    placed, first = sharding.shard_documents(docs, 4, slots=256)
    loads = sharding.slot_loads(placed, 256)
    second = first.rebalance(loads, 5)
    assert (first.version, second.version) == (1, 2) and second.table(1).count() == 256
    old, new = ({r.slot: r.shard for r in m.table().collect()} for m in (first, second))
    assert set(new.values()) == set(range(5))
    assert sum(old[s] != new[s] for s in old) <= 0.3 * 256
    third = second.rebalance(loads, 3)
    assert set(r.shard for r in third.table().collect()) == {0, 1, 2}


def test_sharding_of_odd_rows(spark):
    rows = sharding.shard_documents(odd(spark), 3)[0].collect()
    assert len(rows) == len(ROWS) and sorted({r.shard for r in rows}) == [0, 1, 2]
    assert sharding.shard_documents(empty(spark), 3)[0].count() == 0
    with pytest.raises(ValueError):
        sharding.shard_documents(empty(spark), 9000)


def test_repeated_rows_are_spread(spark):
    """A third of the rows have one id and one text."""
    rows = [(7, "the same text " * 5)] * 2000 + [(i, f"text {i} " * 6) for i in range(100, 4100)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    placed, _ = sharding.shard_documents(df, 10)
    sizes = [r.bytes for r in placed.groupBy("shard").agg(F.sum("size").alias("bytes")).collect()]
    assert len(sizes) == 10 and max(sizes) < 1.1 * min(sizes)
    places = placed.groupBy("shard").agg(F.count("*").alias("n"), F.countDistinct("place").alias("d"), F.max("place").alias("m")).collect()
    assert all(r.n == r.d == r.m + 1 for r in places)
