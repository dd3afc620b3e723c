import hashlib
import random

import pytest
from pyspark.sql import functions as F

from trajmill.operators import blocks, ordering


def seeded(ids, seed):
    return sorted(ids, key=lambda i: (hashlib.md5(f"{seed}:{i}".encode()).hexdigest(), i))


@pytest.mark.parametrize("limit", [0, 1, 57, 1000, 4999, 10**9])
@pytest.mark.parametrize("edge_rows", [1, 100_000])
def test_cut_equals_running_total(spark, limit, edge_rows):
    rng = random.Random(limit)
    value = {i: rng.choice([1, 3, 30, 200]) for i in range(300)}
    df = spark.createDataFrame(list(value.items()), "id bigint, v bigint").withColumn("h", ordering.seed_hash(7, "id"))
    cut = ordering.find_cut(df, F.col("v"), limit, "h", "id", digits=1, edge_rows=edge_rows)
    want, total = set(), 0
    for i in seeded(value, 7):
        if total >= limit:
            break
        want.add(i)
        total += value[i]
    assert {r.id for r in df.where(cut.covers("h", "id")).collect()} == want


@pytest.mark.parametrize("n", [0, 1, 40, 100, 500])
def test_sample_has_exact_size_and_order(spark, n):
    df = spark.range(100)
    got = [r.id for r in ordering.sample_rows(df, n, 3, "id").orderBy("shuffle_key", "id").collect()]
    assert got == seeded(range(100), 3)[:n]


def test_sample_does_not_move_the_rows(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet")
    plan = ordering.sample_rows(df, 100, 0, "doc_id")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Sort" not in plan


def test_sample_scans_twice_at_any_size(spark, tmp_path):
    """Lines are parsed once for the counts and once for the rows, however deep the cut lies."""
    ids = [7] * 3000 + list(range(100, 400))  # one bucket holds most rows
    path = str(tmp_path / "in.jsonl")
    spark.createDataFrame([(i, f"text {i}") for i in ids], "id bigint, text string").write.json(path)
    parsed = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            parsed.add(batch.num_rows)
            yield batch

    rows = spark.read.schema("id bigint, text string").json(path).mapInArrow(count, "id bigint, text string")
    for n in (1, 250, 400, 5000):
        parsed.value = 0
        got = [r.id for r in ordering.sample_rows(rows, n, 3, "id").collect()]
        assert parsed.value <= 2 * len(ids)
        want = sorted(ids, key=lambda i: seeded([i], 3) and (hashlib.md5(f"3:{i}".encode()).hexdigest(), i))
        edge = want[min(n, len(ids)) - 1]
        cut = [i for i in want if (hashlib.md5(f"3:{i}".encode()).hexdigest(), i) <= (hashlib.md5(f"3:{edge}".encode()).hexdigest(), edge)]
        assert sorted(got) == sorted(cut)


def test_positions(spark):
    ids = random.Random(1).sample(range(10**6), 500)
    df = spark.createDataFrame([(i,) for i in ids], "id bigint")
    by_id = {r.id: r.pos for r in ordering.position_by(df, ["id"], "pos", partitions=7).collect()}
    assert by_id == {i: p for p, i in enumerate(sorted(ids))}
    by_seed = {r.id: r.pos for r in ordering.seeded_position(df, 5, "id", "pos", digits=1).collect()}
    assert by_seed == {i: p for p, i in enumerate(seeded(ids, 5))}


def test_positions_of_one_long_key(spark):
    rows = [("hot", t) for t in range(400)] + [("a", 0), ("b", 0), ("b", 1)]
    df = spark.createDataFrame(rows, "key string, turn int")
    got = {(r.key, r.turn): r.pos for r in ordering.position_by(df, ["key", "turn"], "pos").collect()}
    assert got == {k: p for p, k in enumerate(sorted(rows))}


@pytest.mark.parametrize("n", [1, 3, 250, 1000, 1001])
def test_id_cut(spark, n):
    rng = random.Random(n)
    ids = sorted({int(10 ** rng.uniform(0, 15)) for _ in range(1200)})[:1000]
    df = spark.createDataFrame([(i,) for i in ids], "id bigint")
    got = ordering.id_cut(df, n, "id", fanout=10, edge_rows=5)
    assert got == (ids[n - 1] if n <= len(ids) else None)


def test_prefixes_are_nested(spark):
    df = spark.range(0, 1000, 7)
    small = {r.id for r in ordering.prefix_rows(df, (1, 10), "id").collect()}
    large = {r.id for r in ordering.prefix_rows(df, (3, 10), "id").collect()}
    assert len(small) == 143 // 10 and len(large) == 143 * 3 // 10 and small < large
    assert ordering.prefix_rows(df, (1, 1000), "id").count() == 0


@pytest.mark.parametrize("rows,jobs", [(10, 3), (9, 3), (2, 5), (0, 4), (1, 1), (100, 7)])
def test_shards(spark, rows, jobs):
    df = spark.range(rows).select("id", ordering.floor_shard(F.col("id"), rows, jobs).alias("s"))
    per = rows // jobs
    want = {i: next(j for j in range(jobs) if j * per <= i < ((j + 1) * per if j < jobs - 1 else rows)) for i in range(rows)}
    assert {r.id: r.s for r in df.collect()} == want
    slices = [(r.job_id, r.start, r.end) for r in ordering.ceil_slices(df, rows, jobs).orderBy("job_id").collect()]
    size = -(-rows // jobs) if rows else 1
    assert slices == [(j, j * size, min((j + 1) * size, rows)) for j in range(jobs) if j * size < min((j + 1) * size, rows)]


def test_shuffle_is_a_permutation(spark):
    df = ordering.shuffled(spark.range(200), 42, "id", partitions=4)
    assert [r.id for r in df.collect()] == seeded(range(200), 42)


@pytest.mark.parametrize("block_rows", [1, 3, 4096])
def test_context_of_long_keys(spark, block_rows):
    rng = random.Random(block_rows)
    rows = [(k, p, rng.choice(["x", "y", None]), rng.randrange(9)) for k, n in (("hot", 60), ("a", 1), ("b", 7)) for p in rng.sample(range(200), n)]
    df = spark.createDataFrame(rows, "k string, p int, v string, n int")
    got = blocks.in_key_context(
        df, "k", "p", sums={"total": F.col("n")}, previous={"before": F.col("v")}, following={"after": F.col("v")}, block_rows=block_rows
    )
    want = {}
    for key in ("hot", "a", "b"):
        mine, total = sorted(r for r in rows if r[0] == key), 0
        for i, r in enumerate(mine):
            total += r[3]
            want[r[:2]] = (total, mine[i - 1][2] if i else None, mine[i + 1][2] if i + 1 < len(mine) else None)
    assert {(r.k, r.p): (r.total, r.before, r.after) for r in got.collect()} == want
