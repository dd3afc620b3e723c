import random

import pytest
from pyspark.sql import functions as F

from trajmill.functions import arrays as A
from trajmill.operators import pack


def twin(lengths, capacity):
    """Scan all bins for the least sufficient room."""
    free, out = [], {}
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        n = min(lengths[i], capacity)
        fits = [b for b in range(len(free)) if free[b] >= n]
        b = min(fits, key=lambda b: (free[b], b)) if fits else len(free)
        if b == len(free):
            free.append(capacity)
        free[b] -= n
        out[i] = b
    return [out[i] for i in range(len(lengths))]


@pytest.mark.parametrize("seed", range(40))
def test_best_fit(seed):
    rng = random.Random(seed)
    lengths = [rng.choice([1, 5, 40, 99, 100, 150, rng.randrange(1, 100)]) for _ in range(rng.randrange(0, 60))]
    assert pack.best_fit(lengths, 100) == twin(lengths, 100)


def test_packs(spark):
    rng = random.Random(3)
    rows = [(100 + i, i, [i % 250] * rng.choice([1, 7, 30, 64, 80])) for i in range(170)]
    df = spark.createDataFrame(rows, "id bigint, position bigint, input_ids array<int>").withColumn(
        "completion_mask", F.transform("input_ids", lambda x: x % 2)
    )
    plan = pack.plan_packs(df.withColumn("n", F.size("input_ids")), "id", "n", "position", 64, 50)
    bins = {}
    for r in plan.collect():
        assert r.batch == (r.id - 100) // 50
        bins.setdefault((r.batch, r.bin), []).append((r.slot, r.id, r.piece))
    # Rows of 80 tokens are two pieces of a pack of 64; no token is lost.
    assert sum(map(len, bins.values())) == len(rows) + sum(len(r[2]) > 64 for r in rows) > len(rows)
    packs = pack.build_packs(df, plan, "id", 64).collect()
    assert len(packs) == len(bins)
    for p in packs:
        members = sorted(bins[(p.pack_id >> 20, p.pack_id & ((1 << 20) - 1))])
        want = [rows[i - 100][2][64 * piece : 64 * piece + 64] for _, i, piece in members]
        assert p.seq_lengths == [len(w) for w in want] and p.input_ids == sum(want, [])
        assert len(p.input_ids) <= 64 and len(p.completion_mask) == len(p.input_ids)


@pytest.mark.parametrize("n, want", [(0, [0]), (1, [0]), (64, [0]), (65, [0, 1]), (640, list(range(10)))])
def test_pieces(spark, n, want):
    assert spark.range(1).select(pack.pieces(F.lit(n), 64).alias("p")).first().p == want


def test_offsets_and_positions(spark):
    df = spark.createDataFrame([([3, 1, 2],), ([5],), ([2, 0, 1],), ([],)], "s array<int>")
    got = df.select(A.cu_seqlens(F.col("s")).alias("c"), A.position_ids(F.col("s")).alias("p")).collect()
    assert [r.c for r in got] == [[0, 3, 4, 6], [0, 5], [0, 2, 3], [0]]
    assert [r.p for r in got] == [[0, 1, 2, 0, 0, 1], [0, 1, 2, 3, 4], [0, 1, 0], []]


def test_stats(spark):
    df = spark.createDataFrame([(1, [1, 2], [0, 1]), (2, [1] * 4, [1] * 4), (3, [1], [0])], "id int, input_ids array<int>, completion_mask array<int>")
    r = pack.token_stats(df, "id", rows=2).first()
    assert (r.n_rows, r.avg_len, r.min_len, r.max_len, r.avg_unmasked) == (2, 3.0, 2, 4, 2.5)
