"""Whitening against a direct eigendecomposition of the exact covariance."""

from collections import defaultdict

import numpy as np
import pytest

from trajmill.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, label int, x string, n string, component string, part string"


def plain(vectors):
    """Scaled whole numbers, exact differences, eigenvalues (falling) and whitened rows of usable vectors."""
    x = np.floor(64 * np.array(vectors, np.float32).astype(float)).astype(np.int64) + 1_000_000
    n, sums = len(x), x.sum(0)
    difference = n * x - sums
    centred = difference / n
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    return difference, values[::-1], centred, axes[:, ::-1]


def check(df, vectors, ids):
    rows = df.collect()
    difference, values, centred, axes = plain(vectors)
    k = max((r.component for r in rows), default=0)
    got = defaultdict(list)
    for r in rows:
        got[r.vec_id].append(r)
    assert len(rows) == k * len(ids)
    assert {r.n for r in rows} <= {len(ids)} and len({r.identity_error for r in rows}) <= 1
    assert all(r.identity_error < 1e-9 for r in rows)
    table = np.array([[r.whitened for r in sorted(got[i], key=lambda r: r.component)] for i in ids])
    want = centred @ axes[:, :k] / np.sqrt(values[:k])
    assert all(r.deviation == (difference[at] ** 2).sum() for at, i in enumerate(ids) for r in got[i])
    for c in range(k):
        shares = {r.explained for r in rows if r.component == c + 1}
        assert len(shares) == 1 and shares.pop() == pytest.approx(values[c] / values.sum(), rel=1e-9)
    sign = np.sign((table * want).sum(0))
    assert np.abs(table * sign - want).max() < 1e-7
    return k


def table_of(spark, vectors, ids):
    return spark.createDataFrame([(i, None if v is None else [None if c is None else float(c) for c in v], 0, "x", "n", "c", "p") for i, v in zip(ids, vectors, strict=True)], SCHEMA)


def test_query(spark, sf):
    from trajmill.llm.queries import QUERIES

    rows = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    query = QUERIES["op13_whitening"](spark, sf)
    assert query.dtypes == [("vec_id", "bigint"), ("component", "int"), ("n", "bigint"), ("deviation", "bigint"), ("whitened", "double"), ("explained", "double"), ("identity_error", "double")]
    assert check(query, [r.embedding for r in rows], [r.vec_id for r in rows]) == 32


@pytest.mark.parametrize("dims, n", [(1, 9), (3, 50), (7, 200)])
def test_small_tables(spark, dims, n):
    rng = np.random.default_rng(dims)
    vectors = rng.normal(size=(n, dims)) * np.arange(1, dims + 1)
    df = table_of(spark, vectors, range(n)).repartition(40)
    assert check(whitening.whiten(df), vectors, list(range(n))) == dims


def test_odd_rows(spark):
    rng = np.random.default_rng(0)
    good = [list(v) for v in rng.normal(size=(30, 4))]
    good += [good[0]] * 20  # a third of the rows are one vector
    bad = [None, [1.0, None, 2.0, 3.0], [1.0, float("nan"), 0.0, 0.0], [float("inf"), 0.0, 0.0, 0.0], [], [1.0, 2.0], [1e30, 0.0, 0.0, 0.0]]
    df = table_of(spark, good + bad, range(len(good) + len(bad)))
    assert check(whitening.whiten(df), good, list(range(len(good)))) == 4
    df = df.unionByName(df.where("embedding is not null").selectExpr("cast(null as long) vec_id", "embedding", "label", "x", "n", "component", "part").limit(1))
    assert whitening.whiten(df).where("vec_id is null").count() == 4


def test_nothing_to_whiten(spark):
    assert whitening.whiten(table_of(spark, [], [])).collect() == []
    assert whitening.whiten(table_of(spark, [None], [1])).collect() == []
    assert whitening.whiten(table_of(spark, [[1.0, 2.0]] * 5, range(5))).collect() == []
    # One direction without spread is no component.
    flat = np.column_stack([np.arange(20.0), np.zeros(20), np.arange(20.0) % 3])
    assert {r.component for r in whitening.whiten(table_of(spark, flat, range(20))).collect()} == {1, 2}


def test_secular_roots():
    rng = np.random.default_rng(1)
    for n in (1, 2, 5, 40):
        poles, z = np.sort(rng.normal(size=n)) + np.arange(n) * 1e-3, rng.normal(size=n) * 10.0 ** rng.integers(-6, 2, n)
        roots, gaps = whitening.secular_roots(poles, z * z)
        assert np.allclose(roots, np.linalg.eigvalsh(np.diag(poles) + np.outer(z, z)), rtol=1e-12, atol=1e-12)
        assert np.allclose(gaps, poles[:, None] - roots, atol=1e-12)


def scatter(rows):
    centred = rows - rows.mean(0)
    return centred.T @ centred


def test_updates_keep_the_scatter():
    rng = np.random.default_rng(4)
    rows = np.floor(rng.normal(size=(400, 9)) * [1, 1, 1, 50, 50, 0, 3, 8, 20]).astype(np.int64)
    rows[:, 8] = rows[:, 3]  # equal and zero eigenvalues
    rows[100:300] = rows[7]
    whole, parts = whitening.Spectrum.empty(9), []
    whole.add(rows)
    for at in (0, 1, 60, 250):
        parts.append(whitening.Spectrum.empty(9))
        parts[-1].add(rows[at : {0: 1, 1: 60, 60: 250, 250: 400}[at]])
    joined = whitening.Spectrum.empty(9)
    for part in parts:
        joined.combine(part)
    for s in (whole, joined):
        assert s.n == 400 and s.sums == rows.sum(0).tolist()
        assert np.abs((s.vectors * s.values) @ s.vectors.T - scatter(rows)).max() < 1e-9 * scatter(rows).max()
        assert np.abs(s.vectors.T @ s.vectors - np.eye(9)).max() < 1e-11


def test_exact_differences_of_large_numbers():
    rows = np.array([[2**45, 3], [-(2**45), 5], [7, 1]], np.int64)
    centred = whitening.Centred(3 << 40, [int(s) << 40 for s in rows.sum(0)])
    want = [[(3 << 40) * int(v) - (int(s) << 40) for v, s in zip(r, rows.sum(0), strict=True)] for r in rows]
    assert [[int(v) for v in r] for r in centred.differences(rows)] == want
    assert centred.deviations(rows) == [s if (s := sum(v * v for v in r)) < 1 << 63 else None for r in want]
