"""Whitening of embeddings by an incremental eigendecomposition.

Every partition keeps a spectrum: the mean, the eigenvalues and the eigenvectors of the scatter
of the rows it has seen.  A further row changes the scatter by a centred rank-one term; the
new eigenvalues are the roots of a secular equation, whose terms without weight and equal poles
are deflated first.  The spectra of the partitions are combined in a tree of small groups, each
by rank-one updates with the eigenvectors of the other spectrum and with the difference of the
means.  A last pass over the rows projects them on the combined basis and solves the projected
problem (Rayleigh-Ritz), which takes out what rounding has left.

The state of a task is one spectrum, ``dims * (dims + 2)`` numbers, and the driver sees only
such states.  It is meant for up to some thousand dimensions.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F, types as T

from trajmill import scratch
from trajmill.llm.arrow import parts

SCALE = 64
COMPONENTS = 32
#: Spectra that one task combines.
FAN_IN = 16
#: Entries from here on count as not finite: their scaled values are no exact doubles.
LARGEST = 2.0**46
EPS = np.finfo(np.float64).eps
ROUNDS = 80


def secular_roots(poles: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The roots of ``1 + sum(weights / (poles - x))``, one above each pole.

    ``poles`` ascend and differ, ``weights`` are positive.  Returns the roots and ``poles[j] -
    roots[i]`` as a matrix; each root is kept as its distance from the nearer pole, so these
    differences are exact to rounding even where a root almost meets a pole.
    """
    n = len(poles)
    top = np.append(poles[1:], poles[-1] + weights.sum() * (1 + 8 * EPS))
    half = (top - poles) / 2
    columns = np.arange(n)
    upper = 1 + (weights[:, None] / (poles[:, None] - poles - half)).sum(0) < 0
    beyond, upper[-1] = upper[-1], False
    shifted = poles[:, None] - poles[columns + upper]
    low, high = np.where(upper, -half, 0.0), np.where(upper, 0.0, half)
    if beyond:
        low[-1], high[-1] = half[-1], 2 * half[-1]
    below = columns[:, None] <= columns
    x = (low + high) / 2
    with np.errstate(all="ignore"):
        for _ in range(ROUNDS):
            gaps = shifted - x
            terms = weights[:, None] / gaps
            value = 1 + terms.sum(0)
            done = np.abs(value) <= EPS * n * (1 + np.abs(terms).sum(0))
            if done.all():
                break
            low, high = np.where(value < 0, x, low), np.where(value > 0, x, high)
            # Each side of the root is replaced by one pole with the same value and slope.
            slopes = terms / gaps
            left_slope = np.where(below, slopes, 0).sum(0)
            right_slope = slopes.sum(0) - left_slope
            left, right = gaps[columns, columns], np.append(gaps[columns[1:], columns[:-1]], np.inf)
            a = (left + right) * value - left * right * (left_slope + right_slope)
            b = left * right * value
            c = value - left * left_slope - right * right_slope
            root = np.sqrt(np.maximum(a * a - 4 * b * c, 0))
            step = np.where(a <= 0, (a - root) / (2 * c), 2 * b / (a + root))
            step[-1] = left[-1] + left[-1] ** 2 * left_slope[-1] / (value[-1] - left[-1] * left_slope[-1])
            near = x + step
            x = np.where(done, x, np.where((near > low) & (near < high), near, (low + high) / 2))
    return poles[columns + upper] + x, shifted - x


def rank_one(values: np.ndarray, vectors: np.ndarray, z: np.ndarray, weight: float) -> tuple[np.ndarray, np.ndarray]:
    """The spectrum of ``vectors (diag(values) + weight z z') vectors'``; ``values`` ascend, ``weight`` is not negative."""
    v = np.sqrt(weight) * z
    norm = np.sqrt(v @ v)
    if norm == 0:
        return values, vectors
    tolerance = 8 * EPS * max(values[-1], norm * norm)
    live = np.flatnonzero(np.abs(v) * norm > tolerance)
    if not len(live):
        return values, vectors
    a, b = v[live[:-1]], v[live[1:]]
    if (np.diff(values[live]) * np.abs(a * b) <= tolerance * (a * a + b * b)).any():
        values, vectors, v, live = _without_equal_poles(values.copy(), vectors.copy(), v, live, tolerance)
    poles, signs = values[live], np.sign(v[live])
    roots, gaps = secular_roots(poles, v[live] ** 2)
    # The weights for which the computed roots are exact: with them the vectors are orthogonal.
    n = len(live)
    spread = poles - poles[:, None]
    below = np.arange(n)[:, None] > np.arange(n)
    under = np.where(below, spread, np.hstack([spread[:, 1:], np.ones((n, 1))]))
    exact = signs * np.sqrt(np.abs(np.prod(-gaps / under, axis=1)))
    turned = exact[:, None] / gaps
    turned /= np.sqrt((turned * turned).sum(0))
    values, vectors = values.copy(), vectors.copy()
    values[live], vectors[:, live] = roots, vectors[:, live] @ turned
    order = np.argsort(values, kind="stable")
    return values[order], vectors[:, order]


def _without_equal_poles(values, vectors, v, live, tolerance):
    """Turn pairs of (almost) equal eigenvalues so that the update has weight on one of them only."""
    v, kept = v.copy(), []
    before = live[0]
    for at in live[1:]:
        r = np.hypot(v[before], v[at])
        cos, sin = v[at] / r, v[before] / r
        gap = values[at] - values[before]
        if abs(gap * cos * sin) <= tolerance:
            vectors[:, [before, at]] = vectors[:, [before, at]] @ np.array([[cos, sin], [-sin, cos]])
            values[before], values[at] = values[before] + gap * sin * sin, values[at] - gap * sin * sin
            v[before], v[at] = 0.0, r
        else:
            kept.append(before)
        before = at
    return values, vectors, v, np.array([*kept, before])


@dataclass
class Spectrum:
    """Number, mean and eigendecomposition of the scatter of some rows, and their exact sums."""

    n: int
    sums: list[int]
    mean: np.ndarray
    values: np.ndarray
    vectors: np.ndarray

    @classmethod
    def empty(cls, dims: int) -> Spectrum:
        return cls(0, [0] * dims, np.zeros(dims), np.zeros(dims), np.eye(dims))

    def _move(self, mean: np.ndarray, n: int) -> None:
        delta = mean - self.mean
        self.values, self.vectors = rank_one(self.values, self.vectors, self.vectors.T @ delta, self.n * n / (self.n + n))
        self.mean, self.n = self.mean + delta * (n / (self.n + n)), self.n + n

    def add(self, rows: np.ndarray) -> None:
        """Take in rows of whole numbers; equal ones together."""
        self.sums = [a + int(b) for a, b in zip(self.sums, rows.sum(0), strict=True)]
        distinct, counts = np.unique(rows, axis=0, return_counts=True)
        for row, n in zip(distinct.astype(np.float64), counts.tolist(), strict=True):
            self._move(row, n)

    def combine(self, other: Spectrum) -> None:
        self.sums = [a + b for a, b in zip(self.sums, other.sums, strict=True)]
        for value, vector in zip(other.values, other.vectors.T, strict=True):
            if value > 0:
                self.values, self.vectors = rank_one(self.values, self.vectors, self.vectors.T @ vector, value)
        self._move(other.mean, other.n)

    def row(self, part: int) -> tuple:
        return (part, self.n, [Decimal(s) for s in self.sums], self.mean.tolist(), self.values.tolist(), self.vectors.ravel().tolist())

    @classmethod
    def of(cls, n: int, sums: list, mean: list, values: list, vectors: list) -> Spectrum:
        dims = len(mean)
        return cls(int(n), [int(s) for s in sums], np.array(mean, float), np.array(values, float), np.array(vectors, float).reshape(dims, dims))


_SPECTRUM = "part bigint, n bigint, sums array<decimal(38,0)>, mean array<double>, `values` array<double>, vectors array<double>"
_ARROW = pa.schema(
    [("part", pa.int64()), ("n", pa.int64()), ("sums", pa.list_(pa.decimal128(38, 0))), ("mean", pa.list_(pa.float64())), ("values", pa.list_(pa.float64())), ("vectors", pa.list_(pa.float64()))]
)


def whole_vectors(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``vec_id, x`` with ``x`` the scaled entries as whole numbers, without the shift that all share.

    A row whose vector is null or empty or has a null, infinite, undefined or very large entry
    (2^46 or more) goes.
    """
    usable = lambda c: F.coalesce(F.abs(c.cast("double")) < LARGEST, F.lit(False))
    rows = df.select(F.col(vec_id).alias("vec_id"), F.col(vector).alias("v")).where("size(v) > 0").where(F.forall("v", usable))
    return rows.select("vec_id", F.transform("v", lambda c: F.floor(c.cast("double") * SCALE).cast("long")).alias("x"))


def _matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for part in parts(batches):
        if part.num_rows:
            yield part, part.column("x").flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)


def spectrum(vectors: DataFrame, dims: int) -> Spectrum | None:
    """The spectrum of all rows; None without rows."""

    def of_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = Spectrum.empty(dims)
        for _, rows in _matrices(batches):
            state.add(rows)
        if state.n:
            row = state.row(TaskContext.get().partitionId())
            yield pa.RecordBatch.from_arrays([pa.array([value], f.type) for value, f in zip(row, _ARROW, strict=True)], schema=_ARROW)

    def combine(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("part")
        whole = Spectrum.empty(dims)
        for row in group.itertuples(index=False):
            whole.combine(Spectrum.of(*row[1:]))
        return pd.DataFrame([whole.row(int(group["part"].iloc[0]) // FAN_IN)], columns=group.columns)

    level = scratch.materialize(vectors.select("x").mapInArrow(of_partition, _SPECTRUM), "spectra")
    last = level.agg(F.max("part")).first()[0]
    while last:
        level = scratch.materialize(level.groupBy(F.floor(F.col("part") / FAN_IN)).applyInPandas(combine, _SPECTRUM), "spectra")
        last //= FAN_IN
    row = level.first()
    return Spectrum.of(*row[1:]) if row else None


def gram(vectors: DataFrame, dims: int, columns: int, project: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum of ``y' y`` over all rows, with ``y = project(x)``.  Tasks send ``columns ** 2`` numbers each."""

    def of_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((columns, columns))
        for _, rows in _matrices(batches):
            y = project(rows)
            total += y.T @ y
        yield pa.RecordBatch.from_arrays([pa.array([total.ravel().tolist()], pa.list_(pa.float64()))], names=["g"])

    sums = vectors.select("x").mapInArrow(of_partition, "g array<double>").select(F.posexplode("g")).groupBy("pos").agg(F.sum("col"))
    out = np.zeros(columns * columns)
    for at, value in sums.collect():
        out[at] = value
    return out.reshape(columns, columns)


class Centred:
    """``x - S / n`` with one rounding, from whole numbers."""

    def __init__(self, n: int, sums: list[int]) -> None:
        self.n, self.sums = n, sums

    def differences(self, rows: np.ndarray) -> np.ndarray:
        """``n x - S`` exactly."""
        most = max(1, int(np.abs(rows).max()), *map(abs, self.sums))
        if self.n * most < 1 << 61:
            return rows * self.n - np.array(self.sums, np.int64)
        return rows.astype(object) * self.n - np.array(self.sums, object)

    def __call__(self, rows: np.ndarray) -> np.ndarray:
        return (self.differences(rows) / self.n).astype(np.float64)

    def deviations(self, rows: np.ndarray) -> list[int | None]:
        """The sum of squares of the differences; null where it is no 64-bit number."""
        d = self.differences(rows)
        if int(np.abs(d).max()) ** 2 * d.shape[1] < 1 << 63:
            return (d.astype(np.int64) ** 2).sum(1).tolist()
        return [s if s < 1 << 63 else None for s in (d.astype(object) ** 2).sum(1)]


@dataclass
class Whitening:
    """The fitted transformation; ``axes`` turn centred rows into whitened ones."""

    centred: Centred
    axes: np.ndarray
    explained: np.ndarray
    identity_error: float


def dimensions(vectors: DataFrame) -> int:
    """The most frequent length (of equally frequent ones the greatest); 0 without rows."""
    sizes = vectors.groupBy(F.size("x").alias("dims")).agg(F.count(F.lit(1)).alias("n"))
    row = sizes.orderBy(F.desc("n"), F.desc("dims")).first()
    return row.dims if row else 0


def fit(vectors: DataFrame, dims: int, components: int = COMPONENTS) -> Whitening | None:
    """Fit to all rows of ``vectors`` (``x``, all of length ``dims``).

    Directions in which the rows do not differ (eigenvalue zero up to rounding) cannot be
    whitened and are no components.  None without rows.
    """
    rough = spectrum(vectors, dims)
    if rough is None:
        return None
    centred = Centred(rough.n, rough.sums)
    basis = np.linalg.qr(rough.vectors)[0]
    projected = gram(vectors, dims, dims, lambda rows: centred(rows) @ basis) / rough.n
    values, turned = np.linalg.eigh((projected + projected.T) / 2)
    kept = [i for i in range(dims - 1, -1, -1) if values[i] > dims * EPS * max(values[-1], 0)][:components]
    axes = (basis @ turned)[:, kept] / np.sqrt(values[kept])
    explained = values[kept] / np.trace(projected) if kept else np.zeros(0)
    n, k = rough.n, len(kept)
    moments = gram(vectors, dims, k + 1, lambda rows: np.column_stack([centred(rows) @ axes, np.ones(len(rows))])) / n
    mean = moments[:k, k]
    error = float(np.abs(moments[:k, :k] - np.outer(mean, mean) - np.eye(k)).max()) if k else 0.0
    return Whitening(centred, axes, explained, error)


def whiten(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """One row per usable vector and component.

    Columns: ``vec_id, component, n, deviation, whitened, explained, identity_error``.
    ``component`` counts from 1 by falling eigenvalue, ``n`` is the number of fitted rows,
    ``deviation`` the exact sum of ``(n x - S)^2`` (null beyond 64 bits), ``whitened`` the
    projection of ``x - S / n`` on the component over the root of its eigenvalue, ``explained``
    the eigenvalue's share of the trace, ``identity_error`` the largest entry of the covariance
    of the whitened rows minus the identity.

    Rows with a null vector or a null, undefined, infinite or very large entry go, and so do
    rows of another length than the most frequent one.  Repeated rows and null ids are rows
    like others.  An empty table, and one whose vectors are all equal, gives no rows.
    """
    vectors = whole_vectors(df, vec_id, vector)
    dims = dimensions(vectors)
    vectors = vectors.where(F.size("x") == dims)
    model = fit(vectors, dims, components) if dims else None
    id_type = vectors.schema["vec_id"].dataType
    schema = T.StructType(
        [
            T.StructField("vec_id", id_type),
            T.StructField("component", T.IntegerType()),
            T.StructField("n", T.LongType()),
            T.StructField("deviation", T.LongType()),
            T.StructField("whitened", T.DoubleType()),
            T.StructField("explained", T.DoubleType()),
            T.StructField("identity_error", T.DoubleType()),
        ]
    )
    if model is None or not len(model.explained):
        return df.sparkSession.createDataFrame([], schema)
    k = len(model.explained)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, rows in _matrices(batches):
            many = len(rows) * k
            ids = part.column("vec_id").take(pa.array(np.repeat(np.arange(len(rows)), k)))
            deviations = pa.array(model.centred.deviations(rows), pa.int64()).take(pa.array(np.repeat(np.arange(len(rows)), k)))
            yield pa.RecordBatch.from_arrays(
                [
                    ids,
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(rows))),
                    pa.array(np.full(many, model.centred.n)),
                    deviations,
                    pa.array((model.centred(rows) @ model.axes).ravel()),
                    pa.array(np.tile(model.explained, len(rows))),
                    pa.array(np.full(many, model.identity_error)),
                ],
                names=schema.names,
            )

    return vectors.mapInArrow(project, schema)
