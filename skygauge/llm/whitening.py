"""Whitening of embeddings on their leading principal components, by Chebyshev-filtered subspace iteration.

Entries become integers x = floor(1024 c) + 100000. The covariance V is never formed: all that is
asked of the data is V Q for a thin matrix Q, one pass in which each task sums the centred
rows' x (x^T Q) and the sums meet by row of Q. A few Lanczos passes bound the lowest eigenvalue. Then each cycle applies a
polynomial of V to a block of vectors by the Chebyshev recurrence, a pass a degree: it stays small on the
interval of unwanted eigenvalues (from that bound to the block's least Ritz value) and grows fast above it. QR and a
Rayleigh-Ritz step follow. It ends when each wanted pair's residual |V u - e u| is under `tolerance` of the largest eigenvalue
and a further cycle no longer halves it; if it doesn't get there in max_cycles, that is an error. A block as wide as
the vectors is done after one Rayleigh-Ritz step.

Only d x block numbers reach the driver in a pass, however many rows there are. Rows are stored once, as integers; a lost executor
costs a read. Eigenvectors of equal eigenvalues are any basis of theirs.

Rows with a vector that is null, empty, or holds null or non-finite entries, or one of 2^30 or more (whose products wouldn't
be exact), are dropped; so are those whose length isn't the most common one (of equally common ones the longest). Repeated rows and null ids are rows like others. Directions
without variance have no component: with r of them fewer are returned, and none for one row or for
equal rows; an empty table gives no rows. Only the named columns are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skygauge.llm.common import exact_id, give_back, materialize, schema

SCALE, SHIFT = 1024, 100_000
#: Residuals that rounding alone leaves, as a share of the largest eigenvalue.
FLOOR = 1e-13
LARGEST = float(1 << 30)


@dataclass(frozen=True)
class WhitenConfig:
    components: int = 8
    #: Vectors of the block beyond the wanted ones, degree of the polynomial, Lanczos steps for the bound.
    guard: int = 16
    degree: int = 12
    bound_steps: int = 8
    tolerance: float = 1e-11
    max_cycles: int = 60
    #: Eigenvalues under this share of the largest count as none.
    rank_tolerance: float = 1e-10
    seed: int = 0


@dataclass(frozen=True)
class Moments:
    """Number of rows and sums of each dimension."""

    n: int
    sums: np.ndarray

    def centred(self, rows: np.ndarray) -> np.ndarray:
        """Rows less the mean: n x - S is exact where it fits a long integer, and rounded once by the division."""
        if self.n * (float(np.abs(rows).max(initial=0)) + float(np.abs(self.sums / self.n).max())) < 2.0**62:
            return (self.n * rows - self.sums) / self.n
        return rows - self.sums / self.n


@dataclass(frozen=True)
class Whitening:
    moments: Moments
    vectors: np.ndarray
    values: np.ndarray
    trace: float


def integers(vector: str) -> Column:
    """The vector's entries as long integers; null if one is null, not finite or too large."""
    entry = lambda c: F.floor(c.cast("double") * SCALE) + SHIFT
    bad = lambda c: c.isNull() | F.isnan(c) | (F.abs(c.cast("double")) >= LARGEST)
    return F.when(F.col(vector).isNotNull() & (F.size(vector) > 0) & ~F.exists(vector, bad), F.transform(F.col(vector), entry))


def _packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        yield batch.assign(x=[np.asarray(x, "<i8").tobytes() for x in batch["x"]])


def prepare(vectors: DataFrame, id_col: str, vector_col: str) -> tuple[DataFrame, int]:
    """Stored id, no_id and x (bytes of long integers) of the rows that count, and their length (0: none)."""
    rows = vectors.select(*exact_id(id_col), integers(vector_col).alias("x")).where("x IS NOT NULL")
    packed = materialize(rows.mapInPandas(_packed, schema("id long, no_id boolean, x binary")))
    common = packed.groupBy(F.octet_length("x").alias("bytes")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("bytes")).first()
    if common is None:
        return packed, 0
    return packed.where(F.octet_length("x") == common["bytes"]), common["bytes"] // 8


def _matrix(batch: pd.DataFrame, d: int) -> np.ndarray:
    return np.frombuffer(b"".join(batch["x"]), "<i8").reshape(-1, d)


def _summed(rows: DataFrame, partial, shape: tuple[int, int], whole: bool = False) -> np.ndarray:  # noqa: ANN001
    """The sum over all batches of partial(batch), a matrix of that shape: each task sums its own, then rows of the same number meet."""
    names, kind, added = [f"v{j}" for j in range(shape[1])], T.LongType() if whole else T.DoubleType(), "decimal(38,0)" if whole else "double"
    out = T.StructType([T.StructField("row", T.IntegerType()), *(T.StructField(x, kind) for x in names)])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(shape, np.int64 if whole else np.float64)
        any_ = False
        for batch in batches:
            if len(batch):
                total += partial(batch)
                any_ = True
        if any_:
            yield pd.DataFrame(total, columns=names).assign(row=np.arange(shape[0], dtype=np.int32))[out.names]

    total = np.zeros(shape, object if whole else np.float64)
    for r in rows.mapInPandas(run, out).groupBy("row").agg(*(F.sum(F.col(x).cast(added)).alias(x) for x in names)).collect():
        total[r["row"]] = [r[x] for x in names]
    return total


def moments(rows: DataFrame, d: int) -> Moments:
    both = _summed(rows, lambda b: np.concatenate([[len(b)], _matrix(b, d).sum(axis=0)])[None, :], (1, d + 1), True)[0]
    return Moments(int(both[0]), np.array([int(x) for x in both[1:]], np.int64))


def product(rows: DataFrame, m: Moments, q: np.ndarray) -> np.ndarray:
    """V q for the covariance V of all rows: one pass."""
    d = len(q)

    def partial(batch: pd.DataFrame) -> np.ndarray:
        x = m.centred(_matrix(batch, d))
        return x.T @ (x @ q)

    return _summed(rows, partial, q.shape) / m.n


def trace(rows: DataFrame, m: Moments, d: int) -> float:
    return float(_summed(rows, lambda b: np.array([[np.square(m.centred(_matrix(b, d))).sum()]]), (1, 1))[0, 0]) / m.n


def lower_bound(rows: DataFrame, m: Moments, d: int, config: WhitenConfig) -> float:
    """A number near or under the least eigenvalue: the least Ritz value of a few Lanczos steps, less its residual."""
    v = np.random.default_rng(config.seed + 1).standard_normal(d)
    basis, alpha, beta = [v / np.linalg.norm(v)], [], []
    for _ in range(min(config.bound_steps, d)):
        w = product(rows, m, basis[-1][:, None])[:, 0]
        alpha.append(float(w @ basis[-1]))
        for u in basis * 2:
            w = w - (u @ w) * u
        beta.append(float(np.linalg.norm(w)))
        if beta[-1] <= 1e-12 * abs(alpha[0]):
            break
        basis.append(w / beta[-1])
    k = len(alpha)
    values, vectors = np.linalg.eigh(np.diag(alpha) + np.diag(beta[: k - 1], 1) + np.diag(beta[: k - 1], -1))
    return max(0.0, float(values[0] - abs(beta[-1] * vectors[-1, 0])))


def filtered(rows: DataFrame, m: Moments, q: np.ndarray, vq: np.ndarray, low: float, high: float, top: float, degree: int) -> np.ndarray:
    """A polynomial of V applied to q (vq: V q): bounded on [low, high], and 1 at top, by the scaled Chebyshev recurrence."""
    centre, half = (high + low) / 2, (high - low) / 2
    sigma = first = half / (top - centre)
    now, before = (vq - centre * q) * (sigma / half), q
    for _ in range(degree - 1):
        following = 1 / (2 / first - sigma)
        now, before = 2 * (following / half) * (product(rows, m, now) - centre * now) - sigma * following * before, now
        sigma = following
    return now


def eigenpairs(rows: DataFrame, m: Moments, d: int, config: WhitenConfig) -> tuple[np.ndarray, np.ndarray]:
    """The leading unit eigenvectors of the covariance as columns, and their eigenvalues, falling."""
    width = min(d, config.components + config.guard)
    wanted, low, best = min(config.components, d), 0.0, math.inf
    q = np.linalg.qr(np.random.default_rng(config.seed).standard_normal((d, width)))[0]
    for cycle in range(config.max_cycles + 1):
        vq = product(rows, m, q)
        small = q.T @ vq
        values, turn = np.linalg.eigh((small + small.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        q, vq = q @ turn, vq @ turn
        size = max(float(values[0]), 0.0)
        residual = float(np.linalg.norm(vq[:, :wanted] - q[:, :wanted] * values[:wanted], axis=0).max())
        if width == d or not size or residual <= config.tolerance * size and (residual > best / 2 or residual <= FLOOR * size):
            break
        if cycle == config.max_cycles:
            raise RuntimeError(f"eigenvectors not found: residual {residual / size:.1e} after {cycle} cycles")
        best = min(best, residual)
        if not cycle:
            low = lower_bound(rows, m, d, config)
        high = max(float(values[-1]), low + 1e-9 * size)
        if high >= size * (1 - 1e-12):  # all of the block's values are the same
            high = size * (1 - 1e-6)
        q = np.linalg.qr(filtered(rows, m, q, vq, min(low, high - 1e-9 * size), high, size, config.degree))[0]
    real = values[:wanted] > config.rank_tolerance * size
    return q[:, :wanted][:, real], values[:wanted][real]


def fit(rows: DataFrame, d: int, config: WhitenConfig | None = None) -> Whitening:
    """The whitening of prepared rows of length d."""
    config = config or WhitenConfig()
    m = moments(rows, d)
    vectors, values = eigenpairs(rows, m, d, config)
    return Whitening(m, vectors, values, trace(rows, m, d))


def projected(batch: pd.DataFrame, w: Whitening) -> np.ndarray:
    return w.moments.centred(_matrix(batch, len(w.vectors))) @ w.vectors / np.sqrt(w.values)


def identity_error(rows: DataFrame, w: Whitening) -> float:
    """The largest absolute entry of the whitened rows' covariance less the identity."""
    k, n = len(w.values), w.moments.n
    mean = _summed(rows, lambda b: projected(b, w).sum(axis=0)[None, :], (1, k))[0] / n

    def partial(batch: pd.DataFrame) -> np.ndarray:
        y = projected(batch, w) - mean
        return y.T @ y

    return float(np.abs(_summed(rows, partial, (k, k)) / n - np.eye(k)).max())


def deviations(x: np.ndarray, m: Moments) -> list[int]:
    """Sums of (n x - S)^2, exact."""
    most = m.n * (float(np.abs(x).max(initial=0)) + float(np.abs(m.sums / m.n).max()))
    away = m.n * (x if most < 2.0**62 else x.astype(object)) - m.sums
    if float(np.abs(away).max(initial=0)) ** 2 * away.shape[1] < 2.0**62:
        return np.square(away).sum(axis=1).tolist()
    return [sum(v * v for v in row) for row in away.tolist()]


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", config: WhitenConfig | None = None) -> DataFrame:
    """vec_id, component (from 1, by falling eigenvalue), n, deviation, whitened, explained and identity_error: a row for each row and component.

    deviation ends with an error where it exceeds 2^63 - 1.
    """
    rows, d = prepare(vectors, id_col, vector_col)
    out = schema("id long, no_id boolean, component int, n long, deviation long, whitened double, explained double, identity_error double")
    shown = lambda df: df.select(F.when(~F.col("no_id"), F.col("id")).alias("vec_id"), *out.names[2:])
    w = fit(rows, d, config) if d else None
    if w is None or not len(w.values):
        return shown(vectors.sparkSession.createDataFrame([], out))
    error, k = identity_error(rows, w), len(w.values)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            each = np.repeat(np.arange(len(batch)), k)
            yield pd.DataFrame({
                "id": batch["id"].to_numpy()[each], "no_id": batch["no_id"].to_numpy()[each], "component": np.tile(np.arange(1, k + 1, dtype=np.int32), len(batch)), "n": w.moments.n,
                "deviation": np.array(deviations(_matrix(batch, d), w.moments), np.int64)[each], "whitened": projected(batch, w).ravel(), "explained": np.tile(w.values / w.trace, len(batch)), "identity_error": error})
        give_back()

    return shown(rows.mapInPandas(run, out))
