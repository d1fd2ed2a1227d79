"""Whitening of vectors: principal components of their covariance by contour integration (FEAST), scaled to variance one.

Entries become integers, so that counts and sums are exact. Three passes over the vectors: the sums, the covariance
(centred before multiplying), the projections; a task sends a row of sums for each dimension, which Spark adds up. The
driver holds the covariance, dimensions squared, whatever the number of vectors.

There, eigenvalues are counted, not guessed: the negative pivots of V - s I are the eigenvalues below s (Sylvester's
inertia). The axis is cut by such counts into intervals of few eigenvalues, from the top. In each interval the
projector on its eigenvectors, an integral of the resolvent around the interval, is applied to some random vectors by
Gauss-Legendre quadrature, that is by complex shifted solves; Rayleigh-Ritz extracts eigenpairs from what comes out, and
this repeats until their residuals vanish and their number is the counted one (Polizzi, 2009).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep

#: Eigenvalues under this share of the largest count as zero: their directions can't be told from rounding.
ZERO = 1e-11


def below(v: np.ndarray, shift: float) -> int:
    """How many eigenvalues of a symmetric matrix lie below a shift: the negative pivots of its factors, pivots of one or two rows (Bunch and Parlett, 1971)."""
    m, count, alpha = v - shift * np.eye(len(v)), 0, (1 + np.sqrt(17)) / 8
    while len(m):
        off = np.abs(np.triu(m, 1))
        r = int(np.abs(m.diagonal()).argmax())
        if abs(m[r, r]) >= alpha * off.max():
            pivot = [r]
            count += int(m[r, r] < 0)
        else:
            pivot = list(np.unravel_index(off.argmax(), off.shape))
            count += 1  # the determinant of such a pivot is negative
        rest = np.setdiff1d(np.arange(len(m)), pivot)
        if not m[pivot][:, pivot].any():
            break  # nothing is left
        edge = m[np.ix_(rest, pivot)]
        m = m[np.ix_(rest, rest)] - edge @ np.linalg.solve(m[np.ix_(pivot, pivot)], edge.T)
    return count


def intervals(v: np.ndarray, wanted: int, most: int = 8) -> Iterator[tuple[float, float, int]]:
    """(low, high, count) from the top of the spectrum down, until `wanted` eigenvalues over zero are held; at most `most` each where they are apart."""
    top = float(np.abs(v).sum(axis=1).max())  # no eigenvalue is larger
    if top <= 0:
        return
    gap = 1e-10 * top
    ends = (ZERO * top, top * (1 + 1e-9))
    open_ = [(*ends, below(v, ends[1]) - below(v, ends[0]))]
    got = 0
    while open_ and got < wanted:
        low, high, n = open_.pop()
        if n > most and high - low > 4 * gap:
            for share in (0.5, 0.45, 0.55, 0.4, 0.6, 0.3, 0.7, 0.2, 0.8, 0.1, 0.9):  # a place that no eigenvalue is near
                middle = low + share * (high - low)
                under = below(v, middle - gap)
                if under == below(v, middle + gap):
                    above = below(v, high) - under
                    open_ += [(low, middle, n - above), (middle, high, above)]
                    break
            else:
                n = -n
        if n < 0 or not (n > most and high - low > 4 * gap):
            got += abs(n)
            if n:
                yield low, high, abs(n)


def eigenpairs(v: np.ndarray, low: float, high: float, count: int, nodes: int = 8, rounds: int = 40) -> tuple[np.ndarray, np.ndarray]:
    """The eigenvalues in an interval that holds `count` of them, and their eigenvectors."""
    d, centre, radius = len(v), (low + high) / 2, (high - low) / 2
    x, weights = np.polynomial.legendre.leggauss(nodes)
    turn = radius * np.exp(0.5j * np.pi * (1 + x))
    shifted = (centre + turn)[:, None, None] * np.eye(d) - v
    scale, size, rng = float(np.abs(v).sum(axis=1).max()), min(d, 2 * count + 4), np.random.default_rng(7)
    while True:
        q = rng.normal(size=(d, size))
        for _ in range(rounds):
            solved = np.linalg.solve(shifted, np.broadcast_to(q.astype(complex), (nodes, d, size)))
            q = 0.5 * np.einsum("k,kij->ij", weights * turn, solved).real  # the other half of the contour is its mirror image
            q, _ = np.linalg.qr(q)
            e, u = np.linalg.eigh(q.T @ v @ q)
            q = q @ u
            held = (e > low) & (e <= high)
            miss = np.linalg.norm(v @ q - q * e, axis=0)[held]
            if held.sum() == count and miss.max() <= 1e-14 * d * scale:
                return e[held], q[:, held]
        if size == d:
            raise ArithmeticError(f"{int(held.sum())} of {count} eigenvalues between {low} and {high} were found")
        size = min(d, 2 * size)


def components(v: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues of a covariance, at most `wanted` and none that counts as zero, falling, and unit eigenvectors as columns; of each its largest entry is positive."""
    found = [eigenpairs(v, *span) for span in intervals(v, wanted)]
    if not found:
        return np.zeros(0), np.zeros((len(v), 0))
    q, _ = np.linalg.qr(np.concatenate([x for _, x in found], axis=1))  # of all intervals together
    e, u = np.linalg.eigh(q.T @ v @ q)
    q = (q @ u)[:, ::-1][:, :wanted]
    return e[::-1][:wanted], q * np.sign(q[np.abs(q).argmax(axis=0), np.arange(q.shape[1])])


def matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def added(rows: DataFrame, column: str, d: int, of: Callable[[np.ndarray], np.ndarray], kind: str = "double") -> np.ndarray:
    """The sum over all vectors of a column of what `of` makes of a block of them: numbers in d rows; each task sends those rows, and Spark adds them up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0
        for b in batches:
            if b.num_rows:
                total = total + of(matrix(b.column(0))).reshape(d, -1)
        if not isinstance(total, int):
            yield pa.RecordBatch.from_arrays([pa.array(range(d), pa.int32()), pa.array(list(total), pa.list_(pa.int64() if kind == "long" else pa.float64()))], ["i", "xs"])

    parts = rows.select(column).mapInArrow(run, f"i int, xs array<{kind}>").select("i", F.posexplode("xs").alias("j", "x"))
    whole = parts.groupBy("i", "j").agg(F.sum(F.col("x").cast("decimal(38,0)") if kind == "long" else F.col("x")).alias("x")).collect()  # what `of` makes, once
    out = np.zeros((d, 1 + max(r.j for r in whole)), object if kind == "long" else float)
    for r in whole:
        out[r.i, r.j] = int(r.x) if kind == "long" else r.x
    return out


def integers(vectors: DataFrame, scale: int, shift: int, id_col: str, vec_col: str) -> DataFrame:
    """vec_id, x: floor(scale * entry) + shift of vectors of the commonest length that hold finite numbers only."""
    v = F.col(vec_col)
    fine = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf"))) & (F.size(v) > 0)
    rows = vectors.where(F.coalesce(fine, F.lit(False)))
    length = rows.agg(F.mode(F.size(v), True)).first()[0]
    x = F.transform(v, lambda c: F.floor(c.cast("double") * scale).cast("long") + shift)
    return rows.where(F.size(v) == F.lit(length or 0)).select(F.col(id_col).alias("vec_id"), x.alias("x"))


@dataclass
class Whitening:
    """What the fit found: rows, exact sums, falling eigenvalues, eigenvectors as columns, the sum of all eigenvalues."""

    n: int
    sums: np.ndarray
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """n * x - sums, exactly."""
        return self.n * x - self.sums


def fit(rows: DataFrame, most: int = 32) -> Whitening | None:
    """The components of the vectors in column x; None where there are no rows."""
    n = rows.count()
    if not n:
        return None
    d = rows.select(F.size("x")).first()[0]
    sums = added(rows, "x", d, lambda x: x.sum(axis=0), "long")[:, 0]
    if n * max(map(abs, [*sums, 1])) >= 1 << 62:
        raise OverflowError("the entries are too large for exact sums")
    sums = sums.astype(np.int64)

    def products(x: np.ndarray) -> np.ndarray:
        y = (n * x - sums) / n
        return y.T @ y

    v = added(rows, "x", d, products) / n
    values, vectors = components((v + v.T) / 2, most)
    return Whitening(n, sums, values, vectors, float(np.trace(v)))


def identity_error(white: DataFrame, n: int, k: int) -> float:
    """The largest entry, by size, of the covariance of `whitened` (k numbers) less the identity."""
    mean = added(white, "whitened", k, lambda w: w.sum(axis=0))[:, 0] / n
    cov = added(white, "whitened", k, lambda w: (w - mean).T @ (w - mean)) / n
    return float(np.abs(cov - np.eye(k)).max())


def whiten(vectors: DataFrame, most: int = 32, scale: int = 64, shift: int = 1_000_000, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """vectors -> vec_id, n, deviation (sum of squares of n x - S, exact), whitened and explained (arrays, by component), identity_error.

    Null vectors, empty ones, those that hold null or non-finite entries and those of another length than the
    commonest take no part. Repeated rows and null ids count as they stand. Components whose eigenvalue is under ZERO
    of the largest are left out, so vectors that are all equal have none (empty arrays), and few vectors have few. Exact
    numbers that don't fit 64 bits are an error. An empty table gives no rows. Other columns are not looked at.
    """
    spark = vectors.sparkSession
    schema = f"vec_id {vectors.schema[id_col].dataType.simpleString()}, deviation long, whitened array<double>"
    rows = keep(integers(vectors, scale, shift, id_col, vec_col), "integers")
    model = fit(rows, most)
    if model is None:
        return spark.createDataFrame([], schema).select("vec_id", F.lit(0).cast("long").alias("n"), "deviation", "whitened", F.col("whitened").alias("explained"), F.lit(0.0).alias("identity_error"))
    turned = model.vectors / np.sqrt(model.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            y = model.deviations(matrix(b.column(1)))
            far = float(np.abs(y).max())
            if far * far * y.shape[1] < 2.0**62:
                squares = pa.array((y * y).sum(axis=1), pa.int64())
            else:
                squares = pa.array([sum(k * k for k in row) for row in y.tolist()], pa.int64())  # fails beyond 64 bits
            yield pa.RecordBatch.from_arrays([b.column(0), squares, pa.array(list((y / model.n) @ turned), pa.list_(pa.float64()))], ["vec_id", "deviation", "whitened"])

    white = keep(rows.mapInArrow(run, schema), "whitened")
    error = identity_error(white, model.n, len(model.values)) if len(model.values) else 0.0
    explained = F.array(*[F.lit(float(e / model.trace)) for e in model.values]).cast("array<double>")
    return white.select("vec_id", F.lit(model.n).cast("long").alias("n"), "deviation", "whitened", explained.alias("explained"), F.lit(error).alias("identity_error"))


def long_form(white: DataFrame) -> DataFrame:
    """A row for each vector and component, numbered from 1."""
    out = white.select("vec_id", "n", "deviation", "explained", "identity_error", F.posexplode("whitened").alias("k", "whitened"))
    return out.select("vec_id", (F.col("k") + 1).alias("component"), "n", "deviation", "whitened", F.get("explained", F.col("k")).alias("explained"), "identity_error")
