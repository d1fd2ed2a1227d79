"""Potential revenue: linear quantile regression fitted by distributed passes.

The pinball loss is majorised by a quadratic (Hunter and Lange, 2000), so that each step is a weighted least
squares whose sums, (p + 1) squared numbers, come from one pass over the feature table, added up in each task by
matrix products over Arrow batches (as column expressions they would be some hundred aggregates, compiled anew each
step). Weights of the absolute residuals and of the lasso are refreshed each step. The driver solves p + 1 equations.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config as C
from ..plans.lineage import cut


def linear(features: list[str], beta: np.ndarray) -> Column:
    out = F.lit(float(beta[0]))
    for c, b in zip(features, beta[1:]):
        out = out + F.lit(float(b)) * F.col(f"`{c}`")
    return out


def _sums(df: DataFrame, target: str, features: list[str], beta: np.ndarray | None, q: float, eps: float) -> tuple[np.ndarray, np.ndarray, float, int]:
    """Weighted sums of products, of products with the target, the pinball loss and the rows, in one pass: each task sends one row.

    Without beta the weights are 1, as for least squares.
    """
    p = len(features) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b, loss, n = np.zeros((p, p)), np.zeros(p), 0.0, 0
        for batch in batches:
            y, *xs = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(p))
            x = np.column_stack([np.ones(len(y)), *xs])
            r = y - x @ beta if beta is not None else y
            w = 1 / (np.abs(r) + eps) if beta is not None else np.ones(len(y))
            a += (x * w[:, None]).T @ x
            b += x.T @ (w * y + (2 * q - 1 if beta is not None else 0.0))
            loss += float(np.maximum(q * r, (q - 1) * r).sum())
            n += len(y)
        yield pa.RecordBatch.from_arrays([pa.array([[*a.ravel(), *b, loss, n]], pa.list_(pa.float64()))], ["sums"])

    rows = df.select(target, *[F.col(f"`{c}`") for c in features]).mapInArrow(run, "sums array<double>").collect()  # a row for each task
    total = np.sum([r.sums for r in rows], axis=0) if rows else np.zeros(p * p + p + 2)
    return total[: p * p].reshape(p, p), total[p * p : -2], total[-2], int(total[-1])


def quantile_fit(df: DataFrame, target: str, features: list[str], q: float = C.QUANTILE, alpha: float = 0.01, tolerance: float = 1e-7, most_steps: int = 200) -> np.ndarray:
    """Intercept and weights that minimise the mean pinball loss plus alpha times the size of the weights."""
    rows = cut(df.select(F.col(target).cast("double").alias(target), *[F.col(f"`{c}`").cast("double").alias(c) for c in features]), "fit")
    eps = 1e-6 * (rows.agg(F.max(F.abs(F.col(target)))).first()[0] or 1.0)
    a, b, _, n = _sums(rows, target, features, None, q, eps)
    beta, before = np.linalg.lstsq(a, b, rcond=None)[0], np.inf
    for _ in range(most_steps):
        a, b, loss, _ = _sums(rows, target, features, beta, q, eps)
        now = loss / max(1, n) + alpha * float(np.abs(beta[1:]).sum())
        if before - now <= tolerance * max(1e-12, abs(now)):
            break
        d = np.diag([0.0, *(1 / (np.abs(beta[1:]) + 1e-6))])
        beta, before = np.linalg.lstsq(a + 2 * n * alpha * d, b, rcond=None)[0], now
    return beta


def certificate(df: DataFrame, target: str, features: list[str], beta: np.ndarray, q: float = C.QUANTILE, alpha: float = 0.01, enough: float = 8e-5, most_steps: int = 80) -> dict[str, float]:
    """How far a fit can be from the best: n, loss (with the lasso), bound (no fit has less loss), gap (loss - bound), under (share of rows at or under the line).

    The bound is the value of a point of the dual problem: a price from q - 1 to q for each row, such that prices sum to 0
    and, over a feature, to n * alpha at most. Prices go by a row's distance from a line, smoothly within a width of it. Newton
    steps, one pass each, halved where they go too far, move that line in the features that have a weight until the
    sums are as they must be; what the other features' sums are over is taken off by shrinking all prices. So the
    bound holds whatever the fit was. The width falls from a third of the mean loss until the gap is `enough`. The
    driver holds as many sums as features squared.
    """
    p = len(features) + 1
    rows = cut(df.select(F.col(target).cast("double").alias(target), *[F.col(f"`{c}`").cast("double").alias(c) for c in features]), "certified")

    def passed(near: np.ndarray, d: float) -> np.ndarray:
        """Over all rows: their number, the loss of the fit, rows under it, the smooth loss of the line, the prices' value, their sums, and what these lose as the line moves."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(5 + p + p * p)
            for batch in batches:
                y, *xs = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(p))
                x = np.column_stack([np.ones(len(y)), *xs])
                r, away = y - x @ beta, y - x @ near
                root = np.sqrt(away * away + d * d)
                a, h = q - 0.5 + 0.5 * away / root, 0.5 * d * d / root**3
                total += [len(y), np.maximum(q * r, (q - 1) * r).sum(), (r <= 0).sum(), 0.5 * (root + (2 * q - 1) * away).sum(), a @ y, *(x.T @ a), *((x * h[:, None]).T @ x).ravel()]
            yield pa.RecordBatch.from_arrays([pa.array([total], pa.list_(pa.float64()))], ["xs"])

        parts = rows.mapInArrow(run, "xs array<double>").select(F.posexplode("xs").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x"))
        out = np.zeros(5 + p + p * p)
        for r in parts.collect():
            out[r.i] = r.x
        return out

    n, loss, under, *_ = passed(beta, 1.0)
    if not n:
        return {"n": 0, "loss": 0.0, "bound": 0.0, "gap": 0.0, "under": 0.0}
    weighs = np.array([True, *(np.abs(beta[1:]) > 1e-6 * np.abs(beta).max())])
    wanted = n * alpha * np.sign(beta)
    wanted[0] = 0.0
    whole = loss / n + alpha * float(np.abs(beta[1:]).sum())
    d, near, bound, least, step = max(0.3 * loss / n, 1e-12), np.where(weighs, beta, 0.0), -np.inf, np.inf, np.zeros(p)
    for _ in range(most_steps):
        found = passed(near, d)
        smooth, value, sums, moves = found[3] + wanted @ near, found[4], found[5 : 5 + p], found[5 + p :].reshape(p, p)
        if smooth > least + 1e-13 * abs(least):
            step = step / 2
            near = near - step
            continue
        least = smooth
        if abs(sums[0]) <= 1e-9 * n:
            over = float(np.abs(sums[1:]).max(initial=0.0)) / (n * alpha) if alpha else 1.0
            bound = max(bound, value / n / max(1.0, over))
        if float(np.abs(sums - wanted)[weighs].max()) <= 1e-10 * n:
            if whole - bound <= enough * whole or d <= 1e-4 * loss / n:
                break
            d, least, step = d / 4, np.inf, np.zeros(p)
            continue
        step = np.zeros(p)
        step[weighs] = np.linalg.lstsq(moves[np.ix_(weighs, weighs)], (sums - wanted)[weighs], rcond=None)[0]
        near = near + step
    return {"n": int(n), "loss": float(whole), "bound": float(bound), "gap": float(whole - bound), "under": float(under / n)}


def least_squares_fit(df: DataFrame, target: str, features: list[str]) -> np.ndarray:
    """Ordinary least squares, as the fallback model."""
    rows = df.select(F.col(target).cast("double").alias(target), *[F.col(f"`{c}`").cast("double").alias(c) for c in features])
    a, b, _, _ = _sums(rows, target, features, None, 0.5, 1.0)
    return np.linalg.lstsq(a, b, rcond=None)[0]


def fit_sample(df: DataFrame, id_col: str = C.OUTLET_ID, most: int = 50_000) -> DataFrame:
    """The same `most` rows each time: those of least MD5 of their id. A fit on all rows needs no such sample."""
    return df.orderBy(F.md5(F.col(f"`{id_col}`").cast("string").cast("binary")), f"`{id_col}`").limit(most)


def predicted(df: DataFrame, features: list[str], beta: np.ndarray) -> DataFrame:
    """df with predicted_raw, the linear score floored at 0."""
    return df.withColumn("predicted_raw", F.greatest(linear(features, beta), F.lit(0.0)))
