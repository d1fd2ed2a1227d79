import numpy as np
import pytest
from pyspark.sql import functions as F

from storelens.llm import whitening


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", 1) for r in rows], "vec_id long, embedding array<double>, x string, i string, n int").repartition(3)


def check(spark, rows, k=32):
    """The whole result against a plain one: exact integers, the library's eigenvectors."""
    got = whitening.long_form(whitening.whiten(table(spark, rows), k)).collect()
    fine = [(i, v) for i, v in rows if v and all(c is not None and np.isfinite(c) for c in v)]
    x = np.array([[int(np.floor(c * 64)) + 1_000_000 for c in v] for _, v in fine], dtype=object)
    n, sums = len(x), x.sum(axis=0)
    dev = {i: sum(int(n * a - s) ** 2 for a, s in zip(row, sums)) for (i, _), row in zip(fine, x)}
    y = ((n * x - sums) / n).astype(float)
    v = y.T @ y / n
    e, u = np.linalg.eigh(v)
    e, u = e[::-1], u[:, ::-1]
    count = min(k, int((e > 1e-11 * e[0]).sum()))
    assert len(got) == count * n
    if not count:
        return got
    assert {r.component for r in got} == set(range(1, count + 1)) and {r.n for r in got} == {n} and all(r.deviation == dev[r.vec_id] for r in got)
    assert np.allclose([r.explained for r in got], [e[r.component - 1] / np.trace(v) for r in got], rtol=1e-4)
    assert len({r.identity_error for r in got}) == 1 and got[0].identity_error <= 1e-4
    w = {(r.vec_id, r.component): r.whitened for r in got}
    white = np.array([[w[i, c + 1] for c in range(count)] for i, _ in fine])
    gaps = np.abs(np.diff(e)) / e[0]
    for c in range(count):  # a direction is one's own only if no other eigenvalue is near
        if min(gaps[max(0, c - 1) : c + 1], default=1) > 1e-6:
            want = y @ u[:, c] / np.sqrt(e[c])
            assert min(np.abs(white[:, c] - want).max(), np.abs(white[:, c] + want).max()) < 1e-6
    assert np.abs(white.T @ white / n - np.eye(count)).max() <= 1e-4
    return got


def test_vectors_against_the_plain_result(spark):
    rng = np.random.default_rng(1)
    rows = [(i, (rng.normal(size=40) * np.linspace(0.05, 3, 40)).tolist()) for i in range(300)]
    rows += [(400, None), (401, []), (402, [float("nan")] * 40), (403, [1.0] * 39 + [float("-inf")]), (404, [None] * 40)]
    check(spark, rows)


def test_a_hot_vector_and_few_dimensions(spark):
    rng = np.random.default_rng(2)
    check(spark, [(i, [1.0, 2.0, 3.0] if i % 3 else rng.normal(size=3).tolist()) for i in range(200)])
    check(spark, [(i, [float(i % 7)]) for i in range(30)])


def test_fewer_vectors_than_dimensions(spark):
    rng = np.random.default_rng(3)
    got = check(spark, [(i, rng.normal(size=50).tolist()) for i in range(12)])
    assert {r.component for r in got} == set(range(1, 12))


def test_vectors_of_another_length_are_left_out(spark):
    rows = [(1, [1.0, 2.0]), (2, [3.0, 1.0]), (3, [0.0, 0.0]), (4, [1.0, 1.0, 1.0])]
    assert {r.vec_id for r in whitening.whiten(table(spark, rows)).collect()} == {1, 2, 3}


def test_no_vectors_one_vector_equal_vectors(spark):
    assert whitening.long_form(whitening.whiten(table(spark, []))).collect() == [] == whitening.long_form(whitening.whiten(table(spark, [(1, None)]))).collect()
    assert [(r.deviation, r.whitened) for r in whitening.whiten(table(spark, [(1, [1.5, 2.0])])).collect()] == [(0, [])]
    check(spark, [(i, [0.5, -0.5]) for i in range(9)])


def test_repeated_ids_and_null_ids(spark):
    rng = np.random.default_rng(4)
    rows = [(None if i % 2 else 5, rng.normal(size=4).tolist()) for i in range(20)]
    assert whitening.long_form(whitening.whiten(table(spark, rows))).groupBy("vec_id").agg(F.count("*").alias("n")).toPandas().n.tolist() == [40, 40]


def test_deviations_past_53_bits_are_exact(spark):
    rows = [(i, [float(i * 20_000), float(-i), 7.0]) for i in range(60)]
    check(spark, rows)


def of_spectrum(values, seed=0):
    q, _ = np.linalg.qr(np.random.default_rng(seed).normal(size=(len(values), len(values))))
    v = (q * np.array(values, float)) @ q.T
    return (v + v.T) / 2


SPECTRA = {
    "spread": np.linspace(1, 50, 48), "decay": 2.0 ** -np.arange(40), "alike": np.ones(30), "cluster": [5.0] * 12 + [1.0] * 12 + [0.0] * 8,
    "close": 1 + 1e-9 * np.arange(24), "one": [3.0], "none": np.zeros(6), "rank": [4.0, 2.0] + [0.0] * 20, "noise": np.random.default_rng(9).normal(size=64) ** 2,
}


@pytest.mark.parametrize("name", SPECTRA)
def test_components_of_many_spectra(name):
    v = of_spectrum(SPECTRA[name])
    want = np.linalg.eigvalsh(v)[::-1]
    count = min(32, int((want > 1e-11 * max(want[0], 1e-300)).sum())) if want[0] > 1e-12 else 0
    e, q = whitening.components(v, 32)
    assert len(e) == count and np.allclose(e, want[:count], rtol=0, atol=1e-12 * max(1, want[0]))
    assert np.allclose(q.T @ q, np.eye(count), atol=1e-12) and np.allclose(v @ q, q * e, atol=1e-11 * max(1, want[0]))


def test_pivots_count_eigenvalues():
    for seed in range(20):
        rng = np.random.default_rng(seed)
        v = rng.normal(size=(17, 17))
        v = v + v.T
        e = np.linalg.eigvalsh(v)
        for s in (*rng.normal(size=5) * 4, 0.0):
            assert whitening.below(v, s) == (e < s).sum()
    assert whitening.below(np.array([[0.0, 1.0], [1.0, 0.0]]), 0.0) == 1 and whitening.below(np.zeros((3, 3)), 0.0) == 0


def test_intervals_hold_what_they_count():
    v = of_spectrum(SPECTRA["noise"])
    e = np.linalg.eigvalsh(v)
    found = list(whitening.intervals(v, 32))
    assert sum(n for *_, n in found) >= 32 and all(((e > a) & (e <= b)).sum() == n <= 8 for a, b, n in found)
