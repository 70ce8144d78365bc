"""Rank-one spectra and embedding whitening against numpy's eigensolver."""

import numpy as np
import pytest

from pairloom.llm.spectra import Spectrum, rank_one, secular_roots
from pairloom.llm.whitening import BASE, combine, deviation, grid, local_spectra, whiten
from pyspark.sql import functions as F


def scatter(x):
    c = x - x.mean(0)
    return c.T @ c


CASES = {
    "plain": lambda r: r.normal(size=(300, 24)) * r.uniform(0.1, 20, 24),
    "one dimension": lambda r: r.normal(size=(40, 1)),
    "fewer rows than dimensions": lambda r: r.normal(size=(9, 30)),
    "repeats": lambda r: r.normal(size=(6, 12))[r.integers(0, 6, 200)],
    "low rank": lambda r: r.normal(size=(200, 3)) @ r.normal(size=(3, 15)),
    "constant columns": lambda r: np.c_[r.integers(0, 2, (100, 2)), np.full((100, 4), 3.0)],
    "equal eigenvalues": lambda r: np.vstack([np.eye(10), -np.eye(10)] * 5),
    "far scales": lambda r: r.normal(size=(200, 8)) * 10.0 ** np.arange(-6, 10, 2),
}


@pytest.mark.parametrize("name", CASES)
def test_spectrum_is_that_of_the_scatter(name):
    x = CASES[name](np.random.default_rng(1))
    parts = []
    for part in np.array_split(x, 3):
        s = Spectrum(x.shape[1])
        for row in part:
            s.add(row)
        parts.append(s)
    whole = parts[0]
    for p in parts[1:]:
        whole.merge(p)
    exact = scatter(x)
    assert whole.n == len(x)
    assert np.abs(whole.vectors.T @ whole.vectors - np.eye(x.shape[1])).max() < 1e-12
    assert np.abs(whole.vectors * whole.values @ whole.vectors.T - exact).max() <= 1e-12 * np.abs(exact).max()
    np.testing.assert_allclose(whole.values, np.linalg.eigvalsh(exact), atol=1e-12 * np.abs(exact).max())


def test_secular_roots_lie_between_the_poles():
    d, z = np.array([0.0, 1e-9, 1.0, 1.0 + 1e-12, 5.0]), np.array([1e-3, 2.0, 1e-6, 1.0, 0.5])
    away = secular_roots(d, z)
    assert (np.sign(away) == np.where(np.tri(5, dtype=bool), -1, 1)).all()
    values, u = rank_one(d, np.eye(5), z)
    np.testing.assert_allclose(values, np.linalg.eigvalsh(np.diag(d) + np.outer(z, z)), atol=1e-14)
    np.testing.assert_allclose(u * values @ u.T, np.diag(d) + np.outer(z, z), atol=1e-14)
    same, v = rank_one(d, np.eye(5), np.zeros(5))
    assert (same == d).all() and (v == np.eye(5)).all()


def brute(rows, components=16):
    """(id, component) -> row, by numpy's solver on whole matrices."""
    good = [(i, np.floor(64 * np.asarray(v, float)).astype(np.int64) + BASE) for i, v in rows
            if v and all(c is not None and np.isfinite(c) for c in v)]
    out = {}
    for dim in {len(x) for _, x in good}:
        own = [(i, x) for i, x in good if len(x) == dim]
        fit = np.unique([x for _, x in own], axis=0)
        n, s = len(fit), fit.sum(0)
        c = (n * fit - s) / n
        v = c.T @ c / n
        e, q = np.linalg.eigh(v)
        for i, x in own:
            far = int(((n * x.astype(object) - s) ** 2).sum())
            for k in range(1, min(components, dim) + 1):
                if e[-k] > 1e-12 * e[-1]:
                    out.setdefault((i, k), []).append((n, far, (n * x - s) / n @ q[:, -k] / np.sqrt(e[-k]), e[-k] / np.trace(v)))
    return out


def test_whitening_against_numpy(spark):
    r = np.random.default_rng(5)
    vectors = (r.normal(size=(120, 20)) * r.uniform(0.2, 3, 20)).astype("float32").astype(float).tolist()
    vectors[7][3], vectors[8][0], vectors[9][5] = None, float("nan"), float("-inf")
    rows = list(enumerate(vectors)) + [(200, vectors[0]), (None, vectors[1]), (5, vectors[2]), (201, None), (202, [])]
    rows += [(300 + i, [float(a), float(b)]) for i, (a, b) in enumerate(r.normal(size=(15, 2)))]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<float>, x string, n int")
    expected = brute(rows)
    for parts in (1, 7):
        got = whiten(df.repartition(parts)).collect()
        found, signs = {}, {}
        assert {g["identity_error"] for g in got} and max(g["identity_error"] for g in got) < 1e-12
        for g in got:
            found.setdefault((g["vec_id"], g["component"]), []).append(g)
        assert {k: len(v) for k, v in found.items()} == {k: len(v) for k, v in expected.items()}
        for (i, k), exp in expected.items():
            for (n, far, white, share), g in zip(sorted(exp), sorted(found[i, k], key=lambda g: (g["n"], g["deviation"]))):
                assert (g["n"], g["deviation"]) == (n, far) and abs(g["explained"] - share) < 1e-12
                sign = signs.setdefault((n, k), np.sign(white * g["whitened"]))
                assert abs(white * sign - g["whitened"]) < 1e-9


def test_spectra_combine_over_levels(spark):
    x = np.random.default_rng(2).integers(-50, 50, (200, 5))
    df = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    fit = grid(df, "vec_id", "embedding").select("x").distinct().repartition(40)
    state = combine(local_spectra(fit)).collect()
    fine = np.unique(x * 64, axis=0)
    assert len(state) == 1 and state[0]["n"] == len(fine) and [int(s) for s in state[0]["sums"]] == (fine + BASE).sum(0).tolist()
    u = np.array(state[0]["vecs"]).reshape(5, 5)
    np.testing.assert_allclose(u * state[0]["vals"] @ u.T, scatter(fine), rtol=1e-10, atol=1e-6)


def test_whitening_edge_tables(spark):
    schema = "vec_id long, embedding array<float>"
    assert whiten(spark.createDataFrame([], schema)).count() == 0
    assert whiten(spark.createDataFrame([(1, None), (2, [])], schema)).count() == 0
    assert whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], schema)).count() == 0  # no variance
    flat = whiten(spark.createDataFrame([(i, [float(i), 7.0, 2.0 * i]) for i in range(6)], schema)).collect()
    assert {g["component"] for g in flat} == {1} and abs(flat[0]["explained"] - 1) < 1e-12
    huge = whiten(spark.createDataFrame([(1, [1e30, 0.0]), (2, [-1e30, 1.0]), (3, [0.0, 1.0])], schema)).where(F.col("deviation").isNull())
    assert huge.count() > 0


def test_deviation_is_exact_beyond_doubles():
    x = np.array([[BASE + 10**9, BASE], [BASE - 10**9, BASE + 1]])
    n, sums = 3, [3 * BASE + 5, 3 * BASE + 1]
    exp = [sum((n * int(c) - s) ** 2 for c, s in zip(row, sums)) for row in x]
    assert list(deviation(x, n, sums)) == [e if e < 2**63 else None for e in exp]
