import numpy as np
import pytest

from shutterlake.llm.whitening import below, deviations, eigenpairs, reduced, whitened

SCHEMA = "vec_id long, embedding array<float>, component string, n string"


@pytest.mark.parametrize("d", [1, 2, 3, 8, 40])
@pytest.mark.parametrize("kind", ["plain", "close", "diagonal", "one", "zero"])
def test_eigenpairs(d, kind):
    rng = np.random.default_rng(d)
    a = rng.standard_normal((2 * d + 1, d))
    q = np.linalg.qr(rng.standard_normal((d, d)))[0]
    v = {"plain": a.T @ a, "close": q @ np.diag(5 - 1e-10 * np.arange(d)) @ q.T, "diagonal": np.diag(np.arange(1.0, d + 1)), "one": np.outer(a[0], a[0]), "zero": np.zeros((d, d))}[kind]
    e, x = eigenpairs(v, 8)
    size = max(np.abs(v).max(), 1e-300)
    assert np.abs(e - np.linalg.eigvalsh(v)[::-1][:8]).max() <= 1e-13 * size
    assert np.abs(v @ x.T - x.T * e).max() <= 1e-12 * size
    assert np.abs(x @ x.T - np.eye(len(x))).max() < 1e-12


def test_sturm_counts():
    a = np.random.default_rng(2).standard_normal((9, 9))
    v = a + a.T
    diagonal, off, _ = reduced(v)
    e = np.linalg.eigvalsh(v)
    at = np.linspace(e[0] - 1, e[-1] + 1, 40)
    assert below(diagonal, off, at).tolist() == [(e < x).sum() for x in at]


def brute(rows, k=8):
    ok = [(r[0], r[1]) for r in rows if r[1] and all(c is not None and np.isfinite(c) for c in r[1])]
    x = np.floor(1024 * np.array([v for _, v in ok], np.float32).astype(np.float64)).astype(np.int64) + 100_000
    n, s = len(x), x.sum(axis=0)
    y = x - s / n
    v = y.T @ y / n
    e, u = np.linalg.eigh(v)
    e, u = e[::-1][:k], u[:, ::-1][:, :k]
    return [i for i, _ in ok], ((n * x - s) ** 2).sum(axis=1), y @ u / np.sqrt(e), e / np.trace(v), n


def test_matches_brute_force(spark):
    rng = np.random.default_rng(4)
    mix = rng.standard_normal((12, 12)) * np.linspace(3, 0.2, 12)
    rows = [(i, [float(c) for c in rng.standard_normal(12) @ mix], "x", None) for i in range(400)]
    rows += [(1000, None, "", ""), (1001, [None] + [1.0] * 11, "", ""), (1002, [float("nan")] * 12, "", ""), (1003, [float("-inf")] * 12, "", ""), (1004, [], "", "")]
    got = whitened(spark.createDataFrame(rows, SCHEMA).repartition(3)).toPandas()
    ids, deviation, w, explained, n = brute(rows)
    assert len(got) == 8 * len(ids) and set(got.n) == {n} and got.identity_error.nunique() == 1 and got.identity_error.max() < 1e-9
    first = got[got.component == 1].set_index("vec_id").loc[ids]
    assert first.deviation.tolist() == deviation.tolist()
    mine = got.pivot(index="vec_id", columns="component", values="whitened").loc[ids].to_numpy()
    assert np.abs(mine * np.sign((mine * w).sum(axis=0)) - w).max() < 1e-9
    assert np.allclose(got.groupby("component").explained.first(), explained, rtol=1e-9)


def test_few_dimensions_repeats_and_lengths(spark):
    rows = [(1, [0.0, 1.0], "", ""), (1, [0.0, 1.0], "", ""), (None, [2.0, 2.0], "", ""), (3, [5.0, -4.0], "", ""), (4, [7.0], "", ""), (5, [9.0], "", ""), (6, [1.0, 1.0, 1.0], "", "")]
    got = whitened(spark.createDataFrame(rows, SCHEMA)).toPandas()
    assert len(got) == 4 * 2 + 2  # the single vector of three entries varies along nothing
    assert sorted(got[got.vec_id.isin([4, 5])].whitened.abs()) == pytest.approx([1, 1])
    assert got.identity_error.max() < 1e-12


def test_nothing_varies(spark):
    assert whitened(spark.createDataFrame([(i, [1.0, 2.0], "", "") for i in range(5)], SCHEMA)).collect() == []
    assert whitened(spark.createDataFrame([], SCHEMA)).collect() == []


def test_large_entries(spark):
    got = whitened(spark.createDataFrame([(1, [3e38, 0.0], "", ""), (2, [-3e38, 1.0], "", ""), (3, [0.0, 0.5], "", "")], SCHEMA)).toPandas()
    assert dict(zip(got.vec_id, got.deviation, strict=True)) == {1: (1 << 63) - 1, 2: (1 << 63) - 1, 3: 0} and np.isfinite(got.whitened).all()


def test_exact_deviations():
    x = np.array([[10, 1 << 41], [13, -(1 << 41)], [14, 5]])
    sums = np.array([int(s) for s in x.sum(axis=0)], object)
    assert deviations(x, 3, sums).tolist() == [min((1 << 63) - 1, sum((3 * int(a) - int(s)) ** 2 for a, s in zip(r, sums, strict=True))) for r in x]
