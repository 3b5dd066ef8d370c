"""Whitening against numpy's eigenvectors and exact integer sums."""

import numpy as np
import pytest

from arborix.llm import whitening
from arborix.llm.whitening import below, leading

SCHEMA = "vec_id bigint, embedding array<float>, label int, w double, v string, component int"


def brute(rows):
    """(n, S, x-vectors by position, V) of the vectors that stay."""
    good = [(i, e) for i, e in rows if e is not None and all(c is not None and np.isfinite(np.float32(c)) for c in e)]
    x = [[int(np.floor(1024 * float(np.float32(c)))) + 100000 for c in e] for _, e in good]
    n, d = len(x), len(x[0])
    s = [sum(r[j] for r in x) for j in range(d)]
    z = np.array(x, float) - np.array(s, float) / n
    return good, n, s, x, z.T @ z / n


def check(got, rows, k=8):
    good, n, s, x, v = brute(rows)
    e, u = np.linalg.eigh(v)
    e, u = e[::-1], u[:, ::-1]
    k = min(k, len(e))
    mean = np.array(s, float) / n
    want = (np.array(x, float) - mean) @ u[:, :k] / np.sqrt(e[:k])
    dev = [sum((n * a - b) ** 2 for a, b in zip(r, s, strict=True)) for r in x]
    got = [r for r in got.collect()]
    assert len(got) == n * k
    key = lambda i: (i is not None, i or 0)
    mine = np.zeros((n, k))
    order = sorted(range(n), key=lambda p: (key(good[p][0]), dev[p], x[p]))
    for c in range(1, k + 1):
        rs = [r for r in got if r["component"] == c]
        assert {r["n"] for r in rs} == {n}
        assert all(abs(r["explained"] - e[c - 1] / e.sum()) <= 1e-9 for r in rs)
        by = sorted(rs, key=lambda r: (key(r["vec_id"]), r["deviation"]))
        assert [(r["vec_id"], r["deviation"]) for r in by] == [(good[p][0], dev[p]) for p in order]
        mine[:, c - 1] = [r["whitened"] for r in by]
    want = want[order]
    for c in range(k):
        sign = np.sign((mine[:, c] * want[:, c]).sum())
        assert np.allclose(mine[:, c], sign * want[:, c], atol=1e-7)
    assert {r["identity_error"] for r in got} == {got[0]["identity_error"]}
    assert got[0]["identity_error"] < 1e-8


def test_table(spark, small):
    rows = spark.read.parquet(f"{small}/embeddings.parquet")
    check(whitening.whiten(rows), [(r["vec_id"], r["embedding"]) for r in rows.collect()])


def test_awkward_rows(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.standard_normal(3).astype(np.float32).tolist()) for i in range(40)]
    rows += [(7, rows[7][1]), (None, [0.5, 0.25, 1.0]), (None, [3000.5, -1.0, 2.0]), (50, [1e3, -2e3, 3.0])]
    bad = [(90, None), (91, [1.0, None, 2.0]), (92, [float("nan"), 1.0, 2.0]), (93, [1.0, float("inf"), 0.0]), (94, []), (95, [1.0, 2.0])]
    df = spark.createDataFrame([(i, e, 1, 2.0, "x", 3) for i, e in [*rows, *bad]], SCHEMA).repartition(3)
    check(whitening.whiten(df), rows)


def test_nothing(spark):
    out = whitening.whiten(spark.createDataFrame([], SCHEMA))
    assert out.count() == 0
    assert out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert whitening.whiten(spark.createDataFrame([(1, None, 1, 1.0, "", 1), (2, [], 1, 1.0, "", 1)], SCHEMA)).count() == 0


def test_components_without_variance(spark):
    rows = [(i, [float(i), 2.0 * i, 1.0], 0, 0.0, "", 0) for i in range(10)]
    got = whitening.whiten(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == 30
    for r in got:
        assert (r["whitened"] is None) == (r["component"] > 1)
        assert abs(r["explained"] - (r["component"] == 1)) < 1e-12
    one = whitening.whiten(spark.createDataFrame(rows[:1], SCHEMA)).collect()
    assert len(one) == 3 and all(r["whitened"] is None and r["deviation"] == 0 and r["identity_error"] is None for r in one)


def test_large_entries_are_summed_exactly(spark):
    rows = [(i, [float(2 ** 30 + 7 * i), float(i * i)], 0, 0.0, "", 0) for i in range(30)]
    got = {(r["vec_id"], r["component"]): r["deviation"] for r in whitening.whiten(spark.createDataFrame(rows, SCHEMA)).collect()}
    _, n, s, x, _ = brute([(r[0], r[1]) for r in rows])
    for i, v in enumerate(x):
        dev = sum((n * a - b) ** 2 for a, b in zip(v, s, strict=True))
        assert got[i, 1] == (dev if dev < 2 ** 63 else None)


@pytest.mark.parametrize("d", [1, 2, 5, 40])
def test_counts_and_vectors(d):
    rng = np.random.default_rng(d)
    a = rng.standard_normal((d, d))
    a = a + a.T
    w, v = np.linalg.eigh(a)
    for s in np.linspace(w[0] - 1, w[-1] + 1, 31):
        assert below(a, s) == (w < s).sum()
    e, u = leading(a @ a, 8)
    w, v = np.linalg.eigh(a @ a)
    assert np.allclose(e, w[::-1][:8], rtol=1e-10)
    assert np.allclose(np.abs((u * v[:, ::-1][:, :8]).sum(axis=0)), 1)


def test_equal_eigenvalues():
    q, _ = np.linalg.qr(np.random.default_rng(0).standard_normal((30, 30)))
    lam = np.array([5, 5, 5, 4, 4 - 1e-9, 3, 3, 2, 2, 2, 2] + [0] * 19)
    a = q @ np.diag(lam) @ q.T
    a = (a + a.T) / 2
    e, u = leading(a, 8)
    assert np.allclose(e, lam[:8])
    assert np.allclose(u.T @ u, np.eye(8))
    assert np.abs(a @ u - u * e).max() < 1e-13
    assert np.allclose(leading(np.eye(9), 8)[0], 1) and np.allclose(leading(np.zeros((3, 3)), 8)[0], 0)
