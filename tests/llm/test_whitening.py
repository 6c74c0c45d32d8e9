"""Whitening against NumPy's eigenvectors."""

import numpy as np
import pytest

from seriespan.llm import whitening as W
from seriespan.llm.vectors import integer_rows

COLUMNS = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def frame(spark, rows):
    df = spark.createDataFrame([(*r, "a", "b", "c") for r in rows], "vec_id long, embedding array<double>, k string, w string, n string")
    return integer_rows(df.repartition(3))


def whitened(spark, rows, **more):
    df = frame(spark, rows)
    got = W.whiten(df, W.fit(df, **more))
    assert got.columns == COLUMNS
    return sorted((tuple(r) for r in got.collect()), key=lambda r: (r[0] is None, r[:2]))


def brute(rows, dims):
    kept = [(k, v) for k, v in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    x = np.array([[int(np.floor(256 * c)) for c in v] + [0] * (dims - len(v)) for _, v in kept], dtype=np.int64)
    u = np.unique(x, axis=0)
    n, s = len(u), u.sum(axis=0)
    c = u - s / n
    e, v = np.linalg.eigh(c.T @ c / n)
    e, v = e[::-1], v[:, ::-1]
    rank = int((e > 1e-9 * e[0]).sum()) if e[0] > 0 else 0
    m = min(4, rank)
    return [k for k, _ in kept], n, ((n * x - s) ** 2).sum(axis=1), ((x - s / n) @ v[:, :m]) / np.sqrt(e[:m]), e[:m] / e.sum()


def random_rows(n, dims, seed, rank=None):
    r = np.random.default_rng(seed)
    x = r.standard_normal((n, rank or dims)) @ r.standard_normal((rank or dims, dims))
    if rank:
        x = np.round(r.integers(-3, 4, (n, rank)) @ r.integers(-2, 3, (rank, dims)))
    return [(i, [float(c) for c in v]) for i, v in enumerate(x)]


@pytest.mark.parametrize("n,dims,rank", [(300, 9, None), (50, 1, None), (200, 30, 3), (5, 40, None), (400, 12, 2)])
def test_like_numpy(spark, n, dims, rank):
    rows = random_rows(n, dims, dims, rank)
    rows += [(1000 + i, rows[0][1]) for i in range(50)] + [(0, rows[0][1]), (None, rows[1][1]), (2000, rows[2][1][: dims // 2])]
    rows += [(3000, None), (3001, [None] * dims), (3002, [float("nan")] * dims), (3003, [float("-inf")] * dims)]
    got = whitened(spark, rows)
    keys, count, deviation, want, explained = brute(rows, dims)
    m = want.shape[1]
    order = sorted(range(len(keys)), key=lambda i: (keys[i] is None, keys[i] or 0, tuple(want[i])))
    assert len(got) == len(keys) * m
    assert {r[2] for r in got} == {count} and len({r[6] for r in got}) == 1 and got[0][6] < 1e-9
    if rank == 3 or m < 1:
        return  # equal eigenvalues may be turned
    assert sorted({(r[0], r[3]) for r in got}, key=repr) == sorted({(k, int(d)) for k, d in zip(keys, deviation)}, key=repr)
    for j in range(m):
        mine = [r for r in got if r[1] == j + 1]
        sides = np.array(sorted((r[0] is None, r[0] or 0, r[4]) for r in mine))[:, 2]
        both = [np.array(sorted((keys[i] is None, keys[i] or 0, sign * want[i, j]) for i in order))[:, 2] for sign in (1, -1)]
        assert min(np.abs(sides - b).max() for b in both) < 1e-7
        assert abs(mine[0][5] - explained[j]) < 1e-10


def test_nothing_to_whiten(spark):
    assert whitened(spark, []) == []
    assert whitened(spark, [(1, [0.5, 0.5]), (2, [0.5, 0.5])]) == []
    assert whitened(spark, [(1, []), (2, None)]) == []


def test_huge_entries_have_no_deviation_in_a_long(spark):
    got = whitened(spark, [(1, [1e300, 1.0]), (2, [-1e300, 2.0]), (3, [1e30, 3.0])])
    assert {r[3] for r in got} == {None} and all(np.isfinite(r[4]) for r in got)


def test_exact_deviation_near_the_end_of_a_long():
    x = np.array([[1 << 30, 0], [-(1 << 30), 1], [3, 5]], np.int64)
    for n in (1, 3, 1 << 3):
        want = [sum((n * int(v) - s) ** 2 for v, s in zip(row, (7, 6))) for row in x]
        assert W.deviations(x, n, [7, 6]) == [w if w < 2**63 else None for w in want]


@pytest.mark.parametrize("n,rank", [(1, 1), (7, 7), (40, 40), (33, 5)])
def test_factor_and_rotations(n, rank):
    r = np.random.default_rng(n)
    b = r.standard_normal((n, rank)) * np.logspace(0, -4, rank)
    a = b @ b.T
    factor, order = W.cholesky(a)
    assert factor.shape[1] <= rank + 1 and np.abs(factor @ factor.T - a[order][:, order]).max() < 1e-12 * np.abs(a).max()
    turned = W.jacobi(factor)
    products = turned.T @ turned
    norms = np.sqrt(np.maximum(products.diagonal(), 1e-300))
    assert np.abs(products - np.diag(products.diagonal())).max() < 1e-13 * norms.max() ** 2
    values, vectors = W.components_of(a)
    want = np.linalg.eigvalsh(a)[::-1][: len(values)]
    assert np.abs(values - want)[:rank].max() < 1e-12 * want[0]
    assert np.abs(a @ vectors - vectors * values).max() < 1e-12 * want[0]


def test_packing():
    r = np.random.default_rng(1)
    for top in (0, 5, 1 << 15, 1 << 20, 1 << 40, (1 << 63) - 1):
        x = r.integers(-top - 1, top, (20, 6), dtype=np.int64)
        x[3] = 0
        assert (W.unpack([W.pack(v) for v in x], 6) == x).all()
    assert W.pack(np.array([1, 2, 0, 0])) == W.pack(np.array([1, 2]))
