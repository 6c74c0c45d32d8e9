"""Hard negatives against brute force, and the certainty of the intervals."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from seriespan.llm import negatives as N
from seriespan.llm.vectors import integer_rows

SCHEMA = "vec_id long, embedding array<float>, label int, k string, g string, x string, keys string"


def brute(rows, anchor, positives=5, negatives=5):
    """Over (key, label, vector) of the rows that take part, equal rows once."""
    rows = sorted({(k, y, tuple(v)) for k, y, v in rows})
    score = lambda a, b: sum(p * q for p, q in zip(a, b))
    out = set()
    for k, y, v in rows:
        if not anchor(k):
            continue
        same = sorted((-score(v, w), j) for j, z, w in rows if z == y and j != k)[:positives]
        for p, j in same:
            hard = sorted((-score(v, w), i) for i, z, w in rows if z != y and -4 * p <= 5 * score(v, w) <= -5 * p)[:negatives]
            out |= {(k, j, r + 1, i, -p, -s) for r, (s, i) in enumerate(hard)}
    return out


def rows_of(n, dims, seed, labels=3, hot=0.3):
    r = random.Random(seed)
    centre = [r.uniform(-0.5, 0.5) for _ in range(dims)]
    one = [r.uniform(-0.5, 0.5) for _ in range(dims)]
    out = []
    for i in range(n):
        v = one if r.random() < hot else [c + r.gauss(0, 0.3) for c in centre]
        out.append((i, v, r.randrange(labels)))
    return out


def frame(spark, rows):
    df = spark.createDataFrame([(*r, "a", "b", "c", "d") for r in rows], SCHEMA)
    return integer_rows(df.withColumnRenamed("x", "y"), into="v").withColumnRenamed("y", "x")


def found(spark, rows, **more):
    got = N.hard_negatives(frame(spark, rows), F.col("k") % 10 == 0, vector="v", **more)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def ints(v, dims):
    x = [int(np.floor(256 * float(np.float32(c)))) for c in v]
    return x + [0] * (dims - len(x))


@pytest.mark.parametrize("dims,more", [(3, {}), (70, {}), (16, {"slice_bytes": 600}), (8, {"positives": 2, "negatives": 7})])
def test_brute_force(spark, dims, more):
    rows = rows_of(160, dims, dims)
    rows += rows[:3]  # equal rows
    rows += [(7, rows[30][1], 1), (500, [0.25], 1), (510, [], 0), (520, [0.0] * dims, 2)]  # a shared key, short, no and zero vectors
    plain = [(k, y, ints(v, dims)) for k, v, y in rows]
    odd = [(None, [1.0] * dims, 1), (600, None, 1), (610, [None] * dims, 1), (620, [float("nan")] * dims, 1), (630, [float("inf")] + [0.0] * (dims - 1), 1),
           (640, [1.0] * dims, None), (650, [3e38] * dims, 1)]
    want = brute(plain, lambda k: k % 10 == 0, more.get("positives", 5), more.get("negatives", 5))
    assert want and found(spark, rows + odd, **more) == want


def test_empty_and_lonely(spark):
    assert found(spark, []) == set()
    assert found(spark, [(0, [0.5], 1)]) == set()
    assert found(spark, [(0, [0.5], 1), (1, [0.5], 1)]) == set()


def test_intervals_are_certain():
    r = np.random.default_rng(3)
    for dims, scale in ((1, 50), (5, 1000), (64, 256), (130, 1 << 20)):
        x = np.floor(r.standard_normal((200, dims)) * scale).astype(np.int64)
        x[:5] = 0
        a = N.Anchors(x[::7], np.zeros(29, np.int64), np.arange(29))
        codes, align = N.encode(x)
        true = (x[::7] @ x.T).astype(float)
        widths = []

        def wanted(low, high):
            assert (low <= true).all() and (true <= high).all()
            widths.append((high - low).mean())
            return np.ones(low.shape, bool)

        N.survivors(a, np.arange(29), codes, align, wanted)
        assert len(widths) == N.CODES and widths[-1] <= widths[0]


def test_products_are_the_signs_of_the_codes():
    x = np.floor(np.random.default_rng(5).standard_normal((40, 100)) * 100).astype(np.int64)
    codes, _ = N.encode(x)
    a = N.Anchors(x[:10], np.zeros(10, np.int64), np.arange(10))
    signs = np.where(np.unpackbits(codes[:, 0].view(np.uint8), axis=1, bitorder="little")[:, :100] == 1, 1, -1)
    z = x[:10] @ N.rotation(100)
    assert (np.abs(a.products(np.arange(10), codes[:, 0]) - z @ signs.T) <= a.error[:, None] + 1e-2).all()
