"""Operator 13: whitening from a pivoted Cholesky factor and one-sided Jacobi rotations.

The covariance is fitted on the distinct integer vectors. Vectors travel packed in the narrowest of 2,
4 or 8 bytes an entry, so telling them apart moves less than the input, and a vector that a third of
the rows share is combined before the shuffle. A first pass over the distinct ones sums up entries
exactly, a second the products of centred entries: a task returns one triangular row of sums per
dimension, added up by dimension pair in Spark. Of the data only these ``dims * (dims + 1) / 2`` numbers
reach the driver.

There ``cholesky`` factors the scatter with full pivoting, which ends at its rank, and ``jacobi`` turns
pairs of columns of the triangular factor until all are orthogonal; columns of a round are disjoint and
turn at once. The columns' squared norms are the eigenvalues and the columns, normalised and brought
back into the order of the dimensions, the components. A third pass measures the whitened covariance,
and the rows are projected where they lie.

Defined results: rows whose vector is null, or holds null or non-finite entries, are left out; shorter
vectors count as filled up with zeros; integers beyond a long are its ends. Equal rows are projected
each, but fitted once. Components of no variance cannot be whitened: there are as many as the rank, at
most ``components``, none for an empty table or a single vector. A deviation that does not fit a long
is null. Null keys stay. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import settle

COMPONENTS = 4
#: Pivots below this share of the largest are rounding, not variance.
RANK_SHARE = 1e-13
SWEEPS = 60
ROWS = 4096
WIDTHS = (np.int16, np.int32, np.int64)


@dataclass(frozen=True)
class Model:
    """Vectors fitted, exact sums per dimension, eigenvalues and components (columns), and their error."""

    n: int
    sums: list[int]
    values: np.ndarray
    components: np.ndarray
    trace: float
    identity_error: float = 0.0


def pack(x: np.ndarray) -> bytes:
    """An integer vector in the narrowest width, without the zeros it may end with."""
    x = np.trim_zeros(x, "b")
    low, high = (x.min(), x.max()) if len(x) else (0, 0)
    for i, kind in enumerate(WIDTHS):
        if np.iinfo(kind).min <= low and high <= np.iinfo(kind).max:
            return bytes([i]) + x.astype(kind).tobytes()
    raise AssertionError("int64 holds every entry")


def unpack(cells: list[bytes], dims: int) -> np.ndarray:
    out = np.zeros((len(cells), dims), np.int64)
    for i, cell in enumerate(cells):
        x = np.frombuffer(cell, WIDTHS[cell[0]], offset=1)
        out[i, : len(x)] = x
    return out


def packed(rows: DataFrame, vector: str) -> DataFrame:
    """``x`` as packed bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("x")
            flat, ends = column.flatten().to_numpy(), np.asarray(column.offsets) - column.offsets[0].as_py()
            yield pa.RecordBatch.from_arrays([pa.array([pack(flat[a:b]) for a, b in zip(ends, ends[1:])], pa.binary())], ["x"])

    return rows.select(F.col(vector).alias("x")).mapInArrow(run, "x binary")



def sums_of(vectors: DataFrame, dims: int) -> tuple[int, list[int]]:
    """The number of vectors and the exact sum of every dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, [0] * dims
        for batch in batches:
            x = unpack(batch.column("x").to_pylist(), dims)
            n += len(x)
            high, low = (x >> 32).sum(axis=0), (x & 0xFFFFFFFF).sum(axis=0)
            total = [t + (int(h) << 32) + int(v) for t, h, v in zip(total, high, low)]
        rows = [(i, n, str(t)) for i, t in enumerate(total)] if n else []
        yield pa.RecordBatch.from_pylist([dict(zip("ins", r)) for r in rows], pa.schema([("i", pa.int32()), ("n", pa.int64()), ("s", pa.string())]))

    parts = vectors.mapInArrow(run, "i int, n long, s string")
    got = parts.groupBy("i").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()
    sums = [0] * dims
    for r in got:
        sums[r["i"]] = int(r["s"])
    return (got[0]["n"] if got else 0), sums


def products_of(vectors: DataFrame, dims: int, project, width: int) -> np.ndarray:
    """Sum over all vectors of ``y y'`` for ``y = project(x)``, of ``width`` entries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = np.zeros((width, width)), False
        for batch in batches:
            cells = batch.column("x").to_pylist()
            for at in range(0, len(cells), ROWS):
                y = project(unpack(cells[at : at + ROWS], dims))
                total += y.T @ y
                seen = True
        rows = [total[i, : i + 1] for i in range(width)] if seen else []
        yield pa.RecordBatch.from_arrays([pa.array(range(len(rows)), pa.int32()), pa.array(rows, pa.list_(pa.float64()))], ["i", "v"])

    parts = vectors.mapInArrow(run, "i int, v array<double>").select("i", F.posexplode("v").alias("j", "v"))
    out = np.zeros((width, width))
    for r in parts.groupBy("i", "j").agg(F.sum("v").alias("v")).collect():
        out[r["i"], r["j"]] = out[r["j"], r["i"]] = r["v"]
    return out


def cholesky(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower factor ``L`` (dims x rank) and order ``p`` with ``a[p][:, p] = L L'``, largest pivot first."""
    a, n = a.astype(np.float64).copy(), len(a)
    order, factor = np.arange(n), np.zeros((n, n))
    first = float(a.diagonal().max(initial=0.0))
    for k in range(n):
        best = k + int(np.argmax(a.diagonal()[k:]))
        if not a[best, best] > RANK_SHARE * first:
            return factor[:, :k], order
        for m in (a, a.T, factor):
            m[[k, best]] = m[[best, k]]
        order[[k, best]] = order[[best, k]]
        factor[k, k] = np.sqrt(a[k, k])
        factor[k + 1 :, k] = a[k + 1 :, k] / factor[k, k]
        a[k + 1 :, k + 1 :] -= np.outer(factor[k + 1 :, k], factor[k + 1 :, k])
    return factor, order


def jacobi(factor: np.ndarray) -> np.ndarray:
    """The columns of ``factor`` turned against each other until they are orthogonal."""
    w = factor.copy()
    r = w.shape[1]
    if r < 2:
        return w
    if r % 2:
        w = np.hstack([w, np.zeros((len(w), 1))])
    ring = np.arange(w.shape[1])
    half = len(ring) // 2
    for _ in range(SWEEPS):
        turned = 0.0
        for _ in range(len(ring) - 1):
            i, j = ring[:half], ring[half:][::-1]
            p, q = w[:, i], w[:, j]
            alpha, beta, gamma = (p * p).sum(axis=0), (q * q).sum(axis=0), (p * q).sum(axis=0)
            size = np.sqrt(alpha * beta)
            share = np.abs(gamma) / np.where(size > 0, size, 1)
            turned = max(turned, float(share.max()))
            turn = share > 1e-16
            zeta = (beta - alpha) / (2 * np.where(turn, gamma, 1))
            t = np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.hypot(1, zeta))
            t = np.where(turn, t, 0.0)
            c = 1 / np.hypot(1, t)
            w[:, i], w[:, j] = c * p - c * t * q, c * t * p + c * q
            ring = np.concatenate([ring[:1], ring[-1:], ring[1:-1]])
        if turned < 1e-15 * len(ring):
            break
    return w


def components_of(scatter: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues of the scatter, falling, and their unit vectors as columns, largest entry positive."""
    factor, order = cholesky(scatter)
    turned = jacobi(factor)
    norms = np.sqrt((turned**2).sum(axis=0))
    best = [c for c in np.argsort(-norms, kind="stable") if norms[c] > 0]
    out = np.zeros((len(scatter), len(best)))
    out[order] = turned[:, best] / norms[best]
    signs = np.sign(out[np.abs(out).argmax(axis=0), np.arange(len(best))]) if len(best) else np.ones(0)
    return norms[best] ** 2, out * signs


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """``x - sums / n``: the whole part of the mean is taken off in integers, so no digit is lost."""
    whole = np.array([min(max(s // n, -(2**62)), 2**62) for s in sums], np.int64)
    rest = np.array([(s - int(w) * n) / n for s, w in zip(sums, whole)])
    wide = np.abs(x).max(initial=0) >= 2**62
    return (x.astype(np.float64) - whole if wide else (x - whole).astype(np.float64)) - rest


def fit(rows: DataFrame, vector: str = "x", components: int = COMPONENTS) -> Model:
    """The whitening of the distinct vectors in the column of long arrays ``vector``."""
    dims = rows.agg(F.max(F.size(vector))).first()[0] or 0
    vectors = settle(packed(rows, vector).distinct())
    n, sums = sums_of(vectors, dims)
    if not n:
        return Model(0, sums, np.empty(0), np.zeros((dims, 0)), 0.0)
    scatter = products_of(vectors, dims, lambda x: centred(x, n, sums), dims)
    values, directions = components_of(scatter / n)
    values, directions = values[:components], directions[:, :components]
    weights = directions / np.sqrt(values)
    width = len(values)
    seen = products_of(vectors, dims, lambda x: centred(x, n, sums) @ weights, width) / n if width else np.zeros((0, 0))
    error = float(np.abs(seen - np.eye(width)).max(initial=0.0))
    return Model(n, sums, values, directions, float(np.trace(scatter)) / n, error)


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Exact sums of ``(n * x - sums) ** 2``; None where a long does not hold it."""
    rough = ((centred(x, n, sums) * n) ** 2).sum(axis=1)
    small = np.array([((s + 2**63) % 2**64) - 2**63 for s in sums], np.int64)
    with np.errstate(over="ignore"):
        exact = ((x * np.int64(n) - small) ** 2).sum(axis=1)  # modulo 2**64, so right wherever it fits
    out: list[int | None] = exact.tolist()
    for i in np.flatnonzero(rough > 2.0**62):
        true = sum((n * int(v) - s) ** 2 for v, s in zip(x[i], sums))
        out[i] = true if true < 2**63 else None
    return out


def whiten(rows: DataFrame, model: Model, key: str = "vec_id", vector: str = "x") -> DataFrame:
    """``key, component, n, deviation, whitened, explained, identity_error`` of every row and component."""
    dims, width = len(model.sums), len(model.values)
    weights = model.components / np.sqrt(model.values)
    explained = model.values / model.trace if width else model.values
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows if width else 0, ROWS):
                part = batch.slice(at, ROWS)
                column = part.column("x")
                ends = np.asarray(column.offsets) - column.offsets[0].as_py()
                flat, size = column.flatten().to_numpy(), np.diff(ends)
                x = np.zeros((len(size), dims), np.int64)
                line = np.repeat(np.arange(len(size)), size)
                x[line, np.arange(len(flat)) - ends[line]] = flat
                found = centred(x, model.n, model.sums) @ weights
                lists = lambda v: pa.array(list(v), pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays(
                    [part.column("k"), pa.array(deviations(x, model.n, model.sums), pa.int64()), lists(found)], ["k", "deviation", "w"]
                )

    found = rows.select(F.col(key).alias("k"), F.col(vector).alias("x")).mapInArrow(run, f"k {kind}, deviation long, w array<double>")
    shares = F.array(*[F.lit(float(v)) for v in explained]) if width else F.array().cast("array<double>")
    return found.select("k", "deviation", F.posexplode("w").alias("c", "whitened")).select(
        F.col("k").alias(key), (F.col("c") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened",
        shares[F.col("c")].alias("explained"), F.lit(model.identity_error).alias("identity_error"),
    )
