"""Whitening of vectors along their leading principal components.

Method. Two passes over the vectors: their count and exact integer sums by dimension, then the covariance, summed by task over vectors that are centred first (the
whole part of the mean is taken off in integers, the rest in doubles, so that nothing cancels). The covariance of d dimensions, d^2
numbers whatever the count of vectors, is reduced to a tridiagonal matrix by Householder reflections; bisection by Sturm counts finds the leading eigenvalues,
and inverse iteration their vectors, made orthogonal to those found before wherever eigenvalues stand close. The components go back
through the reflections and are broadcast; a third pass projects every vector, and the projections' own covariance is measured from them.

Entries become x = floor(scale * c) + shift, c as double, as 64-bit integers.

Defined cases: a vector that is null, empty or holds a null, NaN or infinite entry takes no part. Vectors of each length are fitted by
themselves. Entries of 2^40 / scale or more in size count as that. A component whose eigenvalue is not above 10^-12 of the trace (more components than
the vectors span, a single vector, equal vectors) has no rows, as nothing varies along it. Repeated rows count as often as they occur; a null id
stays. Exact sums beyond 64 bits end at the limits of a long. An empty table gives an empty result; other columns play no part.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shutterlake.session import written
from shutterlake.sources.tables import read_table

COMPONENTS, SCALE, SHIFT = 8, 1024, 100_000
#: Eigenvalues nearer than this share of the largest are one cluster.
CLOSE = 1e-3
#: Of the trace, below which nothing varies along a component.
NOTHING = 1e-12
_FAR = float(1 << 40)
_TOP = (1 << 63) - 1


def reduced(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Diagonal, off-diagonal and reflectors of a symmetric matrix's Householder tridiagonal form; reflector k acts on the places after k."""
    a, reflectors = np.array(v, dtype=np.float64), []
    n = len(a)
    for k in range(n - 2):
        x = a[k + 1 :, k]
        u = x.copy()
        size = np.sqrt((x / s) @ (x / s)) * s if (s := np.abs(x).max()) > 0 else 0.0
        u[0] += np.copysign(size, x[0])
        norm = np.sqrt(u @ u)
        u = u / norm if norm > 0 and np.abs(x[1:]).max() > 0 else np.zeros_like(u)  # nothing to clear
        reflectors.append(u)
        if u.any():
            block = a[k + 1 :, k + 1 :]
            p = block @ u
            w = p - (u @ p) * u
            block -= 2 * (np.outer(u, w) + np.outer(w, u))
            a[k + 1 :, k] -= 2 * u * (u @ a[k + 1 :, k])
            a[k, k + 1 :] = a[k + 1 :, k]
    return np.diag(a).copy(), np.diag(a, 1).copy(), reflectors


def below(diagonal: np.ndarray, off: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many eigenvalues of a tridiagonal matrix are less than each of ``at``: the negative terms of its Sturm sequence."""
    least = np.finfo(float).tiny * max(1.0, float((off**2).max(initial=0.0)))
    q = diagonal[0] - at
    count = (q < 0).astype(int)
    for d, e in zip(diagonal[1:], off, strict=True):
        q = np.where(np.abs(q) < least, -least, q)
        q = d - at - e * e / q
        count += q < 0
    return count


def leading_values(diagonal: np.ndarray, off: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` largest eigenvalues, falling, bisected side by side until doubles lie no closer."""
    n, reach = len(diagonal), np.abs(np.append(off, 0)) + np.abs(np.append(0, off))
    low, high = np.full(k, (diagonal - reach).min()), np.full(k, (diagonal + reach).max())
    high = high + np.abs(high) * 1e-12 + np.finfo(float).tiny
    rank = n - 1 - np.arange(k)  # so many eigenvalues are smaller
    while True:
        middle = low + (high - low) / 2
        open_ = (middle > low) & (middle < high)
        if not open_.any():
            return low + (high - low) / 2
        under = below(diagonal, off, middle) > rank
        high = np.where(open_ & under, middle, high)
        low = np.where(open_ & ~under, middle, low)


def _solved(diagonal: np.ndarray, off: np.ndarray, at: float, right: np.ndarray) -> np.ndarray:
    """(T - at) x = right by elimination with row exchanges; a pivot of zero becomes a tiny one."""
    n = len(diagonal)
    d, up, upper, x = diagonal - at, np.append(off, 0.0), np.zeros(n), right.copy()
    tiny = np.finfo(float).eps * max(float(np.abs(diagonal).max()), float(np.abs(off).max(initial=0.0)), np.finfo(float).tiny)
    for i in range(n - 1):
        low = off[i]
        if abs(low) > abs(d[i]):  # the row below goes first
            d[i], up[i], upper[i], below_, here = low, d[i + 1], up[i + 1], d[i], up[i]
            factor = below_ / d[i]
            d[i + 1], up[i + 1] = here - factor * up[i], -factor * upper[i]
            x[i], x[i + 1] = x[i + 1], x[i] - factor * x[i + 1]
        else:
            d[i] = d[i] or tiny
            factor = low / d[i]
            d[i + 1] -= factor * up[i]
            x[i + 1] -= factor * x[i]
    for i in range(n - 1, -1, -1):
        d[i] = d[i] if abs(d[i]) > tiny else np.copysign(tiny, d[i])
        x[i] = (x[i] - (up[i] * x[i + 1] if i + 1 < n else 0.0) - (upper[i] * x[i + 2] if i + 2 < n else 0.0)) / d[i]
        if abs(x[i]) > 1e200:
            x *= 1e-200
    return x


def eigenpairs(v: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` largest eigenvalues of a symmetric matrix, falling, and their unit vectors as rows."""
    n = len(v)
    k, size = min(k, n), float(np.abs(v).max())
    if not size:
        return np.zeros(k), np.eye(n)[:k]
    diagonal, off, reflectors = reduced(v / size)
    values, vectors, rng = leading_values(diagonal, off, k), [], np.random.default_rng(0)
    near = CLOSE * max(abs(values[0]), abs(values[-1]))
    for i, value in enumerate(values):
        close = [vectors[j] for j in range(i) if values[j] - value <= near]  # values fall, so a cluster is what stands just before
        x = rng.standard_normal(n)
        for _ in range(5):
            x = _solved(diagonal, off, float(value), x)
            x /= np.abs(x).max()
            for _ in range(2):  # twice is enough
                for y in close:
                    x -= (x @ y) * y
            x /= np.sqrt(x @ x)
        vectors.append(x)
    out = np.array(vectors)
    for at in range(len(reflectors) - 1, -1, -1):
        u = reflectors[at]
        out[:, at + 1 :] -= 2 * np.outer(out[:, at + 1 :] @ u, u)
    return values * size, out / np.sqrt((out**2).sum(axis=1))[:, None]


def whole(entries: np.ndarray, scale: int = SCALE, shift: int = SHIFT) -> np.ndarray:
    """x of each entry."""
    return np.clip(np.floor(scale * entries.astype(np.float64)), -_FAR, _FAR).astype(np.int64) + shift


def _batches(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _each(rows: DataFrame, dim: int, start: Callable, schema: str) -> DataFrame:
    """What ``start()(x of a batch)`` has gathered at a task's end, by rows of ``(i, v)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gathered = None
        add = start()
        for batch in batches:
            if batch.num_rows:
                gathered = add(gathered, whole(_batches(batch.column(0), dim)))
        if gathered is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(len(gathered)), pa.int32()), pa.array(list(gathered))], ["i", "v"])

    return rows.mapInArrow(run, schema)


def fitted(rows: DataFrame, dim: int, k: int) -> tuple[int, np.ndarray, np.ndarray, np.ndarray, float]:
    """Count, exact sums, eigenvalues, components and trace of ``rows(vec)`` of ``dim`` entries each."""
    n = rows.count()

    def sums():
        return lambda held, x: x.sum(axis=0) + (0 if held is None else held)

    total = _each(rows, dim, sums, "i int, v long").groupBy("i").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v")).collect()  # a row for each dimension
    exact = [int(v) for _, v in sorted(total)]
    mean = np.array([s // n for s in exact], np.int64)
    rest = np.array([(s - n * int(m)) / n for s, m in zip(exact, mean, strict=True)])

    def products():
        def add(held, x):
            y = (x - mean).astype(np.float64) - rest
            return y.T @ y + (0 if held is None else held)

        return add

    rows_of = _each(rows, dim, products, "i int, v array<double>").select("i", F.posexplode("v").alias("j", "v"))
    v = np.zeros((dim, dim))
    for i, j, x in rows_of.groupBy("i", "j").agg(F.sum("v")).collect():  # dim^2 numbers
        v[i, j] = x / n
    v = (v + v.T) / 2
    values, vectors = eigenpairs(v, k)
    trace = float(np.trace(v))
    kept = values > NOTHING * trace if trace > 0 else np.zeros(len(values), bool)
    return n, np.array(exact, object), values[kept], vectors[kept], trace


def deviations(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """Exact sum over dimensions of (n * x - S)^2, at most the largest long."""
    mean = np.array([int(s) // n for s in sums], np.int64)
    left = np.array([int(s) - n * int(m) for s, m in zip(sums, mean, strict=True)], object)
    z = x - mean
    bound = int(np.abs(z).max(initial=0)) * n + n
    if bound * bound * x.shape[1] < _TOP:
        return ((z * n - left.astype(np.int64)) ** 2).sum(axis=1)
    exact = ((z.astype(object) * n - left) ** 2).sum(axis=1)
    return np.array([min(int(d), _TOP) for d in exact], np.int64)


def _projected(rows: DataFrame, dim: int, n: int, sums: np.ndarray, values: np.ndarray, vectors: np.ndarray) -> DataFrame:
    """``(id, deviation, w)``: ``w`` the whitened coordinates of each row. The components, at most ``k`` times ``dim`` doubles, go with the task."""
    mean = np.array([int(s) // n for s in sums], np.int64)
    rest = np.array([(int(s) - n * int(m)) / n for s, m in zip(sums, mean, strict=True)])
    model = rows.sparkSession.sparkContext.broadcast((vectors / np.sqrt(values)[:, None], mean, rest, sums))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        axes, mean, rest, sums = model.value
        for batch in batches:
            if batch.num_rows:
                x = whole(_batches(batch.column(1), dim))
                w = ((x - mean).astype(np.float64) - rest) @ axes.T
                offsets = pa.array(np.arange(0, w.size + 1, len(axes), dtype=np.int32))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(deviations(x, n, sums)), pa.ListArray.from_arrays(offsets, pa.array(w.ravel()))], ["id", "deviation", "w"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, deviation long, w array<double>")


def identity_error(projected: DataFrame, k: int) -> float:
    """Largest absolute entry of the covariance of ``w`` minus the identity, centred by its own means."""
    at = lambda i: F.element_at("w", i + 1)
    means = projected.agg(*[F.avg(at(i)) for i in range(k)]).first()
    cells = [(i, j) for i in range(k) for j in range(i + 1)]
    found = projected.agg(*[F.avg((at(i) - F.lit(means[i])) * (at(j) - F.lit(means[j]))) for i, j in cells]).first()
    return max(abs(x - (i == j)) for x, (i, j) in zip(found, cells, strict=True))


def whitened(vectors: DataFrame, k: int = COMPONENTS, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``(vec_id, component, n, deviation, whitened, explained, identity_error)`` for each vector that takes part and each component up to ``k``."""
    spark = vectors.sparkSession
    bad = F.exists(vec_col, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    clean = vectors.filter(F.col(vec_col).isNotNull() & (F.size(vec_col) > 0) & ~bad).select(F.col(id_col).alias("id"), F.col(vec_col).alias("vec"))
    kind = vectors.schema[id_col].dataType.simpleString()
    out = spark.createDataFrame([], f"`{id_col}` {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")
    for (dim,) in clean.select(F.size("vec")).distinct().toLocalIterator():
        rows = clean.filter(F.size("vec") == dim)
        n, sums, values, axes, trace = fitted(rows.select("vec"), dim, k)
        if not len(values):
            continue
        table = written(_projected(rows, dim, n, sums, values, axes), "whitened")
        share = F.array(*[F.lit(float(e) / trace) for e in values])
        each = table.select("id", "deviation", F.posexplode("w").alias("at", "whitened"))
        columns = [F.col("id").alias(id_col), (F.col("at") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened", F.element_at(share, F.col("at") + 1).alias("explained")]
        out = out.unionByName(each.select(*columns, F.lit(identity_error(table, len(values))).alias("identity_error")))
    return out


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitened(read_table(spark, sf_dir, "embeddings"))
