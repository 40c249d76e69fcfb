"""Whitening of embeddings by their leading principal components.

Entries become integers, so the covariance of the distinct vectors is computed without rounding: tasks
sum products of differences from a centre near the mean, in 64 bits while these hold them, and the exact
sums give each entry of the matrix as a fraction. The matrix, d * d numbers, is reduced to tridiagonal form
by Householder reflections; its leading eigenvalues come from bisection by Sturm counts, its vectors from
inverse iteration, with vectors of a cluster of eigenvalues made orthogonal to one another. The projection
is broadcast; all passes over vectors run in tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged, table

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 16
#: Entries below this times SCALE are integers that doubles hold.
MOST = 2.0**46
#: Eigenvalues within this share of the greatest are a cluster; those below NIL of it have no component.
CLUSTER, NIL = 1e-3, 1e-12


def integers(vectors: DataFrame) -> DataFrame:
    """(vec_id, x array<long>): vectors without null or non-finite entries, of the most frequent length (of equally
    frequent ones the longest). An entry of 2**46 or more, whose integer doubles don't hold, is an error."""
    v = F.col("embedding").cast("array<double>")
    sound = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    rows = vectors.select("vec_id", v.alias("v")).where(F.col("v").isNotNull() & (F.size("v") > 0)).where(sound)
    bad = F.raise_error(F.lit("an entry is too large for an exact integer")).cast("long")
    x = F.transform("v", lambda c: F.when(F.abs(c) < F.lit(MOST), F.floor(c * F.lit(float(SCALE))) + F.lit(SHIFT).cast("long")).otherwise(bad))
    rows = staged(rows.select("vec_id", x.alias("x")), "integers")
    common = rows.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    return rows.where(F.size("x") == common["d"]) if common else rows


def _matrix(column: pa.ListArray, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False).reshape(-1, d)


def _summed(column: pa.ListArray, d: int, centre: np.ndarray, step: int = 4096) -> list[list[int]]:
    """The exact sums of products of a batch's differences from centre, as integers."""
    total = [[0] * d for _ in range(d)]
    for i in range(0, len(column), step):
        y = _matrix(column.slice(i, step), d) - centre
        most = int(np.abs(y).max(initial=0))
        if most * most * len(y) >= 1 << 63:
            part = (y.astype(object).T @ y.astype(object)).tolist()
        elif most * most * len(y) < 1 << 53:  # integers that doubles hold, by the quick product
            part = np.rint(y.astype(float).T @ y.astype(float)).astype(np.int64).tolist()
        else:
            part = (y.T @ y).tolist()
        total = [[a + b for a, b in zip(r, s, strict=True)] for r, s in zip(total, part, strict=True)]
    return total


def covariance(fit: DataFrame, d: int) -> tuple[int, list[int], np.ndarray]:
    """(n, sums S of each dimension, covariance with divisor n) of the vectors x of fit; exact but for the last rounding."""
    sums = fit.select(F.posexplode("x").alias("j", "c")).groupBy("j").agg(F.sum(F.col("c").cast("decimal(38,0)")).alias("s"), F.count("*").alias("n"))
    rows = sorted(sums.collect())  # d rows
    n, total = rows[0]["n"], [int(r["s"]) for r in rows]
    centre = np.array([round(Fraction(s, n)) for s in total], np.int64)

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        upper = np.triu_indices(d)
        whole = [[0] * d for _ in range(d)]
        for batch in batches:
            part = _summed(batch.column("x"), d, centre)
            whole = [[a + b for a, b in zip(r, s, strict=True)] for r, s in zip(whole, part, strict=True)]
        values = [str(whole[i][j]) for i, j in zip(*upper, strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(upper[0], pa.int32()), pa.array(upper[1], pa.int32()), pa.array(values)], names=["i", "j", "s"])

    entries = fit.select("x").mapInArrow(products, "i int, j int, s string").groupBy("i", "j").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    out = np.zeros((d, d))
    rest = [s - n * int(c) for s, c in zip(total, centre, strict=True)]
    for r in entries.collect():  # d * (d + 1) / 2 rows
        i, j = r["i"], r["j"]
        out[i, j] = out[j, i] = float(Fraction(n * int(r["s"]) - rest[i] * rest[j], n * n))
    return n, total, out


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(diagonal, off-diagonal, q) with a = q @ T @ q.T, by Householder reflections."""
    t, d = a.copy(), len(a)
    q = np.eye(d)
    for k in range(d - 2):
        x = t[k + 1 :, k]
        alpha = -np.copysign(np.linalg.norm(x), x[0])
        u = x.copy()
        u[0] -= alpha
        size = np.linalg.norm(u)
        if size == 0:
            continue
        u /= size
        low = t[k + 1 :, k:]
        low -= 2 * np.outer(u, u @ low)
        right = t[k:, k + 1 :]
        right -= 2 * np.outer(right @ u, u)
        q[:, k + 1 :] -= 2 * np.outer(q[:, k + 1 :] @ u, u)
    return np.diag(t).copy(), np.diag(t, -1).copy(), q


def below(diagonal: np.ndarray, off: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many eigenvalues of the tridiagonal matrix are below each of `at`: the negative pivots (Sturm's count)."""
    least = np.finfo(float).tiny * max(1.0, float((off**2).max(initial=0)))
    pivot = diagonal[0] - at
    count = (pivot < 0).astype(int)
    for i in range(1, len(diagonal)):
        pivot = np.where(np.abs(pivot) < least, -least, pivot)
        pivot = diagonal[i] - at - off[i - 1] ** 2 / pivot
        count += pivot < 0
    return count


def leading_values(diagonal: np.ndarray, off: np.ndarray, k: int) -> np.ndarray:
    """The k greatest eigenvalues, falling, by bisection down to neighbouring doubles."""
    reach = np.abs(np.append(off, 0)) + np.abs(np.append(0, off))
    d = len(diagonal)
    low, high = np.full(k, (diagonal - reach).min()), np.full(k, (diagonal + reach).max() * (1 + 1e-15) + np.finfo(float).tiny)
    place = d - np.arange(k)  # the i-th greatest has at most so many below an upper end
    for _ in range(2100):
        middle = low + (high - low) / 2
        if ((middle <= low) | (middle >= high)).all():
            break
        over = below(diagonal, off, middle) >= place
        high, low = np.where(over, middle, high), np.where(over, low, middle)
    return low + (high - low) / 2


def _solved(diagonal: np.ndarray, off: np.ndarray, shift: float, b: np.ndarray, tiny: float) -> np.ndarray:
    """x with (T - shift) x = b, by elimination with row exchanges; pivots of nothing count as tiny."""
    d = len(diagonal)
    main, upper, second, b = diagonal - shift, np.append(off, 0.0), np.zeros(d), b.copy()
    for i in range(d - 1):
        below_ = off[i]
        if abs(below_) > abs(main[i]):
            factor = main[i] / below_
            main[i], main[i + 1], upper[i] = below_, upper[i] - factor * main[i + 1], main[i + 1]
            second[i], upper[i + 1] = upper[i + 1], -factor * upper[i + 1]
            b[i], b[i + 1] = b[i + 1], b[i] - factor * b[i + 1]
        else:
            factor = below_ / (main[i] if main[i] else tiny)
            main[i + 1] -= factor * upper[i]
            b[i + 1] -= factor * b[i]
    x = np.zeros(d)
    for i in range(d - 1, -1, -1):
        rest = b[i] - (upper[i] * x[i + 1] if i + 1 < d else 0) - (second[i] * x[i + 2] if i + 2 < d else 0)
        x[i] = rest / (main[i] if abs(main[i]) > tiny else tiny)
    return x


def leading_vectors(diagonal: np.ndarray, off: np.ndarray, values: np.ndarray) -> np.ndarray:
    """A unit eigenvector in each column, by inverse iteration from fixed starts; those of eigenvalues in one cluster
    are made orthogonal at every step."""
    scale = max(float(np.abs(values).max(initial=0)), np.finfo(float).tiny)
    tiny, out = scale * np.finfo(float).eps / 4, np.zeros((len(diagonal), len(values)))
    first = 0
    for k, value in enumerate(values):
        if k and values[k - 1] - value > CLUSTER * scale:
            first = k
        x = np.random.default_rng(k).standard_normal(len(diagonal))
        for _ in range(5):
            x = _solved(diagonal, off, value, x / np.linalg.norm(x), tiny)
            for _ in range(2):
                x = x / np.abs(x).max()
                x = x - out[:, first:k] @ (out[:, first:k].T @ x)
        out[:, k] = x / np.linalg.norm(x)
    return out


def principal(matrix: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, unit vectors in columns) of the k greatest; an entry of greatest size is positive in each."""
    if len(matrix) == 1:
        return matrix[0].copy(), np.ones((1, 1))
    diagonal, off, q = tridiagonal(matrix)
    values = leading_values(diagonal, off, k)
    vectors = q @ leading_vectors(diagonal, off, values)
    return values, vectors * np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(k)])


def _off(x: np.ndarray, n: int, total: np.ndarray) -> np.ndarray:
    """n * x - S, exact."""
    if int(np.abs(x).max(initial=0)) * n >= 1 << 62:
        raise OverflowError("entries times the number of vectors leave 64 bits")
    return n * x - total


def _whitened(x: np.ndarray, n: int, total: np.ndarray, projection: np.ndarray) -> np.ndarray:
    return (_off(x, n, total) / n) @ projection


def identity_error(fit: DataFrame, n: int, total: np.ndarray, projection: np.ndarray) -> float:
    """The largest absolute entry of the covariance of whitened vectors minus the identity."""
    d, k = projection.shape

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = np.zeros((k + 1, k))
        for batch in batches:
            for i in range(0, batch.num_rows, 4096):
                w = _whitened(_matrix(batch.column("x").slice(i, 4096), d), n, total, projection)
                whole[:k] += w.T @ w
                whole[k] += w.sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(k + 1, dtype=np.int32), k)), pa.array(np.tile(np.arange(k, dtype=np.int32), k + 1)), pa.array(whole.ravel())], names=["i", "j", "s"])

    square = np.zeros((k + 1, k))
    for r in fit.select("x").mapInArrow(products, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).collect():  # k * (k + 1) rows
        square[r["i"], r["j"]] = r["s"]
    mean = square[k] / n  # whitened vectors are centred: nothing but rounding
    return float(np.abs(square[:k] / n - np.outer(mean, mean) - np.eye(k)).max(initial=0))


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: for each vector without null or
    non-finite entries and each component up to `components`.

    Vectors are floor(64 * entry) + 1000000; the fit list has each of these once. Components of no variance (fewer
    distinct vectors than dimensions, equal entries) have no rows, so a table of equal vectors gives none. Ragged
    vectors: those of the most frequent length take part. Empty vectors have no component. Null and repeated ids
    stay, a row of the result for each row. An entry of 2**46 or more and a deviation that leaves 64 bits are errors.
    """
    spark = vectors.sparkSession
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    rows = integers(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding"))
    head = rows.select(F.size("x").alias("d")).first()
    if head is None:
        return spark.createDataFrame([], schema)
    d = head["d"]
    fit = staged(rows.select("x").distinct(), "distinct-vectors")
    n, sums, matrix = covariance(fit, d)
    trace = float(np.trace(matrix))
    if not trace:
        return spark.createDataFrame([], schema)
    values, axes = principal(matrix, min(components, d))
    real = values > NIL * values[0]
    values, axes = values[real], axes[:, real]
    k = len(values)
    total, projection = np.array(sums, np.int64), axes / np.sqrt(values)
    error = identity_error(fit, n, total, projection)
    sent = spark.sparkContext.broadcast((total, projection, values / trace))  # (d + 1) * (k + 1) numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, projection, explained = sent.value
        for batch in batches:
            for i in range(0, batch.num_rows, 4096):
                part = batch.slice(i, 4096)
                x = _matrix(part.column("x"), d)
                off = _off(x, n, total)
                most = int(np.abs(off).max(initial=0))
                square = (off * off).sum(axis=1) if most * most * d < 1 << 63 else np.array([sum(int(c) ** 2 for c in r) for r in off], object)
                if square.max(initial=0) >= 1 << 63:
                    raise OverflowError("a deviation leaves 64 bits")
                white = _whitened(x, n, total, projection)
                at = pa.array(np.repeat(np.arange(len(x)), k))
                columns = [part.column("vec_id").take(at), np.tile(np.arange(1, k + 1, dtype=np.int32), len(x)), np.full(len(x) * k, n), np.repeat(square.astype(np.int64), k), white.ravel(), np.tile(explained, len(x)), np.full(len(x) * k, error)]
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names=[c.split()[0] for c in schema.split(", ")])

    return rows.mapInArrow(run, schema)


def query(spark, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))
