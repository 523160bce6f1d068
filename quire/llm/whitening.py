"""Embedding whitening by spectral divide and conquer over polar decompositions.

The components are the eigenvectors of the vectors' covariance V. For a shift s within
V's spectrum the polar factor of V - s*I has the eigenvalue 1 where V's are above s and
-1 where they are below, so half of it plus the identity projects on the upper invariant
subspace. Bases of that subspace and its complement split V in two, and each part that
may hold a wanted component is split again until it is a single direction, or a multiple
of the identity. Polar factors come from the QR-based dynamically weighted Halley
iteration (QDWH), which needs six QR factorisations or so whatever the condition.

Spark does all that touches rows: distinct vectors, their sums, their covariance by
partial sums in each task, and the projection. Only matrices of the vectors' dimension
reach the driver, and a matrix of dimension x components is broadcast to the tasks.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from quire.llm.common import settle

EPS = np.finfo(float).eps
SHIFTS = (0.0, 0.13, -0.17, 0.31, -0.37, 0.53, -0.59, 0.71, -0.83)  # of the spread, round the mean
CELLS = 1 << 20  # numbers an array works on at a time


# -- the spectrum of one symmetric matrix ------------------------------------------


def polar(a: np.ndarray, rounds: int = 40) -> np.ndarray | None:
    """The orthogonal polar factor of a square matrix, or None if a is singular."""
    m = len(a)
    x = a / np.linalg.norm(a)
    try:
        low = 1 / (np.linalg.norm(np.linalg.inv(x), 1) * np.sqrt(m))
    except np.linalg.LinAlgError:
        return None
    if not low > EPS:
        return None
    eye = np.eye(m)
    for _ in range(rounds):
        sq = low * low
        g = np.cbrt(4 * (1 - sq) / (sq * sq))
        root = np.sqrt(1 + g)
        u = root + np.sqrt(max(0.0, 8 - 4 * g + 8 * (2 - sq) / (sq * root))) / 2
        v = (u - 1) ** 2 / 4
        w = u + v - 1
        q, _ = np.linalg.qr(np.vstack([np.sqrt(w) * x, eye]))
        new = (v / w) * x + (u - v / w) / np.sqrt(w) * (q[:m] @ q[m:].T)
        low = min(1.0, low * (u + v * sq) / (1 + w * sq))
        moved = np.linalg.norm(new - x)
        x = new
        if abs(1 - low) < 10 * EPS and moved < np.cbrt(4 * EPS):
            break
    return x


def divide(a: np.ndarray, size: float):
    """Bases of the invariant subspaces of a above and below some shift, or None if a
    is a multiple of the identity to rounding. size: the norm roundings are relative to."""
    m = len(a)
    mean = np.trace(a) / m
    spread = np.linalg.norm(a - mean * np.eye(m)) / np.sqrt(m)
    if spread <= 4 * EPS * size:
        return None
    best = None
    start = np.random.default_rng(7).standard_normal((m, m))
    for shift in SHIFTS:
        u = polar(a - (mean + shift * spread) * np.eye(m))
        if u is None:
            continue
        p = (u + u.T) / 4 + np.eye(m) / 2
        k = int(round(np.trace(p)))
        if not 0 < k < m:
            continue
        q, _ = np.linalg.qr(p @ start[:, :k], mode="complete")
        for _ in range(2):  # the range of p again, from a basis that is all but in it
            q, _ = np.linalg.qr(p @ q[:, :k], mode="complete")
        left = np.linalg.norm(q[:, k:].T @ a @ q[:, :k])
        if best is None or left < best[0]:
            best = left, q[:, :k], q[:, k:]
        if left <= 8 * EPS * size * np.sqrt(m):
            break
    return None if best is None else best[1:]


def components(a: np.ndarray, count: int | None = None):
    """(eigenvalues, falling; unit eigenvectors, one a column) of a symmetric matrix:
    the first ``count``, or all. Within equal eigenvalues any orthonormal basis."""
    count = len(a) if count is None else min(count, len(a))
    size = max(np.linalg.norm(a), np.finfo(float).tiny)
    done, todo = [], [np.eye(len(a))]
    while todo and sum(b.shape[1] for _, b in done) < count:  # parts come in falling order
        base = todo.pop()
        part = base.T @ a @ base
        part = (part + part.T) / 2
        halves = divide(part, size) if len(part) > 1 else None
        if halves is None:
            done.append((part.diagonal(), base))
        else:
            upper, lower = (np.linalg.qr(base @ h)[0] for h in halves)
            todo += [lower, upper]
    values = np.concatenate([e for e, _ in done])
    vectors = np.concatenate([b for _, b in done], axis=1)
    order = np.argsort(-values, kind="stable")[:count]
    return values[order], vectors[:, order]


# -- rows ----------------------------------------------------------------------------


def on_grid(vector: Column, grid: int) -> Column:
    """floor(grid * entry) of each entry as long; null for a vector that is null or has
    an entry that is null or not finite."""
    entries = F.transform(vector, lambda c: c.cast("double"))
    whole = F.forall(entries, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    return F.when(whole, F.transform(entries, lambda c: F.floor(c * grid)))


def _matrix(column, dimension: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dimension)


def _sums(fit: DataFrame, dimension: int) -> tuple[int, list[int]]:
    """Number of vectors and the exact sum of each dimension; long sums can't overflow,
    since upper and lower 32 bits are summed apart."""

    def run(batches):
        n, high, low = 0, np.zeros(dimension, np.int64), np.zeros(dimension, np.int64)
        for batch in batches:
            x = _matrix(batch["x"], dimension)
            n, high, low = n + len(x), high + (x >> 32).sum(0), low + (x & 0xFFFFFFFF).sum(0)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(dimension)), pa.array(np.full(dimension, n)), pa.array(high), pa.array(low)], names=["i", "n", "high", "low"]
        )

    rows = fit.mapInArrow(run, "i long, n long, high long, low long").groupBy("i").agg(F.sum("n"), F.sum("high"), F.sum("low"))
    rows = sorted(rows.collect())  # a row for each dimension
    return (rows[0][1] if rows else 0), [r[2] * 2**32 + r[3] for r in rows]


def _covariance(fit: DataFrame, n: int, mean: np.ndarray) -> np.ndarray:
    """The vectors' covariance: each is centred, then multiplied; divisor n."""
    dimension = len(mean)
    i, j = np.triu_indices(dimension)

    def run(batches):
        total = np.zeros((dimension, dimension))
        for batch in batches:
            x = _matrix(batch["x"], dimension)
            for at in range(0, len(x), max(1, CELLS // dimension)):
                d = x[at : at + max(1, CELLS // dimension)] - mean
                total += d.T @ d
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(total[i, j])], names=["i", "j", "v"])

    rows = fit.mapInArrow(run, "i long, j long, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect()
    out = np.zeros((dimension, dimension))
    for r in rows:
        out[r.i, r.j] = out[r.j, r.i] = r.v / n
    return out


def _deviations(x: np.ndarray, n: int, sums: list[int]) -> list:
    """The exact sum over dimensions of (n*x - sum)**2; None if it is beyond a long."""
    bound = n * max(abs(int(x.min(initial=0))), abs(int(x.max(initial=0)))) + max(map(abs, sums), default=0)
    if bound >= 2**62:
        exact = [sum((n * int(v) - s) ** 2 for v, s in zip(row, sums)) for row in x.tolist()]
        return [v if v < 2**63 else None for v in exact]
    y = n * x - np.array(sums, np.int64)
    about = (y.astype(float) ** 2).sum(1)
    exact = (y * y).sum(1)  # right modulo 2**64, so right where the true value is a long
    if (about < 2**62).all():
        return exact.tolist()
    return [v if v < 2**63 else None for v in (sum(int(e) ** 2 for e in row) for row in y.tolist())]


def whiten(vectors: DataFrame, count: int = 4, grid: int = 256, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """Vectors laid on a grid and whitened along their first components.

    Each entry c becomes the long x = floor(grid*c). Components are the unit eigenvectors
    of the covariance of the distinct x-vectors (n of them, of sums S; divisor n),
    numbered from 1 by falling eigenvalue e, either sign. Returns for each vector and
    each of the first ``count`` components: id, component, n, deviation (sum of
    (n*x - S)**2, exact; null if beyond a long), whitened ((x - S/n) along the component,
    over sqrt(e)), explained (e over the trace) and identity_error (how far the whitened
    distinct vectors' covariance is from the identity at most, one value).

    Rows whose vector is null, or holds a null, NaN or infinite entry, are left out, as
    are those of another length than the most common (the longest of several). Repeated
    vectors count once in the fit and each row is returned; repeated and null ids are
    rows like any. A component without variance (up to rounding) is none: vectors all
    alike, a single one or an empty table give no rows. Among equal eigenvalues any
    orthonormal basis may come. Entries beyond a long, once on the grid, are cut to it.
    Further columns are not read.
    """
    spark = vectors.sparkSession
    kind = vectors.schema[id_column].dataType.simpleString()
    base = vectors.select(F.col(id_column).alias("id"), on_grid(F.col(vector_column), grid).alias("x")).where("x IS NOT NULL")
    sizes = base.groupBy(F.size("x").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).limit(1).collect()
    schema = f"id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    dimension = sizes[0][0] if sizes else 0
    if not dimension:
        return spark.createDataFrame([], schema).withColumnRenamed("id", id_column)
    base = base.where(F.size("x") == dimension)
    fit = settle(base.select("x").distinct())
    n, sums = _sums(fit, dimension)
    mean = np.array([s / n for s in sums])
    cov = _covariance(fit, n, mean)
    values, basis = components(cov, count)
    real = values > dimension * EPS * max(values.max(initial=0), np.finfo(float).tiny)
    values, basis = values[real], basis[:, real]
    if not len(values):
        return spark.createDataFrame([], schema).withColumnRenamed("id", id_column)
    explained = values / np.trace(cov)
    shared = spark.sparkContext.broadcast((mean, basis / np.sqrt(values)))  # dimension x count numbers

    def projected(x):
        mean, turn = shared.value
        step = max(1, CELLS // len(mean))
        return np.concatenate([(x[a : a + step] - mean) @ turn for a in range(0, len(x), step)] or [np.zeros((0, turn.shape[1]))])

    k = len(values)

    def check(batches):
        for batch in batches:
            w = projected(_matrix(batch["x"], dimension))
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(w[:, c])) for c in range(k)], names=[f"w{c}" for c in range(k)])

    pairs = [(a, b) for a in range(k) for b in range(a, k)]
    found = fit.mapInArrow(check, ", ".join(f"w{c} double" for c in range(k)))
    found = found.agg(*[F.covar_pop(f"w{a}", f"w{b}") for a, b in pairs]).first()
    error = max(abs(v - (a == b)) for v, (a, b) in zip(found, pairs))

    def run(batches):
        for batch in batches:
            x = _matrix(batch["x"], dimension)
            each = np.repeat(np.arange(len(x)), k)
            yield pa.RecordBatch.from_arrays(
                [
                    batch["id"].take(pa.array(each)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), pa.array(np.full(len(each), n)),
                    pa.array(_deviations(x, n, sums), pa.int64()).take(pa.array(each)), pa.array(projected(x).ravel()),
                    pa.array(np.tile(explained, len(x))), pa.array(np.full(len(each), error)),
                ],
                names=["id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return base.mapInArrow(run, schema).withColumnRenamed("id", id_column)
