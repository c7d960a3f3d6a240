"""Embedding whitening by components that contour integration finds.

The leading eigenvectors of the vectors' covariance are found slice by slice of its spectrum. Inertia counts,
the signs of a pivoted symmetric factorisation of V - s I, say how many eigenvalues lie above s; bisection on them
cuts the leading part into intervals that hold a few each. In an interval FEAST projects a random block onto the
eigenvectors that belong there: a contour round the interval is integrated by Gauss-Legendre quadrature, each node a
solve with the complex shifted covariance, and Rayleigh-Ritz on the projected block extracts components, until
their residuals are at rounding level. The number found must be that which inertia counts promise.

Plan: distinct quantised vectors are written once; sums and centred products are added up by task, then by row of
the matrix; a task solves an interval. What reaches the driver is bounded by the dimension: `max_dim` squared numbers.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

NODES = 8  # quadrature nodes on the upper half of a contour
RESIDUAL = 1e-13  # of the covariance's norm
_PIVOT = (1 + math.sqrt(17)) / 8


def inertia(a: np.ndarray) -> tuple[int, int, int]:
    """How many eigenvalues of the symmetric a are positive, negative and zero, by a pivoted LDL' factorisation.

    Pivots are single diagonal entries, or 2 x 2 blocks where the largest entry off the diagonal is much larger.
    """
    a = np.array(a, dtype=np.float64)
    tiny = np.finfo(np.float64).eps * np.abs(a).max(initial=0.0)
    plus = minus = 0
    while len(a):
        size = np.abs(a)
        p = int(size.diagonal().argmax())
        off = size - np.diag(size.diagonal())
        i, j = divmod(int(off.argmax()), len(a))
        if max(size[p, p], off[i, j]) <= tiny:
            break
        if size[p, p] >= _PIVOT * off[i, j]:
            plus, minus, pick = plus + (a[p, p] > 0), minus + (a[p, p] < 0), [p]
        else:  # a block of that kind has a negative determinant
            plus, minus, pick = plus + 1, minus + 1, [i, j]
        rest = np.delete(np.arange(len(a)), pick)
        side = a[np.ix_(rest, pick)]
        a = a[np.ix_(rest, rest)] - side @ np.linalg.solve(a[np.ix_(pick, pick)], side.T)
        a = (a + a.T) / 2
    return int(plus), int(minus), len(a)


def above(v: np.ndarray, s: float) -> int:
    """How many eigenvalues of v are larger than s."""
    return inertia(v - s * np.eye(len(v)))[0]


def intervals(v: np.ndarray, count: int, most: int = 16) -> list[tuple[float, float, int]]:
    """(low, high, number) of adjoining intervals, from the top, that hold the `count` largest eigenvalues.

    Each holds `most` at most; more where eigenvalues agree to about ten digits, which no cut can part, and
    then the last may hold some beyond `count`. Borders are put where counts differ on either side.
    """
    top = float(np.abs(v).sum(axis=1).max())  # Gershgorin
    high, done, found = top * (1 + 1e-9) + np.finfo(float).tiny, 0, []
    while done < count:
        wanted = min(count, done + most)
        low, up, held = -top * 1e-9 - np.finfo(float).tiny, high, len(v)
        # low has wanted or more above it, up fewer.
        while held != wanted and up - low > 1e-10 * top:
            middle = (low + up) / 2
            n = above(v, middle)
            low, up, held = (middle, up, n) if n >= wanted else (low, middle, held)
        # Away from the eigenvalue above: down, as long as the count stays.
        lower = low
        for _ in range(20):
            step = lower - (up - low) / 4
            if above(v, step) != held:
                break
            lower = step
        low = (low + lower) / 2 if lower < low else low
        found.append((float(low), float(high), held - done))
        high, done = low, held
    return found


def feast(v: np.ndarray, low: float, high: float, number: int, *, rounds: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """The `number` eigenvalues of v between low and high, falling, and their unit eigenvectors as columns.

    The block is wider than the number, so that neighbours outside the interval don't slow it down. Raises
    ArithmeticError where residuals stay above rounding level or another number than that is found.
    """
    dim, eye = len(v), np.eye(len(v))
    width = min(dim, number + max(8, number))
    norm = float(np.linalg.norm(v, 2))
    x, w = np.polynomial.legendre.leggauss(NODES)
    angle = math.pi / 2 * (1 - x)
    centre, radius = (low + high) / 2, (high - low) / 2
    block = np.random.default_rng(12).standard_normal((dim, width))
    for _ in range(rounds):
        block = np.linalg.qr(block)[0]
        image = np.zeros_like(block)
        for a, weight in zip(angle, w, strict=True):
            turn = np.exp(1j * a)
            image += (weight / 2) * (radius * turn * np.linalg.solve((centre + radius * turn) * eye - v, block)).real
        basis = np.linalg.qr(image)[0]
        values, small = np.linalg.eigh(basis.T @ v @ basis)
        block = basis @ small
        inside = (values > low) & (values < high)
        residual = np.linalg.norm(v @ block[:, inside] - block[:, inside] * values[inside], axis=0)
        if inside.sum() == number and residual.max(initial=0.0) <= RESIDUAL * norm * math.sqrt(dim):
            order = np.argsort(-values[inside], kind="stable")
            return values[inside][order], block[:, inside][:, order]
    raise ArithmeticError(f"{int(inside.sum())} of {number} eigenvalues between {low} and {high}, residual {residual.max(initial=0.0)}")


def components(spark, v: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """The `count` largest eigenvalues of the symmetric, non-negative v, falling, and unit eigenvectors as rows; an interval a task.

    All zero, v has eigenvalues of zero and the first axes for eigenvectors. An eigenvector's largest entry is positive.
    """
    count = min(count, len(v))
    scale = float(np.abs(v).max(initial=0.0))
    if not scale:
        return np.zeros(count), np.eye(len(v))[:count]
    unit = v / scale
    found = intervals(unit, count)

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for low, high, number in batch.itertuples(index=False):
                values, vectors = feast(unit, low, high, int(number))
                yield pd.DataFrame({"value": values, "vector": list(vectors.T)})

    cuts = spark.createDataFrame(found, "low double, high double, number int").repartition(len(found))
    rows = cuts.mapInPandas(solve, "value double, vector array<double>").collect()
    rows = sorted(rows, key=lambda r: -r["value"])[:count]
    vectors = np.array([r["vector"] for r in rows])
    signs = np.sign(vectors[np.arange(count), np.abs(vectors).argmax(axis=1)])
    return np.array([r["value"] for r in rows]) * scale, vectors * signs[:, None]


def _matrix(column: pa.Array) -> np.ndarray:
    """A list column without nulls, all of one length, as rows."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per task and dimension: sums of the high and low halves of x, so that none overflows, and the largest |x|."""
    high = low = most = None
    for batch in batches:
        if batch.num_rows:
            x = _matrix(batch.column(0))
            parts = (x >> 32).sum(axis=0), (x & 0xFFFFFFFF).sum(axis=0), np.maximum(x.max(axis=0), -(x.min(axis=0) + 1))
            high, low, most = parts if high is None else (high + parts[0], low + parts[1], np.maximum(most, parts[2]))
    if high is not None:
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(high))), pa.array(high), pa.array(low), pa.array(most)], names=["i", "high", "low", "most"])


def _products(means: np.ndarray, axes: np.ndarray | None):
    """Per task: the rows of the sum of products of centred vectors, projected on axes if there are any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                x = _matrix(batch.column(0).slice(at, 4096)) - means
                x = x if axes is None else x @ axes
                total = x.T @ x if total is None else total + x.T @ x
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(list(total), pa.list_(pa.float64()))], names=["i", "row"])

    return run


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one i added up, whichever batch they come in."""
    found: dict[int, np.ndarray] = {}
    for batch in batches:
        for i, row in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            got = row.values.to_numpy()
            found[i] = found[i] + got if i in found else got
    if found:
        yield pa.RecordBatch.from_arrays([pa.array(list(found)), pa.array(list(found.values()), pa.list_(pa.float64()))], names=["i", "row"])


def covariance(fit: DataFrame, n: int, means: np.ndarray, axes: np.ndarray | None = None) -> np.ndarray:
    """The covariance, divisor n, of fit's x, centred first, then projected on the columns of axes if given."""
    parts = fit.select("x").mapInArrow(_products(means, axes), "i long, row array<double>")
    rows = parts.repartition("i").mapInArrow(_added, "i long, row array<double>").collect()
    total = np.array([r["row"] for r in sorted(rows, key=lambda r: r["i"])])
    return (total + total.T) / 2 / n


def quantised(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, x) of the vectors that take part: x is floor(256 * c) of every entry c, as array<long>.

    Null vectors, and those with null or non-finite entries, are dropped; so are empty ones, and vectors of another
    length than the commonest (ties: the smaller), between which there is no covariance. Beyond the range of long x stays at its end.
    """
    doubles = vectors.select(F.col(f"`{id_col}`").alias("vec_id"), F.col(f"`{vector_col}`").cast("array<double>").alias("c"))
    finite = lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf")))
    good = doubles.where("c is not null and size(c) > 0").where(F.forall("c", finite))
    common = good.groupBy(F.size("c").alias("length")).count().orderBy(F.desc("count"), "length").first()
    good = good.where(F.size("c") == (common.length if common else 0))
    return good.select("vec_id", F.transform("c", lambda e: F.floor(e * 256).cast("long")).alias("x"))


def whitened(vectors: DataFrame, *, count: int = 4, max_dim: int = 4096, **columns) -> DataFrame:
    """One row a vector that takes part and component, 1 to count (or the dimension, if smaller).

    Columns vec_id, component int, n long, deviation long, whitened double, explained double, identity_error double. Means and
    covariance are those of the n distinct x. whitened is the centred x on the component over the root of its eigenvalue;
    explained the eigenvalue's share of the trace; identity_error the largest entry of the covariance of whitened,
    over the n distinct x, less the identity. deviation is exact, null where it exceeds long. Components whose eigenvalue is zero
    to rounding, as all are if n is 1, have null for whitened, do not count in identity_error, and explain zero, or null if
    the trace is zero. Repeated vectors, and repeated or null ids, are rows of their own. No vectors give no rows. Dimensions above
    max_dim are refused: the covariance has to fit the driver and a task.
    """
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    spark = vectors.sparkSession
    rows = quantised(vectors, **columns)
    fit = stored(rows.select("x").distinct(), "whitening-fit")
    n = fit.count()
    if not n:
        return spark.createDataFrame([], schema)
    dim = fit.select(F.size("x")).first()[0]
    if dim > max_dim:
        raise ValueError(f"vectors of {dim} entries, more than max_dim {max_dim}")
    decimal = lambda c: F.sum(F.col(c).cast("decimal(38,0)")).alias(c)
    parts = fit.mapInArrow(_sums, "i long, high long, low long, most long").groupBy("i").agg(decimal("high"), decimal("low"), F.max("most").alias("most"))
    parts = sorted(parts.collect(), key=lambda r: r["i"])
    sums = [(int(r["high"]) << 32) + int(r["low"]) for r in parts]
    means = np.array([s / n for s in sums])
    v = covariance(fit, n, means)
    trace = float(np.trace(v))
    values, axes = components(spark, v, count)
    real = values > dim * np.finfo(np.float64).eps * trace
    project = np.zeros_like(axes.T)
    project[:, real] = axes[real].T / np.sqrt(values[real])
    error = float(np.abs(covariance(fit, n, means, project[:, real]) - np.eye(real.sum())).max()) if real.any() else None
    explained = [float(e) / trace if trace else None for e in np.where(real, values, 0.0)]
    widest = max(int(r["most"]) + 1 + (abs(s) + n - 1) // n for r, s in zip(parts, sums, strict=True))
    small = dim * (n * widest) ** 2 < 1 << 63
    exact = np.array(sums, dtype=np.int64 if small else object)
    k = len(values)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                batch = whole.slice(at, 4096)
                x = _matrix(batch.column(1))
                off = n * (x if small else x.astype(object)) - exact
                deviation = pa.array([d if d < 1 << 63 else None for d in (off * off).sum(axis=1).tolist()], pa.int64())
                scores = (x - means) @ project
                ids = np.repeat(np.arange(len(x)), k)
                tile = lambda values, kind, m=len(x): pa.array(list(values) * m, kind)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(ids)), tile(range(1, k + 1), pa.int32()), pa.array(np.full(len(ids), n)),
                        deviation.take(pa.array(ids)), pa.array(scores.ravel(), mask=np.tile(~real, len(x))),
                        tile(explained, pa.float64()), tile([error], pa.float64(), len(ids)),
                    ],
                    names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), "x").mapInArrow(score, schema)
