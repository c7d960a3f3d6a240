"""Exact nearest chunks within equal metadata, measured in units; the triangle inequality skips blocks of them.

A unit is a bounded number of queries and of chunks of one filter class. A task holds a unit's queries, then its chunks. Chunks
whose nearest pivot is the same and whose distance to it lies in one ring make a block. A query can't be nearer to a block than
its own distance to a pivot is outside the range of the block's distances to that pivot. So each query's nearest block is
measured first; its k-th distance bounds what is wanted, and only blocks that may lie within it are measured as well. Cosine
distance is half the squared distance of unit vectors, so it is searched in the same way.

Blocks are measured by products of matrices. These say which pairs may be among the k nearest, and only such pairs are measured
entry by entry, so distances and ties are those of the plain formula. A unit gives k rows a query at most; pivots are chosen in it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.windows import shared_path

# Distances by products and bounds are off by less than this, relative to the largest: far more than rounding can add.
SLACK = 1e-9
# Rows of a block, and pairs, that are measured at once.
BLOCK, PAIRS = 512, 1 << 18


def _sum(terms: Callable[[int], np.ndarray], dims: int) -> np.ndarray:
    """Added up in order, as the formula in SQL does."""
    total = terms(0) + 0.0
    for i in range(1, dims):
        total = total + terms(i)
    return total


def l2_squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of the rows of a and b, pair by pair."""
    return _sum(lambda i: (a[:, i] - b[:, i]) ** 2, a.shape[1])


def cosine_distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    dot, own, other = (_sum(lambda i, x=x, y=y: x[:, i] * y[:, i], a.shape[1]) for x, y in ((a, b), (a, a), (b, b)))
    return 1 - np.clip(dot / np.sqrt(own * other), -1.0, 1.0)


MEASURES = {"l2sq": l2_squared, "cosine": cosine_distance}


def _sound(vector: Column, dims: int, metric: str) -> Column:
    """Whether a vector takes part: `dims` finite entries, not all of them zero if angles are wanted."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return (F.size(vector) == dims) & F.lit(dims > 0) & finite & (F.lit(True) if metric != "cosine" else F.exists(vector, lambda x: x != 0))


def _stored(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read back: it is used more than once."""
    path = shared_path(df.sparkSession, f"stratolab-{name}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def choose_pivots(points: np.ndarray, count: int) -> np.ndarray:
    """At most `count` of the points, far from each other."""
    found, far = [0], np.linalg.norm(points - points[0], axis=1)
    while len(found) < min(count, len(points)) and far.max() > 0:
        found.append(int(far.argmax()))
        far = np.minimum(far, np.linalg.norm(points - points[found[-1]], axis=1))
    return points[found]


def _far(points: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.stack([np.linalg.norm(points - p, axis=1) for p in pivots], axis=1)


class Unit:
    """Queries, and the k nearest of the chunks that they have met."""

    def __init__(self, k: int, metric: str, ids: np.ndarray, x: np.ndarray, *, pivots: int, rings: int, sample: int):
        self.k, self.metric, self.ids, self.x = k, metric, ids, x
        self.pivots, self.rings, self.sample = pivots, rings, sample
        self.points = self._points(x)
        self.rows = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))  # query's place, chunk_id, distance

    def _points(self, x: np.ndarray) -> np.ndarray:
        """Of length 1 if angles are wanted: then the squared distance is twice the cosine distance."""
        if self.metric != "cosine":
            return x
        large = x / np.abs(x).max(axis=1, keepdims=True)
        return large / np.linalg.norm(large, axis=1, keepdims=True)

    def _first(self, q: np.ndarray, ids: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The k nearest rows of each query, ties to the smaller id."""
        order = np.lexsort((ids, d, q))
        q, ids, d = q[order], ids[order], d[order]
        kept = np.ones(len(q), dtype=bool)
        kept[self.k :] = q[self.k :] != q[: -self.k]
        return q[kept], ids[kept], d[kept]

    def _blocks(self, points: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
        """Places of the chunks of each block, and the least that each query's distance to each block can be."""
        pivots = choose_pivots(points[np.linspace(0, len(points) - 1, min(self.sample, len(points))).astype(int)], self.pivots)
        far, at = _far(points, pivots), _far(self.points, pivots)
        own = far.argmin(axis=1)
        order = np.lexsort((far[np.arange(len(far)), own], own))
        blocks = []
        for one in np.split(order, np.cumsum(np.bincount(own, minlength=len(pivots)))[:-1]):
            ring = max(1, min(BLOCK, -(-len(one) // self.rings)))
            blocks += [one[i : i + ring] for i in range(0, len(one), ring)]
        gap = np.zeros((len(at), len(blocks)))
        for p in range(len(pivots)):
            low, high = (np.array([f(far[b, p]) for b in blocks]) for f in (np.min, np.max))
            np.maximum(gap, np.maximum(low - at[:, [p]], at[:, [p]] - high), out=gap)
        return blocks, gap

    def meet(self, ids: np.ndarray, x: np.ndarray) -> None:
        """Of equal vectors only the k smallest ids can be wanted by any query."""
        order = np.argsort(ids, kind="stable")
        ids, x = ids[order], x[order] + 0.0
        same = np.unique(np.ascontiguousarray(x).view(np.dtype((np.void, x.dtype.itemsize * x.shape[1]))).ravel(), return_inverse=True)[1]
        order = np.argsort(same, kind="stable")
        kept = np.ones(len(order), dtype=bool)
        kept[self.k :] = same[order][self.k :] != same[order][: -self.k]
        order = np.sort(order[kept])
        self._search(ids[order], x[order])

    def _search(self, ids: np.ndarray, x: np.ndarray) -> None:
        points = self._points(x)
        blocks, gap = self._blocks(points)
        square, norm = (self.points**2).sum(axis=1), (points**2).sum(axis=1)
        scale = float(square.max() + norm.max())
        slack = SLACK * scale
        near = np.full((len(self.ids), self.k), np.inf)  # squared distances of points, the least k met, as products tell them
        # What was met in an earlier piece bounds what is wanted in this.
        place = np.arange(len(self.rows[0])) - np.searchsorted(self.rows[0], self.rows[0])
        near[self.rows[0], place] = self.rows[2] * (2 if self.metric == "cosine" else 1)
        near.sort(axis=1)
        found: list[tuple[np.ndarray, np.ndarray]] = []
        held = 0

        def settle() -> None:
            """Measures what is still within reach, and keeps the k nearest."""
            nonlocal held
            rows = [self.rows]
            for q, c in found:
                for i in range(0, len(q), PAIRS):
                    a, b = q[i : i + PAIRS], c[i : i + PAIRS]
                    rows.append((a, ids[b], MEASURES[self.metric](self.x[a], x[b])))
                if len(rows) > 8:
                    rows = [self._first(*(np.concatenate(r) for r in zip(*rows, strict=True)))]
            self.rows = self._first(*(np.concatenate(r) for r in zip(*rows, strict=True)))
            found.clear()
            held = 0

        def measure(asked: np.ndarray, block: np.ndarray) -> None:
            nonlocal held
            d = square[asked, None] + norm[None, block] - 2 * (self.points[asked] @ points[block].T)
            least = np.partition(d, self.k - 1, axis=1)[:, : self.k] if len(block) > self.k else d
            near[asked] = np.partition(np.concatenate([near[asked], least], axis=1), self.k - 1, axis=1)[:, : self.k]
            q, c = np.nonzero(~(d > near[asked].max(axis=1)[:, None] + 2 * slack))  # what overflowed is kept
            found.append((asked[q], block[c]))
            held += len(q)
            if held > 4 * PAIRS:
                settle()

        first = gap.argmin(axis=1)
        for b, block in enumerate(blocks):
            if len(asked := np.flatnonzero(first == b)):
                measure(asked, block)
        for b, block in enumerate(blocks):
            reach = np.sqrt(np.maximum(near.max(axis=1), 0.0) + 2 * slack) * (1 + SLACK) + SLACK * np.sqrt(scale)
            if len(asked := np.flatnonzero((first != b) & ~(gap[:, b] > reach))):
                measure(asked, block)
        settle()


def _search(k: int, metric: str, dims: int, part_rows: int, options: dict):
    """Rows are (class, part, of, kind, id, e) in order: a unit's queries, kind 0, then its chunks, kind 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, unit, kept, n = None, None, ([], []), [0, 0]

        def flush(kind: int) -> None:
            nonlocal unit
            if n[kind]:
                ids, x = np.concatenate([i for i, _ in kept[kind]]), np.concatenate([v for _, v in kept[kind]])
                kept[kind].clear()
                n[kind] = 0
                if kind == 0:
                    unit = Unit(k, metric, ids, x, **options)
                elif unit:
                    unit.meet(ids, x)

        def found() -> Iterator[pa.RecordBatch]:
            flush(0)
            flush(1)
            if unit and len(unit.rows[0]):
                q, ids, d = unit.rows
                yield pa.RecordBatch.from_arrays([pa.array(unit.ids[q]), pa.array(ids), pa.array(d)], names=["query_id", "chunk_id", "distance"])

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(i).to_numpy().astype(np.int64) for i in range(4)], axis=1)
            ids = batch.column(4).to_numpy()
            x = batch.column(5).flatten().to_numpy().astype(np.float64).reshape(-1, dims)
            starts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
            for start, end in zip(starts, starts[1:], strict=False):
                *own, kind = keys[start].tolist()
                if own != key:
                    yield from found()
                    key, unit = own, None
                if kind == 1:
                    flush(0)
                kept[kind].append((ids[start:end].copy(), x[start:end]))
                n[kind] += end - start
                if kind == 1 and n[1] > 2 * part_rows:  # ids that repeat lie in one part
                    flush(1)
        yield from found()

    return run


def measured(queries: DataFrame, chunks: DataFrame, k: int, metric: str, filters: list[str], *, pivots: int = 8, rings: int = 16, part_rows: int = 16_384, query_rows: int = 4096, sample: int = 1024) -> DataFrame:
    """(query_id, chunk_id, distance) of the k nearest of each query in each part of its class: among them the k nearest of all.

    Null vectors, those with null or non-finite entries, of zeros under cosine, or of another length than the commonest of the
    chunks take no part.
    """
    chunks = _stored(chunks.select(*filters, F.col("chunk_id").cast("long"), F.col("embedding").alias("e")), "chunks")
    queries = _stored(queries.select(*filters, F.col("query_id").cast("long"), F.col("embedding").alias("e")), "queries")
    common = chunks.where("e is not null").groupBy(F.size("e").alias("n")).count().orderBy(F.desc("count"), "n").first()
    dims = common.n if common else 0
    good, asked = (df.where(_sound(F.col("e"), dims, metric)).withColumn("e", F.col("e").cast("array<double>") if chunks.schema["e"] != queries.schema["e"] else F.col("e")) for df in (chunks, queries))

    def sizes(df: DataFrame, rows: int, name: str) -> DataFrame:
        return df.groupBy(*filters).agg(F.ceil(F.count("*") / rows).cast("int").alias(name))

    classes = sizes(good, part_rows, "parts").join(sizes(asked, query_rows, "groups"), filters)
    classes = _stored(classes.withColumn("class", F.monotonically_increasing_id()), "chunk-classes")
    units = classes.agg(F.sum(F.col("parts").cast("long") * F.col("groups"))).first()[0] or 1

    def dealt(df: DataFrame, kind: int, name: str, own: str, other: str) -> DataFrame:
        """Rows of df in their own one of `own`, for each of `other`."""
        rows = df.join(classes, filters).withColumn("own", F.pmod(F.xxhash64(name), F.col(own)).cast("int"))
        rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col(other) - 1)))
        part, group = ("own", "other") if kind else ("other", "own")
        return rows.select("class", F.col(part).alias("part"), F.col(group).alias("of"), F.lit(kind).alias("kind"), F.col(name).alias("id"), "e")

    unit = ["class", "part", "of"]
    rows = dealt(asked, 0, "query_id", "groups", "parts").unionByName(dealt(good, 1, "chunk_id", "parts", "groups"))
    rows = rows.repartition(min(units, 10_000), *unit).sortWithinPartitions(*unit, "kind")
    options = {"pivots": pivots, "rings": rings, "sample": sample}
    return rows.mapInArrow(_search(k, metric, dims, part_rows, options), "query_id long, chunk_id long, distance double")


def nearest(queries: DataFrame, chunks: DataFrame, k: int, metric: str, filters: list[str], **options) -> DataFrame:
    """(query_id, rank, chunk_id, distance) of the k nearest chunks with equal filters, ties to the smaller chunk_id."""
    w = Window.partitionBy("query_id").orderBy("distance", "chunk_id")
    found = measured(queries, chunks, k, metric, filters, **options)
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
