"""Approximate nearest neighbours by multi-index hashing.

Vectors get binary codes: signs under learned rotations. A code is split into
16-bit substrings and each is indexed. Codes within Hamming radius r agree with
a query on some substring up to floor(r / substrings) bits, so probing every
indexed value that near, in each substring, retrieves all of them (pigeonhole);
the full distance then drops the rest, and the floats of what remains are
reranked by exact cosine. Where probing would retrieve a large share of a block,
the full distances of its rows to many queries are taken at once: the same rows.

Rotations and radius are fitted on a bounded sample. The index holds every row,
in blocks of a fixed number of rows; queries, a stated set, lie in blocks of their own.
A unit of work is a bounded number of query blocks and of blocks. Its query blocks come
first and are held, then its blocks pass one at a time, so memory and work are bounded.
A unit returns k rows a query, so nothing of the candidates is shuffled, and no block
passes the driver.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

_SUB = 16
# A product of matrices tells cosines to this, far more than rounding can add; what it leaves over is scored exactly.
_SLACK = 1e-9
# Probing is left out where it would retrieve more than this share of random codes.
_MOST = 0.125


class Model(NamedTuple):
    rotation: np.ndarray  # dimensions x bits
    radius: int

    @property
    def substrings(self) -> int:
        return self.rotation.shape[1] // _SUB

    @property
    def share(self) -> float:
        """The share of random codes that probing retrieves."""
        near = sum(math.comb(_SUB, i) for i in range(min(_SUB, self.radius // self.substrings) + 1)) / 2**_SUB
        return 1 - (1 - near) ** self.substrings

    def codes(self, x: np.ndarray) -> np.ndarray:
        """uint16 substrings of the codes of x's rows."""
        bits = (x @ self.rotation) > 0
        return np.packbits(bits, axis=1).view(np.uint16)


def _rotation(x: np.ndarray, seed: int, rounds: int) -> np.ndarray:
    """An orthogonal map that brings rows of x near corners of the cube: alternate signs and Procrustes."""
    rng = np.random.default_rng(seed)
    r = np.linalg.qr(rng.standard_normal((x.shape[1], x.shape[1])))[0]
    for _ in range(rounds):
        u, _, vt = np.linalg.svd(x.T @ np.sign(x @ r))
        r = u @ vt
    return r


def learn(x: np.ndarray, *, bits: int = 128, k: int = 5, recall: float = 0.97, rounds: int = 20, probes: int = 200) -> Model:
    """Rotations and radius from sample rows x (unit length).

    As many rotations as bits need, each from its own start. The radius is that
    which holds the share `recall` of the true k neighbours of `probes` sample
    rows; in the whole table neighbours are no farther than in a sample of it.
    """
    dims = x.shape[1]
    times = -(-bits // dims)
    rotation = np.concatenate([_rotation(x, s, rounds) for s in range(times)], axis=1)
    rotation = rotation[:, : max(_SUB, rotation.shape[1] // _SUB * _SUB)]
    if rotation.shape[1] % _SUB:
        rotation = np.pad(rotation, ((0, 0), (0, _SUB - rotation.shape[1] % _SUB)))
    model = Model(rotation, rotation.shape[1])
    codes = model.codes(x)
    near: list[np.ndarray] = []
    for q in range(min(probes, len(x))):
        cosine = x @ x[q]
        cosine[q] = -np.inf
        best = np.argsort(-cosine)[: min(k, len(x) - 1)]
        near.append(_hamming(codes[best], codes[q]))
    distances = np.concatenate(near) if near else np.empty(0)
    return model._replace(radius=int(np.quantile(distances, recall, method="higher"))) if len(distances) else model


def _hamming(codes: np.ndarray, one: np.ndarray) -> np.ndarray:
    return np.bitwise_count(codes ^ one).sum(axis=1, dtype=np.int64)


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hamming distances of all codes of a to all of b."""
    if a.shape[1] % 4 == 0:
        a, b = np.ascontiguousarray(a).view(np.uint64), np.ascontiguousarray(b).view(np.uint64)
    total = np.zeros((len(a), len(b)), np.uint16)
    for w in range(a.shape[1]):
        total += np.bitwise_count(a[:, [w]] ^ b[:, w])
    return total


def fit(vectors: DataFrame, dims: int, *, sample: int = 4096, n_rows: int | None = None, **options) -> Model | None:
    """A model of the usable (vec_id, v) rows; the `sample` of least hash of the id make it.

    Every partition sends its least rows to the driver. Of a known number of rows only those below a
    hash that some twice as many as wanted should lie below are looked at, so that these are few in all;
    where ids repeat so that they aren't enough, all are.
    """
    least = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample)
    rows = []
    if n_rows and n_rows > 4 * sample:
        below = F.xxhash64("vec_id") < F.lit(-(2**63) + 2**64 * 2 * sample // n_rows)
        rows = vectors.where(below).orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).collect()
    if len(rows) < sample:
        rows = least.collect()
    if not rows:
        return None
    x = np.array([r.v for r in rows], dtype=np.float64).reshape(-1, dims)
    return learn(x / np.linalg.norm(x, axis=1, keepdims=True), **options)


class Index:
    """One block's rows under each substring: sorted values and whose they are."""

    def __init__(self, model: Model, x: np.ndarray):
        norms = np.linalg.norm(x, axis=1, keepdims=True)
        self.model, self.unit = model, x / norms
        self.codes = model.codes(self.unit)
        self.lists = []
        for s in range(model.substrings):
            order = np.argsort(self.codes[:, s], kind="stable")
            values, starts = np.unique(self.codes[order, s], return_index=True)
            self.lists.append((values, np.append(starts, len(order)), order))

    def within(self, code: np.ndarray, radius: int) -> np.ndarray:
        """Rows whose code lies within the radius: probe, unite, verify on the full code."""
        seen = np.zeros(len(self.codes), dtype=bool)
        each = radius // self.model.substrings
        for s, (values, starts, order) in enumerate(self.lists):
            hit = np.flatnonzero(np.bitwise_count(values ^ code[s]) <= each)
            if len(hit) == len(values):
                seen[:] = True
                break
            sizes = starts[hit + 1] - starts[hit]
            first = np.repeat(starts[hit] - np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes)
            seen[order[first + np.arange(len(first))]] = True
        rows = np.flatnonzero(seen)
        return rows[_hamming(self.codes[rows], code) <= radius]


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row-wise cosine in double precision; equal pairs of vectors give equal values."""
    return (a * b).sum(axis=1) / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1)))


class Asked:
    """A block of queries and the k best rows that each has met."""

    def __init__(self, model: Model, k: int, ids: np.ndarray, x: np.ndarray):
        self.model, self.k, self.ids, self.x = model, k, ids.tolist(), x
        self.unit = x / np.linalg.norm(x, axis=1, keepdims=True)
        self.codes = model.codes(self.unit)
        self.best = [(np.empty(0, np.int64), np.empty(0))] * len(self.ids)

    def _first(self, ids: np.ndarray, score: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The k best, ties to the smaller id; an id's equal scores count once."""
        order = np.lexsort((ids, -score))
        ids, score = ids[order], score[order]
        new = np.ones(len(ids), dtype=bool)
        new[1:] = (ids[1:] != ids[:-1]) | (score[1:] != score[:-1])
        return ids[new][: self.k], score[new][: self.k]

    def _meet_together(self, index: Index, ids: np.ndarray, x: np.ndarray, near: np.ndarray) -> Iterable[int]:
        """Meets rows within the radius without probing; gives back the queries that are to be searched alone."""
        other = np.array(self.ids)[:, None] != ids
        inside = (_distances(self.codes, index.codes) <= self.model.radius) & other
        counts, enough = inside.sum(axis=1), np.minimum(self.k, other.sum(axis=1))
        full = np.array([len(b[0]) == self.k for b in self.best])
        floor = np.array([b[1][-1] if f else -np.inf for b, f in zip(self.best, full, strict=True)])
        if len(ids) > self.k and not full.all():
            floor[~full] = np.partition(np.where(inside[~full], near[~full], -np.inf), -self.k, axis=1)[:, -self.k]
        alone = set(np.flatnonzero(counts < enough).tolist())
        places, rows = np.nonzero(inside & ~(near < floor[:, None] - _SLACK))
        score = cosine(x[rows], self.x[places])
        ends = np.append(np.flatnonzero(places[1:] != places[:-1]) + 1, len(places))
        for start, end in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True):
            if start == end or (at := int(places[start])) in alone:
                continue
            found = self._first(ids[rows[start:end]], score[start:end])
            if not full[at] and len(found[0]) < self.k and end - start < counts[at]:  # some were an id's equal scores
                alone.add(at)
                continue
            self.best[at] = self._first(*(np.concatenate(two) for two in zip(self.best[at], found, strict=True)))
        return sorted(alone)

    def meet(self, index: Index, ids: np.ndarray, x: np.ndarray) -> None:
        all_bits, near = self.model.rotation.shape[1], self.unit @ index.unit.T
        alone = range(len(self.ids)) if self.model.share <= _MOST else self._meet_together(index, ids, x, near)
        for at in alone:
            qid, vector, code, radius = self.ids[at], self.x[at], self.codes[at], self.model.radius
            others = int((ids != qid).sum())
            while True:  # a block with too few codes in the radius is searched farther out
                rows = index.within(code, radius)
                rows = rows[ids[rows] != qid]
                if len(rows) >= min(self.k, others) or radius >= all_bits:
                    break
                radius = min(all_bits, radius + self.model.substrings)
            if len(self.best[at][0]) == self.k:
                rows = rows[~(near[at, rows] < self.best[at][1][-1] - _SLACK)]
            most = rows
            if len(rows) > self.k:
                most = rows[~(near[at, rows] < np.partition(near[at, rows], -self.k)[-self.k] - _SLACK)]
            found = self._first(ids[most], cosine(x[most], vector[None, :]))
            if len(found[0]) < self.k and len(most) < len(rows):  # some were an id's equal scores
                found = self._first(ids[rows], cosine(x[rows], vector[None, :]))
            self.best[at] = self._first(*(np.concatenate(two) for two in zip(self.best[at], found, strict=True)))


def _search(model: Model, k: int, dims: int):
    """Rows are (unit, kind, ids, vectors), packed and in order: a unit's query blocks, kind 0, then its blocks, kind 1."""

    def found(asked: list[Asked]) -> Iterator[pa.RecordBatch]:
        for block in asked:
            held = [(qid, *best) for qid, best in zip(block.ids, block.best, strict=True) if len(best[0])]
            if held:
                columns = [np.repeat([h[0] for h in held], [len(h[1]) for h in held]), np.concatenate([h[1] for h in held]), np.concatenate([h[2] for h in held])]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _FOUND, strict=True)], schema=_FOUND)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, asked = None, []
        for batch in batches:
            for unit, kind, ids, x in zip(*(batch.column(i) for i in range(4)), strict=True):
                if last != unit.as_py():
                    yield from found(asked)
                    last, asked = unit.as_py(), []
                ids, x = np.frombuffer(ids.as_buffer(), np.int64), np.frombuffer(x.as_buffer(), np.float64).reshape(-1, dims)
                if kind.as_py() == 0:
                    asked.append(Asked(model, k, ids.copy(), x.copy()))
                    continue
                index = Index(model, x)
                for block in asked:
                    block.meet(index, ids, x)
        yield from found(asked)

    return run


_FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


def _blocks(rows: DataFrame, n: int) -> DataFrame:
    """n blocks of about equal size, each one row of packed ids and vectors."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, parts = [], []
            for rows in batch.column(1):
                ids.append(rows.values.field("vec_id").to_numpy().tobytes())
                parts.append(rows.values.field("v").flatten().to_numpy().tobytes())
            columns = [batch.column(0), pa.array(ids, pa.binary()), pa.array(parts, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["b", "i", "x"])

    block = F.pmod(F.xxhash64("vec_id", "v"), F.lit(n)).cast("int")
    grouped = rows.groupBy(block.alias("b")).agg(F.collect_set(F.struct("vec_id", "v")).alias("rows"))
    return grouped.mapInArrow(pack, "b int, i binary, x binary")


def nearest(
    vectors: DataFrame,
    *,
    k: int = 5,
    query_every: int = 50,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    block_rows: int = 4000,
    query_rows: int = 500,
    task_blocks: int = 32,
    unit_blocks: int = 8,
    **fit_options,
) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest by cosine of rows whose id is divisible by query_every.

    Vectors that are null, zero, or hold a null or non-finite component take no
    part, nor do null ids, nor vectors whose length is not the commonest, the larger of
    equals. Ties go to the smaller id. A query's own id is never
    returned; further rows that repeat an id count as candidates of other queries,
    and as further queries give no rows of their own. With fewer than k
    candidates all are returned. An empty table gives no row.
    """
    v = F.col(vector_col).cast("array<double>")
    usable = (
        vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v"))
        .where("vec_id is not null and v is not null")
        .where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
        .where(F.exists("v", lambda x: x != 0))
    )
    lengths = usable.groupBy(F.size("v").alias("dims")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("dims"))
    about = lengths.first()
    dims, n_rows = (about.dims, about.n) if about else (1, 0)
    usable = usable.where(F.size("v") == dims)
    model = fit(usable, dims, k=k, n_rows=n_rows, **fit_options)
    base_blocks = max(1, -(-n_rows // block_rows))
    asked = usable.where(F.pmod("vec_id", F.lit(query_every)) == 0)
    asked = asked.groupBy("vec_id").agg(F.min("v").alias("v"))
    n_asked = asked.count()
    query_blocks = max(1, -(-n_asked // query_rows))
    if model is None:
        model = Model(np.zeros((dims, _SUB)), 0)
    base = stored(_blocks(usable, base_blocks), "ann-base")
    asks = stored(_blocks(asked, query_blocks), "ann-queries")
    # Each group of query blocks meets each group of blocks in a unit; there are some units for every core.
    groups = -(-query_blocks // task_blocks)
    wanted = 4 * vectors.sparkSession.sparkContext.defaultParallelism
    parts = min(base_blocks, max(-(-base_blocks // unit_blocks), -(-wanted // groups)))

    def dealt(blocks: DataFrame, kind: int, unit: F.Column) -> DataFrame:
        return blocks.select(F.explode(unit).alias("unit"), F.lit(kind).alias("kind"), "i", "x")

    every_part, every_group = F.sequence(F.lit(0), F.lit(parts - 1)), F.sequence(F.lit(0), F.lit(groups - 1))
    rows = dealt(asks, 0, F.transform(every_part, lambda p: p * groups + F.pmod("b", F.lit(groups))))
    rows = rows.unionByName(dealt(base, 1, F.transform(every_group, lambda g: F.pmod("b", F.lit(parts)) * groups + g)))
    rows = rows.repartitionById(parts * groups, "unit").sortWithinPartitions("unit", "kind")
    found = rows.mapInArrow(_search(model, k, dims), "query_id long, vec_id long, score double").distinct()
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
