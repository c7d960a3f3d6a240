"""Exact retrieval by pivots against brute force, and how many pairs it measures."""

from __future__ import annotations

import math

import numpy as np
import pytest

from stratolab.operators import advisory, retrieval

FILTERS = ["a", "b"]


def frame(spark, rows, name):
    return spark.createDataFrame([(int(i), a, b, None if v is None else [None if x is None else float(x) for x in v]) for i, a, b, v in rows], f"{name} long, a string, b int, embedding array<float>")


def clustered(rng, count, dims=16, centres=12, spread=0.05):
    middle = rng.standard_normal((centres, dims)) * 3
    which = rng.integers(0, centres, count)
    return (middle[which] + spread * rng.standard_normal((count, dims))).astype(np.float32)


def distances(q, c, metric):
    q, c = q.astype(np.float64), c.astype(np.float64)
    if metric == "l2sq":
        return ((q[:, None] - c[None]) ** 2).sum(axis=2)
    return 1 - q @ c.T / np.linalg.norm(q, axis=1)[:, None] / np.linalg.norm(c, axis=1)


@pytest.mark.parametrize("metric", ["l2sq", "cosine"])
@pytest.mark.parametrize("kind", ["clusters", "even"])
def test_pivots_find_what_brute_force_finds(spark, metric, kind):
    rng = np.random.default_rng(2)
    x = clustered(rng, 1500) if kind == "clusters" else rng.standard_normal((1500, 16)).astype(np.float32)
    x[10:20] = x[10]  # ties
    side = [(("x", "y", "z")[i % 3], i % 2) for i in range(len(x))]
    chunks = frame(spark, [(i, *side[i], x[i]) for i in range(len(x))], "chunk_id")
    asked = range(0, len(x), 20)
    queries = frame(spark, [(i, *side[i], x[i]) for i in asked], "query_id")
    found = retrieval.measured(queries, chunks, 4, metric, FILTERS, rings=6, part_rows=40)
    pairs = found.select("query_id", "chunk_id")
    assert pairs.count() == pairs.distinct().count()
    total = sum(side[i] == side[j] for i in asked for j in range(len(x)))
    if kind == "clusters":
        assert pairs.count() < total / 2
    got = {}
    for r in advisory.retrieve(queries, chunks, 4, metric, FILTERS, rings=6, part_rows=40).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.chunk_id))
    d = distances(x[list(asked)], x, metric)
    for row, i in enumerate(asked):
        mates = [j for j in range(len(x)) if side[j] == side[i]]
        near = sorted(round(d[row, j], 7) for j in mates)[:4]
        ids = [j for _, j in sorted(got[i])]
        assert [round(d[row, j], 7) for j in ids] == near


def test_odd_vectors_and_empty_classes(spark):
    ok = [1.0, 0.0]
    chunks = frame(spark, [(1, "x", 1, ok), (2, "x", 1, None), (3, "x", 1, [math.nan, 1]), (4, "x", 1, [1.0]), (5, "x", 1, [0.0, 0.0]), (6, "x", 1, [None, 1]), (7, "y", 1, ok), (8, "x", 1, ok)], "chunk_id")
    queries = frame(spark, [(1, "x", 1, [1.0, 1.0]), (2, "nowhere", 1, ok), (3, "x", 1, None), (4, "y", 1, ok), (5, None, 1, ok)], "query_id")
    key = lambda df: sorted((r.query_id, r.rank, r.chunk_id, r.empty_reason is None) for r in df.collect())
    none = [(2, None, None, False), (3, None, None, False), (5, None, None, False)]
    assert key(advisory.retrieve(queries, chunks, 4, "cosine", FILTERS)) == sorted([(1, 1, 1, True), (1, 2, 8, True), *none, (4, 1, 7, True)], key=str)
    assert (1, 2, 8, True) not in key(advisory.retrieve(queries, chunks, 1, "l2sq", FILTERS))
    empty = key(advisory.retrieve(queries, chunks.where("false"), 4, "l2sq", FILTERS))
    assert len(empty) == 5 and not any(r[3] for r in empty)
    assert advisory.retrieve(queries.where("false"), chunks, 4, "l2sq", FILTERS).isEmpty()


def test_all_chunks_equal(spark):
    chunks = frame(spark, [(i, "x", 1, [1.0, 2.0, 3.0]) for i in range(300)], "chunk_id")
    queries = frame(spark, [(7, "x", 1, [1.0, 2.0, 3.0])], "query_id")
    got = advisory.retrieve(queries, chunks, 3, "l2sq", FILTERS, part_rows=16).collect()
    assert sorted(r.chunk_id for r in got) == [0, 1, 2]
