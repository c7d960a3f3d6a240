"""Units of retrieval: what they give back, rows that repeat, and ties as SQL settles them."""

from __future__ import annotations

import duckdb
import numpy as np

from stratolab.operators import advisory, retrieval
from stratolab.plans import products


def chunks_of(spark, x, ids=None):
    rows = [(int(i), "x", [float(e) for e in v]) for i, v in zip(range(len(x)) if ids is None else ids, x, strict=True)]
    return spark.createDataFrame(rows, "chunk_id long, a string, embedding array<double>")


def test_units_give_back_k_rows_a_query(spark):
    x = np.random.default_rng(4).standard_normal((1200, 24))
    chunks = chunks_of(spark, x)
    queries = chunks.where("chunk_id % 20 = 0").withColumnRenamed("chunk_id", "query_id")
    found = retrieval.measured(queries, chunks, 4, "cosine", ["a"], part_rows=400)
    most = found.groupBy("query_id").count().agg({"count": "max"}).first()[0]
    assert found.select("query_id").distinct().count() == 60 and most <= 4 * 3


def test_ids_that_repeat_and_units_of_any_size(spark):
    rng = np.random.default_rng(6)
    x = np.concatenate([rng.integers(-2, 3, (400, 3)), np.full((60, 3), 1)]).astype(float)  # many ties
    x = x[(x != 0).any(axis=1)]
    ids = np.where(np.arange(len(x)) % 3 == 0, 7, np.arange(len(x)))
    chunks = chunks_of(spark, x, ids)
    queries = chunks_of(spark, x[:40]).withColumnRenamed("chunk_id", "query_id")
    for metric, measure in retrieval.MEASURES.items():
        want = []
        for q in range(40):
            d = measure(np.repeat(x[[q]], len(x), axis=0), x)
            want += [(q, r + 1, int(ids[i]), d[i]) for r, i in enumerate(np.lexsort((ids, d))[:5])]
        for sizes in ({"part_rows": 5, "query_rows": 7}, {"part_rows": 5, "query_rows": 100, "pivots": 1, "rings": 1}, {}):
            got = advisory.retrieve(queries, chunks, 5, metric, ["a"], **sizes).collect()
            assert sorted((r.query_id, r.rank, r.chunk_id, r.distance) for r in got) == want


def test_distances_that_overflow(spark):
    chunks = chunks_of(spark, [[1e200, 0.0], [-1e200, 0.0], [1.0, 1.0], [1.0, 1.5]])
    queries = chunks_of(spark, [[1.0, 1.0]]).withColumnRenamed("chunk_id", "query_id")
    got = advisory.retrieve(queries, chunks, 4, "l2sq", ["a"]).orderBy("rank").collect()
    assert [(r.chunk_id, r.distance) for r in got] == [(2, 0.0), (3, 0.25), (0, float("inf")), (1, float("inf"))]


def test_cosine_agrees_with_sql_on_multiples(spark, tmp_path):
    rng = np.random.default_rng(8)
    base = rng.integers(-3, 4, (30, 6)) + 0.5
    x = np.concatenate([base * 2.0**s for s in range(-4, 4)] + [base * s for s in (3.0, 0.3, 7.0)]).astype(np.float32)
    spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    spark.createDataFrame([(i, "xx", 4) for i in range(0, 3 * len(x))], "doc_id long, lang string, n_chars int").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    for name in ("embeddings", "documents"):
        con.execute(f"create view {name} as select * from read_parquet('{tmp_path}/{name}.parquet/*.parquet')")
    want = con.execute(f"SELECT query_id, rank, chunk_id, distance FROM ({products.R.oracles()['f21_retrieve_cosine']})").fetchall()
    got = [(r.query_id, r.rank, r.chunk_id, r.distance) for r in products.f21_retrieve_cosine(spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(want)
