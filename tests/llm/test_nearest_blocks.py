"""Blocks of vectors meet in units without passing the driver, and units of any size give the same rows."""

from __future__ import annotations

import numpy as np

from stratolab.llm import ann


def frame(spark, n=1200, dims=16):
    x = np.random.default_rng(3).standard_normal((n, dims))
    x[700:712] = x[50]  # equal scores
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(701, x[50].tolist()), (702, (2 * x[50]).tolist())]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>")


def rows(found):
    return sorted((r.query_id, r.rank, r.vec_id, round(r.score, 12)) for r in found.collect())


def test_no_block_is_broadcast(spark):
    found = ann.nearest(frame(spark), block_rows=100, query_rows=4, task_blocks=2)
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "Join" not in plan


def test_units_of_any_size_give_the_same_rows(spark):
    vectors = frame(spark).cache()
    how = {"block_rows": 100, "query_rows": 4, "recall": 1.0}
    whole = rows(ann.nearest(vectors, task_blocks=100, unit_blocks=100, **how))
    assert [r[1] for r in whole] == [1, 2, 3, 4, 5] * 24
    assert rows(ann.nearest(vectors, task_blocks=1, unit_blocks=1, **how)) == whole
    assert [r[2] for r in whole if r[0] == 50] == [700, 701, 702, 703, 704]


def test_the_sample_is_the_same_with_the_number_of_rows(spark):
    vectors = frame(spark).toDF("vec_id", "v")
    one, two = ann.fit(vectors, 16, sample=100), ann.fit(vectors, 16, sample=100, n_rows=1202)
    assert one.radius == two.radius and (one.rotation == two.rotation).all()
    same = vectors.selectExpr("7L as vec_id", "v")
    assert ann.fit(same, 16, sample=100, n_rows=1202) is not None


def test_codes_compared_together_give_the_rows_of_probing(monkeypatch):
    x = np.random.default_rng(5).standard_normal((900, 32))
    x[300:340] = x[7]
    ids = np.arange(900)
    ids[320:340] = 300
    model = ann.learn(x / np.linalg.norm(x, axis=1, keepdims=True))
    best = []
    for share in (0.0, 1.0):
        monkeypatch.setattr(ann.Model, "share", share)
        asked = ann.Asked(model, 5, ids[:50], x[:50])
        for start in range(0, 900, 150):
            block = slice(start, start + 150)
            asked.meet(ann.Index(model, x[block]), ids[block], x[block])
        best.append([(i.tolist(), s.tolist()) for i, s in asked.best])
    assert best[0] == best[1]
    assert best[0][7][0] == [300, 301, 302, 303, 304]


def test_the_share_that_probing_retrieves():
    assert ann.Model(np.zeros((16, 128)), 7).share < 2 ** -12 < 0.8 < ann.Model(np.zeros((16, 128)), 55).share < 0.9
