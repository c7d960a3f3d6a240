"""Exact selection, the reservoir's pieces against the ordered fold, and what its stream writes."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest

from stratolab.operators import replay, selection
from stratolab.streaming import online

SCHEMA = "season int, t_s long, score double, draw double, place double"


@pytest.mark.parametrize("share", [0.3, 0.999])
def test_selection_is_exact(spark, share):
    rng = np.random.default_rng(6)
    groups = {
        0: rng.standard_normal(700).tolist(), 1: [5.0] * 40, 2: [1.0, 2.0], 3: [-1e308, 1e308, 0.0, 1e-300, 1e-307, 1.0, math.nextafter(1, 2)], None: (10.0 ** rng.uniform(-200, 200, 300)).tolist(),
        4: rng.integers(0, 3, 500).astype(float).tolist(), 5: [0.25], 6: [None, math.nan, math.inf],
    }
    rows = [(g, v) for g, vs in groups.items() for v in vs] + [(2, None), (2, math.nan), (2, -math.inf)]
    got = {r.g: (r.n, r.quantile) for r in selection.quantiles(spark.createDataFrame(rows, "g int, v double"), ["g"], "v", share, bins=256).collect()}
    assert set(got) == set(groups) - {6}
    for g, (n, q) in got.items():
        assert n == len(groups[g]) and math.isclose(q, np.quantile(np.array(groups[g]), share), rel_tol=1e-12)


def test_selection_without_groups_or_rows(spark):
    table = spark.createDataFrame([(float(i),) for i in range(10)], "v double")
    assert [tuple(r) for r in selection.quantiles(table, [], "v", 0.5).collect()] == [(10, 4.5)]
    assert selection.quantiles(table.where("false"), [], "v", 0.5).isEmpty()
    with pytest.raises(ValueError, match="share"):
        selection.quantiles(table, [], "v", 1.5)


def rows_of(seed, seasons=3, count=250):
    dice = random.Random(seed)
    out = []
    for s in range(seasons):
        t = 0
        for _ in range(count):
            t += dice.choice([1800, 3600, 5400, 10800, 20000, 90000])
            out.append((s, t, dice.choice([0.0, round(dice.random(), 2)]), dice.random(), dice.random()))
    return out


def ordered(rows, policy, capacity):
    """The fold of each season in time order."""
    out = []
    for season in sorted({r[0] for r in rows}):
        box = replay.Reservoir(policy, capacity)
        mine = sorted(r[1:] for r in rows if r[0] == season)
        codes = [box.offer(*r)[0] for r in mine]
        out += [(season, t, s, c, t in box.records.rows) for (t, s, _, _), c in zip(mine, codes, strict=True)]
    return sorted(out)


@pytest.mark.parametrize(("seed", "capacity", "history"), [(1, 5, 40), (2, 60, 4096), (3, 500, 60), (4, 1, 30)])
def test_pieces_give_the_ordered_fold(spark, seed, capacity, history):
    policy = replay.Policy(min_history=20, quantile=0.4, floor=0.05, history=history)
    rows = rows_of(seed)
    want = ordered(rows, policy, capacity)
    got = replay.decorrelate(spark.createDataFrame(rows, SCHEMA), policy, capacity)
    assert sorted(map(tuple, got.collect())) == want
    assert capacity == 500 or any(r[3] == "admitted_evicting" for r in want)


def test_batch_and_fold_go_by_the_same_history(spark):
    policy = replay.Policy(min_history=5, quantile=0.75, history=50)
    rows = rows_of(9, seasons=1)
    box = replay.History(policy.history)
    for _, _, score, _, place in rows:
        box.add(place, score)
    kept = replay.score_history(spark.createDataFrame(rows, SCHEMA), policy)
    assert sorted((r.place, r.score) for r in kept.collect()) == box.rows and len(box.rows) == 50
    got = replay.admission_threshold(kept, policy).first()
    assert math.isclose(got.threshold, box.threshold(policy)) and got.rule == "streaming_quantile"
    cold = replay.admission_threshold(kept.limit(3), policy).first()
    assert (cold.threshold, cold.rule) == (policy.floor, "cold_start_floor")


def test_a_batch_writes_what_changes(spark, tmp_path):
    """A season's second batch of two rows writes a handful of entries, though its state holds hundreds; decisions are the fold's."""
    policy, rows = replay.Policy(min_history=20, quantile=0.4, history=150), rows_of(12, seasons=1)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for part in (rows[:-2], rows[-2:]):
            spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            source = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
            out = online.stream_reservoir(source, policy, capacity=30).writeStream.format("parquet").option("path", str(tmp_path / "out"))
            query = out.option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
            query.awaitTermination()
            changed = max(p["stateOperators"][0]["numRowsUpdated"] for p in query.recentProgress)
            assert changed > 150 if len(part) > 2 else 0 < changed <= 8
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    got = spark.read.parquet(str(tmp_path / "out"))
    assert sorted((r.t_s, r.code) for r in got.collect()) == [(t, c) for _, t, _, c, _ in ordered(rows, policy, 30)]
