"""Bilinear values at more points than may be gathered under their source cells."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratolab.functions.geo import Grid
from stratolab.operators import regrid

SOURCE = Grid(0.0, 3.0, 0.0, 3.0, 1.0, 4, 4)


def field(spark, frames=3):
    rng = np.random.default_rng(5)
    rows = [(f, r, c, float(v)) for f in range(frames) for r in range(4) for c in range(4) for v in [rng.standard_normal()]]
    return spark.createDataFrame(rows, "f int, row int, col int, value double")


def test_many_points_are_not_gathered_by_cell(spark):
    cells = field(spark)
    target = spark.range(200_000).select(F.col("id").alias("k"), (F.col("id") * 37 % 3000 / 1000).alias("lat"), (F.col("id") * 53 % 3000 / 1000).alias("lon"))
    out = regrid.regrid_bilinear(cells, SOURCE, target, ["k"], ["f"])
    assert "collect_list" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert out.count() == 600_000
    held = {(r.f, r.row, r.col): r.value for r in cells.collect()}
    for row in out.where("k % 9973 = 5").collect():
        y, x = row.k * 37 % 3000 / 1000, row.k * 53 % 3000 / 1000
        r, c, a, b = int(y), int(x), y - int(y), x - int(x)
        corners = [((r, c), (1 - a) * (1 - b)), ((r, c + 1), (1 - a) * b), ((r + 1, c), a * (1 - b)), ((r + 1, c + 1), a * b)]
        want = sum(w * held[(row.f, *at)] for at, w in corners if w > 1e-9)
        assert row.value == pytest.approx(want, abs=1e-6)


def test_both_ways_give_the_same_rows(spark, monkeypatch):
    cells = field(spark).where("not (row = 1 and col = 2) and not (f = 2 and row < 3)")
    cells = cells.withColumn("value", F.when(~((F.col("row") == 3) & (F.col("col") == 0)), F.col("value")))
    places = [(k, y / 4, x / 4) for k, (y, x) in enumerate((y, x) for y in range(-5, 18) for x in range(-5, 18))]
    places += [(7, 0.25, 0.5), (7, 2.5, 2.5), (8, 2.25, 2.75), (8, 2.25, 2.75), (None, 0.5, 0.5), (None, 2.5, 2.5), (900, None, 1.0), (901, 1.0, None), (902, -9.0, 1.0)]
    target = spark.createDataFrame(places, "k int, lat double, lon double")
    found = lambda: sorted(((r.f, r.k, None if r.value is None else round(r.value, 9)) for r in regrid.regrid_bilinear(cells, SOURCE, target, ["k"], ["f"]).collect()), key=str)
    few = found()
    monkeypatch.setattr(regrid, "MAX_BROADCAST_POINTS", 10)
    many = found()
    assert few and many == few
    assert sum(v is None for *_, v in many) > 10
