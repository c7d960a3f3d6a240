"""Packed windows against the same windows a row a cell, and what both shuffle."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from stratolab.functions.geo import Grid
from stratolab.functions.scalar import is_observed
from stratolab.operators import assemble, packed, sync
from stratolab.operators.packed import Layout
from stratolab.schema import BIT

STEP = 1800
CHANNELS = [(0, False, True), (3, False, False), (5, True, True), (8, False, True)]  # 8 has no cells


def by_rows(times, cells, static, height, width):
    """The windows with every cell of every frame a row: joins, windows over time, masks."""
    slots = sync.lookback(times)
    named = F.array(*[F.struct(F.lit(i).alias("channel_idx"), F.lit(s).alias("is_static"), F.lit(b).alias("blended")) for i, s, b in CHANNELS])
    dense = slots.withColumn("c", F.explode(named)).select("t0_s", "t", "slot_s", "c.*")
    for c, n in (("row", height), ("col", width)):
        dense = dense.withColumn(c, F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    joined = dense.join(cells.withColumnRenamed("value", "moving"), ["slot_s", "channel_idx", "row", "col"], "left").join(static.withColumnRenamed("value", "still"), ["channel_idx", "row", "col"], "left")
    framed = joined.withColumns({"valid_time": F.col("t0_s"), "value": F.coalesce("moving", "still")})
    filled = sync.fill_gaps(framed, ["valid_time", "channel_idx", "row", "col"], "t", blended=F.col("blended"))
    cell = Window.partitionBy("valid_time", "t", "row", "col")
    whole = F.min(F.when(~F.col("is_static"), F.col("value").isNotNull())).over(cell)
    out = assemble.fill_missing(filled.withColumn("cell_valid", F.coalesce(whole, F.lit(True))))
    return out.select("valid_time", "t", "channel_idx", "row", "col", "value", "valid", "filled", "cell_valid")


def packed_static(static, layout):
    tile = ["channel_idx", "tile_row", "tile_col"]
    held = layout.placed(static).groupBy(*tile).agg(F.collect_list(F.struct("place", "value")).alias("held"))
    return held.select(*tile, packed.dense(F.col("held"), layout.places).alias("values"))


def tables(spark, height, width, slots, seed, gone=0.1):
    dice = random.Random(seed)
    odd = [None, math.nan, math.inf]
    cells = [
        (t * STEP, i, r, c, dice.choice(odd) if dice.random() < 0.15 else dice.uniform(-9, 9))
        for t in range(slots) if dice.random() > 0.2
        for i in (0, 3) if dice.random() > gone
        for r in range(height) for c in range(width) if dice.random() > gone
    ]
    static = [(5, r, c, float(r * c)) for r in range(height) for c in range(width) if r + c != 3]
    return (
        spark.createDataFrame([(t * STEP,) for t in range(slots)], "t0_s long"),
        spark.createDataFrame(cells, "slot_s long, channel_idx int, row int, col int, value double"),
        spark.createDataFrame(static, "channel_idx int, row int, col int, value double"),
    )


def rows(df):
    names = ("valid_time", "t", "channel_idx", "row", "col", "value", "valid", "filled", "cell_valid")
    return sorted(tuple(round(r[n], 9) if n == "value" else r[n] for n in names) for r in df.collect())


@pytest.mark.parametrize(("tile", "stretch"), [(3, 12), (16, 20)])
def test_packed_windows_equal_rows(spark, tile, stretch):
    layout = Layout(Grid(0.0, 4.0, 0.0, 3.0, 1.0, 5, 4), tile=tile, stretch=stretch)
    times, cells, static = tables(spark, 5, 4, 31, seed=tile)
    got = packed.windows(times, packed.pack(cells, layout), packed_static(static, layout), CHANNELS, layout)
    assert rows(packed.unpacked(got, layout)) == rows(by_rows(times, cells, static, 5, 4))
    counted = packed.unpacked(got, layout).groupBy("valid_time", "t", "channel_idx").agg(
        F.count("*").alias("cells"), *[F.count_if(c).alias(c) for c in ("filled", "valid", "cell_valid")], F.round(F.sum("value"), 6).alias("total")
    )
    assert sorted(counted.collect()) == sorted(packed.summary(got).withColumn("total", F.round("total", 6)).select(counted.columns).collect())


def test_no_cells_give_empty_frames(spark):
    layout = Layout(Grid(0.0, 1.0, 0.0, 1.0, 1.0, 2, 2))
    times, cells, static = tables(spark, 2, 2, 2, seed=1)
    none = packed.windows(times, packed.pack(cells.where("false"), layout), packed_static(static.where("false"), layout), CHANNELS, layout)
    got = packed.unpacked(none, layout).collect()
    assert len(got) == 2 * 13 * 4 * 4 and not any(r.valid or r.filled or r.cell_valid or r.value for r in got)
    assert packed.windows(times.where("false"), packed.pack(cells, layout), packed_static(static, layout), CHANNELS, layout).isEmpty()


def test_windows_are_judged_as_rows_are(spark):
    dice = random.Random(4)
    frames = spark.createDataFrame(
        [(s, t * STEP, dice.choice([0, 0, 0, BIT["MISSING_FILE"]])) for s in ("a", "b", "other") for t in range(90) if dice.random() > 0.25],
        "stream string, slot_s long, qc_flag int",
    )
    times = spark.createDataFrame([(t * STEP,) for t in range(-3, 110)], "t0_s long")
    layout = Layout(Grid(0.0, 1.0, 0.0, 1.0, 1.0, 2, 2), stretch=17)
    spine = sync.lookback(times).withColumn("stream", F.explode(F.array(F.lit("a"), F.lit("b"))))
    held = spine.join(frames, ["stream", "slot_s"], "left").withColumn("qc_flag", F.coalesce("qc_flag", F.lit(BIT["MISSING_FILE"])))
    want = sync.assess(held, ["t0_s", "stream"], "t", is_observed("qc_flag")).select("t0_s", "stream", "accepted")
    got = packed.judge(times, frames, ["a", "b"], layout)
    assert sorted(map(tuple, got.select("t0_s", "stream", "accepted").collect())) == sorted(map(tuple, want.collect()))
    assert all(len(r.observed) == 13 for r in got.collect())


def shuffled(spark, df) -> int:
    """Bytes that running df writes to shuffles."""
    written = lambda: spark.sparkContext._jsc.sc().statusStore().executorSummary("driver").totalShuffleWrite()
    before = written()
    df.write.format("noop").mode("overwrite").save()
    return written() - before


def test_cells_are_shuffled_about_once(spark):
    """Thirteen frames a window cost less than twice the cells; a row a cell costs more than ten times as much."""
    layout = Layout(Grid(0.0, 15.0, 0.0, 15.0, 1.0, 16, 16), tile=8, stretch=48)
    times, cells, static = tables(spark, 16, 16, 60, seed=9, gone=0.0)
    cells = cells.where("channel_idx = 0").cache()
    once = shuffled(spark, cells.repartition(4, "row", "col"))
    still = packed_static(static, layout)
    dense = shuffled(spark, packed.windows(times, packed.pack(cells, layout), still, CHANNELS, layout))
    assert dense < 2 * once
    assert shuffled(spark, by_rows(times, cells, static, 16, 16)) > 10 * dense


def test_layouts_are_checked():
    for wrong in ({"tile": 0}, {"stretch": 11}, {"offsets": (0, 1)}):
        with pytest.raises(ValueError, match="tiles"):
            Layout(Grid(0.0, 1.0, 0.0, 1.0, 1.0, 2, 2), **wrong)
