"""The input-window pipeline: align, accept, regrid, scale, pack, fill, mask."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geo import Grid
from ..operators import assemble, norm, packed, regrid, sync
from ..operators.packed import Layout
from ..sources import grd
from .fixtures import view


def packed_inputs(
    times: DataFrame,
    frames: DataFrame,
    cells: DataFrame,
    static: DataFrame,
    stats: DataFrame,
    channels: DataFrame,
    policy: DataFrame,
    *,
    streams: list[str],
    source: Grid,
    layout: Layout,
) -> DataFrame:
    """Accepted windows a row a tile and channel, frames and cells as arrays: see packed.windows.

    times: t0_s; frames: (stream, slot_s, qc_flag); cells: (slot_s, channel, row,
    col, lat, lon, value); static: (channel, row, col, value) on the layout's grid, the same in
    each frame. Windows are judged on the frames of `streams` alone, and only cells of accepted ones
    are regridded: bilinear if continuous, nearest if categorical. Frames that are missing
    are filled from their neighbours in the window. channels: the declared ones that are wanted.
    """
    judged = packed.judge(times, frames, streams, layout)
    good = judged.groupBy("t0_s").agg(F.bool_and("accepted").alias("ok")).where("ok").select("t0_s")
    used = cells.join(good.select(F.explode(layout.slots("t0_s")).alias("slot_s")).distinct(), "slot_s", "left_semi")

    declared = channels.select("idx", "channel", "kind", "is_static").collect()  # one row a channel
    target = layout.grid
    points = grd.grid_cells(times.sparkSession, target).select("row", "col", "lat", "lon")
    read = used.select(F.col("slot_s").alias("slot"), "channel", F.lit(0).alias("level"), "row", "col", "lat", "lon", "value")
    regridded = []
    for kind in ("continuous", "categorical"):
        names = [c.channel for c in declared if c.kind == kind and not c.is_static]
        if names:
            regridded.append(regrid.regrid_stream(read.where(F.col("channel").isin(names)), kind, source, points, grid=target))
    dynamic = [norm.normalise(x.select("slot", "channel", "row", "col", "value"), stats, policy) for x in regridded]
    stacked = assemble.stack_channels(dynamic, channels).select(F.col("slot").alias("slot_s"), "channel_idx", "row", "col", "value")
    fixed = assemble.stack_channels([norm.normalise(static, stats, policy)], channels)
    tile = ["channel_idx", "tile_row", "tile_col"]
    fixed = layout.placed(fixed).groupBy(*tile).agg(F.collect_list(F.struct("place", "value")).alias("held"))
    fixed = fixed.select(*tile, packed.dense(F.col("held"), layout.places).alias("values"))
    wanted = [(c.idx, c.is_static, c.kind == "continuous") for c in declared]
    return packed.windows(good, packed.pack(stacked, layout), fixed, wanted, layout)


def build_inputs(*tables: DataFrame, streams: list[str], source: Grid, target: Grid, **layout) -> DataFrame:
    """packed_inputs a row a cell: (valid_time, t, channel_idx, row, col, value, valid, filled, cell_valid)."""
    how = Layout(target, **layout)
    return packed.unpacked(packed_inputs(*tables, streams=streams, source=source, layout=how), how)


FIXTURE_CHANNELS = ("insat_tir1", "dem_elevation", "lulc_mask")


FIXTURE_GRID = Grid(20.0, 20.25, 77.0, 77.25, 1 / 12, 4, 4)


def fixture_tables(spark, sf_dir: str) -> tuple[DataFrame, ...]:
    """times, frames, cells, static, stats, channels and policies from events: every slot of their span is a valid time."""
    f = view(spark, sf_dir, "fx_frame").where("stream = 'insat'")
    frames = f.select("stream", "slot_s", F.lit(0).alias("qc_flag"))
    k = F.explode(F.sequence(F.lit(0), F.lit(15)))
    cells = f.withColumn("k", k).select(
        "slot_s", F.lit("insat_tir1").alias("channel"), F.floor(F.col("k") / 4).cast("int").alias("row"), (F.col("k") % 4).cast("int").alias("col"),
        (20 + F.floor(F.col("k") / 4) / 12).alias("lat"), (77 + (F.col("k") % 4) / 12).alias("lon"), (F.col("v") % 100 + F.col("k")).cast("double").alias("value"),
    )
    ground = view(spark, sf_dir, "fx_static").withColumns({"row": F.floor(F.col("cell") / 4).cast("int"), "col": (F.col("cell") % 4).cast("int")})
    static = ground.select(F.lit("dem_elevation").alias("channel"), "row", "col", F.col("elevation_m").alias("value")).unionByName(
        ground.select(F.lit("lulc_mask").alias("channel"), "row", "col", F.col("lulc").cast("double").alias("value"))
    )
    stats = norm.build_channel_stats(cells.select("channel", "value").unionByName(static.select("channel", "value")))
    channels = norm.channel_table(spark).where(F.col("channel").isin(*FIXTURE_CHANNELS))
    ends = f.agg(F.min("slot_s").alias("a"), F.max("slot_s").alias("z")).first()
    times = sync.slot_spine(spark, ends.a or 0, ends.z or 0, ["insat"]).select(F.col("slot_s").alias("t0_s"))
    return times, frames, cells, static, stats, channels, norm.channel_policies(channels)


def fixture_inputs(spark, sf_dir: str) -> DataFrame:
    """The pipeline over every slot of the events' span on a 4 x 4 grid; slots without an event of the stream are missing."""
    layout = Layout(FIXTURE_GRID, tile=3)
    return packed_inputs(*fixture_tables(spark, sf_dir), streams=["insat"], source=FIXTURE_GRID, layout=layout)


FIXTURE_SQL = """WITH f AS (SELECT slot_s, v FROM fx_frame WHERE stream = 'insat'),
  lb AS (SELECT t0, k AS t, t0 + (k - 12) * 1800 AS slot_s FROM (SELECT unnest(range(a, z + 1, 1800)) AS t0 FROM (SELECT min(slot_s) AS a, max(slot_s) AS z FROM f)),
    (SELECT unnest(range(13)) AS k)),
  h AS (SELECT t0, t, v, sum(CASE WHEN v IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY t0 ORDER BY t ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS gone FROM lb LEFT JOIN f USING (slot_s)),
  good AS (SELECT t0 FROM h GROUP BY t0 HAVING count(v) > 0 AND max(gone) < 3),
  cl AS (SELECT unnest(range(16)) AS k), st AS (SELECT min(v % 100 + k) AS lo, max(v % 100 + k) AS hi FROM f, cl),
  w AS (SELECT t0, t, k, (v % 100 + k - lo) / (hi - lo) AS x FROM h SEMI JOIN good USING (t0), cl, st),
  n AS (SELECT *, last_value(CASE WHEN x IS NOT NULL THEN t END IGNORE NULLS) OVER b AS pt, last_value(x IGNORE NULLS) OVER b AS px,
      first_value(CASE WHEN x IS NOT NULL THEN t END IGNORE NULLS) OVER a AS nt, first_value(x IGNORE NULLS) OVER a AS nx
    FROM w WINDOW b AS (PARTITION BY t0, k ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), a AS (PARTITION BY t0, k ORDER BY t ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)),
  y AS (SELECT t0, t, 0 AS channel_idx, x IS NULL AS filled, coalesce(x, px + (nx - px) * (t - pt) / (nt - pt), px, nx) AS value FROM n
    UNION ALL SELECT t0, t, 27, false, (elevation_m - lo) / (hi - lo) FROM lb SEMI JOIN good USING (t0), fx_static, (SELECT min(elevation_m) AS lo, max(elevation_m) AS hi FROM fx_static)
    UNION ALL SELECT t0, t, 28, false, lulc FROM lb SEMI JOIN good USING (t0), fx_static)
  SELECT t0 AS valid_time, CAST(t AS int) AS t, CAST(channel_idx AS int) AS channel_idx, count(*) AS cells, count_if(filled) AS filled, count(value) AS valid, count(value) AS cell_valid,
    round(sum(value), 6) AS total FROM y GROUP BY ALL"""
