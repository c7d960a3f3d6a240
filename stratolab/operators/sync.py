"""Slots, alignment of streams, gaps and their filling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalar import is_observed, is_usable, set_flag
from ..schema import BIT, LEADS, LOOKBACK, SLOT_MINUTES, TOLERANCE_S

SLOT_S = SLOT_MINUTES * 60


def nearest_slot(seconds: Column, slot_s: int = SLOT_S) -> Column:
    """The slot in seconds nearest a time; halfway belongs to the later."""
    return F.floor((seconds + slot_s // 2) / slot_s).cast("long") * slot_s


def admit(observations: DataFrame, time_col: str = "obs_s", tolerance: int = TOLERANCE_S, slot_s: int = SLOT_S) -> DataFrame:
    """Observations within tolerance of a slot, with slot_s and offset_s."""
    slot = nearest_slot(F.col(time_col), slot_s)
    with_slot = observations.withColumn("slot_s", slot).withColumn("offset_s", F.col(time_col) - F.col("slot_s"))
    return with_slot.where(F.abs("offset_s") <= tolerance)


def slot_spine(spark: SparkSession, first_s: int, last_s: int, streams: list[str], slot_s: int = SLOT_S) -> DataFrame:
    """Every (slot_s, stream) of a span."""
    slots = spark.range(first_s, last_s + 1, slot_s).select(F.col("id").alias("slot_s"))
    return slots.select("slot_s", F.explode(F.array(*map(F.lit, streams))).alias("stream"))


def synchronise(spine: DataFrame, frames: DataFrame) -> DataFrame:
    """A row for each (slot_s, stream) of the spine; an absent frame carries MISSING_FILE."""
    marked = frames.withColumn("present", F.lit(True))
    if "qc_flag" not in frames.columns:
        marked = marked.withColumn("qc_flag", F.lit(0))
    joined = spine.join(marked, ["slot_s", "stream"], "left")
    return joined.withColumn("qc_flag", F.coalesce("qc_flag", F.lit(BIT["MISSING_FILE"]))).withColumn(
        "present", F.coalesce("present", F.lit(False))
    )


complete_frames = synchronise


def asof_nearest(
    left: DataFrame, right: DataFrame, tolerance: int, *, time: str = "t_s", by: list[str] | None = None
) -> DataFrame:
    """left with the right row nearest in time within tolerance, the later of equals; null right columns if none.

    Times are seconds. Buckets as wide as the tolerance turn the band into an
    equi-join with three candidate buckets, so no pair outside it is formed.
    """
    by = by or []
    width = max(1, tolerance)
    bucket = lambda c: F.floor(F.col(c) / width).cast("long")
    keep = [c for c in right.columns if c not in (time, *by)]
    r = right.select(
        *by, F.col(time).alias("right_s"), *keep, F.explode(F.array(*[bucket(time) + d for d in (-1, 0, 1)])).alias("near")
    )
    keys = left.columns
    counted = left.groupBy(*keys).agg(F.count("*").alias("copies")).withColumn("near", bucket(time))
    joined = counted.join(r, [*by, "near"], "left")
    gap = F.abs(F.col("right_s") - F.col(time))
    best = F.max_by(F.struct("right_s", *keep), F.when(gap <= tolerance, F.struct(-gap, F.col("right_s")))).alias("best")
    found = joined.groupBy(*keys, "copies").agg(best)
    every = found.withColumn("copies", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return every.select(*keys, "best.*")


def snap_backward(seconds: Column, step_s: int) -> Column:
    """The last native step at or before a time, counted from the epoch."""
    return F.floor(seconds / step_s).cast("long") * step_s


def asof_backward(left: DataFrame, right: DataFrame, step_s: int, *, time: str = "t_s", by: list[str] | None = None) -> DataFrame:
    """left joined to right's row of the native step that covers it: an equi-join on the snapped time."""
    by = by or []
    r = right.withColumnRenamed(time, "snap_s")
    return left.withColumn("snap_s", snap_backward(F.col(time), step_s)).join(r, [*by, "snap_s"], "left")


def asof_latest(left: DataFrame, right: DataFrame, *, time: str = "t_s", value: str = "value", by: list[str]) -> DataFrame:
    """left with right's latest value at or before it, of any age: one ordered pass over both sides of each key."""
    l = left.select(*by, F.col(time), F.struct(*left.columns).alias("row"), F.lit(None).cast(right.schema[value].dataType).alias("v"))
    r = right.select(*by, F.col(time), F.lit(None).cast(l.schema["row"].dataType).alias("row"), F.col(value).alias("v"))
    w = Window.partitionBy(*by).orderBy(time, F.col("row").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    merged = l.unionByName(r).withColumn("latest", F.last("v", ignorenulls=True).over(w))
    return merged.where("row is not null").select("row.*", "latest")


def lookback(times: DataFrame, offsets: tuple[int, ...] = LOOKBACK, step_s: int = SLOT_S) -> DataFrame:
    """(t0_s, t, slot_s): the input slots of each valid time."""
    return times.select("t0_s", F.posexplode(F.array(*map(F.lit, offsets))).alias("t", "o")).select(
        "t0_s", "t", (F.col("t0_s") + F.col("o") * step_s).alias("slot_s")
    )


def leads(times: DataFrame, offsets: tuple[int, ...] = LEADS, step_s: int = SLOT_S) -> DataFrame:
    """(t0_s, lead, slot_s), leads counted from 0."""
    return lookback(times, offsets, step_s).withColumnRenamed("t", "lead")


def runs(df: DataFrame, keys: list[str], order: str, flag: Column) -> DataFrame:
    """(keys, start, length) of runs of rows for which flag holds, counted from 0 within keys."""
    w = Window.partitionBy(*keys).orderBy(order)
    numbered = df.select(*keys, order, (F.row_number().over(w) - 1).alias("i"), flag.alias("f"))
    held = numbered.where("f").withColumn("island", F.col("i") - F.row_number().over(w))
    return held.groupBy(*keys, "island").agg(F.min("i").alias("start"), F.count("*").alias("length")).drop("island")


def assess(frames: DataFrame, keys: list[str], order: str, observed: Column, limit: int = 2) -> DataFrame:
    """(keys, accepted, reason): refused without an observed frame, or with a gap over the limit."""
    missing = runs(frames, keys, order, ~observed).groupBy(*keys).agg(
        F.max("length").alias("longest"), F.sum("length").alias("total")
    )
    seen = frames.groupBy(*keys).agg(F.count_if(observed).alias("n"))
    joined = seen.join(missing, keys, "left")
    # The wording of reasons.
    reason = (
        F.when(F.col("n") == 0, F.lit("no observed frames in the sequence"))
        .when(F.col("longest") > limit, F.format_string("longest gap is %d frames, over the limit of %d", "longest", F.lit(limit)))
        .when(F.col("total").isNull(), F.lit("complete"))
        .otherwise(F.format_string("%d frames missing, longest run %d", "total", "longest"))
    )
    accepted = (F.col("n") > 0) & (F.coalesce("longest", F.lit(0)) <= limit)
    return joined.select(*keys, accepted.alias("accepted"), reason.alias("reason"))


def neighbours(df: DataFrame, keys: list[str], order: str, value: str = "value") -> DataFrame:
    """df with the previous and next observed order and value, the row itself left out."""
    w = Window.partitionBy(*keys).orderBy(order)
    back, ahead = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(1, Window.unboundedFollowing)
    at = F.when(F.col(value).isNotNull(), F.struct(F.col(order).alias("o"), F.col(value).alias("v")))
    both = df.withColumns({"p": F.last(at, ignorenulls=True).over(back), "q": F.first(at, ignorenulls=True).over(ahead)})
    return both.select(
        *df.columns, F.col("p.o").alias("prev_order"), F.col("p.v").alias("prev_value"),
        F.col("q.o").alias("next_order"), F.col("q.v").alias("next_value"),
    )


def fill_gaps(df: DataFrame, keys: list[str], order: str, value: str = "value", blended: Column | None = None) -> DataFrame:
    """df with value filled between neighbours, fill_method, filled, and flags OR-ed with what was done.

    Both neighbours: linear in order, or the nearer one, the earlier of equals, where
    `blended` is false, as for categories; one: held; none: GAP_FILL_FAILED. Old
    flags stay, so a filled frame that was missing is still not usable.
    """
    n = neighbours(df, keys, order, value)
    share = (F.col(order) - F.col("prev_order")) / (F.col("next_order") - F.col("prev_order"))
    blend = F.col("prev_value") + (F.col("next_value") - F.col("prev_value")) * share
    if blended is not None:
        blend = F.when(blended, blend).when(share <= 0.5, F.col("prev_value")).otherwise(F.col("next_value"))
    p, q = F.col("prev_value").isNotNull(), F.col("next_value").isNotNull()
    gap = F.col(value).isNull()
    method = F.when(~gap, F.lit(None)).when(p & q, "linear").when(p | q, "hold").otherwise("failed")
    out = n.withColumn("fill_method", method)
    if "qc_flag" in df.columns:
        done = F.when(F.col("fill_method").isin("linear", "hold"), set_flag("qc_flag", "GAP_FILLED_SPLINE")).when(
            F.col("fill_method") == "failed", set_flag("qc_flag", "GAP_FILL_FAILED")
        )
        out = out.withColumn("qc_flag", F.coalesce(done, F.col("qc_flag")))
    new = F.when(~gap, F.col(value)).when(p & q, blend).otherwise(F.coalesce("prev_value", "next_value"))
    return out.withColumn(value, new).withColumn("filled", F.coalesce(F.col("fill_method").isin("linear", "hold"), F.lit(False))).drop(
        "prev_order", "prev_value", "next_order", "next_value"
    )


def lift(df: DataFrame, keys: list[str], order: str, kind: str, value: str = "value") -> DataFrame:
    """Coarse values carried to finer rows: continuous between neighbours, others held; never beyond the last value."""
    if kind not in ("continuous", "precipitation", "categorical"):
        raise ValueError(f"unknown kind {kind!r}")
    n = neighbours(df, keys, order, value)
    share = (F.col(order) - F.col("prev_order")) / (F.col("next_order") - F.col("prev_order"))
    blend = F.col("prev_value") + (F.col("next_value") - F.col("prev_value")) * share
    inside = F.col("next_value").isNotNull()
    new = blend if kind == "continuous" else F.when(inside, F.col("prev_value"))
    return n.withColumn(value, F.coalesce(F.col(value), new)).select(df.columns)


def tile_shifts(pairs: DataFrame, present: DataFrame, tile: int, radius: int, levels: int = 0) -> DataFrame:
    """(seq, before, after, tile_row, tile_col, d struct<dr,dc>): how each tile of an earlier frame moved to the later one.

    pairs: (seq, before, after); present: (seq, frame, row, col, value), values not null. Least mean absolute difference
    over the cells that both have, then least |dr| + |dc|, dr and dc. With levels = 0 all (2 radius + 1)^2 shifts are tried.
    Otherwise frames are averaged over blocks of 2, 4, .. 2^levels cells, the whole reach is tried on the
    coarsest alone, and each finer one tries the nine shifts about twice the shift before, and then the nine about the best
    of these, since what is found coarsely may be off by more than one: on smooth fields the same shifts. A cell is then copied 18 times
    a level, and at the coarsest (2 radius / 2^levels + 3)^2 times; a level has a quarter of the cells of the one below.
    """
    if levels < 0 or tile % 2**levels:
        raise ValueError("a tile is a whole number of the coarsest level's blocks")
    tile_keys = ["seq", "before", "after", "tile_row", "tile_col"]
    flow = None
    for level in range(levels, -1, -1):
        block = 2**level
        side = tile // block
        cells = present if level == 0 else present.groupBy(
            "seq", "frame", F.floor(F.col("row") / block).cast("int").alias("row"), F.floor(F.col("col") / block).cast("int").alias("col")
        ).agg(F.avg("value").alias("value"))
        a = pairs.join(cells.withColumnRenamed("frame", "before"), ["seq", "before"]).withColumnRenamed("value", "v0")
        a = a.withColumns({f"tile_{c}": F.floor(F.col(c) / side).cast("int") for c in ("row", "col")})
        b = cells.select("seq", F.col("frame").alias("after"), F.col("row").alias("r1"), F.col("col").alias("c1"), F.col("value").alias("v1"))
        reach = -(-radius // block)
        # (what to centre on, how far to go): the whole reach once, or one step from twice the shift before and one from there.
        for centre, spread in ((None, reach),) if flow is None else ((2, 1), (1, 1)):
            around = a if centre is None else a.join(flow, tile_keys)
            middle = {c: F.lit(0) if centre is None else centre * F.col(f"d.{c}") for c in ("dr", "dc")}
            steps = F.sequence(F.lit(-spread), F.lit(spread))
            tried = around.withColumn("i", F.explode(steps)).withColumn("j", F.explode(steps))
            tried = tried.withColumns({"dr": middle["dr"] + F.col("i"), "dc": middle["dc"] + F.col("j")})
            tried = tried.where(F.greatest(F.abs("dr"), F.abs("dc")) <= reach)
            met = tried.withColumns({"r1": F.col("row") + F.col("dr"), "c1": F.col("col") + F.col("dc")}).join(b, ["seq", "after", "r1", "c1"])
            cost = met.groupBy(*tile_keys, "dr", "dc").agg(F.avg(F.abs(F.col("v0") - F.col("v1"))).alias("cost"))
            best = F.min_by(F.struct("dr", "dc"), F.struct("cost", F.abs("dr") + F.abs("dc"), "dr", "dc"))
            flow = cost.groupBy(*tile_keys).agg(best.alias("d"))
    return flow


def fill_advective(cells: DataFrame, tile: int, radius: int, coverage: float = 0.25, levels: int = 0) -> DataFrame:
    """Cells of gap frames moved in from the anchor frames on both sides.

    cells: (seq, frame, row, col, value) of whole sequences, gaps null, and qc_flag if
    there is one. Anchors are frames with a value in at least `coverage` of their cells; a frame
    between two anchors that is none itself is a gap. Per tile
    the shift of least mean absolute difference between the two anchors is found
    among (2 radius + 1)^2 (`tile_shifts`; with levels, from coarse to fine); a gap at share s takes the earlier anchor moved by s
    of it and the later moved back by 1 - s, blended by nearness, or the one
    that has a value there. Filled cells carry GAP_FILLED_OPTICAL_FLOW.
    """
    keys = ["seq", "row", "col"]
    seen = cells.groupBy("seq", "frame").agg(F.avg(F.col("value").isNotNull().cast("double")).alias("share"))
    frames = seen.select("seq", "frame", F.when(F.col("share") >= coverage, F.lit(True)).alias("ok"))
    present = cells.where("value is not null").select("seq", "frame", "row", "col", "value")
    w = Window.partitionBy("seq").orderBy("frame")
    at = F.when(F.col("ok"), F.col("frame"))
    gaps = frames.select(
        "seq", "frame", "ok",
        F.last(at, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("before"),
        F.first(at, ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing)).alias("after"),
    ).where("ok is null and before is not null and after is not null").drop("ok")
    pairs = gaps.select("seq", "before", "after").distinct()
    tiles = [F.floor(F.col(c) / tile).cast("int").alias(f"tile_{c}") for c in ("row", "col")]
    flow = tile_shifts(pairs, present, tile, radius, levels)
    share = (F.col("frame") - F.col("before")) / (F.col("after") - F.col("before"))
    moving = gaps.withColumn("s", share)

    def warp(anchor: str, part: Column, name: str) -> DataFrame:
        src = moving.join(present.withColumnRenamed("frame", anchor), ["seq", anchor]).select("*", *tiles)
        shifted = src.join(flow, ["seq", "before", "after", "tile_row", "tile_col"], "left")
        move = lambda c: F.col(c) + F.round(part * F.coalesce(F.col(f"d.d{c[0]}"), F.lit(0))).cast("int")
        return shifted.select("seq", "frame", "s", move("row").alias("row"), move("col").alias("col"), "value").groupBy(
            "seq", "frame", "s", "row", "col"
        ).agg(F.avg("value").alias(name))

    early = warp("before", F.col("s"), "early")
    late = warp("after", F.col("s") - 1, "late")
    both = early.join(late, ["seq", "frame", "s", "row", "col"], "full")
    blend = F.when(
        F.col("early").isNotNull() & F.col("late").isNotNull(), F.col("early") * (1 - F.col("s")) + F.col("late") * F.col("s")
    ).otherwise(F.coalesce("early", "late"))
    filled = both.select("seq", "frame", "row", "col", blend.alias("moved"))
    new = F.col("value").isNull() & F.col("moved").isNotNull()
    flag = F.col("qc_flag") if "qc_flag" in cells.columns else F.lit(0)
    return cells.join(filled, ["frame", *keys], "left").select(
        "seq", "frame", "row", "col", F.coalesce("value", "moved").alias("value"), new.alias("filled"),
        F.when(new, set_flag(flag, "GAP_FILLED_OPTICAL_FLOW")).otherwise(flag).alias("qc_flag"),
    )


def fractions(frames: DataFrame, keys: list[str], flags: str = "qc_flag") -> DataFrame:
    return frames.groupBy(*keys).agg(
        F.avg(is_usable(flags).cast("double")).alias("usable_fraction"),
        F.avg(is_observed(flags).cast("double")).alias("observed_fraction"),
    )


def last_frames(frames: DataFrame, keys: list[str], order: str, n: int) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(F.desc(order))
    return frames.withColumn("_back", F.row_number().over(w)).where(F.col("_back") <= n).drop("_back")


def stretch_uint8(cells: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """Values between the 1st and 99th percentile of their frame stretched to 0..255; null is 0, a flat frame is 0."""
    limits = cells.groupBy(*keys).agg(F.percentile(value, F.array(F.lit(0.01), F.lit(0.99))).alias("p"))
    low, high = F.col("p")[0], F.col("p")[1]
    ratio = F.try_divide(F.col(value) - low, high - low)
    scaled = F.floor(F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), ratio)) * 255, 9))
    joined = cells.join(limits, keys)
    level = F.when(F.col(value).isNull() | ratio.isNull(), F.lit(0)).otherwise(scaled)
    return joined.withColumn("level", level.cast("int")).drop("p")


def surface_record(slot_s: Column) -> Column:
    """The day whose accumulation a slot belongs to, in seconds."""
    return F.floor(slot_s / 86_400).cast("long") * 86_400


def select_level(cells: DataFrame, level: int) -> DataFrame:
    return cells.where(F.col("level") == level)


def modal_shape(frames: DataFrame, keys: list[str], order: str) -> DataFrame:
    """frames with whether (height, width) is the commonest of the sequence; the first seen wins ties."""
    sizes = frames.groupBy(*keys, "height", "width").agg(F.count("*").alias("n"), F.min(order).alias("o"))
    w = Window.partitionBy(*keys).orderBy(F.desc("n"), "o")
    modal = sizes.withColumn("k", F.row_number().over(w)).where("k = 1").select(*keys, F.struct("height", "width").alias("modal"))
    return frames.join(modal, keys).withColumn(
        "fits", (F.col("height") == F.col("modal.height")) & (F.col("width") == F.col("modal.width"))
    ).drop("modal")
