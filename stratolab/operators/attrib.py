"""Attribution and attention summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def attribution_summary(attr: DataFrame, by: list[str]) -> DataFrame:
    """Signed and absolute sums by channel, frame or cell."""
    return attr.groupBy(*by).agg(F.sum("attribution").alias("signed"), F.sum(F.abs("attribution")).alias("absolute"))


def top_drivers(attr: DataFrame, k: int, keys: list[str] | None = None) -> DataFrame:
    """The k channels of largest magnitude with sign and direction, for each of `keys`; k is the report's length."""
    keys = keys or []
    s = attribution_summary(attr, [*keys, "channel"])
    w = Window.partitionBy(*(keys or [F.lit(1)])).orderBy(F.desc(F.abs("signed")), "channel")  # channels of a window, a fixed number
    ranked = s.withColumn("rank", F.row_number().over(w))
    direction = F.when(F.col("signed") >= 0, "raised").otherwise("lowered")
    return ranked.where(F.col("rank") <= k).withColumn("direction", direction)


def _blocks(df: DataFrame, factor: int) -> tuple[Column, Column]:
    return F.floor(F.col("map_row") / factor).cast("long").alias("block_row"), F.floor(F.col("map_col") / factor).cast("long").alias("block_col")


def pool_sum(maps: DataFrame, factor: int, keys: list[str] | None = None, value: str = "attribution", size: int | None = None) -> DataFrame:
    if size is not None and size % factor:
        raise ValueError(f"{factor} does not divide {size}")
    return maps.groupBy(*(keys or []), *_blocks(maps, factor)).agg(F.sum(value).alias(value))


def pool_mean(mask: DataFrame, factor: int, value: str = "mask") -> DataFrame:
    """Share of each block that the region covers. A region without a cell is refused by failing the job."""
    out = mask.groupBy(*_blocks(mask, factor)).agg(F.avg(F.col(value).cast("double")).alias("weight"))
    total = F.sum("weight").over(Window.partitionBy(F.lit(1)))  # blocks of one map, a fixed number
    return out.withColumn("weight", F.when(total > 0, F.col("weight")).otherwise(F.raise_error(F.lit("the region is empty")).cast("double")))


def convergence_check(attr: DataFrame, difference: float, tolerance: float = 0.05, keys: list[str] | None = None) -> DataFrame:
    """Residual of the attributions' sum, of each of `keys`, against the output difference they should explain."""
    total = F.sum("attribution")
    out = attr.groupBy(*(keys or [])).agg(total.alias("total"), F.abs(total - difference).alias("residual"))
    return out.withColumn("converged", F.col("residual") <= tolerance * F.greatest(F.abs("total"), F.lit(1e-6)))


def attention_share(share: DataFrame, region: DataFrame | None = None, keys: list[str] | None = None) -> DataFrame:
    """Per frame t its share of attention over the region, and relative to uniform.

    share: (keys, t, map_row, map_col, share); region: (map_row, map_col, weight).
    No attention at all fails the job.
    """
    keys = keys or []
    if region is None:
        frames = share.groupBy(*keys, "t").agg(F.avg("share").alias("s"))
    else:
        joined = share.join(region, ["map_row", "map_col"])
        frames = joined.groupBy(*keys, "t").agg((F.sum(F.col("share") * F.col("weight")) / F.sum("weight")).alias("s"))
    w = Window.partitionBy(*(keys or [F.lit(1)]))  # frames of a window, a fixed number
    total = F.sum("s").over(w)
    part = F.when(total > 0, F.col("s") / total).otherwise(F.raise_error(F.lit("no attention over the region")).cast("double"))
    return frames.select(*keys, "t", part.alias("share"), (part * F.count("*").over(w)).alias("relative_to_uniform"))


def rank_frames(shares: DataFrame, k: int, keys: list[str] | None = None) -> DataFrame:
    w = Window.partitionBy(*(keys or [F.lit(1)])).orderBy(F.desc("share"), "t")
    return shares.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def lookback_indices(frames: DataFrame, keys: list[str], time: str = "slot_s") -> DataFrame:
    """frames with offset counted back from the last, and whether steps are even."""
    w = Window.partitionBy(*keys).orderBy(time)
    stepped = frames.withColumn("_gap", F.col(time) - F.lag(time).over(w))
    steps = stepped.groupBy(*keys).agg(
        F.count_distinct("_gap").alias("_gaps"), F.max("_gap").alias("_step"), F.max(time).alias("_end")
    )
    out = stepped.drop("_gap").join(steps, keys)
    even = F.col("_gaps") <= 1
    offset = F.when(even, F.coalesce((F.col(time) - F.col("_end")) / F.col("_step"), F.lit(0.0)).cast("long"))
    return out.withColumns({"even": even, "lookback": offset}).drop("_gaps", "_step", "_end")


def scale_by_max(maps: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """Values over the largest magnitude of their map; a zero map stays as it is."""
    top = maps.groupBy(*keys).agg(F.max(F.abs(value)).alias("top"))
    scaled = F.when(F.col("top") > 0, F.col(value) / F.col("top")).otherwise(F.col(value))
    return maps.join(top, keys).withColumn(value, scaled).drop("top")


def sum_frames(attr: DataFrame, keys: list[str] | None = None) -> DataFrame:
    return attr.groupBy(*(keys or []), "map_row", "map_col").agg(F.sum("attribution").alias("attribution"))


def _drivers() -> Column:
    one = F.struct("rank", "channel", F.round("signed", 6).alias("score"), "direction")
    return F.sort_array(F.collect_list(one)).alias("drivers")


def _evidence() -> Column:
    one = F.struct("rank", "t", F.round("share", 5).alias("share"), F.round("relative_to_uniform", 3).alias("relative"))
    return F.sort_array(F.collect_list(one)).alias("evidence")


def _caveats(excluded: list[str], steps: int) -> Column:
    """What weakens a row with total, residual, evidence, attributed and served."""
    slack = F.col("residual") > 0.05 * F.greatest("total", F.lit(1e-6))
    found = F.array(
        F.when(slack, F.format_string("attributions leave a residual of %.3g; raise the steps above %d", "residual", F.lit(steps))),
        F.when(F.get("evidence", F.lit(0))["relative"] < 1.2, F.lit("evidence frames are close to uniform")),
        F.lit(f"{', '.join(excluded)} were held fixed and not assessed") if excluded else F.lit(None).cast("string"),
        F.when(F.col("attributed") < F.col("served"), F.format_string("covers %d of %d members", "attributed", "served")),
    )
    return F.array_compact(found)


def explanation_report(
    attr: DataFrame, shares: DataFrame, excluded: list[str], *, residual: float, attributed: int, served: int, steps: int = 32, k: int = 5
) -> DataFrame:
    """One row: top drivers, top frames, excluded channels, and what weakens the explanation."""
    drivers = top_drivers(attr, k).agg(_drivers())
    frames = rank_frames(shares, k).agg(_evidence())
    total = attr.agg(F.abs(F.sum("attribution")).alias("total"))
    one = drivers.crossJoin(frames).crossJoin(total)  # one row each
    one = one.withColumns({"residual": F.lit(float(residual)), "attributed": F.lit(attributed), "served": F.lit(served)})
    fixed = F.array(*map(F.lit, excluded)).cast("array<string>").alias("excluded")
    return one.select("drivers", "evidence", fixed, _caveats(excluded, steps).alias("caveats"))


def explanation_reports(
    attr: DataFrame, shares: DataFrame, checks: DataFrame, keys: list[str], excluded: list[str], *, steps: int = 32, k: int = 5
) -> DataFrame:
    """Reports of many windows at once: one row for each row of checks, which has `keys`, difference, attributed and served.

    difference is the change of output that the window's attributions should add up to. A window
    without attributions has a total of zero and no drivers, one without shares no evidence.
    Windows that checks lacks, and null keys, have no report. Attributions are summed by channel before any
    of a window's rows meet, so a window of many cells costs no more than its channels.
    """
    by_channel = attribution_summary(attr, [*keys, "channel"]).select(*keys, "channel", F.col("signed").alias("attribution"))
    drivers = top_drivers(by_channel, k, keys).groupBy(*keys).agg(_drivers())
    totals = by_channel.groupBy(*keys).agg(F.sum("attribution").cast("double").alias("sum"))
    frames = rank_frames(shares, k, keys).groupBy(*keys).agg(_evidence())
    found = drivers.join(totals, keys)
    one = checks.select(*keys, "difference", "attributed", "served").join(found, keys, "left").join(frames, keys, "left")
    total, none = F.coalesce("sum", F.lit(0.0)), F.array()
    one = one.withColumns({
        "total": F.abs(total), "residual": F.abs(total - F.col("difference").cast("double")),
        "drivers": F.coalesce("drivers", none.cast(drivers.schema["drivers"].dataType)),
        "evidence": F.coalesce("evidence", none.cast(frames.schema["evidence"].dataType)),
    })
    fixed = F.array(*map(F.lit, excluded)).cast("array<string>").alias("excluded")
    return one.select(*keys, "drivers", "evidence", fixed, _caveats(excluded, steps).alias("caveats"))
