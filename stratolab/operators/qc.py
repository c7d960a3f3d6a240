"""Quality control of frames and cells."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import cloud_height_m, haversine_km, parallax_corrected
from ..functions.scalar import clear_flag, flag_names, set_flag
from ..schema import BOUNDS
from .sync import runs

SYSTEMATIC_SHARE = 0.01


def bounds_table(spark, bounds: Mapping[str, tuple[float, float]] = BOUNDS) -> DataFrame:
    rows = [(k, float(a), float(b)) for k, (a, b) in bounds.items()]
    return spark.createDataFrame(rows, "variable string, low double, high double")


def _bounded(value: Column, low, high, action: str) -> Column:
    if action == "mask":
        return F.when(value.between(low, high), value)
    if action == "clip":
        return F.when(value.isNotNull(), F.greatest(low, F.least(high, value)))
    raise ValueError(f"unknown action {action!r}")


def apply_bounds(df: DataFrame, low: float, high: float, action: str = "mask", value: str = "value") -> DataFrame:
    """value masked or clipped to [low, high], with out_of_range."""
    v = F.col(value)
    outside = F.coalesce(~v.between(low, high), F.lit(False))
    return df.withColumn("out_of_range", outside).withColumn(value, _bounded(v, F.lit(low), F.lit(high), action))


def apply_bounds_table(cells: DataFrame, bounds: DataFrame, action: str = "mask") -> DataFrame:
    """Bounds by variable; a variable without bounds is left alone."""
    joined = cells.join(bounds, "variable", "left")
    v, free = F.col("value"), F.col("low").isNull()
    outside = F.coalesce(~v.between(F.col("low"), F.col("high")), F.lit(False))
    new = F.when(free, v).otherwise(_bounded(v, F.col("low"), F.col("high"), action))
    return joined.withColumn("out_of_range", outside).withColumn("value", new).drop("low", "high")


def bounds_report(bounded: DataFrame, keys: list[str], present: Column) -> DataFrame:
    """Counts out of range, their share of values present, and whether that looks systematic."""
    out = bounded.groupBy(*keys).agg(
        F.count_if("out_of_range").alias("out_of_range"), F.count_if(present).alias("present")
    )
    share = F.col("out_of_range") / F.greatest(F.col("present"), F.lit(1))
    return out.withColumn("share", share).withColumn("systematic", share >= SYSTEMATIC_SHARE)


def calibrate(counts: DataFrame, lut: DataFrame, mode: str = "nearest", count: str = "count") -> DataFrame:
    """counts with temperature by table (idx, kelvin); null beyond it. The table has one row a level."""
    table = lut.select(F.col("idx").cast("long"), "kelvin")
    c = F.col(count)
    if mode == "nearest":
        keyed = counts.withColumn("idx", F.bround(c).cast("long"))
        return keyed.join(table, "idx", "left").drop("idx").withColumnRenamed("kelvin", "temperature")
    if mode != "linear":
        raise ValueError(f"unknown mode {mode!r}")
    low = table.select(F.col("idx").alias("i0"), F.col("kelvin").alias("k0"))
    high = table.select(F.col("idx").alias("i1"), F.col("kelvin").alias("k1"))
    keyed = counts.withColumns({"i0": F.floor(c).cast("long"), "i1": F.ceil(c).cast("long")})
    joined = keyed.join(low, "i0", "left").join(high, "i1", "left")
    t = F.col("k0") + (F.col("k1") - F.col("k0")) * (c - F.col("i0"))
    return joined.withColumn("temperature", t).drop("i0", "i1", "k0", "k1")


def scanline_stats(
    cells: DataFrame,
    keys: list[str],
    *,
    row: str = "row",
    width: int,
    max_empty_run: int = 3,
    tolerance: float = 0.01,
    saturated_share: float = 0.98,
    ceiling: float | None = None,
) -> DataFrame:
    """Per scan line: n present, spread, and whether it is in a long run of empty lines, constant, or saturated."""
    v = F.col("value")
    at_top = F.count_if(v >= ceiling) if ceiling is not None else F.lit(0)
    lines = cells.groupBy(*keys, row).agg(F.count(v).alias("n"), F.stddev_pop(v).alias("spread"), at_top.alias("top"))
    gaps = runs(lines, keys, row, F.col("n") == 0).where(F.col("length") > max_empty_run)
    first = lines.groupBy(*keys).agg(F.min(row).alias("row0"))
    # Lines are dense within a frame, so a run's start is an offset from the first line.
    bad = gaps.join(first, keys).select(
        *keys, F.explode(F.sequence(F.col("row0") + F.col("start"), F.col("row0") + F.col("start") + F.col("length") - 1)).alias(row)
    ).withColumn("fill_bad", F.lit(True))
    enough = F.col("n") >= max(8, width // 64)
    joined = lines.join(bad.withColumn(row, F.col(row).cast(lines.schema[row].dataType)), [*keys, row], "left")
    return joined.select(
        *keys,
        row,
        "n",
        "spread",
        F.coalesce("fill_bad", F.lit(False)).alias("fill_bad"),
        F.coalesce(enough & (F.col("spread") < tolerance), F.lit(False)).alias("constant_bad"),
        (enough & (F.col("top") / F.greatest(F.col("n"), F.lit(1)) >= saturated_share)).alias("saturated_bad"),
    )


def apply_dropout(cells: DataFrame, keys: list[str], stats: DataFrame, *, row: str = "row") -> DataFrame:
    """cells without the values of bad lines."""
    bad = stats.where("fill_bad or constant_bad or saturated_bad").select(*keys, row, F.lit(True).alias("bad"))
    joined = cells.join(bad, [*keys, row], "left")
    return joined.withColumn("value", F.when(F.col("bad").isNull(), F.col("value"))).drop("bad")


def dropout_report(stats: DataFrame, keys: list[str]) -> DataFrame:
    """Per frame how many lines are bad, by cause, and the flags that follow."""
    any_bad = F.col("fill_bad") | F.col("constant_bad") | F.col("saturated_bad")
    out = stats.groupBy(*keys).agg(
        F.count_if("fill_bad").alias("fill_rows"),
        F.count_if("constant_bad").alias("constant_rows"),
        F.count_if("saturated_bad").alias("saturated_rows"),
        F.count_if(any_bad).alias("total_bad_rows"),
    )
    line = F.when(F.col("total_bad_rows") > 0, set_flag(F.lit(0), "SCANLINE_DROPOUT")).otherwise(0)
    top = F.when(F.col("saturated_rows") > 0, set_flag(F.lit(0), "SATURATED")).otherwise(0)
    return out.withColumn("qc_flag", line.bitwiseOR(top))


def is_saturated(cells: DataFrame, keys: list[str], ceiling: float, share: float = 0.98) -> DataFrame:
    top = F.avg((F.col("value") >= ceiling).cast("double"))
    return cells.groupBy(*keys).agg(F.coalesce(top >= share, F.lit(False)).alias("saturated"))


def combined_flags(frames: DataFrame, keys: list[str], flags: str = "qc_flag") -> DataFrame:
    out = frames.groupBy(*keys).agg(F.bit_or(flags).alias("qc_flag"))
    return out.withColumn("names", flag_names("qc_flag"))


def static_layer_qc(cells: DataFrame, *, fill: float, categorical: bool, keys: list[str]) -> DataFrame:
    """Per layer: whether categorical values are whole, and its classes. A file's own nodata beats the fill value."""
    nodata = F.coalesce("nodata", F.lit(fill)) if "nodata" in cells.columns else F.lit(fill)
    v = F.when(F.col("value") != nodata, F.col("value"))
    whole = F.bool_and(v.isNull() | (v == F.rint(v))) if categorical else F.bool_and(F.lit(True))
    classes = F.sort_array(F.collect_set(v.cast("int"))) if categorical else F.array().cast("array<int>")
    return cells.groupBy(*keys).agg(
        whole.alias("integral"), (F.first(classes) if not categorical else classes).alias("classes"), F.count(v).alias("present")
    )


def corrected_parallax(cells: DataFrame, satellite_lon: float = 82.0, altitude_km: float = 35_786.0) -> DataFrame:
    """cells (lat, lon, ctt, qc_flag) at their ground positions; what moved loses PARALLAX_UNCORRECTED."""
    p = cells.withColumn("p", parallax_corrected("lat", "lon", cloud_height_m("ctt"), satellite_lon, altitude_km))
    km = haversine_km("lat", "lon", F.col("p.lat"), F.col("p.lon"))
    flag = F.when(F.col("p.moved"), clear_flag("qc_flag", "PARALLAX_UNCORRECTED")).otherwise(F.col("qc_flag"))
    return (
        p.withColumns({"shift_km": F.when(F.col("p.moved"), km).otherwise(0.0), "qc_flag": flag, "moved": F.col("p.moved")})
        .withColumns({"lat": F.col("p.lat"), "lon": F.col("p.lon")})
        .drop("p")
    )


def parallax_report(moved: DataFrame, keys: list[str]) -> DataFrame:
    return moved.groupBy(*keys).agg(
        F.avg(F.when(F.col("moved"), F.col("shift_km"))).alias("mean_km"),
        F.max("shift_km").alias("max_km"),
        F.count_if("moved").alias("cells_moved"),
    )


def geolocation_spread(frames: DataFrame, keys: list[str], cell: list[str]) -> DataFrame:
    """The largest difference of a cell's latitude or longitude from its first frame, in km, and whether one map serves all."""
    first = F.min_by(F.struct("lat", "lon"), "frame").alias("f")
    base = frames.groupBy(*keys, *cell).agg(first)
    joined = frames.join(base, [*keys, *cell])
    gap = F.greatest(F.abs(F.col("lat") - F.col("f.lat")), F.abs(F.col("lon") - F.col("f.lon"))) * 111.32
    return joined.groupBy(*keys).agg(F.max(gap).alias("spread_km")).withColumn("shared", F.col("spread_km") < 1e-6)


def frame_qc(cells: DataFrame, keys: list[str], *, satellite: bool, low: float, high: float, width: int) -> DataFrame:
    """The chain in order: scan lines, bounds, parallax; the first and last for satellites only."""
    if satellite:
        cells = apply_dropout(cells, keys, scanline_stats(cells, keys, width=width, ceiling=high))
    cells = apply_bounds(cells, low, high)
    return corrected_parallax(cells) if satellite and "ctt" in cells.columns else cells
