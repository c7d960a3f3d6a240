"""District membership, zonal statistics and impacts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.geo import DOMAIN, Grid, cell_area_km2, indices_to_latlon, latlon_to_indices
from ..functions.scalar import lead_hours, lead_time
from ..schema import MIN_AREA_KM2, MIN_FRACTION, REPORT_FLOOR, SEVERITY_BANDS

DISTRICT = ["state", "district"]


def district_mean(field: DataFrame, districts: DataFrame, value: str = "value", cell: str = "cell") -> DataFrame:
    """Area-weighted mean over cells that have a value; null where none has."""
    joined = districts.join(field.select(cell, F.col(value).alias("v")), cell).where("v is not null")
    means = joined.groupBy(*DISTRICT).agg((F.sum(F.col("v") * F.col("area_km2")) / F.sum("area_km2")).alias("mean"))
    return districts.select(*DISTRICT).distinct().join(means, DISTRICT, "left")


def district_class_fraction(
    field: DataFrame, districts: DataFrame, classes: list[int], value: str = "value", cell: str = "cell"
) -> DataFrame:
    """Share of the area with a class that lies in one of the classes."""
    joined = districts.join(field.select(cell, F.col(value).alias("v")), cell).where("v is not null")
    inside = F.sum(F.when(F.col("v").isin(*classes), F.col("area_km2")).otherwise(0.0))
    return joined.groupBy(*DISTRICT).agg((inside / F.sum("area_km2")).alias("fraction"))


def district_summary(districts: DataFrame, cell: str = "cell") -> DataFrame:
    return districts.groupBy(*DISTRICT).agg(F.sum("area_km2").alias("area_km2"), F.count(cell).alias("cells"))


def mean_cells(districts: DataFrame, cell: str = "cell") -> DataFrame:
    return district_summary(districts, cell).agg(F.count("*").alias("districts"), F.avg("cells").alias("mean_cells"))


def districts_at(points: DataFrame, districts: DataFrame, cell: str = "cell") -> DataFrame:
    """points with an array of (state, district) that cover their cell; empty where none does."""
    held = districts.groupBy(cell).agg(F.sort_array(F.collect_set(F.struct(*DISTRICT))).alias("districts"))
    kind = "array<struct<state:string,district:string>>"
    return points.join(held, cell, "left").withColumn("districts", F.coalesce("districts", F.array().cast(kind)))


def scope_district(df: DataFrame, districts: DataFrame, state: str, district: str, cell: str = "cell") -> DataFrame:
    """Rows of one district's cells. An unknown district is refused."""
    wanted = districts.where((F.col("state") == state) & (F.col("district") == district))
    if wanted.isEmpty():
        raise ValueError(f"no district {district!r} in {state!r}")
    return df.join(wanted.select(cell).distinct(), cell, "left_semi")


def dissolve(districts: DataFrame, cell: str = "cell") -> DataFrame:
    return districts.dropDuplicates([*DISTRICT, cell])


def severity_band(probability: Column, intensity: Column | None = None, bands=SEVERITY_BANDS) -> Column:
    """The band of the highest probability limit that is met; with an intensity, its limit counts too."""
    met = []
    for p, mm, name in bands:
        ok = probability >= p
        if intensity is not None:
            ok = ok & (intensity.isNull() | (intensity >= mm))
        met.append(F.when(ok, F.struct(F.lit(p).alias("p"), F.lit(name).alias("name"))))
    return F.array_max(F.array_compact(F.array(*met)))["name"]


def extract_impacts(
    probability: DataFrame,
    districts: DataFrame,
    *,
    cell: str = "cell",
    floor: float = REPORT_FLOOR,
    min_area: float = MIN_AREA_KM2,
    min_fraction: float = MIN_FRACTION,
    by: list[str] | None = None,
) -> DataFrame:
    """Districts whose affected area passes a gate at some lead.

    probability: (.., lead, cell, probability[, intensity]). Peak lead and widest
    lead are the first of equals; gates are inclusive and either suffices.
    """
    by = by or []
    has = "intensity" in probability.columns
    mm = F.col("intensity") if has else F.lit(None).cast("double")
    joined = districts.join(probability.withColumn("mm", mm), cell)
    hit = F.col("probability") >= floor
    leads = joined.groupBy(*by, *DISTRICT, "lead").agg(
        F.sum(F.when(hit, F.col("area_km2")).otherwise(0.0)).alias("area"),
        F.max("probability").alias("p"),
        F.max("mm").alias("mm"),
    )
    total = districts.groupBy(*DISTRICT).agg(F.sum("area_km2").alias("district_area_km2"))
    leads = leads.join(total, DISTRICT)
    fraction = F.col("area") / F.greatest(F.col("district_area_km2"), F.lit(1e-9))
    passes = (F.round(F.col("area"), 6) >= min_area) | (F.round(fraction, 9) >= min_fraction)
    first = lambda v: F.struct(F.round(F.col(v), 9), -F.col("lead"))  # noqa: E731  the earliest lead of equals
    out = leads.groupBy(*by, *DISTRICT).agg(
        F.max("p").alias("peak_probability"),
        F.max_by("lead", first("p")).alias("peak_lead"),
        F.min(F.when(passes, F.col("lead"))).alias("onset_lead"),
        F.max(F.when(passes, F.col("lead"))).alias("expiry_lead"),
        F.max("area").alias("affected_area_km2"),
        F.max(fraction).alias("affected_fraction"),
        F.first("district_area_km2").alias("district_area_km2"),
        F.max("mm").alias("peak_intensity"),
    )
    out = out.where("onset_lead is not null")
    return out.withColumn("severity", severity_band(F.col("peak_probability"), F.col("peak_intensity")))


def rank_impacts(impacts: DataFrame, limit: int, by: list[str]) -> DataFrame:
    """The first `limit` of each forecast (`by`), the report's length: by peak probability, then state and district."""
    order = Window.partitionBy(*by).orderBy(F.desc("peak_probability"), *DISTRICT)
    return impacts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit).drop("rank")


def onset_expiry(series: DataFrame, keys: list[str], floor: float = REPORT_FLOOR) -> DataFrame:
    """First and last lead at or above the floor; null where none is."""
    at = F.when(F.col("probability") >= floor, F.col("lead"))
    return series.groupBy(*keys).agg(F.min(at).alias("onset_lead"), F.max(at).alias("expiry_lead"))


def impact_times(impacts: DataFrame, valid_time: str = "valid_time") -> DataFrame:
    """Hours and clock times of onset and expiry."""
    return impacts.select(
        "*",
        lead_hours("onset_lead").alias("onset_hours"),
        lead_hours("expiry_lead").alias("expiry_hours"),
        lead_time(valid_time, "onset_lead").alias("onset_time"),
        lead_time(valid_time, "expiry_lead").alias("expiry_time"),
    )


def presented_impacts(impacts: DataFrame) -> DataFrame:
    """Rows as they are shown: shares to 4 digits, areas and rates to 1."""
    return impacts.select(
        *DISTRICT,
        F.round("peak_probability", 4).alias("peak_probability"),
        "peak_lead",
        "onset_lead",
        "expiry_lead",
        F.round("affected_area_km2", 1).alias("affected_area_km2"),
        F.round("affected_fraction", 4).alias("affected_fraction"),
        F.round("district_area_km2", 1).alias("district_area_km2"),
        F.round("peak_intensity", 2).alias("peak_intensity"),
        "severity",
    )


def point_series(cells: DataFrame, keys: list[str], value: str = "probability") -> DataFrame:
    """Values by lead as one array a cell."""
    pairs = F.sort_array(F.collect_list(F.struct("lead", F.col(value).alias("v"))))
    return cells.groupBy(*keys).agg(F.transform(pairs, lambda p: p["v"]).alias("series"))


def point_forecast(
    points: DataFrame, nowcast: DataFrame, districts: DataFrame, grid: Grid = DOMAIN, floor: float = REPORT_FLOOR, by: list[str] | None = None
) -> DataFrame:
    """Per forecast (`by`) and point (point_id, lat, lon): its cell, series, peak, onset, expiry and districts.

    nowcast: (by, row, col, lead, probability); districts: (state, district, row,
    col, ..). Points outside the domain give no row.
    """
    at = points.withColumn("at", latlon_to_indices("lat", "lon", grid)).where("at is not null")
    at = at.select("point_id", "at.row", "at.col")
    joined = at.join(nowcast, ["row", "col"])
    keys = [*(by or []), "point_id", "row", "col"]
    late = F.when(F.col("probability") >= floor, F.col("lead"))
    pairs = F.sort_array(F.collect_list(F.struct("lead", "probability")))
    rows = joined.groupBy(*keys).agg(
        F.transform(pairs, lambda p: p["probability"]).alias("series"),
        F.max("probability").alias("peak_probability"),
        F.max_by("lead", F.struct("probability", -F.col("lead"))).alias("peak_lead"),
        F.min(late).alias("onset_lead"),
        F.max(late).alias("expiry_lead"),
    )
    held = districts.groupBy("row", "col").agg(F.sort_array(F.collect_set(F.struct(*DISTRICT))).alias("districts"))
    return rows.join(held, ["row", "col"], "left")


# --- polygons --------------------------------------------------------------------


def _ring_edges(polygons: DataFrame) -> DataFrame:
    """(state, district, ring_id, y0, x0, y1, x1): a row an edge. Rings of under 3 points give none; equal rings of a district count once."""
    clean = F.filter("ring", lambda p: p["lat"].isNotNull() & p["lon"].isNotNull())
    rings = polygons.select(*DISTRICT, clean.alias("ring")).where("size(ring) >= 3").dropDuplicates([*DISTRICT, "ring"])
    following = F.concat(F.slice("ring", F.lit(2), F.size("ring") - 1), F.slice("ring", 1, 1))
    edges = F.transform(F.arrays_zip(F.col("ring").alias("a"), following.alias("b")), lambda e: F.struct(
        e["a"]["lat"].alias("y0"), e["a"]["lon"].alias("x0"), e["b"]["lat"].alias("y1"), e["b"]["lon"].alias("x1")
    ))
    # Two digests name a ring within its district.
    named = F.struct(F.xxhash64("ring").alias("a"), F.hash("ring").alias("b"))
    return rings.select(*DISTRICT, named.alias("ring_id"), F.explode(edges).alias("e")).select(*DISTRICT, "ring_id", "e.*")


def _span(low: Column, high: Column, origin: float, step: float, size: int) -> Column:
    """Indices of cells whose closed extent may meet [low, high], with one to spare on each side; empty beyond the grid."""
    first = F.greatest(F.floor((low - origin) / step - 0.5).cast("int"), F.lit(0))
    last = F.least(F.ceil((high - origin) / step + 0.5).cast("int"), F.lit(size - 1))
    return F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))


def filed_edges(polygons: DataFrame, grid: Grid = DOMAIN) -> DataFrame:
    """Edges filed under the grid rows that they may meet: (.., row, lat, y0, x0, y1, x1). An edge is tested in these rows only."""
    edges = _ring_edges(polygons)
    rows = _span(F.least("y0", "y1"), F.greatest("y0", "y1"), grid.lat_min, grid.resolution, grid.height)
    return edges.withColumn("row", F.explode(rows)).withColumn("lat", F.lit(grid.lat_min) + F.col("row") * grid.resolution)


def _inner_cells(filed: DataFrame, grid: Grid) -> DataFrame:
    """Cells whose centre a ring holds. On a row's centre line a ring's crossings pair up, and what lies between is taken whole."""
    x = F.col("x0") + (F.col("lat") - F.col("y0")) * (F.col("x1") - F.col("x0")) / (F.col("y1") - F.col("y0"))
    crossed = filed.where((F.col("lat") < F.col("y0")) != (F.col("lat") < F.col("y1"))).select(*DISTRICT, "ring_id", "row", x.alias("x"))
    line = Window.partitionBy(*DISTRICT, "ring_id", "row").orderBy("x")
    paired = crossed.select("*", F.row_number().over(line).alias("k"), F.lead("x").over(line).alias("until")).where("k % 2 = 1")
    cols = _span(F.col("x"), F.col("until"), grid.lon_min, grid.resolution, grid.width)
    lon = F.lit(grid.lon_min) + F.col("col") * grid.resolution
    return paired.withColumn("col", F.explode(cols)).where((lon >= F.col("x")) & (lon < F.col("until"))).select(*DISTRICT, "row", "col")


def _border_cells(filed: DataFrame, grid: Grid) -> DataFrame:
    """Cells that an edge enters: the edge clipped to the row, and then to the few cells beside what is left of it."""
    half = grid.resolution / 2

    def clipped(start: str, end: str, centre: Column) -> tuple[Column, Column]:
        """The part [low, high] of the edge within half a cell of centre on one axis; low > high where there is none."""
        delta = F.col(end) - F.col(start)
        t0, t1 = F.try_divide(centre - half - F.col(start), delta), F.try_divide(centre + half - F.col(start), delta)
        level = F.abs(F.col(start) - centre) <= half
        low = F.when(delta != 0, F.greatest(F.lit(0.0), F.least(t0, t1))).otherwise(0.0)
        return low, F.when(delta != 0, F.least(F.lit(1.0), F.greatest(t0, t1))).when(level, 1.0).otherwise(-1.0)

    low, high = clipped("y0", "y1", F.col("lat"))
    at = filed.withColumns({"low": low, "high": high}).where("low <= high")
    reach = lambda t: F.col("x0") + F.col(t) * (F.col("x1") - F.col("x0"))
    cols = _span(F.least(reach("low"), reach("high")), F.greatest(reach("low"), reach("high")), grid.lon_min, grid.resolution, grid.width)
    low, high = clipped("x0", "x1", F.lit(grid.lon_min) + F.col("col") * grid.resolution)
    tested = at.withColumn("col", F.explode(cols)).where(F.greatest("low", low) <= F.least("high", high))
    return tested.select(*DISTRICT, "row", "col")


def district_cells(polygons: DataFrame, grid: Grid = DOMAIN, predicate: str = "touches") -> DataFrame:
    """(state, district, row, col, area_km2) of cells under each polygon, dissolved by district.

    polygons: (state, district, ring array<struct<lat,lon>>), a ring closed or not. Edges are filed by grid
    row: their crossings with the row's centre line give spans of inner cells, taken whole by the even-odd
    rule, and only cells beside an edge are tested against it, so work follows the rings' length and the
    cells found. Predicate `touches` takes cells that the polygon meets anywhere, `within` those whose
    centre it holds. A district may have several rings. Points with a null are left out of a ring; rings of
    under 3 points, null rings and empty tables give no cells.
    """
    if predicate not in ("touches", "within"):
        raise ValueError(f"unknown predicate {predicate!r}")
    filed = filed_edges(polygons, grid)
    found = _inner_cells(filed, grid)
    if predicate == "touches":
        found = found.unionByName(_border_cells(filed, grid))
    return found.dropDuplicates([*DISTRICT, "row", "col"]).withColumn("area_km2", cell_area_km2("row", grid))


def unresolved_districts(polygons: DataFrame, cells: DataFrame) -> DataFrame:
    """Districts without any cell."""
    return polygons.select(*DISTRICT).distinct().join(cells, DISTRICT, "left_anti")


def cell_centres(cells: DataFrame, grid: Grid = DOMAIN) -> DataFrame:
    return cells.withColumn("at", indices_to_latlon("row", "col", grid)).select("*", "at.lat", "at.lon").drop("at")


RING = T.ArrayType(T.StructType([T.StructField("lat", T.DoubleType()), T.StructField("lon", T.DoubleType())]))
POLYGON = T.StructType([T.StructField("state", T.StringType()), T.StructField("district", T.StringType()), T.StructField("ring", RING)])


def share_of_total(df: DataFrame, value: str, by: list[str]) -> Column:
    return F.col(value) / F.sum(value).over(Window.partitionBy(*by))
