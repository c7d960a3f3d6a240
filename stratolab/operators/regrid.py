"""Regridding as equi-joins on cell keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import DOMAIN, Grid, haversine_km
from ..sources.windows import shared_path

KM_PER_DEGREE = 111.32
MAX_BROADCAST_CELLS = 160_000
MAX_BROADCAST_POINTS = 160_000
MAX_POINTS = 1024


def default_radius_km(spacing_deg: float) -> float:
    """Half as much again as the sources' median spacing."""
    return 1.5 * spacing_deg * KM_PER_DEGREE


def regrid_nearest(
    points: DataFrame, grid: Grid = DOMAIN, *, radius_km: float, frame: list[str] | None = None, tie: str = "point_id"
) -> DataFrame:
    """(frame, row, col, value) of each target cell's nearest point within the radius, the smaller tie key of equals.

    Points (lat, lon, value, tie) are dealt to every cell within reach of their
    own, so the search is an equi-join-free explode and one aggregation.
    """
    frame = frame or []
    up = int(radius_km / (grid.resolution * KM_PER_DEGREE)) + 1
    north = max(abs(grid.lat_min), abs(grid.lat_max))
    import math

    side = int(radius_km / (grid.resolution * KM_PER_DEGREE * max(0.05, math.cos(math.radians(north))))) + 1

    def near(c: str, low: float, reach: int, size: int) -> Column:
        own = F.round((F.col(c) - low) / grid.resolution).cast("int")
        first, last = F.greatest(own - reach, F.lit(0)), F.least(own + reach, F.lit(size - 1))
        return F.when(first <= last, F.sequence(first, last))

    dealt = points.where("lat is not null and lon is not null and value is not null")
    dealt = dealt.withColumn("row", F.explode(near("lat", grid.lat_min, up, grid.height)))
    dealt = dealt.withColumn("col", F.explode(near("lon", grid.lon_min, side, grid.width)))
    km = haversine_km(
        "lat", "lon", F.lit(grid.lat_min) + F.col("row") * grid.resolution, F.lit(grid.lon_min) + F.col("col") * grid.resolution
    )
    reached = dealt.withColumn("km", km).where(F.col("km") <= radius_km)
    return reached.groupBy(*frame, "row", "col").agg(
        F.min_by("value", F.struct(F.round("km", 9), tie)).alias("value"), F.min("km").alias("km")
    )


def _axes(source: Grid, offset: float, scale: float, clamp: bool) -> tuple[tuple[Column, Column], tuple[Column, Column]]:
    """The source row and column at or below (lat, lon), each with the fraction beyond it."""

    def axis(c: Column, low: float, size: int) -> tuple[Column, Column]:
        at = (c - low) / source.resolution * scale + offset
        if clamp:
            at = F.greatest(F.lit(0.0), F.least(F.lit(float(size - 1)), at))
        at = F.round(at, 9)
        return F.floor(at).cast("int"), at - F.floor(at)

    return axis(F.col("lat"), source.lat_min, source.height), axis(F.col("lon"), source.lon_min, source.width)


CORNERS = [(i, j) for i in (0, 1) for j in (0, 1)]


def bilinear_corners(target: DataFrame, source: Grid, offset: float = 0.0, scale: float = 1.0, clamp: bool = False) -> DataFrame:
    """target (lat, lon, ..) with its up to four source corners (src_row, src_col) and their weights."""
    (r, fr), (c, fc) = _axes(source, offset, scale, clamp)
    corners = [
        F.struct((r + i).alias("src_row"), (c + j).alias("src_col"), ((fr if i else 1 - fr) * (fc if j else 1 - fc)).alias("w"))
        for i, j in CORNERS
    ]
    needed = F.filter(F.array(*corners), lambda x: x["w"] > 0)
    return target.withColumn("corner", F.explode(needed)).select(*target.columns, "corner.*")


def regrid_bilinear(cells: DataFrame, source: Grid, target: DataFrame, keys: list[str], frame: list[str] | None = None) -> DataFrame:
    """Values at target points (keys, lat, lon) from a regular source grid; null if a needed corner has none.

    cells: (frame, row, col, value). Corners with weight zero are not needed. Corners are
    fixed by the grids: each source cell gets the array of points that it serves,
    so one equi-join and one aggregation reach them. Where points are too many for that, they meet
    patches of cells instead. A frame's points none of whose
    corners has a row are left out, as are points outside the source grid.
    """
    frame = frame or []
    if target.limit(MAX_BROADCAST_POINTS + 1).count() > MAX_BROADCAST_POINTS:
        return _regrid_many(cells, source, target, keys, frame)
    corners = bilinear_corners(target, source)
    size = Window.partitionBy(*keys)
    needed = corners.withColumn("need", F.count("*").over(size))
    served = needed.groupBy(F.col("src_row").alias("row"), F.col("src_col").alias("col")).agg(
        F.collect_list(F.struct(*keys, "w", "need")).alias("points")
    )
    # At most as many rows as the source grid has cells, and four entries a point.
    served = F.broadcast(served) if source.height * source.width <= MAX_BROADCAST_CELLS else served
    joined = cells.join(served, ["row", "col"]).select(*frame, "value", F.explode("points").alias("p"))
    whole = F.count("value") == F.first("p.need")
    point = [F.col(f"p.{k}").alias(k) for k in keys]
    return joined.groupBy(*frame, *point).agg(F.when(whole, F.sum(F.col("p.w") * F.col("value"))).alias("value"))


def _regrid_many(cells: DataFrame, source: Grid, target: DataFrame, keys: list[str], frame: list[str]) -> DataFrame:
    """regrid_bilinear for any number of points: each meets the 2 x 2 patch of cells round it, a row a frame.

    Points are shuffled once, by their keys, and stay there if the patches are small enough for the
    session's broadcast threshold; otherwise both sides meet by the patch's corner.
    """
    patch = F.explode(F.array(*[F.struct((F.col("row") - i).alias("src_row"), (F.col("col") - j).alias("src_col"), F.lit(n).alias("n")) for n, (i, j) in enumerate(CORNERS)]))
    own = [F.col("k.n") == n for n in range(len(CORNERS))]
    parts = {"total": [F.sum(F.when(o, F.col("value"))) for o in own], "held": [F.count(F.when(o, F.col("value"))) for o in own], "seen": [F.count(F.when(o, 1)) for o in own]}
    patches = cells.select(*frame, "value", patch.alias("k")).groupBy(*frame, "k.src_row", "k.src_col")
    patches = patches.agg(*[F.array(*each).alias(name) for name, each in parts.items()])
    # Written, so that its size is known before points are dealt.
    path = shared_path(cells.sparkSession, "stratolab-patches")
    patches.write.parquet(path)
    patches = cells.sparkSession.read.schema(patches.schema).parquet(path)

    (r, fr), (c, fc) = _axes(source, 0.0, 1.0, False)
    points = target.select(*keys, r.alias("src_row"), c.alias("src_col"), fr.alias("fr"), fc.alias("fc"))
    weights = [(F.col("fr") if i else 1 - F.col("fr")) * (F.col("fc") if j else 1 - F.col("fc")) for i, j in CORNERS]

    def over(part, zero) -> Column:
        """The sum of what part gives for each corner that is needed."""
        used = [F.when(w > 0, F.coalesce(part(n), F.lit(zero))).otherwise(F.lit(zero)) for n, w in enumerate(weights)]
        return used[0] + used[1] + used[2] + used[3]

    points = points.withColumn("need", over(lambda n: F.lit(1), 0)).where("need > 0")
    points = points.withColumn("need", F.sum("need").over(Window.partitionBy(*keys)))
    met = points.join(patches, ["src_row", "src_col"]).where(over(lambda n: F.col("seen")[n], 0) > 0)
    held, total = over(lambda n: F.col("held")[n], 0), over(lambda n: weights[n] * F.col("total")[n], 0.0)
    met = met.select(*frame, *keys, "need", held.alias("held"), total.alias("total"))
    return met.groupBy(*frame, *keys).agg(F.when(F.sum("held") == F.first("need"), F.sum("total")).alias("value"))


def regrid_stream(cells: DataFrame, kind: str, source: Grid, target: DataFrame, *, grid: Grid = DOMAIN, radius_km: float | None = None) -> DataFrame:
    """Every (slot, channel, level) of a stream: bilinear if continuous, nearest if categorical.

    cells: (slot, channel, level, row, col, lat, lon, value); target: (row, col, lat, lon).
    """
    frame = ["slot", "channel", "level"]
    if kind == "continuous":
        goal = target.select(F.col("row").alias("target_row"), F.col("col").alias("target_col"), "lat", "lon")
        out = regrid_bilinear(cells, source, goal, ["target_row", "target_col"], frame)
        return out.withColumnsRenamed({"target_row": "row", "target_col": "col"})
    if kind != "categorical":
        raise ValueError(f"unknown kind {kind!r}")
    points = cells.withColumn("point_id", F.col("row") * 1_000_000 + F.col("col"))
    radius = radius_km or default_radius_km(source.resolution)
    return regrid_nearest(points, grid, radius_km=radius, frame=frame).drop("km")


def resize_map(maps: DataFrame, src: int, dst: int, keys: list[str] | None = None, value: str = "value") -> DataFrame:
    """Square maps (keys, row, col, value) resized bilinearly with half-pixel centres and clamped edges."""
    keys = keys or []
    ratio = src / dst

    def part(c: str) -> tuple[Column, Column]:
        at = F.greatest(F.lit(0.0), F.least(F.lit(float(src - 1)), (F.col(c) + 0.5) * ratio - 0.5))
        return F.floor(at).cast("int"), at - F.floor(at)

    spark = maps.sparkSession
    grid = spark.range(dst).select(F.col("id").cast("int").alias("out_row")).withColumn(
        "out_col", F.explode(F.sequence(F.lit(0), F.lit(dst - 1)))
    )
    (r, fr), (c, fc) = part("out_row"), part("out_col")
    corner = [
        F.struct((r + i).alias("row"), (c + j).alias("col"), ((fr if i else 1 - fr) * (fc if j else 1 - fc)).alias("w"))
        for i in (0, 1)
        for j in (0, 1)
    ]
    weights = grid.withColumn("k", F.explode(F.filter(F.array(*corner), lambda x: x["w"] > 0))).select("out_row", "out_col", "k.*")
    joined = maps.join(F.broadcast(weights), ["row", "col"])  # at most 4 dst^2 rows, a parameter
    return joined.groupBy(*keys, "out_row", "out_col").agg(F.sum(F.col("w") * F.col(value)).alias(value)).withColumnsRenamed(
        {"out_row": "row", "out_col": "col"}
    )


def hazard_density(alerts: DataFrame, grid: DataFrame) -> DataFrame:
    """Gaussian influence of open alerts (hazard_type, lat, lng, risk_score) on grid points, at most 100.

    The sum at a point takes in every alert, so every alert is carried to all points of the
    grid, whose size is a display parameter and checked; sums are partial first.
    """
    points = [(r.lat, r.lng) for r in grid.select("lat", "lng").limit(MAX_POINTS + 1).collect()]
    if len(points) > MAX_POINTS:
        raise ValueError(f"a display grid has at most {MAX_POINTS} points")
    at = F.explode(F.array(*[F.struct(F.lit(a).alias("g_lat"), F.lit(b).alias("g_lng")) for a, b in points]))
    sigma = 60 + 1.4 * F.col("risk_score")
    km = haversine_km("g_lat", "g_lng", F.col("lat"), F.col("lng"))
    pairs = alerts.where("status != 'resolved'").withColumn("g", at).select("*", "g.g_lat", "g.g_lng")
    value = F.sum(F.col("risk_score") * F.exp(-km * km / (2 * sigma * sigma)))
    out = pairs.groupBy("hazard_type", F.col("g_lat").alias("lat"), F.col("g_lng").alias("lng")).agg(value.alias("v"))
    return out.select("hazard_type", "lat", "lng", F.round(F.least(F.lit(100.0), "v"), 1).alias("value"))


def dominant_hazard(density: DataFrame, order: tuple[str, ...] = ("thunderstorm", "cloudburst", "flash_flood")) -> DataFrame:
    """The hazard of the largest value at each point, the first in order of equals."""
    place = F.array_position(F.array(*map(F.lit, order)), F.col("hazard_type"))
    best = F.max_by(F.struct("hazard_type", "value"), F.struct("value", -place))
    return density.groupBy("lat", "lng").agg(best.alias("b")).select("lat", "lng", "b.hazard_type", "b.value")


def grid_spacing(axis: DataFrame, order: str = "i", value: str = "v") -> DataFrame:
    """Smallest and largest step of an axis, and whether it is even."""
    gap = F.col(value) - F.lag(value).over(Window.orderBy(order))
    out = axis.select(gap.alias("g")).where("g is not null").agg(F.min("g").alias("least"), F.max("g").alias("most"))
    return out.withColumn("even", F.abs(F.col("most") - F.col("least")) <= 1e-6 * F.abs("most"))
