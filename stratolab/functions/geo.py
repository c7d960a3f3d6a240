"""Grid and ellipsoid geometry as column expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import EARTH_KM


@dataclass(frozen=True)
class Grid:
    """A regular grid of cell centres; the row grows northwards."""

    lat_min: float = 6.0
    lat_max: float = 38.0
    lon_min: float = 68.0
    lon_max: float = 100.0
    resolution: float = 1 / 12
    height: int = 384
    width: int = 384


DOMAIN = Grid()


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(float(x))


def in_domain(lat, lon, grid: Grid = DOMAIN) -> Column:
    """Within the outer bounds: half a cell beyond the outermost centres."""
    half = grid.resolution / 2
    return _c(lat).between(grid.lat_min - half, grid.lat_max + half) & _c(lon).between(
        grid.lon_min - half, grid.lon_max + half
    )


def latlon_to_indices(lat, lon, grid: Grid = DOMAIN) -> Column:
    """struct(row, col) of the nearest centre, halves to even, clamped; null outside the domain."""

    def index(x: Column, low: float, size: int) -> Column:
        return F.greatest(F.lit(0), F.least(F.lit(size - 1), F.bround((x - low) / grid.resolution).cast("int")))

    found = F.struct(
        index(_c(lat), grid.lat_min, grid.height).alias("row"), index(_c(lon), grid.lon_min, grid.width).alias("col")
    )
    return F.when(in_domain(lat, lon, grid), found)


def indices_to_latlon(row, col, grid: Grid = DOMAIN) -> Column:
    """struct(lat, lon) of a cell centre; null for indices outside the grid."""
    r, c = _c(row), _c(col)
    inside = r.between(0, grid.height - 1) & c.between(0, grid.width - 1)
    centre = F.struct(
        (F.lit(grid.lat_min) + r * grid.resolution).alias("lat"), (F.lit(grid.lon_min) + c * grid.resolution).alias("lon")
    )
    return F.when(inside, centre)


def cell_area_km2(row, grid: Grid = DOMAIN) -> Column:
    """Area of a cell of that row: the spherical band between its edges."""
    centre = F.lit(grid.lat_min) + _c(row) * grid.resolution
    half = grid.resolution / 2
    band = F.sin(F.radians(centre + half)) - F.sin(F.radians(centre - half))
    return F.lit(EARTH_KM**2) * F.radians(F.lit(grid.resolution)) * band


def haversine_km(lat1, lon1, lat2, lon2, radius: float = 6371.0) -> Column:
    a1, a2 = F.radians(_c(lat1)), F.radians(_c(lat2))
    h = F.pow(F.sin((a2 - a1) / 2), 2) + F.cos(a1) * F.cos(a2) * F.pow(F.sin(F.radians(_c(lon2) - _c(lon1)) / 2), 2)
    return 2 * radius * F.atan2(F.sqrt(h), F.sqrt(1 - h))


# The WGS84 ellipsoid, and the highest cloud top taken for real.
WGS84_A = 6_378_137.0
WGS84_F = 1.0 / 298.257223563
WGS84_B = WGS84_A * (1.0 - WGS84_F)
E2 = 1.0 - (WGS84_B / WGS84_A) ** 2
MAX_CLOUD_M = 20_000.0


def cloud_height_m(ctt_k, lapse_k_per_km: float = 6.5, surface_k: float = 300.0) -> Column:
    """Cloud-top height from its temperature, between 0 and 20 km; null stays null."""
    if lapse_k_per_km <= 0:
        raise ValueError("the lapse rate is positive")
    height = (F.lit(surface_k) - _c(ctt_k)) * (1000.0 / lapse_k_per_km)
    return F.when(height.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(MAX_CLOUD_M), height)))


def _curvature(sine: Column) -> Column:
    return F.lit(WGS84_A) / F.sqrt(1 - E2 * sine * sine)


def geodetic_to_ecef(lat, lon, height=0.0) -> Column:
    """struct(x, y, z) in metres."""
    la, lo, h = F.radians(_c(lat)), F.radians(_c(lon)), _c(height)
    n = _curvature(F.sin(la))
    return F.struct(
        ((n + h) * F.cos(la) * F.cos(lo)).alias("x"),
        ((n + h) * F.cos(la) * F.sin(lo)).alias("y"),
        ((n * (1 - E2) + h) * F.sin(la)).alias("z"),
    )


def _let(value: Column, use) -> Column:
    """use(value), with value worked out once however often it is used."""
    return F.transform(F.array(value), use)[0]


def ecef_to_geodetic(x, y, z, iterations: int = 5) -> Column:
    """struct(lat, lon, height). The iteration is a fold over a struct, so the plan stays small."""
    point = F.struct(_c(x).alias("x"), _c(y).alias("y"), _c(z).alias("z"), F.hypot(_c(x), _c(y)).alias("p"))

    def height(p: Column, lat: Column) -> Column:
        return p["p"] / F.greatest(F.cos(lat), F.lit(1e-12)) - _curvature(F.sin(lat))

    def closer(p: Column, lat: Column) -> Column:
        n = _curvature(F.sin(lat))
        return F.atan2(p["z"], p["p"] * (1 - E2 * n / (n + height(p, lat))))

    def found(p: Column) -> Column:
        steps = F.sequence(F.lit(1), F.lit(iterations))
        lat = F.aggregate(steps, F.atan2(p["z"], p["p"] * (1 - E2)), lambda lat, _: closer(p, lat))
        return _let(
            lat,
            lambda lat: F.struct(
                F.degrees(lat).alias("lat"), F.degrees(F.atan2(p["y"], p["x"])).alias("lon"), height(p, lat).alias("height")
            ),
        )

    return _let(point, found)


def parallax_corrected(lat, lon, height_m, satellite_lon: float = 82.0, altitude_km: float = 35_786.0) -> Column:
    """struct(lat, lon, moved): the ground point under a cloud top seen at (lat, lon).

    The ray from the satellite through the apparent point meets the surface at
    cloud height nearer the satellite; with z stretched to a sphere that is a
    quadratic. Where there is no height or no meeting, the point stays.
    """
    import math

    radius = WGS84_A + altitude_km * 1000
    sx, sy = radius * math.cos(math.radians(satellite_lon)), radius * math.sin(math.radians(satellite_lon))
    stretch = WGS84_A / WGS84_B

    def meeting(r: Column) -> Column:
        """Along the ray r, where it meets the surface at height r.h first; null where it does not."""
        squared = r["x"] * r["x"] + r["y"] * r["y"] + F.pow(r["z"] * stretch, 2)
        offset = F.lit(radius**2) - F.pow(F.lit(WGS84_A) + r["h"], 2)
        parts = F.struct(squared.alias("a"), (2 * (r["x"] * sx + r["y"] * sy)).alias("b"), offset.alias("c"))
        root = lambda q: q["b"] * q["b"] - 4 * q["a"] * q["c"]
        return _let(parts, lambda q: F.when((r["h"] > 0) & (root(q) >= 0) & (q["a"] > 0), (-q["b"] - F.sqrt(root(q))) / (2 * q["a"])))

    def ground(r: Column, t: Column) -> Column:
        top = ecef_to_geodetic(r["x"] * t + sx, r["y"] * t + sy, r["z"] * t)
        kept = F.struct(r["lat"].alias("lat"), r["lon"].alias("lon"), F.lit(False).alias("moved"))
        moved = _let(top, lambda g: F.struct(g["lat"].alias("lat"), (F.pmod(g["lon"] + 180, F.lit(360.0)) - 180).alias("lon"), F.lit(True).alias("moved")))
        return F.when(t > 0, moved).otherwise(kept)

    seen = _let(geodetic_to_ecef(lat, lon), lambda g: F.struct(
        (g["x"] - sx).alias("x"), (g["y"] - sy).alias("y"), g["z"].alias("z"), _c(height_m).alias("h"), _c(lat).alias("lat"), _c(lon).alias("lon")
    ))
    return _let(seen, lambda r: _let(meeting(r), lambda t: ground(r, t)))
