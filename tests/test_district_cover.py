"""District cells by filed edges against every cell tested against every edge."""

from __future__ import annotations

import numpy as np
import pytest

from stratolab.functions.geo import Grid
from stratolab.operators import impact

GRID = Grid(lat_min=0.0, lat_max=23.0, lon_min=10.0, lon_max=33.0, resolution=1.0, height=24, width=24)


def star(seed: int, points: int, lat: float, lon: float, reach: float) -> list[dict]:
    rng = np.random.default_rng(seed)
    angle = np.sort(rng.uniform(0, 2 * np.pi, points))
    r = reach * rng.uniform(0.3, 1.0, points)
    return [{"lat": float(lat + a), "lon": float(lon + b)} for a, b in zip(r * np.sin(angle), r * np.cos(angle), strict=True)]


def brute(ring, predicate):
    """Even-odd by a ray to the east, and each edge cut to each cell's box in 2000 steps and at its ends."""
    p = np.array([(q["lat"], q["lon"]) for q in ring])
    hit = set()
    for row in range(24):
        for col in range(24):
            lat, lon = float(row), 10.0 + col
            odd = False
            for (y0, x0), (y1, x1) in zip(p, np.roll(p, -1, axis=0), strict=True):
                if (lat < y0) != (lat < y1):
                    odd ^= lon < x0 + (lat - y0) * (x1 - x0) / (y1 - y0)
                if predicate == "touches":
                    t = np.linspace(0, 1, 2001)
                    near = (np.abs(y0 + t * (y1 - y0) - lat) <= 0.5) & (np.abs(x0 + t * (x1 - x0) - lon) <= 0.5)
                    if near.any():
                        hit.add((row, col))
            if odd:
                hit.add((row, col))
    return hit


@pytest.mark.parametrize("predicate", ["within", "touches"])
def test_equals_all_pairs(spark, predicate):
    rings = {f"d{k}": star(k, 5 + 4 * k, 6 + 3 * k, 13 + 4 * k, 5.3) for k in range(5)}
    rings["bow"] = [{"lat": a, "lon": b} for a, b in ((2.2, 12.2), (8.3, 20.4), (2.4, 20.1), (8.1, 12.6))]
    closed = rings["d1"] + rings["d1"][:1]
    rows = [("S", k, v) for k, v in rings.items()] + [("S", "d1", closed), ("S", "d2", rings["d2"]), ("S", "none", None), ("S", "line", rings["d1"][:2])]
    rows.append(("S", "holed", [rings["bow"][0], {"lat": None, "lon": 3.0}, *rings["bow"][1:]]))
    got = {}
    for r in impact.district_cells(spark.createDataFrame(rows, impact.POLYGON), GRID, predicate).collect():
        got.setdefault(r.district, []).append((r.row, r.col))
    assert all(len(v) == len(set(v)) for v in got.values()) and not {"none", "line"} & set(got)
    for name, ring in rings.items():
        want = brute(ring, predicate)
        # The steps of the brute force may miss an edge that only grazes a cell's corner.
        assert want <= set(got[name]) and len(set(got[name]) - want) <= (1 if predicate == "touches" else 0)
    assert set(got["holed"]) == set(got["bow"])
    assert impact.district_cells(spark.createDataFrame([], impact.POLYGON), GRID, predicate).count() == 0


def test_edges_are_tested_in_their_rows_only(spark):
    """A fine outline of 4000 edges on a fine grid: edge tests follow its length, not cells times edges."""
    grid = Grid(lat_min=0.0, lat_max=19.9, lon_min=0.0, lon_max=19.9, resolution=0.1, height=200, width=200)
    angle = np.linspace(0, 2 * np.pi, 4000, endpoint=False)
    ring = [{"lat": float(10 + 8 * np.sin(a)), "lon": float(10 + 8 * np.cos(a))} for a in angle]
    polygons = spark.createDataFrame([("S", "disc", ring)], impact.POLYGON)
    cells = impact.district_cells(polygons, grid, "within").count()
    assert abs(cells - np.pi * 80**2) < 100
    assert impact.filed_edges(polygons, grid).count() < 4 * 4000 < cells * 4000 / 1000
    plan = impact.district_cells(polygons, grid)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan
