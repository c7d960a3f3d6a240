"""Yearly headerless grids of little-endian float32, one slab a day."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class GrdSpec:
    """Fixed values of the archive's layout: rows from south to north, columns from west to east."""

    height: int = 129
    width: int = 135
    fill: float = -999.0
    lat_min: float = 6.5
    lon_min: float = 66.5
    resolution: float = 0.25


def days_in(year: int) -> int:
    return 366 if year % 4 == 0 and (year % 100 != 0 or year % 400 == 0) else 365


def _decoder(spec: GrdSpec, first: int, last: int):
    """Binary files to cells of the days of year in [first, last]; a file of a wrong size gives one row that says so."""
    slab = spec.height * spec.width
    rows = np.repeat(np.arange(spec.height, dtype=np.int32), spec.width)
    cols = np.tile(np.arange(spec.width, dtype=np.int32), spec.height)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = re.search(r"(\d{4})\.grd$", path, re.IGNORECASE)
                year = int(found[1]) if found else None
                if year is None or len(content) != days_in(year) * slab * 4:
                    why = "no year in the name" if year is None else f"{len(content)} bytes are not {days_in(year)} days"
                    yield _batch([path], [year], [None], [None], [None], [None], [why])
                    continue
                days = np.frombuffer(content, "<f4").reshape(-1, slab)
                for d in range(max(first, 1), min(last, len(days)) + 1):
                    v = days[d - 1].astype(np.float32)
                    missing = ~np.isfinite(v) | (np.abs(v - np.float32(spec.fill)) < 1e-3)
                    n = slab
                    yield _batch([path] * n, [year] * n, [d] * n, rows, cols, pa.array(v, mask=missing), [None] * n)

    return run


def _batch(path, year, day, row, col, value, fault) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.float32(), pa.string())
    made = [x if isinstance(x, pa.Array) else pa.array(x, k) for x, k in zip((path, year, day, row, col, value, fault), kinds, strict=True)]
    return pa.RecordBatch.from_arrays(made, names=["path", "year", "day", "row", "col", "value", "fault"])


def read_grd(spark: SparkSession, path: str, spec: GrdSpec = GrdSpec(), first_day: int = 1, last_day: int = 366) -> DataFrame:
    """(path, date, row, col, lat, lon, value, fault); fill and non-finite values are null.

    Only the days of year asked for are decoded. A file whose size does not fit
    its year gives one row with a fault and no cells.
    """
    return decode_grd(spark.read.format("binaryFile").load(path).select("path", "content"), spec, first_day, last_day)


def decode_grd(files: DataFrame, spec: GrdSpec = GrdSpec(), first_day: int = 1, last_day: int = 366) -> DataFrame:
    """read_grd of files (path, content)."""
    cells = files.mapInArrow(
        _decoder(spec, first_day, last_day), "path string, year int, day int, row int, col int, value float, fault string"
    )
    date = F.date_add(F.make_date("year", F.lit(1), F.lit(1)), F.col("day") - 1)
    return cells.select(
        "path", date.alias("date"), "row", "col",
        (F.lit(spec.lat_min) + F.col("row") * spec.resolution).alias("lat"),
        (F.lit(spec.lon_min) + F.col("col") * spec.resolution).alias("lon"), "value", "fault",
    )


def grid_axes(spark: SparkSession, spec: GrdSpec = GrdSpec()) -> DataFrame:
    """(axis, i, v): the archive's native latitudes and longitudes."""
    lat = spark.range(spec.height).select(F.lit("lat").alias("axis"), F.col("id").alias("i"), (F.lit(spec.lat_min) + F.col("id") * spec.resolution).alias("v"))
    lon = spark.range(spec.width).select(F.lit("lon").alias("axis"), F.col("id").alias("i"), (F.lit(spec.lon_min) + F.col("id") * spec.resolution).alias("v"))
    return lat.unionByName(lon)


def grid_cells(spark: SparkSession, grid) -> DataFrame:
    """(row, col, lat, lon, area_km2) of every cell of a target grid."""
    from ..functions.geo import cell_area_km2, indices_to_latlon

    rows = spark.range(grid.height).select(F.col("id").cast("int").alias("row"))
    cells = rows.withColumn("col", F.explode(F.sequence(F.lit(0), F.lit(grid.width - 1))))
    at = cells.withColumn("at", indices_to_latlon("row", "col", grid))
    return at.select("row", "col", "at.lat", "at.lon", cell_area_km2("row", grid).alias("area_km2"))
