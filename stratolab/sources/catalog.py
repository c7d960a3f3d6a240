"""Granule catalogues and path templates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Month names in file names, and the name pattern's parts.
MONTHS = ("JAN", "FEB", "MAR", "APR", "MAY", "JUN", "JUL", "AUG", "SEP", "OCT", "NOV", "DEC")
GRANULE = r"^(\d\w*?)_(\d{2})([A-Z]{3})(\d{4})_(\d{2})(\d{2})_"
NWP = r"([a-z]+)_(\d+)?_?(\d{4})(\d{2})\.[a-z0-9]+$"


def granule_catalog(files: DataFrame, path: str = "path") -> DataFrame:
    """files with name, satellite and scan_time from names such as 3DIMG_23SEP2017_0600_L1C.h5.

    Names of another form, and impossible dates, have a null scan_time.
    """
    name = F.element_at(F.split(F.col(path), "/"), -1)
    part = lambda i: F.regexp_extract("name", GRANULE, i)
    number = lambda i: part(i).try_cast("int")
    month = F.array_position(F.array(*map(F.lit, MONTHS)), part(3)).cast("int")
    time = F.try_make_timestamp(number(4), F.nullif(month, F.lit(0)), number(2), number(5), number(6), F.lit(0.0))
    out = files.withColumn("name", name)
    return out.withColumns({"satellite": F.nullif(part(1), F.lit("")), "scan_time": time})


def with_slot(cat: DataFrame, minutes: int = 30) -> DataFrame:
    """Catalogue rows with the slot their scan starts in."""
    s = F.unix_seconds("scan_time")
    return cat.withColumn("slot", F.timestamp_seconds(F.floor(s / (60 * minutes)) * 60 * minutes))


def latest_granule(cat: DataFrame) -> DataFrame:
    """One path a (satellite, slot): the last name in order, which is the newest processing version."""
    return cat.groupBy("satellite", "slot").agg(F.max_by("path", "name").alias("path"))


def parse_nwp_path(files: DataFrame, path: str = "path") -> DataFrame:
    """files with variable, level (null at the surface), year and month from .../u_850_201707.nc."""
    part = lambda i: F.nullif(F.regexp_extract(path, NWP, i), F.lit(""))
    return files.withColumns(
        {"variable": part(1), "level": part(2).try_cast("int"), "year": part(3).try_cast("int"), "month": part(4).try_cast("int")}
    )


def render_nwp_path(rows: DataFrame, root: str = "", suffix: str = "nc") -> DataFrame:
    level = F.when(F.col("level").isNotNull(), F.format_string("_%d", "level")).otherwise(F.lit(""))
    stamp = F.format_string("_%04d%02d", "year", "month")
    return rows.withColumn("path", F.concat(F.lit(root), "variable", level, stamp, F.lit("." + suffix)))
