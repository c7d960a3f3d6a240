"""Column functions: flags, sentinels, transforms, scaling, labels, vectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import BIT, FATAL, LEVELS, QC_FLAGS, RECONSTRUCTED, UPPER_AIR


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


# --- QC flags -----------------------------------------------------------------


def is_usable(flags) -> Column:
    return _c(flags).bitwiseAND(FATAL) == 0


def is_observed(flags) -> Column:
    return _c(flags).bitwiseAND(FATAL | RECONSTRUCTED) == 0


def set_flag(flags, *names: str) -> Column:
    return _c(flags).bitwiseOR(sum(BIT[n] for n in set(names)))


def clear_flag(flags, *names: str) -> Column:
    return _c(flags).bitwiseAND(~sum(BIT[n] for n in set(names)))


def flag_names(flags) -> Column:
    """Names of the set bits, in bit order."""
    named = [F.when(_c(flags).bitwiseAND(BIT[n]) != 0, F.lit(n)) for n in QC_FLAGS]
    return F.array_compact(F.array(*named))


# --- cleaning -----------------------------------------------------------------


def null_sentinel(c, fill: float, tolerance: float = 1e-6) -> Column:
    """Values close to the fill value, and NaN and infinities, become null."""
    v = _c(c)
    return F.when((F.abs(v - fill) > tolerance) & ~F.isnan(v) & (F.abs(v) < float("inf")), v)


def unpacked(raw, fill, scale: float = 1.0, offset: float = 0.0) -> Column:
    return F.when(_c(raw) != fill, _c(raw) * scale + offset)


def clean_lat(lat) -> Column:
    return F.when(_c(lat).between(-90, 90), _c(lat))


def clean_lon(lon) -> Column:
    """Longitudes from -180 to 360 are meaningful; others null."""
    return F.when(_c(lon).between(-180, 360), _c(lon))


def filled(c, value: float = 0.0) -> Column:
    """Null, NaN and infinities become value."""
    v = _c(c)
    return F.when(v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")), v).otherwise(F.lit(value))


def wind_speed(u, v) -> Column:
    """Null where a component is missing."""
    return F.hypot(_c(u), _c(v))


# --- transforms and scaling -----------------------------------------------------


def transformed(c, transform: str | None) -> Column:
    v = _c(c)
    above = F.when(v.isNotNull(), F.greatest(v, F.lit(0.0)))
    return {None: v, "log1p": F.log1p(above), "sqrt": F.sqrt(above)}[transform]


def restored(c, transform: str | None) -> Column:
    v = _c(c)
    return {None: v, "log1p": F.expm1(v), "sqrt": v * v}[transform]


def normalised(c, mean, std, low, high, method, *, min_std=1e-3, epsilon=1e-6, sigma=6.0) -> Column:
    """By method column: zscore (floored spread, clipped), minmax (zeros if the span is degenerate), none."""
    v, span = _c(c), _c(high) - _c(low)
    z = (v - _c(mean)) / F.greatest(_c(std), F.lit(min_std))
    clipped = F.when(z.isNotNull(), F.greatest(F.lit(-sigma), F.least(F.lit(sigma), z)))
    ratio = (v - _c(low)) / F.when(F.abs(span) >= epsilon, span)
    scaled = F.when(F.abs(span) < epsilon, F.lit(0.0)).otherwise(ratio)
    return F.when(_c(method) == "zscore", clipped).when(_c(method) == "minmax", scaled).otherwise(v)


def denormalised(c, mean, std, low, high, method, *, min_std=1e-3) -> Column:
    v = _c(c)
    return (
        F.when(_c(method) == "zscore", v * F.greatest(_c(std), F.lit(min_std)) + _c(mean))
        .when(_c(method) == "minmax", v * (_c(high) - _c(low)) + _c(low))
        .otherwise(v)
    )


def by_transform(c, transform, function) -> Column:
    """`function` with the transform named in a column."""
    t = _c(transform)
    return (
        F.when(t == "log1p", function(c, "log1p")).when(t == "sqrt", function(c, "sqrt")).otherwise(function(c, None))
    )


# --- names ----------------------------------------------------------------------


def split_level_channel(c) -> Column:
    """struct(variable, level) of names such as u850; null for others."""
    name = F.regexp_extract(_c(c), r"^([a-z]+)(\d+)$", 1)
    level = F.regexp_extract(_c(c), r"^([a-z]+)(\d+)$", 2)
    known = name.isin(*UPPER_AIR) & level.isin(*map(str, LEVELS))
    return F.when(known, F.struct(name.alias("variable"), level.try_cast("int").alias("level")))


def channel_provenance(c) -> Column:
    v = _c(c)
    return (
        F.when(v.startswith("insat_"), F.lit("insat"))
        .when(split_level_channel(v).isNotNull(), F.lit("imdaa"))
        .when(v.isin("imd_precip", "temp_2m", "rh_2m", "wind_10m"), F.lit("imd_surface"))
        .when(v.isin("dem_elevation", "lulc_mask", "soil_type"), F.lit("static"))
        .otherwise(F.lit("unknown"))
    )


def detect_crs(c) -> Column:
    """Label of a model grid type; unknown types stay without one."""
    return F.when(F.lower(_c(c)).isin("regular_ll", "latlon", "regular"), F.lit("EPSG:4326"))


def event_title(hazard) -> Column:
    return F.concat(F.lit("Heavy Rainfall - "), F.initcap(F.replace(_c(hazard), F.lit("_"), F.lit(" "))))


def area_description(district, state) -> Column:
    return F.concat_ws(", ", _c(district), _c(state))


def percent(c) -> Column:
    """A share as a whole per cent, halves to even."""
    return F.concat(F.bround(_c(c) * 100).cast("long").cast("string"), F.lit("%"))


def decimal_text(c, pattern: str) -> Column:
    """A number by a decimal pattern such as 0.00."""
    return F.call_function("format_number", _c(c), F.lit(pattern))


# --- time -------------------------------------------------------------------------


def lead_hours(lead, minutes: int = 30) -> Column:
    """Hours ahead of zero-based lead frames."""
    return (_c(lead) + 1) * minutes / 60


def lead_time(valid_time, lead, minutes: int = 30) -> Column:
    return _c(valid_time) + F.make_dt_interval(mins=((_c(lead) + 1) * minutes).cast("int"))


# --- vectors ----------------------------------------------------------------------


def dot(a, b) -> Column:
    pairs = F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x)


def l2_squared(a, b) -> Column:
    gaps = F.zip_with(_c(a), _c(b), lambda x, y: F.pow(x.cast("double") - y.cast("double"), F.lit(2.0)))
    return F.aggregate(gaps, F.lit(0.0), lambda s, x: s + x)


def cosine_distance(a, b) -> Column:
    return 1 - dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))
