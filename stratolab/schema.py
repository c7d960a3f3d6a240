"""Fixed values of the data model: QC flags, channels, bands and thresholds."""

from __future__ import annotations

# QC bits in order.
QC_FLAGS = (
    "MISSING_FILE",
    "CORRUPT_OR_MISSING",
    "VARIABLE_ABSENT",
    "PARTIAL_COVERAGE",
    "CALIBRATION_FAILED",
    "SATURATED",
    "SCANLINE_DROPOUT",
    "GEOLOCATION_MISSING",
    "PARALLAX_UNCORRECTED",
    "OUT_OF_PHYSICAL_RANGE",
    "GAP_FILLED_OPTICAL_FLOW",
    "GAP_FILLED_SPLINE",
    "GAP_FILL_FAILED",
)
BIT = {name: 1 << i for i, name in enumerate(QC_FLAGS)}
FATAL = BIT["MISSING_FILE"] | BIT["CORRUPT_OR_MISSING"] | BIT["VARIABLE_ABSENT"] | BIT["GAP_FILL_FAILED"]
RECONSTRUCTED = BIT["GAP_FILLED_OPTICAL_FLOW"] | BIT["GAP_FILLED_SPLINE"]
REPLAY_DISQUALIFYING = (
    BIT["SATURATED"] | BIT["SCANLINE_DROPOUT"] | BIT["CALIBRATION_FAILED"] | BIT["PARTIAL_COVERAGE"]
)

# Pressure levels, upper-air variables, and the 30 channels in order.
LEVELS = (200, 500, 700, 850)
UPPER_AIR = ("u", "v", "t", "rh", "z")
CHANNELS = (
    *(("satellite", c, "continuous", "minmax", None) for c in ("insat_tir1", "insat_wv", "insat_ctt")),
    *(("nwp", f"{v}{p}", "continuous", "zscore", None) for v in UPPER_AIR for p in LEVELS),
    ("surface", "imd_precip", "continuous", "minmax", "log1p"),
    *(("surface", c, "continuous", "zscore", None) for c in ("temp_2m", "rh_2m", "wind_10m")),
    ("static", "dem_elevation", "continuous", "minmax", None),
    ("static", "lulc_mask", "categorical", "none", None),
    ("static", "soil_type", "categorical", "none", None),
)

# Physical bounds.
BOUNDS = {
    "insat_tir1": (180.0, 340.0),
    "insat_wv": (180.0, 300.0),
    "insat_ctt": (180.0, 320.0),
    "imd_precip": (0.0, 1200.0),
    "hem_rain_rate": (0.0, 300.0),
    "temp_2m": (220.0, 330.0),
    "rh_2m": (0.0, 100.0),
    "wind_10m": (0.0, 120.0),
    "u": (-150.0, 150.0),
    "v": (-150.0, 150.0),
    "t": (180.0, 340.0),
    "rh": (0.0, 100.0),
    "z": (0.0, 20000.0),
}

# Rain classes in mm/h, reporting floor, severity bands as (probability, intensity, name).
RAIN_CLASSES = {"light": 2.5, "moderate": 7.5, "heavy": 15.0, "very_heavy": 35.0, "extremely_heavy": 60.0}
REPORT_FLOOR = 0.15
SEVERITY_BANDS = ((0.15, 2.5, "low"), (0.30, 7.5, "moderate"), (0.50, 15.0, "high"), (0.70, 35.0, "severe"))
CAP_SEVERITY = {"low": "Minor", "moderate": "Moderate", "high": "Severe", "severe": "Extreme"}
CAP_SEVERITY_RANK = {"Unknown": 0, "Minor": 1, "Moderate": 2, "Severe": 3, "Extreme": 4}
CAP_CERTAINTY_RANK = {"Unknown": 0, "Unlikely": 1, "Possible": 2, "Likely": 3, "Observed": 4}

# District gates, terrain taxonomy, slots.
MIN_AREA_KM2, MIN_FRACTION = 150.0, 0.05
MOUNTAIN_M, COAST_M, URBAN_FRACTION = 500.0, 20.0, 0.30
SLOT_MINUTES, TOLERANCE_S, LOOKBACK, LEADS = 30, 420, tuple(range(-12, 1)), tuple(range(1, 13))
EARTH_KM = 6371.0088
