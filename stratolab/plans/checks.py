"""Configuration, its files and its checks, for one run and for a table of runs."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geo import DOMAIN, Grid
from ..operators.replay import POLICY, Policy
from ..schema import LEADS, LOOKBACK, MIN_AREA_KM2, MIN_FRACTION, RAIN_CLASSES, SEVERITY_BANDS


@dataclass(frozen=True)
class Config:
    grid: Grid = DOMAIN
    lookback: tuple[int, ...] = LOOKBACK
    leads: tuple[int, ...] = LEADS
    step_minutes: int = 30
    record: tuple[str, str] = ("2017-06-01", "2020-09-30")
    reference: tuple[str, str] = ("2017-06-01", "2019-09-30")
    train_until: str = "2019-09-30"
    validation_from: str = "2020-06-01"
    rain_classes: dict[str, float] = field(default_factory=lambda: dict(RAIN_CLASSES))
    bands: tuple[tuple[float, float, str], ...] = SEVERITY_BANDS
    gates: tuple[float, float] = (MIN_AREA_KM2, MIN_FRACTION)
    dissolve_key: str = "district"
    terrain_m: tuple[float, float] = (20.0, 500.0)
    policy: Policy = POLICY
    monitor: str = "csi_heavy"
    streams: tuple[str, ...] = ("insat", "imdaa", "imd_surface")
    required_streams: tuple[str, ...] = ("insat", "imd_surface")
    methods: dict[str, str] = field(default_factory=lambda: {"continuous": "linear", "precipitation": "hold", "categorical": "nearest"})


def _need(ok: bool, why: str) -> None:
    if not ok:
        raise ValueError(why)


def check_grid(c: Config) -> None:
    g = c.grid
    _need(g.lat_min < g.lat_max and g.lon_min < g.lon_max, "extents are not in order")
    for cells, low, high in ((g.height, g.lat_min, g.lat_max), (g.width, g.lon_min, g.lon_max)):
        span = high - low
        _need(abs(cells * g.resolution - span) < g.resolution * 1.5, f"{cells} cells of {g.resolution} do not make {span} degrees")


def check_time(c: Config) -> None:
    _need(c.lookback[-1] == 0, "the lookback ends at the valid time")
    _need(all(b - a == 1 for a, b in zip(c.lookback, c.lookback[1:], strict=False)), "the lookback ascends by one")
    _need(c.leads == tuple(range(1, len(c.leads) + 1)) and len(c.leads) > 0, "leads count from one")
    _need(c.step_minutes > 0 and 1440 % c.step_minutes == 0, "the step divides the day")


def check_leak(c: Config) -> None:
    _need(c.reference[1] <= c.train_until, "the climatology reaches beyond the training cutoff")
    _need(c.record[0] <= c.reference[0] <= c.reference[1] <= c.record[1], "the climatology is outside the record")
    _need(c.train_until < c.validation_from, "validation starts before training ends")


def check_bands(c: Config) -> None:
    for i in (0, 1):
        limits = [b[i] for b in c.bands]
        _need(limits == sorted(set(limits)), "severity bands do not rise")
    classes = list(c.rain_classes.values())
    _need(classes == sorted(set(classes)), "rain classes do not rise")


def check_replay(c: Config) -> None:
    c.policy.check()
    _need(set(c.required_streams) <= set(c.streams), "a required stream is not read")
    band = c.monitor.partition("_")[2]
    _need(band in c.rain_classes, f"no rain class is named {band!r}")
    _need(c.rain_classes[band] == c.policy.heavy_mm_h, "replay and monitor differ in their threshold")
    _need(c.policy.gate_frames <= len(c.lookback), "the gate looks at more frames than there are")


def check_methods(c: Config) -> None:
    _need(c.methods.get("categorical") == "nearest", "categories are never blended")
    _need(c.methods.get("precipitation") != "linear", "accumulations are not interpolated")


def check_gates(c: Config) -> None:
    _need(any(g > 0 for g in c.gates), "both district gates are zero")
    _need(bool(c.dissolve_key), "districts need a key to dissolve by")
    _need(c.terrain_m[0] < c.terrain_m[1], "terrain bands are not in order")


def check(c: Config) -> None:
    """All of them; the first that fails raises ValueError."""
    for one in (check_grid, check_time, check_leak, check_bands, check_replay, check_methods, check_gates):
        one(c)


SECTIONS = {"grid": Grid, "policy": Policy}


def read_config(spark: SparkSession, path: str) -> Config:
    """A checked configuration from the JSON files of a folder, each with some of Config's keys; a handful of small files.

    Unknown keys, keys that two files give, and wrong values are refused.
    """
    known = {f.name: f.default for f in fields(Config)}
    found: dict = {}
    for r in sorted(spark.read.text(path, wholetext=True).collect()):
        for key, value in json.loads(r.value).items():
            if key not in known:
                raise ValueError(f"unknown key {key!r}")
            if key in found:
                raise ValueError(f"{key!r} is given twice")
            if key in SECTIONS:
                wrong = set(value) - {f.name for f in fields(SECTIONS[key])}
                if wrong:
                    raise ValueError(f"unknown keys {sorted(wrong)} in {key!r}")
                value = SECTIONS[key](**value)
            elif isinstance(value, list):
                value = tuple(tuple(v) if isinstance(v, list) else v for v in value)
            found[key] = value
    config = Config(**found)
    check(config)
    return config


def config_faults(runs: DataFrame) -> DataFrame:
    """runs with `faults`: which checks the configuration of each run fails, in order.

    Columns: height, width, lat_min, lat_max, lon_min, lon_max, resolution; lookback,
    leads arrays, step_minutes; record_from, record_to, reference_from, reference_to,
    train_until, validation_from as text; bands and classes, arrays of limits; heavy_mm_h
    and monitor_mm_h; gate_frames, quantile; categorical and precipitation methods;
    min_area, min_fraction, dissolve_key, coast_m, mountain_m.
    """
    c = F.col

    def rising(name: str) -> F.Column:
        return F.coalesce(c(name) == F.array_sort(F.array_distinct(name)), F.lit(False))

    span = lambda n, low, high: F.abs(c(n) * c("resolution") - (c(high) - c(low))) < c("resolution") * 1.5
    steps = F.zip_with(F.slice("lookback", F.lit(2), F.size("lookback")), "lookback", lambda b, a: b - a)
    ascends = F.forall(F.slice(steps, F.lit(1), F.size("lookback") - 1), lambda d: d == 1)
    sound = {
        "grid": (c("lat_min") < c("lat_max")) & (c("lon_min") < c("lon_max")) & span("height", "lat_min", "lat_max") & span("width", "lon_min", "lon_max"),
        "time": (F.element_at("lookback", -1) == 0) & ascends & (c("leads") == F.sequence(F.lit(1), F.size("leads"))) & (c("step_minutes") > 0) & (1440 % c("step_minutes") == 0),
        "leak": (c("reference_to") <= c("train_until")) & (c("record_from") <= c("reference_from")) & (c("reference_from") <= c("reference_to"))
        & (c("reference_to") <= c("record_to")) & (c("train_until") < c("validation_from")),
        "bands": rising("bands") & rising("classes"),
        "replay": (c("heavy_mm_h") == c("monitor_mm_h")) & (c("gate_frames") <= F.size("lookback")) & c("quantile").between(0, 1),
        "methods": (c("categorical") == "nearest") & (c("precipitation") != "linear"),
        "gates": ((c("min_area") > 0) | (c("min_fraction") > 0)) & (c("dissolve_key") != "") & (c("coast_m") < c("mountain_m")),
    }
    named = [F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in sound.items()]
    return runs.withColumn("faults", F.array_compact(F.array(*named)))
