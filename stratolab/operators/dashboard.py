"""Alert boards, regional rules and event archives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import decimal_text

# Per region flash-flood IWV and CTT drop, cloudburst rate and area, wind gust.
REGION_LIMITS = (
    ("IN-MH-MUM", "Mumbai Metro", 55.0, 8.0, 100.0, 20, 65.0),
    ("IN-HP-SOL", "Solan District", 38.0, 10.0, 75.0, 10, 52.0),
    ("IN-HP-SHM", "Shimla", 40.0, 9.0, 80.0, 12, 55.0),
    ("IN-UK-RUD", "Rudraprayag", 36.0, 10.0, 70.0, 10, 50.0),
    ("IN-AS-GUW", "Guwahati", 50.0, 7.0, 90.0, 15, 60.0),
    ("IN-WB-DAR", "Darjeeling", 42.0, 9.0, 80.0, 12, 55.0),
    ("IN-TN-CHE", "Chennai", 54.0, 7.0, 95.0, 20, 65.0),
    ("IN-MH-PUN", "Pune Outskirts", 48.0, 8.0, 85.0, 18, 60.0),
)
# Names of the alert source for this board's.
HAZARDS = {"thunderstorm": "thunderstorm", "cloudburst": "cloudburst", "flash_flood": "flashFlood"}
STATUSES = {
    "active": "active",
    "acknowledged": "acknowledged",
    "escalated": "active",
    "resolved": "resolved",
    "false_alarm": "resolved",
}


def limits_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        list(REGION_LIMITS),
        "region_id string, region_name string, lim_iwv double, lim_ctt double, lim_rain double, area_km2 int, lim_wind double",
    )


def rule_join(telemetry: DataFrame, limits: DataFrame) -> DataFrame:
    """Telemetry of known regions with their limits, one row a region."""
    return telemetry.join(limits, "region_id")


def evaluate_rules(joined: DataFrame) -> DataFrame:
    """Three rows a telemetry row: rule_id, rule_text, is_met, status_text."""
    n = lambda c: decimal_text(F.col(c), "0.##")

    def rule(rid: str, text: Column, met: Column) -> Column:
        return F.struct(F.lit(rid).alias("rule_id"), text.alias("rule_text"), F.coalesce(met, F.lit(False)).alias("is_met"))

    flood = (F.col("iwv") > F.col("lim_iwv")) & (F.col("ctt_drop_30m") > F.col("lim_ctt"))
    rules = F.array(
        rule("flash-flood-critical", F.concat(F.lit("IWV > "), n("lim_iwv"), F.lit("mm AND CTT drop > "), n("lim_ctt"), F.lit("°C/30min")), flood),
        rule("cloudburst-warning", F.concat(F.lit("Rainfall Rate > "), n("lim_rain"), F.lit("mm/h over "), F.col("area_km2").cast("string"), F.lit("km²")), F.col("rainfall_rate") > F.col("lim_rain")),
        rule("high-wind-watch", F.concat(F.lit("Wind Gust > "), n("lim_wind"), F.lit("km/h")), F.col("wind_gust") > F.col("lim_wind")),
    )
    out = joined.withColumn("rule", F.explode(rules)).select(*joined.columns, "rule.*")
    return out.withColumn("status_text", F.when(F.col("is_met"), "Triggered").otherwise("Not Met"))


def _matches(search: str, *columns: str) -> Column:
    text = search.strip().lower()
    hit = F.lit(not text)
    for c in columns:
        hit = hit | F.lower(F.col(c).cast("string")).contains(text)
    return hit


def _is(column: str, wanted: str) -> Column:
    return F.lit(True) if wanted == "all" else F.col(column) == wanted


def filter_alerts(alerts: DataFrame, hazard="all", severity="all", status="all", search="") -> DataFrame:
    return alerts.where(
        _is("hazard_type", hazard) & _is("severity", severity) & _is("status", status) & _matches(search, "id", "region_name", "state")
    )


def filter_events(events: DataFrame, hazard="all", outcome="all", search="") -> DataFrame:
    same = F.lit(True) if hazard == "all" else F.lower("hazard_type") == hazard.lower()
    return events.where(same & _is("outcome", outcome) & _matches(search, "id", "region_name", "state"))


def _named(mapping: dict[str, str], column: str) -> Column:
    pairs = [F.lit(x) for p in mapping.items() for x in p]
    return F.coalesce(F.create_map(*pairs)[F.col(column)], F.col(column))


def map_alert(alerts: DataFrame) -> DataFrame:
    """Source alerts in the board's names: hazard, status, rounded risk, halves upwards."""
    return alerts.withColumns(
        {
            "hazard_type": _named(HAZARDS, "hazard_type"),
            "status": _named(STATUSES, "status"),
            "risk_score": F.floor(F.col("risk_score") + 0.5).cast("long"),
        }
    )


def delivery_channels(deliveries: Column) -> Column:
    """struct(sms, push, siren): channels with a delivery that was sent. Null deliveries are none."""
    sent = F.coalesce(
        F.transform(F.filter(deliveries, lambda d: d["status"] == "sent"), lambda d: d["channel"]), F.array().cast("array<string>")
    )
    return F.struct(*[F.array_contains(sent, c).alias(c) for c in ("sms", "push", "siren")])


def timeline(events: Column) -> Column:
    return F.transform(events, lambda e: F.struct(e["label"].alias("label"), e["timestamp"].alias("time")))


def alert_kpis(alerts: DataFrame) -> DataFrame:
    mean = F.coalesce(F.floor(F.avg("risk_score") + 0.5).cast("long"), F.lit(0).cast("long"))
    return alerts.agg(
        F.count("*").alias("total"),
        F.count_if(F.col("status") == "active").alias("active"),
        F.count_if(F.col("severity") == "severe").alias("severe"),
        mean.alias("mean_risk"),
    )


def default_region(alerts: DataFrame) -> DataFrame:
    """Region of the riskiest active alert, the smallest id of equals; without one, of the smallest id."""
    rank = F.struct((F.col("status") == "active").cast("int"), F.when(F.col("status") == "active", F.col("risk_score")).otherwise(0), -F.col("id"))
    return alerts.agg(F.max_by("region_name", rank).alias("region_name"))


def event_peaks(events: DataFrame, series: str = "series") -> DataFrame:
    """events with max risk, max IWV and min CTT of their series of structs."""
    of = lambda name: F.transform(series, lambda p: p[name])
    return events.withColumns({"peak_risk": F.array_max(of("risk")), "peak_iwv": F.array_max(of("iwv")), "lowest_ctt": F.array_min(of("ctt"))})


def event_frequency(events: DataFrame) -> DataFrame:
    """Counts by month and hazard, by month, and in all."""
    return events.rollup("month", "hazard_type").agg(F.count("*").alias("n"))


def outcome_scorecard(events: DataFrame) -> DataFrame:
    """Precision, recall and counts from outcomes hit, miss and false_alarm."""
    n = lambda o: F.count_if(F.col("outcome") == o)
    hit, miss, false = n("hit"), n("miss"), n("false_alarm")
    return events.agg(
        hit.alias("hits"), miss.alias("misses"), false.alias("false_alarms"),
        F.try_divide(hit, hit + false).alias("precision"), F.try_divide(hit, hit + miss).alias("recall"),
    )


def to_geojson(points: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """One FeatureCollection text a group of (lat, lng, value), features in order of place."""
    feature = F.struct(
        F.lit("Feature").alias("type"),
        F.struct(F.lit("Point").alias("type"), F.array("lng", "lat").alias("coordinates")).alias("geometry"),
        F.struct("value").alias("properties"),
    )
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("lat", "lng", feature.alias("f")))), lambda x: x["f"])
    whole = F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), ordered.alias("features")))
    return points.groupBy(*(keys or [])).agg(whole.alias("geojson"))
