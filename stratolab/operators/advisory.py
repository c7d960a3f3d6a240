"""Retrieval of guidance, decision rules, and alert documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import area_description, decimal_text, event_title, percent
from ..schema import CAP_CERTAINTY_RANK, CAP_SEVERITY, CAP_SEVERITY_RANK, COAST_M, MOUNTAIN_M, URBAN_FRACTION
from . import retrieval
from .impact import DISTRICT, district_class_fraction, district_mean

FILTERS = ["hazard_class", "severity_tier", "region"]


def _lookup(mapping: dict, key: Column) -> Column:
    entries = [F.lit(x) for pair in mapping.items() for x in pair]
    return F.create_map(*entries)[key]


# --- labels ---------------------------------------------------------------------


def region_class(elevation: Column) -> Column:
    """Terrain from mean elevation; unknown is plains."""
    return (
        F.when(elevation >= MOUNTAIN_M, "mountainous").when(elevation <= COAST_M, "coastal").otherwise("plains")
    )


def hazard_class(urban: Column, available: Column) -> Column:
    """Waterlogging in urban districts; without a codebook, or below the share, flash flood."""
    return F.when(available & (urban >= URBAN_FRACTION), "urban_waterlogging").otherwise("flash_flood")


def district_profiles(static: DataFrame, districts: DataFrame, urban_classes: list[int]) -> DataFrame:
    """(state, district, elevation_m, urban_fraction); a null urban_fraction means no codebook."""
    height = district_mean(static, districts, "elevation_m").withColumnRenamed("mean", "elevation_m")
    if not urban_classes:
        return height.withColumn("urban_fraction", F.lit(None).cast("double"))
    urban = district_class_fraction(static, districts, urban_classes, "lulc").withColumnRenamed("fraction", "urban_fraction")
    return height.join(urban, DISTRICT, "left")


def with_profile(impacts: DataFrame, profiles: DataFrame) -> DataFrame:
    known = profiles.withColumn("known", F.lit(True))
    joined = impacts.join(known, DISTRICT, "left")
    return joined.withColumn("reason", F.when(F.col("known").isNull(), "no terrain profile")).drop("known")


def retrieval_context(impacts: DataFrame) -> DataFrame:
    """impacts with profile columns given their labels, and which of these are defaults. Null severities are left out."""
    high, urban = F.col("elevation_m"), F.col("urban_fraction")
    return impacts.where("severity is not null").withColumns(
        {
            "hazard_class": hazard_class(urban, urban.isNotNull()),
            "severity_tier": F.col("severity"),
            "region": region_class(high),
            "defaulted": F.array_compact(
                F.array(F.when(urban.isNull(), F.lit("hazard_class")), F.when(high.isNull(), F.lit("region")))
            ),
        }
    )


# --- retrieval --------------------------------------------------------------------


def retrieve(queries: DataFrame, chunks: DataFrame, k: int = 4, metric: str = "l2sq", filters: list[str] = FILTERS, **options) -> DataFrame:
    """Per query (query_id, filters, embedding) the k nearest chunks with equal metadata, nearest first.

    query_ids are unique. Only chunks that can qualify are measured: see retrieval. A query without
    any match keeps one row with empty_reason. Ties go to the smaller chunk_id. Vectors that are null, not
    finite, or of another length than the chunks' take no part, as do vectors of zeros under cosine.
    """
    best = retrieval.nearest(queries, chunks, k, metric, filters, **options)
    out = queries.select("query_id").join(best, "query_id", "left")
    return out.withColumn("empty_reason", F.when(F.col("chunk_id").isNull(), "no chunk matches the filter"))


def query_text() -> Column:
    return F.concat(
        F.lit("What should people do about "), F.replace("hazard_class", F.lit("_"), F.lit(" ")), F.lit(" of severity "), "severity_tier",
        F.lit(" in "), "region", F.lit(" terrain? Chance of heavy rain "), percent("peak_probability"), F.lit(", share of the district "),
        percent("affected_fraction"), F.lit("."),
    )


def prompt_text() -> Column:
    """The situation and the excerpts, one fact a line, from an impact row with context, times, guidelines and drivers."""
    clock = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ssXXX")
    fact = lambda name, *value: F.concat(F.lit(f"{name} = "), *value)
    hours = lambda c: decimal_text(F.col(c), "0.0")
    listed = lambda items, say: F.array_join(F.transform(items, say), "\n")
    facts = [
        fact("place", area_description("district", "state")),
        fact("issued", clock("valid_time")),
        fact("starts", clock("onset_time"), F.lit(", in "), hours("onset_hours"), F.lit(" h")),
        fact("ends", clock("expiry_time"), F.lit(", in "), hours("expiry_hours"), F.lit(" h")),
        fact("chance of heavy rain", percent("peak_probability")),
        fact("area hit", decimal_text("affected_area_km2", "0"), F.lit(" km2, "), percent("affected_fraction"), F.lit(" of the place")),
        fact("band", F.coalesce("severity", F.lit("none"))),
        F.when(F.col("peak_intensity").isNotNull(), fact("strongest rain", decimal_text("peak_intensity", "0"), F.lit(" mm/h"))),
        fact("hazard", F.col("hazard_class")),
        fact("terrain", F.col("region")),
        F.when(F.size("defaulted") > 0, fact("assumed, not known", F.array_join("defaulted", ", "))),
    ]
    driven = F.when(F.size("drivers") > 0, F.concat(F.lit("[what moved the forecast]\n"), listed("drivers", lambda d: F.concat(d["channel"], F.lit(" "), d["direction"], F.lit(" it")))))
    quoted = F.when(
        F.size("guidelines") > 0, listed("guidelines", lambda g: F.concat(g["chunk_id"], F.lit(" from "), g["source"], F.lit(": "), F.trim(g["text"])))
    ).otherwise(F.concat(F.lit("nothing found: "), F.coalesce("empty_reason", F.lit("no reason given"))))
    return F.concat_ws("\n", F.lit("[situation]"), *facts, driven, F.lit("[guidelines to draw on]"), quoted)


# --- CAP ----------------------------------------------------------------------------


def cap_urgency(hours: Column, immediate: float = 2.0, expected: float = 6.0) -> Column:
    return F.when(hours <= immediate, "Immediate").when(hours <= expected, "Expected").otherwise("Future")


def cap_certainty(probability: Column) -> Column:
    return F.when(probability >= 0.7, "Likely").when(probability >= 0.3, "Possible").otherwise("Unlikely")


def cap_severity_floor(band: Column) -> Column:
    return F.coalesce(_lookup(CAP_SEVERITY, band), F.lit("Unknown"))


def validate_texts(texts: DataFrame) -> DataFrame:
    """texts (cap_severity, cap_urgency, cap_certainty) with impact columns (severity, onset_hours,
    peak_probability), given accepted and the first reason against."""
    floor = _lookup(CAP_SEVERITY_RANK, cap_severity_floor(F.col("severity")))
    ceiling = _lookup(CAP_CERTAINTY_RANK, cap_certainty(F.col("peak_probability")))
    reason = (
        F.when(F.coalesce(_lookup(CAP_SEVERITY_RANK, F.col("cap_severity")), F.lit(-1)) < floor, "severity_below_floor")
        .when(~F.col("cap_urgency").eqNullSafe(cap_urgency(F.col("onset_hours"))), "urgency_contradicts_onset")
        .when(F.col("cap_certainty") == "Observed", "certainty_observed")
        .when(F.coalesce(_lookup(CAP_CERTAINTY_RANK, F.col("cap_certainty")), F.lit(99)) > ceiling, "certainty_above_ceiling")
    )
    return texts.withColumn("reason", reason).withColumn("accepted", F.col("reason").isNull())


def cap_field_errors(texts: DataFrame, headline_max: int = 160, prose_max: int = 4000, blank: dict[str, Column] | None = None) -> DataFrame:
    """texts with an array of field errors: blank, too long, or expiry not after onset.

    `blank` says when a field counts as blank, for those fields that are judged so; by default
    each of the three does where it is null or holds spaces alone.
    """
    faults = []
    limits = {"headline": headline_max, "description": prose_max, "instruction": prose_max}
    blank = {name: F.trim(F.coalesce(name, F.lit(""))) == "" for name in limits} if blank is None else blank
    for name, most in limits.items():
        if name in blank:
            faults.append(F.when(blank[name], F.lit(f"{name} is blank")))
        faults.append(F.when(F.length(name) > most, F.lit(f"{name} is too long")))
    faults.append(F.when(~(F.col("expires") > F.col("onset")), F.lit("expires before onset")))
    return texts.withColumn("errors", F.array_compact(F.array(*faults)))


def grounded(guidelines: Column, official: Column) -> Column:
    return (F.size(guidelines) > 0) & official


def corpus_label(documents: DataFrame, sample_prefix: str = "SAMPLE") -> DataFrame:
    """Official only if no document's source is a sample."""
    any_sample = F.coalesce(F.bool_or(F.col("source").startswith(sample_prefix)), F.lit(True))
    return documents.agg(F.when(any_sample, "sample").otherwise("official").alias("corpus_label"))


def cap_parameters() -> Column:
    """The alert's name-value pairs: fixed ones, those that apply, one a citation, one a driver.

    Names and number patterns are fixed values.
    """

    def pair(name: str, value: Column) -> Column:
        return F.when(value.isNotNull(), F.struct(F.lit(name).alias("value_name"), value.alias("value")))

    number = lambda c, f: decimal_text(F.col(c), f)
    fixed = F.array(
        pair("peak_probability", number("peak_probability", "0.0000")),
        pair("corpus", F.col("corpus")),
        pair("affected_area_km2", number("affected_area_km2", "0.0")),
        pair("affected_fraction", number("affected_fraction", "0.0000")),
        pair("hazard_class", F.col("hazard_class")),
        pair("region_class", F.col("region")),
        pair("grounded_in_ndma", F.col("grounded").cast("string")),
        pair("peak_intensity_mm_h", number("peak_intensity", "0.00")),
        F.when(F.size("defaulted") > 0, F.struct(F.lit("defaulted_labels").alias("value_name"), F.array_join("defaulted", ",").alias("value"))),
    )
    cited = F.transform("guidelines", lambda g: F.struct(F.lit("ndma_citation").alias("value_name"), g["chunk_id"].alias("value")))
    driven = F.transform(
        "drivers", lambda d: F.struct(F.lit("forecast_driver").alias("value_name"), F.concat(d["channel"], F.lit(":"), d["direction"]).alias("value"))
    )
    return F.concat(F.array_compact(fixed), cited, driven)


def build_alerts(rows: DataFrame, sender: str = "nowcast", language: str = "en-IN") -> DataFrame:
    """Accepted text rows as alert structs. The identifier is a digest of district and time, so reruns agree."""
    ident = F.sha2(F.concat_ws("|", F.lit(sender), "state", "district", F.col("valid_time").cast("string")), 256)
    info = F.struct(
        F.lit(language).alias("language"),
        F.array(F.lit("Met")).alias("category"),
        event_title("hazard_class").alias("event"),
        F.col("cap_urgency").alias("urgency"),
        F.col("cap_severity").alias("severity"),
        F.col("cap_certainty").alias("certainty"),
        F.col("headline"),
        F.col("description"),
        F.col("instruction"),
        F.col("valid_time").alias("effective"),
        F.col("onset_time").alias("onset"),
        F.col("expiry_time").alias("expires"),
        cap_parameters().alias("parameter"),
        F.array(F.struct(area_description("district", "state").alias("area_desc"))).alias("area"),
    )
    alert = F.struct(
        F.substring(ident, 1, 32).alias("identifier"), F.lit(sender).alias("sender"), F.col("valid_time").alias("sent"),
        F.lit("Actual").alias("status"), F.lit("Alert").alias("msg_type"), F.lit("Public").alias("scope"), F.array(info).alias("info"),
    )
    return rows.withColumn("alert", alert)


def advisories(impacts: DataFrame, profiles: DataFrame, texts: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Every impact with its text's verdict: alert-ready, or the reason why not.

    impacts carry onset_hours; texts (by, state, district, cap_* ..) may lack
    districts. The impact is reported in any case.
    """
    context = with_profile(impacts, profiles)
    joined = context.join(texts.withColumn("has_text", F.lit(True)), [*(by or []), *DISTRICT], "left")
    checked = validate_texts(joined.withColumnRenamed("reason", "profile_reason"))
    reason = F.coalesce(
        "profile_reason", F.when(F.col("has_text").isNull(), F.lit("no text is available")), F.col("reason")
    )
    return checked.withColumn("reason", reason).withColumn("accepted", F.col("reason").isNull()).drop("profile_reason", "has_text")


def presented_guidelines(found: DataFrame) -> DataFrame:
    return found.select("query_id", "rank", "chunk_id", F.round("distance", 4).alias("distance"))
