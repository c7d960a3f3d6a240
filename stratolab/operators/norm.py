"""Climatology, channel policies and scaling of cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import by_transform, denormalised, normalised, restored, transformed
from ..schema import CHANNELS

STATS = "channel string, mean double, std double, min double, max double, count long, source string"


def channel_table(spark) -> DataFrame:
    """(idx, grp, channel, kind, method, transform, is_static) in the declared order."""
    rows = [(i, g, c, k, m, t, g == "static") for i, (g, c, k, m, t) in enumerate(CHANNELS)]
    kinds = "idx int, grp string, channel string, kind string, method string, transform string, is_static boolean"
    return spark.createDataFrame(rows, kinds)


def channel_policies(channels: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """Group defaults, then overrides (channel, method, transform); categorical channels are never scaled."""
    out = channels
    if overrides is not None:
        o = overrides.select("channel", F.col("method").alias("m"), F.col("transform").alias("t"))
        out = channels.join(o, "channel", "left")
        out = out.withColumns({"method": F.coalesce("m", "method"), "transform": F.coalesce("t", "transform")}).drop("m", "t")
    plain = F.col("kind") == "categorical"
    return out.withColumns(
        {
            "method": F.when(plain, F.lit("none")).otherwise(F.col("method")),
            "transform": F.when(~plain, F.col("transform")),
        }
    )


def in_reference(time: Column, first_year: int, last_year: int, months: list[int]) -> Column:
    return F.year(time).between(first_year, last_year) & F.month(time).isin(*months)


PERCENTILES = (1, 5, 25, 50, 75, 95, 99)


def build_channel_stats(cells: DataFrame, period: Column | None = None, transform: str = "transform", source: str | None = None) -> DataFrame:
    """Statistics per channel after its transform, over the reference period; physical_mean before it.

    Percentiles p1 to p99 come from a mergeable sketch, each within 1/100000 of its rank.
    """
    used = cells.where(period) if period is not None else cells
    t = by_transform("value", transform, transformed) if transform in cells.columns else F.col("value")
    return used.withColumn("tv", t).groupBy("channel").agg(
        F.avg("tv").alias("mean"),
        F.stddev_samp("tv").alias("std"),
        F.min("tv").alias("min"),
        F.max("tv").alias("max"),
        F.count("tv").alias("count"),
        F.avg("value").alias("physical_mean"),
        F.percentile_approx("tv", [p / 100 for p in PERCENTILES], 100_000).alias("p"),
    ).select("*", *[F.col("p")[i].alias(f"p{p}") for i, p in enumerate(PERCENTILES)], F.lit(source).cast("string").alias("source")).drop("p")


def with_stats(cells: DataFrame, stats: DataFrame, policy: DataFrame) -> DataFrame:
    """cells with their channel's policy and statistics, both one row a channel. Missing statistics fail the job."""
    p = policy.select("channel", "method", "transform")
    s = stats.select("channel", "mean", "std", F.col("min").alias("low"), F.col("max").alias("high"))
    joined = cells.join(p, "channel", "left").join(s, "channel", "left")
    message = F.concat(F.lit("no statistics for channel "), F.col("channel"))
    lacking = F.coalesce(F.col("method") != "none", F.lit(True)) & F.col("mean").isNull()
    checked = F.when(lacking, F.raise_error(message).cast("double")).otherwise(F.col("mean"))
    return joined.withColumn("mean", checked)


def _added(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c not in ("method", "transform", "mean", "std", "low", "high")]


def normalise(cells: DataFrame, stats: DataFrame, policy: DataFrame) -> DataFrame:
    j = with_stats(cells, stats, policy)
    v = by_transform("value", "transform", transformed)
    out = j.withColumn("value", normalised(v, "mean", "std", "low", "high", "method"))
    return out.select(_added(out))


def denormalise(cells: DataFrame, stats: DataFrame, policy: DataFrame) -> DataFrame:
    j = with_stats(cells, stats, policy)
    j = j.withColumn("value", denormalised("value", "mean", "std", "low", "high", "method"))
    out = j.withColumn("value", by_transform("value", "transform", restored))
    return out.select(_added(out))


def channel_baseline(stats: DataFrame, policy: DataFrame) -> DataFrame:
    """(channel, passthrough, baseline): the physical mean through transform and scaling; categorical is null."""
    j = stats.join(policy.select("channel", "kind", "method", "transform"), "channel")
    v = by_transform("physical_mean", "transform", transformed)
    scaled = normalised(v, "mean", "std", "min", "max", "method")
    passed = F.col("kind") == "categorical"
    return j.select("channel", passed.alias("passthrough"), F.when(~passed, scaled).alias("baseline"))


def expand_baseline(window: DataFrame, baseline: DataFrame) -> DataFrame:
    """window with baseline values; a passthrough channel's is the input itself."""
    j = window.join(baseline, "channel")
    return j.withColumn("baseline", F.when(F.col("passthrough"), F.col("value")).otherwise(F.coalesce("baseline", F.lit(0.0))))


def baseline_summary(baseline: DataFrame) -> DataFrame:
    zero = ~F.col("passthrough") & (F.col("baseline") == 0)
    return baseline.agg(
        F.count("*").alias("channels"),
        F.count_if(zero).alias("zero_valued"),
        F.count_if("passthrough").alias("passthrough"),
        F.count_if(~F.col("passthrough") & ~F.coalesce(zero, F.lit(False))).alias("non_zero"),
    )
