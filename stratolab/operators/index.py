"""Seasons, valid times and the split by reaching edge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schema import LEADS, LOOKBACK, SLOT_MINUTES


def season_runs(spark: SparkSession, years: list[int], months: list[int], step: int = SLOT_MINUTES) -> DataFrame:
    """(year, first_month, last_month, season_start, season_end) of each run of months.

    The last slot of a run is one step before midnight of the month's end.
    Months that meet over the new year, and steps that do not divide a day,
    are refused.
    """
    if step <= 0 or 1440 % step:
        raise ValueError(f"a step of {step} minutes does not divide the day")
    if not months:
        raise ValueError("no months are given")
    if {1, 12} <= set(months):
        raise ValueError("a season over the new year belongs to no single year")
    grid = spark.createDataFrame([(m,) for m in sorted(set(months))], "month int")
    island = F.col("month") - F.row_number().over(Window.orderBy("month"))
    runs = grid.withColumn("island", island).groupBy("island").agg(
        F.min("month").alias("first_month"), F.max("month").alias("last_month")
    )
    named = spark.createDataFrame([(y,) for y in sorted(set(years))], "year int").crossJoin(runs)  # years x runs
    start = F.make_timestamp("year", "first_month", F.lit(1), F.lit(0), F.lit(0), F.lit(0))
    month_end = F.last_day(F.make_date("year", "last_month", F.lit(1)))
    end = F.date_add(month_end, 1).cast("timestamp") - F.make_dt_interval(mins=F.lit(step))
    return named.select(
        "year", "first_month", "last_month", start.alias("season_start"), end.alias("season_end")
    )


def margins(step: int = SLOT_MINUTES, sequence: int = len(LOOKBACK), leads: int = len(LEADS)) -> tuple[Column, Column]:
    """Lookback and horizon as intervals."""
    if sequence < 1 or leads < 1:
        raise ValueError("a window has at least one input and one lead frame")
    return F.make_dt_interval(mins=F.lit((sequence - 1) * step)), F.make_dt_interval(mins=F.lit(leads * step))


def valid_times(
    seasons: DataFrame, step: int = SLOT_MINUTES, sequence: int = len(LOOKBACK), leads: int = len(LEADS), inside: bool = True
) -> DataFrame:
    """Every valid_time a season supports; `inside` keeps whole windows within it."""
    back, ahead = margins(step, sequence, leads)
    first = F.col("season_start") + back if inside else F.col("season_start")
    last = F.col("season_end") - ahead if inside else F.col("season_end")
    bounded = seasons.withColumns({"first": first, "last": last}).where("first <= last")
    every = F.sequence("first", "last", F.make_dt_interval(mins=F.lit(step)))
    return bounded.select("year", F.explode(every).alias("valid_time"))


def split_times(
    times: DataFrame,
    train_until: str = "2019-09-30 23:59:59",
    validation_from: str = "2020-06-01 00:00:00",
    step: int = SLOT_MINUTES,
    sequence: int = len(LOOKBACK),
    leads: int = len(LEADS),
) -> DataFrame:
    """times with split: train if the last lead is in time, validation if the first input is, else discarded."""
    back, ahead = margins(step, sequence, leads)
    t = F.col("valid_time")
    side = (
        F.when(t + ahead <= F.lit(train_until).cast("timestamp"), "train")
        .when(t - back >= F.lit(validation_from).cast("timestamp"), "validation")
        .otherwise("discarded")
    )
    return times.withColumn("split", side)


def build_index(spark: SparkSession, years: list[int], months: list[int], **split) -> DataFrame:
    return split_times(valid_times(season_runs(spark, years, months)), **split)


def split_summary(split: DataFrame, step: int = SLOT_MINUTES, sequence: int = len(LOOKBACK), leads: int = len(LEADS)) -> DataFrame:
    """Per side: windows, first and last time, and the envelope its frames reach over."""
    back, ahead = margins(step, sequence, leads)
    return split.groupBy("split").agg(
        F.count("*").alias("windows"),
        F.min("valid_time").alias("first_time"),
        F.max("valid_time").alias("last_time"),
        F.min(F.col("valid_time") - back).alias("reaches_from"),
        F.max(F.col("valid_time") + ahead).alias("reaches_to"),
    )


def overlap(split: DataFrame) -> DataFrame:
    """(shared, train_reaches_to, validation_reaches_from): 0 shared times and ordered edges mean disjoint sides."""
    s = split_summary(split)
    edge = lambda side, c: F.max(F.when(F.col("split") == side, F.col(c)))
    edges = s.agg(edge("train", "reaches_to").alias("train_to"), edge("validation", "reaches_from").alias("validation_from"))
    t = split.where("split = 'train'").select("valid_time")
    shared = t.intersect(split.where("split = 'validation'").select("valid_time")).agg(F.count("*").alias("shared"))
    return edges.crossJoin(shared)


def assert_disjoint(split: DataFrame) -> None:
    row = overlap(split).first()
    late = row.train_to is not None and row.validation_from is not None and row.train_to > row.validation_from
    if row.shared or late:
        raise ValueError(f"training reaches {row.train_to}, validation starts at {row.validation_from}")


def in_record(time: Column, seasons: DataFrame | None = None, *, start: str, end: str, months: list[int] | None = None) -> Column:
    """Within the span and, if months are given, in the season; months None tests the span alone."""
    ok = time.between(F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp"))
    return ok & F.month(time).isin(*months) if months else ok


def assert_train_only(records: DataFrame, split: DataFrame) -> None:
    """Refuse records whose time is not in the training side."""
    train = split.where("split = 'train'").select("valid_time")
    if not records.join(train, "valid_time", "left_anti").isEmpty():
        raise ValueError("a record is not from the training split")
