"""Channels into windows, their validity, and samples."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import filled, flag_names, is_observed, is_usable

CELL = ["valid_time", "t", "row", "col"]


def stack_channels(parts: list[DataFrame], channels: DataFrame) -> DataFrame:
    """Streams' cells in one table with channel_idx in declared order; undeclared channels are left out."""
    stacked = reduce(lambda a, b: a.unionByName(b), parts)
    dims = channels.select("channel", F.col("idx").alias("channel_idx"))
    return stacked.join(dims, "channel")


def broadcast_static(window: DataFrame, static: DataFrame, cell: list[str] | None = None) -> DataFrame:
    """Static values on every frame of a window; static: (cell, channel, value)."""
    cell = cell or ["row", "col"]
    frames = window.select("valid_time", "t", *cell).distinct()
    return frames.join(static, cell)


def channel_coverage(cells: DataFrame, keys: list[str], sparse: float = 0.5) -> DataFrame:
    out = cells.groupBy(*keys, "channel").agg(F.avg(F.col("value").isNotNull().cast("double")).alias("coverage"))
    return out.withColumns({"empty": F.col("coverage") == 0, "sparse": (F.col("coverage") > 0) & (F.col("coverage") < sparse)})


def validity(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Whether all dynamic channels of a cell have a value; static ones do not count."""
    return cells.where("not is_static").groupBy(*keys).agg(F.bool_and(F.col("value").isNotNull()).alias("valid"))


def fill_missing(cells: DataFrame, value: float = 0.0) -> DataFrame:
    """Null, NaN and infinite values replaced, once `valid` keeps what was there."""
    was = F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") < float("inf"))
    return cells.withColumn("valid", was).withColumn("value", filled("value", value))


def channel(window: DataFrame, channels: DataFrame, name: str) -> DataFrame:
    if channels.where(F.col("channel") == name).isEmpty():
        raise KeyError(name)
    return window.where(F.col("channel") == name)


def resolve_alias(cells: DataFrame, aliases: DataFrame) -> DataFrame:
    """cells with `variable`: by short name first, else by key. aliases: (variable, short_name, key), one row each."""
    short = aliases.select(F.col("short_name").alias("name"), F.col("variable").alias("v1"))
    exact = aliases.select(F.col("key").alias("name"), F.col("variable").alias("v2"))
    return cells.join(short, "name", "left").join(exact, "name", "left").withColumn("variable", F.coalesce("v1", "v2")).drop("v1", "v2")


def attach_ctt(target: DataFrame, satellite: DataFrame) -> DataFrame:
    """target cells with cloud-top temperature of the same slot. Frames of other sizes fail the job."""
    keys = ["slot", "row", "col"]
    sizes = target.groupBy("slot").agg(F.count("*").alias("n")).join(satellite.groupBy("slot").agg(F.count("*").alias("m")), "slot")
    ok = sizes.select("slot", F.when(F.col("n") == F.col("m"), F.lit(True)).otherwise(F.raise_error(F.lit("frames differ in shape")).cast("boolean")).alias("same"))
    return target.join(satellite.select(*keys, F.col("value").alias("ctt")), keys).join(ok, "slot").where("same").drop("same")


def pair_samples(inputs: DataFrame, targets: DataFrame) -> DataFrame:
    """Inputs and targets (valid_time, accepted, reason) as samples, accepted if both are, with both reasons."""
    i = inputs.select("valid_time", F.col("accepted").alias("a"), F.col("reason").alias("ra"))
    t = targets.select("valid_time", F.col("accepted").alias("b"), F.col("reason").alias("rb"))
    why = F.concat_ws(
        "; ", F.when(~F.col("a"), F.concat(F.lit("input: "), "ra")), F.when(~F.col("b"), F.concat(F.lit("target: "), "rb"))
    )
    return i.join(t, "valid_time").select(
        "valid_time", (F.col("a") & F.col("b")).alias("accepted"), F.nullif(why, F.lit("")).alias("reason")
    )


def missing_windows(index: DataFrame, store: DataFrame) -> DataFrame:
    return index.join(store, "valid_time", "left_anti")


def acceptance_report(samples: DataFrame, keys: list[str], first: int = 3) -> DataFrame:
    """Kept and dropped per batch, and the first reasons in time order; `first` is the report's length."""
    why = F.when(~F.col("accepted"), F.struct("valid_time", "reason"))
    return samples.groupBy(*keys).agg(
        F.count_if("accepted").alias("kept"),
        F.count_if(~F.col("accepted")).alias("dropped"),
        F.transform(F.slice(F.sort_array(F.collect_list(why)), 1, first), lambda x: x["reason"]).alias("reasons"),
    )


def window_summary(frames: DataFrame, keys: list[str]) -> DataFrame:
    """Per window and stream: observed share, reconstructed frames, names of all flags."""
    seen = is_observed("qc_flag")
    return frames.groupBy(*keys, "stream").agg(
        F.avg(seen.cast("double")).alias("observed_fraction"),
        F.sort_array(F.collect_list(F.when(is_usable("qc_flag") & ~seen, F.col("t")))).alias("reconstructed_frames"),
        flag_names(F.bit_or("qc_flag")).alias("flags"),
    )


def accept_targets(frames: DataFrame, keys: list[str]) -> DataFrame:
    """Target windows: the earliest faulty lead decides. frames: (keys, lead, qc_flag), leads from 0."""
    name = F.concat_ws(", ", flag_names("qc_flag"))
    at = (F.col("lead") + 1).cast("string")
    unusable = F.concat(F.lit("lead frame t+"), at, F.lit(" is unusable ("), name, F.lit("); targets are never gap-filled"))
    rebuilt = F.concat(F.lit("lead frame t+"), at, F.lit(" is reconstructed ("), name, F.lit("); a target must be observed"))
    fault = F.when(~is_usable("qc_flag"), unusable).when(~is_observed("qc_flag"), rebuilt)
    out = frames.withColumn("fault", fault).groupBy(*keys).agg(
        F.min_by("fault", F.when(F.col("fault").isNotNull(), F.col("lead"))).alias("reason")
    )
    return out.withColumn("accepted", F.col("reason").isNull())


def assert_partition(channels: DataFrame, declared: DataFrame) -> None:
    """Indices and names cover exactly the declared channels."""
    have, want = channels.select("idx", "channel"), declared.select("idx", "channel")
    doubled = have.count() != have.select("idx").distinct().count()
    if doubled or not have.exceptAll(want).isEmpty() or not want.exceptAll(have).isEmpty():
        raise ValueError("channels do not partition the declared order")


def assert_channel_order(window: DataFrame, channels: DataFrame) -> None:
    """Assembled indices agree with declared names."""
    seen = window.select("channel_idx", "channel").distinct().withColumnRenamed("channel_idx", "idx")
    wrong = seen.join(channels.select("idx", "channel"), ["idx", "channel"], "left_anti")
    if not wrong.isEmpty():
        raise ValueError("assembled channels are not in declared order")


def assert_dense(cells: DataFrame, keys: list[str], height: int, width: int) -> None:
    if not cells.groupBy(*keys).count().where(F.col("count") != height * width).isEmpty():
        raise ValueError(f"a frame does not have {height} x {width} cells")


def dense_tensor(window: DataFrame) -> DataFrame:
    """One array of values in row order for each (valid_time, t, channel)."""
    pairs = F.sort_array(F.collect_list(F.struct("row", "col", "value")))
    return window.groupBy("valid_time", "t", "channel_idx").agg(F.transform(pairs, lambda p: p["value"].cast("float")).alias("tensor"))
