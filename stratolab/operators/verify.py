"""Verification of ensembles, and the decision to promote a model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import RAIN_CLASSES

HIGHER_IS_BETTER = {"csi": True, "pod": True, "far": False, "crps": False, "mae": False}
CELL = ["window_id", "lead", "cell"]


def higher_is_better(metric: str) -> bool:
    """Direction of a metric by the part of its name before the band; unknown names are refused."""
    stem = metric.split("_")[0]
    if stem not in HIGHER_IS_BETTER:
        raise ValueError(f"no direction is known for {metric!r}")
    return HIGHER_IS_BETTER[stem]


def verify_join(ensemble: DataFrame, target: DataFrame, keys: list[str] = CELL) -> DataFrame:
    """Members against valid observations on (window, lead, cell); observation as `observed`."""
    valid = target.where("rain_mm_h is not null").select(*keys, F.col("rain_mm_h").alias("observed"))
    return ensemble.join(valid, keys)


def reduce_ensemble(ensemble: DataFrame, keys: list[str] = CELL) -> DataFrame:
    """Mean, max, min, lower median and spread per cell; one member has no spread."""
    v = F.col("rain_mm_h")
    return ensemble.groupBy(*keys).agg(
        F.avg(v).alias("mean"),
        F.max(v).alias("max"),
        F.min(v).alias("min"),
        F.expr("percentile_disc(0.5) within group (order by rain_mm_h)").alias("median"),
        F.stddev_samp(v).alias("std"),
        F.count(v).alias("members"),
    )


def exceedance(ensemble: DataFrame, threshold: float, keys: list[str] = CELL) -> DataFrame:
    """Share of members at or above the threshold."""
    share = F.avg((F.col("rain_mm_h") >= threshold).cast("double"))
    return ensemble.groupBy(*keys).agg(share.alias("probability"))


def exceedance_classes(ensemble: DataFrame, classes: dict[str, float] = RAIN_CLASSES, keys: list[str] = CELL) -> DataFrame:
    """One row a cell and rain class. All classes are counted in one aggregation, then unpivoted."""
    shares = [F.avg((F.col("rain_mm_h") >= t).cast("double")).alias(c) for c, t in classes.items()]
    return ensemble.groupBy(*keys).agg(*shares).unpivot(keys, list(classes), "rain_class", "probability")


def contingency(pairs: DataFrame, threshold: float, by: list[str] | None = None) -> DataFrame:
    """Hits, misses, false alarms and correct negatives per member, thresholds inclusive."""
    said, seen = F.col("rain_mm_h") >= threshold, F.col("observed") >= threshold
    return pairs.groupBy(*(by or []), "member").agg(
        F.count_if(said & seen).alias("hits"),
        F.count_if(~said & seen).alias("misses"),
        F.count_if(said & ~seen).alias("false_alarms"),
        F.count_if(~said & ~seen).alias("correct_negatives"),
    )


COUNTS = ("hits", "misses", "false_alarms", "correct_negatives")


def pool_tables(tables: DataFrame) -> DataFrame:
    """Counts summed per member. Tables of different thresholds are refused: the job fails."""
    one = F.count_distinct("threshold") == 1
    checked = F.assert_true(one, F.lit("tables of different thresholds do not pool"))
    total = tables.agg(F.when(one, F.lit(True)).otherwise(checked.isNull()).alias("ok"))
    pooled = tables.groupBy("member", "threshold").agg(*[F.sum(c).alias(c) for c in COUNTS])
    return pooled.crossJoin(F.broadcast(total)).where("ok").drop("ok")


def member_skill(tables: DataFrame) -> DataFrame:
    hits, misses, false = F.col("hits"), F.col("misses"), F.col("false_alarms")
    return tables.select(
        "*",
        F.try_divide(hits, hits + misses + false).alias("csi"),
        F.try_divide(hits, hits + misses).alias("pod"),
        F.try_divide(false, hits + false).alias("far"),
    )


def skill(tables: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Means over members whose score is defined; null if none is. events_observed sums over members."""
    scored = member_skill(tables)
    return scored.groupBy(*(by or [])).agg(
        F.avg("csi").alias("csi"),
        F.avg("pod").alias("pod"),
        F.avg("far").alias("far"),
        F.sum(F.col("hits") + F.col("misses")).alias("events_observed"),
    )


def ensemble_mae(pairs: DataFrame, keys: list[str] = CELL) -> DataFrame:
    cells = pairs.groupBy(*keys).agg(F.abs(F.avg("rain_mm_h") - F.first("observed")).alias("e"))
    return cells.agg(F.avg("e").alias("mae"))


def crps_cells(pairs: DataFrame, keys: list[str] = CELL) -> DataFrame:
    """CRPS per cell, all n squared pairs of members counted through their sorted ranks."""
    cells = pairs.groupBy(*keys).agg(
        F.sort_array(F.collect_list("rain_mm_h")).alias("x"), F.first("observed").alias("y")
    )
    return cells.select(*keys, _crps(F.col("x"), F.col("y")).alias("crps"))


def _crps(x: Column, y: Column) -> Column:
    """Of sorted members x: mean distance from y, less half the members' mean distance from each other."""
    n = F.size(x).cast("double")
    gap = F.aggregate(x, F.lit(0.0), lambda s, v: s + F.abs(v - y)) / n
    ranked = F.transform(x, lambda v, i: (2 * i + 1 - F.size(x)) * v)
    return gap - F.aggregate(ranked, F.lit(0.0), lambda s, v: s + v) / (n * n)


def crps(pairs: DataFrame, keys: list[str] = CELL) -> DataFrame:
    return crps_cells(pairs, keys).agg(F.avg("crps").alias("crps"))


METRICS = tuple(HIGHER_IS_BETTER)


def score(pairs: DataFrame, threshold: float, band: str, metrics: tuple[str, ...] = METRICS) -> DataFrame:
    """One row (name, value) a metric: counts pooled first, ratios last. Undefined metrics have a null value.

    metrics: which of csi, pod, far, crps and mae; events_observed goes with the
    first three, and windows with all. One aggregation of the pairs by cell serves them all.
    """
    unknown = [m for m in metrics if m not in METRICS]
    if unknown or not metrics:
        raise ValueError(f"metrics are some of {METRICS}, not {unknown or 'none'}")
    if not threshold > 0:
        raise ValueError("the threshold is positive")
    cells = pairs.groupBy(*CELL).agg(
        F.sort_array(F.collect_list(F.struct(F.col("rain_mm_h").alias("v"), "member"))).alias("m"), F.first("observed").alias("y")
    )
    x = F.transform("m", lambda r: r["v"])
    facts = [F.col("window_id")]
    if "mae" in metrics:
        facts.append(F.abs(F.aggregate(x, F.lit(0.0), lambda s, v: s + v) / F.size("m") - F.col("y")).alias("mae"))
    if "crps" in metrics:
        facts.append(_crps(x, F.col("y")).alias("crps"))
    counted = [m for m in ("csi", "pod", "far") if m in metrics]
    if counted:
        say = F.transform("m", lambda r: F.struct(r["member"].alias("member"), r["v"].alias("rain_mm_h"), F.col("y").alias("observed")))
        facts.append(say.alias("said"))
    per_cell = cells.select(*facts)
    plain = [F.avg(m).alias(m) for m in ("mae", "crps") if m in metrics]
    wide = per_cell.agg(*plain, F.count_distinct("window_id").cast("double").alias("windows"))
    if counted:
        members = per_cell.select(F.explode("said").alias("s")).select("s.*")
        skills = skill(contingency(members, threshold)).select(
            *[F.col(m).alias(f"{m}_{band}") for m in counted], F.coalesce("events_observed", F.lit(0)).cast("double").alias("events_observed")
        )
        wide = skills.join(wide)  # one row each
    return wide.unpivot([], wide.columns, "name", "value")


def undefined_metrics(report: DataFrame) -> DataFrame:
    return report.where("value is null").agg(F.sort_array(F.collect_list("name")).alias("undefined"))


def soft_exceedance(cells: DataFrame, threshold: float, temperature: float, by: list[str] | None = None) -> DataFrame:
    """Mean logistic of the excess over valid cells. Without any the job fails."""
    logistic = 1 / (1 + F.exp(-(F.col("rain_mm_h") - threshold) / temperature))
    out = cells.where("rain_mm_h is not null").groupBy(*(by or [])).agg(F.avg(logistic).alias("soft"))
    if by:
        return out
    return out.select(F.coalesce("soft", F.raise_error(F.lit("no valid cell in the region")).cast("double")).alias("soft"))


def grid_cell_score(pairs: DataFrame, ceiling: float = 24.0, keys: list[str] = CELL) -> DataFrame:
    """Absolute error of the ensemble mean, weighted by the observation clipped to [0, ceiling]."""
    cells = pairs.groupBy(*keys).agg(F.avg("rain_mm_h").alias("m"), F.first("observed").alias("y"))
    weight = F.greatest(F.lit(0.0), F.least(F.lit(ceiling), F.col("y")))
    return cells.agg(F.avg(F.abs(F.col("m") - F.col("y")) * weight).alias("score"))


def reported_leads(df: DataFrame, hours: list[int], minutes: int = 30, lead: str = "lead") -> DataFrame:
    """Rows of zero-based leads that end on one of the reported hours."""
    ahead = (F.col(lead) + 1) * minutes
    return df.where((ahead % 60 == 0) & (ahead / 60).cast("int").isin(*hours))


def gate_join(candidate: DataFrame, incumbent: DataFrame) -> DataFrame:
    """(name, candidate, incumbent) of two (name, value) tables."""
    c = candidate.select("name", F.col("value").alias("candidate"))
    return c.join(incumbent.select("name", F.col("value").alias("incumbent")), "name", "full")


def promotion_gate(
    joined: DataFrame,
    *,
    monitor: str = "csi_heavy",
    guarded: tuple[str, ...] = ("far_heavy", "crps"),
    min_delta: float = 0.005,
    max_regression: float = 0.02,
    min_events: int = 50,
    by: list[str] | None = None,
) -> DataFrame:
    """promote, delta and all reasons as codes, from rows (name, candidate, incumbent).

    An incumbent without any value is absent: the first model with enough
    events is promoted. NaN counts as undefined.
    """

    def value(side: str, name: str) -> Column:
        v = F.nanvl(F.col(side), F.lit(None).cast("double"))
        return F.max(F.when(F.col("name") == name, v))

    names = [monitor, *[g for g in guarded if g != monitor]]
    row = joined.groupBy(*(by or [])).agg(
        *[value(s, n).alias(f"{s}_{i}") for i, n in enumerate(names) for s in ("candidate", "incumbent")],
        F.coalesce(value("candidate", "events_observed"), F.lit(0.0)).alias("events"),
        F.count("incumbent").alias("held"),
    )

    def better(i: int) -> Column:
        gain = F.col(f"candidate_{i}") - F.col(f"incumbent_{i}")
        return gain if higher_is_better(names[i]) else -gain

    undefined = F.col("candidate_0").isNull()
    few = F.col("events") < min_events
    known = F.col("incumbent_0").isNotNull()
    compared = ~undefined & known
    faults = [
        F.when(undefined, F.lit("undefined_monitor")),
        F.when(~undefined & few, F.lit("event_floor")),
        F.when(compared & (F.round(better(0), 9) < min_delta), F.lit("short_of_delta")),
        *[
            F.when(compared & (F.round(-better(i), 9) > max_regression), F.lit(f"regressed:{names[i]}"))
            for i in range(1, len(names))
        ],
    ]
    said = row.withColumn("faults", F.array_compact(F.array(*faults)))
    clear = F.size("faults") == 0
    notes = [
        F.when(~undefined & ~known & (F.col("held") == 0) & clear, F.lit("first_model")),
        F.when(~undefined & ~known & (F.col("held") > 0), F.lit("unknown_incumbent")),
        F.when(compared & clear, F.lit("improved")),
    ]
    return said.select(
        *(by or []),
        clear.alias("promote"),
        F.when(compared, better(0)).alias("delta"),
        F.concat("faults", F.array_compact(F.array(*notes))).alias("reasons"),
    )


def best_run(runs: DataFrame, metric: str, *, by: list[str], order: str = "step", value: str = "value", keep: int = 3) -> DataFrame:
    """Whether each run of a model (`by`) beats all before it (NaN and null never do), and whether it is among the last `keep`."""
    v = F.nanvl(F.col(value), F.lit(None).cast("double"))
    before = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    up = higher_is_better(metric)
    best = F.max(v).over(before) if up else F.min(v).over(before)
    beats = v.isNotNull() & (best.isNull() | (v > best if up else v < best))
    late = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(order))) <= keep
    return runs.withColumns({"is_best": F.coalesce(beats, F.lit(False)), "kept": late})
