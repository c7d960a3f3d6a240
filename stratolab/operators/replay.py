"""The reservoir of extreme events: gate, score, threshold, decorrelation, sampling."""

from __future__ import annotations

import math
from bisect import bisect_left, insort
from collections.abc import Iterable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import is_observed
from ..schema import REPLAY_DISQUALIFYING
from . import selection


@dataclass(frozen=True)
class Policy:
    """Fixed values of the admission policy."""

    gate_frames: int = 4
    min_valid: float = 0.85
    min_target_valid: float = 0.85
    min_precip: float = 0.85
    heavy_mm_h: float = 15.0
    quantile: float = 0.90
    floor: float = 0.001
    history: int = 4096
    min_history: int = 256
    separation_minutes: int = 180

    def check(self) -> None:
        shares = (self.min_valid, self.min_target_valid, self.min_precip, self.quantile, self.floor)
        if not all(0 <= x <= 1 for x in shares):
            raise ValueError("shares lie between 0 and 1")
        if self.gate_frames < 1 or self.separation_minutes < 0 or not 1 <= self.min_history <= self.history:
            raise ValueError("frames, separation or history are out of range")


POLICY = Policy()


def replay_gate(windows: DataFrame, policy: Policy = POLICY) -> DataFrame:
    """windows with `code`: the first reason against admission, else null.

    windows: accepted, streams (required ones, map<string,array<int>> of flags
    by frame, oldest first), n_frames, validity, precip_coverage, target_validity.
    """
    last = lambda a: F.slice(a, F.greatest(F.lit(1), F.size(a) - policy.gate_frames + 1), policy.gate_frames)
    required = F.array(F.lit("insat"), F.lit("imd_surface"))
    held = F.transform(required, lambda s: F.try_element_at("flags", s))
    absent = F.exists(held, lambda a: a.isNull())
    short = F.exists(held, lambda a: F.size(a) < F.col("n_frames"))
    gate = F.flatten(F.transform(held, last))
    code = (
        F.when(~F.col("accepted"), "rejected_window_not_accepted")
        .when(absent, "rejected_stream_absent")
        .when(short, "rejected_flags_truncated")
        .when(F.exists(gate, lambda f: ~is_observed(f)), "rejected_not_observed")
        .when(F.exists(gate, lambda f: f.bitwiseAND(REPLAY_DISQUALIFYING) != 0), "rejected_disqualifying_flag")
        .when(F.col("validity").isNull(), "rejected_no_validity")
        .when(F.col("validity") < policy.min_valid, "rejected_low_validity")
        .when(F.col("precip_coverage").isNull(), "rejected_precip_coverage_unknown")
        .when(F.col("precip_coverage") < policy.min_precip, "rejected_low_precip_coverage")
        .when(F.col("target_validity") < policy.min_target_valid, "rejected_low_target_validity")
    )
    return windows.withColumn("code", code)


def storm_score(target: DataFrame, threshold: float = POLICY.heavy_mm_h, keys: list[str] | None = None) -> DataFrame:
    """Per window: largest share of valid cells at or above the threshold at one lead, that lead, p99.9 and maximum.

    Without any such cell the peak lead is -1; without valid cells all is 0.
    """
    keys = keys or ["window_id"]
    v = F.col("rain_mm_h")
    leads = target.groupBy(*keys, "lead").agg(F.count(v).alias("n"), F.count_if(v >= threshold).alias("k"))
    area = F.coalesce(F.try_divide(F.col("k"), F.col("n")), F.lit(0.0))
    peaks = leads.withColumn("area", area).groupBy(*keys).agg(
        F.max("area").alias("score"), F.max_by("lead", F.struct(F.round("area", 12), -F.col("lead"))).alias("at")
    )
    most = target.groupBy(*keys).agg(F.coalesce(F.max(v), F.lit(0.0)).alias("max_mm_h"))
    high = selection.quantiles(target, keys, "rain_mm_h", 0.999)
    out = peaks.join(most, keys).join(high.select(*keys, F.col("quantile").alias("q")), keys, "left").withColumn("p999", F.coalesce("q", F.lit(0.0)))
    return out.select(
        *keys,
        F.round("score", 6).alias("score"),
        F.when(F.col("score") > 0, F.col("at")).otherwise(F.lit(-1)).alias("peak_lead"),
        F.round("p999", 3).alias("p999"),
        F.round("max_mm_h", 3).alias("max_mm_h"),
    )


def score_history(scores: DataFrame, policy: Policy = POLICY, place: str = "place") -> DataFrame:
    """The scores that the threshold goes by: an even sample of policy.history of all that were seen, which the fold keeps as well.

    Those of smallest `place`, a draw of its own a row, so that partial samples merge and order doesn't matter.
    """
    return scores.where("score is not null").orderBy(place).limit(policy.history)


def admission_threshold(history: DataFrame, policy: Policy = POLICY, score: str = "score") -> DataFrame:
    """(threshold, rule): the floor until there are min_history scores, then their exact quantile, linear between ranks."""
    found = selection.quantiles(history, [], score, policy.quantile)
    one = history.sparkSession.range(1).select(F.lit(0).cast("long").alias("n"), F.lit(None).cast("double").alias("quantile"))
    out = found.unionByName(one).agg(F.max("n").alias("n"), F.max("quantile").alias("q"))
    cold = F.col("n") < policy.min_history
    return out.select(
        F.when(cold, F.lit(policy.floor)).otherwise(F.col("q")).alias("threshold"),
        F.when(cold, "cold_start_floor").otherwise("streaming_quantile").alias("rule"),
    )


def unit_hash(seed: int, *keys) -> Column:
    """A number in (0, 1) from a hash, so that batch, stream and SQL draw alike: 52 bits of an MD5 of "<seed>:<key>:..."."""
    text = F.concat_ws(":", F.lit(str(seed)), *[(F.col(k) if isinstance(k, str) else k).cast("string") for k in keys])
    return (F.conv(F.substring(F.md5(F.encode(text, "UTF-8")), 1, 13), 16, 10).cast("double") + 0.5) / float(2**52)


def reservoir_key(score, draw) -> Column:
    """log(u) / score: the largest keys are a sample weighted by score. Null, the least, where the score is 0 or null."""
    return F.try_divide(F.log(draw), score)


def weighted_reservoir(rows: DataFrame, n: int, key: str = "reservoir_key", tie: str = "valid_time") -> DataFrame:
    """The n rows of largest key; n is the reservoir's capacity. Per-partition top-k, then a merge."""
    return rows.orderBy(F.desc(key), tie).limit(n)


def session_strongest(scores: DataFrame, minutes: int = POLICY.separation_minutes, time: str = "t_s", *, by: list[str]) -> DataFrame:
    """One row a storm: within `by`, such as a season, times with gaps under the separation belong together.

    The strongest, then earliest, stays.
    """
    order = Window.partitionBy(*by).orderBy(time)
    gap = F.col(time) - F.lag(time).over(order)
    storm = F.sum(F.when(gap < minutes * 60, 0).otherwise(1)).over(order)
    best = F.max_by(F.struct(time, "score"), F.struct("score", -F.col(time)))
    return scores.withColumn("storm", storm).groupBy(*by, "storm").agg(best.alias("b"), F.count("*").alias("members")).select(
        *by, "storm", F.col(f"b.{time}").alias(time), F.col("b.score").alias("score"), "members"
    )


class History:
    """The scores of smallest place, at most `size`, and their quantile from an index in order of score."""

    def __init__(self, size: int, rows: Iterable[tuple[float, float]] = ()):
        self.size, self.rows = size, sorted(rows)  # place, score
        self.scores = sorted(s for _, s in self.rows)

    def add(self, place: float, score: float) -> tuple[float, float] | None:
        """The row that falls out, which may be the new one."""
        insort(self.rows, (place, score))
        insort(self.scores, score)
        if len(self.rows) <= self.size:
            return None
        gone = self.rows.pop()
        del self.scores[bisect_left(self.scores, gone[1])]
        return gone

    def threshold(self, policy: Policy) -> float:
        if len(self.scores) < policy.min_history:
            return policy.floor
        at = (len(self.scores) - 1) * policy.quantile
        low = math.floor(at)
        high = min(low + 1, len(self.scores) - 1)
        return self.scores[low] + (self.scores[high] - self.scores[low]) * (at - low)


class Records:
    """Scored windows that passed the threshold: neighbours, capacity. capacity None: without bound."""

    def __init__(self, policy: Policy, capacity: int | None, rows: Iterable[tuple[int, float, float]] = ()):
        self.apart, self.capacity = policy.separation_minutes * 60, capacity
        self.rows = {t: (s, k) for t, s, k in rows}  # time: score, key

    def offer(self, t_s: int, score: float, draw: float) -> tuple[str, list[int]]:
        """The decision's code and the times of records that go; rows come in time order."""
        close = [t for t in self.rows if abs(t - t_s) < self.apart]
        if close and score <= max(self.rows[t][0] for t in close):
            return "rejected_temporal_duplicate", []
        for t in close:
            del self.rows[t]
        key = math.log(draw) / score
        if self.capacity is None or len(self.rows) < self.capacity:
            self.rows[t_s] = (score, key)
            return "admitted", close
        weakest = min(self.rows, key=lambda t: (self.rows[t][1], t))
        if key <= self.rows[weakest][1]:
            return "rejected_reservoir_key", close
        del self.rows[weakest]
        self.rows[t_s] = (score, key)
        return "admitted_evicting", [*close, weakest]


class Reservoir:
    """The ordered fold over scored windows: history, threshold, neighbours, capacity.

    Draws and places are given with each row, from hashes of a seed and the time, so a rerun and a
    stream decide alike. What is said to go and to come is all that a stored state has to write.
    """

    def __init__(self, policy: Policy, capacity: int, history: Iterable[tuple[float, float]] = (), records: Iterable[tuple[int, float, float]] = ()):
        self.policy = policy
        self.history = History(policy.history, history)
        self.records = Records(policy, capacity, records)

    def offer(self, t_s: int, score: float, draw: float, place: float) -> tuple[str, tuple[float, float] | None, list[int]]:
        """The decision's code, the history row and the records' times that go; rows come in time order."""
        gone = self.history.add(place, score)
        if score <= 0:
            return "rejected_zero_score", gone, []
        if score < self.history.threshold(self.policy):
            return "rejected_below_threshold", gone, []
        code, left = self.records.offer(t_s, score, draw)
        return code, gone, left


def thresholds(scores: DataFrame, policy: Policy = POLICY, season: str = "season") -> DataFrame:
    """scores (season, t_s, score, draw, place) with the threshold each meets, itself included in the history.

    A season holds one small row a window, a number fixed by the calendar; only time, score and place go through its task.
    """

    def run(frames: pd.DataFrame) -> pd.DataFrame:
        rows, past, met = frames.sort_values("t_s", kind="stable"), History(policy.history), []
        for p, s in zip(rows["place"], rows["score"], strict=True):
            past.add(p, s)
            met.append(past.threshold(policy))
        return rows.assign(threshold=met)[[season, "t_s", "score", "draw", "threshold"]]

    kind = scores.schema[season].dataType.simpleString()
    return scores.select(season, "t_s", "score", "draw", "place").groupBy(season).applyInPandas(run, f"{season} {kind}, t_s long, score double, draw double, threshold double")


def decorrelate(scores: DataFrame, policy: Policy = POLICY, capacity: int = 512, season: str = "season") -> DataFrame:
    """scores (season, t_s, score, draw, place), one a season and t_s, with their decisions: those of the ordered fold of a season.

    Only what passes its threshold is folded. Windows that lie the separation or more apart do not touch each other, so a season
    is cut there and its pieces are folded side by side, as if there were no capacity. If at no time more than `capacity` windows
    are held then, that is the fold's result; the windows that passed in seasons where they are more are folded in order.
    """
    kind = scores.schema[season].dataType.simpleString()
    schema = f"{season} {kind}, t_s long, score double, code string, held boolean, more int"

    def fold(limit: int | None):
        def run(frames: pd.DataFrame) -> pd.DataFrame:
            rows, box, codes, more = frames.sort_values("t_s", kind="stable"), Records(policy, limit), [], []
            for t, s, u in zip(rows["t_s"], rows["score"], rows["draw"], strict=True):
                code, gone = box.offer(t, s, u)
                codes.append(code)
                more.append(code.startswith("admitted") - len(gone))
            held = [t in box.rows for t in rows["t_s"]]
            return rows.assign(code=codes, held=held, more=more)[[season, "t_s", "score", "code", "held", "more"]]

        return run

    met = thresholds(scores, policy, season)
    early = F.when(F.col("score") <= 0, "rejected_zero_score").when(F.col("score") < F.col("threshold"), "rejected_below_threshold")
    judged = met.withColumn("code", early)
    order = Window.partitionBy(season).orderBy("t_s")
    apart = F.col("t_s") - F.lag("t_s").over(order) >= policy.separation_minutes * 60
    piece = F.sum(F.coalesce(apart.cast("int"), F.lit(0))).over(order)
    passed = judged.where("code is null").select(season, "t_s", "score", "draw", piece.alias("piece"))
    alone = passed.groupBy(season, "piece").applyInPandas(fold(None), schema)
    counted = alone.withColumn("held_then", F.sum("more").over(order))
    crowded = counted.groupBy(season).agg((F.max("held_then") > capacity).alias("crowded"))
    full = passed.join(crowded.where("crowded").select(season), season, "left_semi").groupBy(season).applyInPandas(fold(capacity), schema)
    free = alone.join(crowded.where("not crowded").select(season), season, "left_semi")
    columns = [season, "t_s", "score", "code", "held"]
    rest = judged.where("code is not null").select(season, "t_s", "score", "code", F.lit(False).alias("held"))
    return rest.unionByName(free.select(columns)).unionByName(full.select(columns))


def reservoir_stats(decisions: DataFrame) -> DataFrame:
    return decisions.groupBy("code").agg(F.count("*").alias("n"), F.min("score").alias("least"), F.max("score").alias("most"))


def sample_reservoir(reservoir: DataFrame, n: int, seed: int, key: str = "t_s") -> DataFrame:
    """n rows drawn evenly without replacement; the draw depends on seed and key alone."""
    return reservoir.orderBy(unit_hash(seed, key), key).limit(n)
