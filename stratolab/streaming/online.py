"""Structured Streaming forms of slot admission, verification, rules and the reservoir."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.dashboard import evaluate_rules, rule_join
from ..operators.replay import POLICY, Policy, Reservoir
from ..schema import SLOT_MINUTES, TOLERANCE_S

SLOT_S = SLOT_MINUTES * 60


def slot_time(ts) -> F.Column:
    return F.timestamp_seconds(F.floor((F.unix_seconds(ts) + SLOT_S // 2) / SLOT_S) * SLOT_S)


def stream_slots(sdf: DataFrame, *, time: str = "ts", stream: str = "stream", value: str = "value", late: str = "30 minutes") -> DataFrame:
    """Counts and sums per (slot, stream) of observations within tolerance of a slot.

    The tolerance is about position; lateness is bounded by the watermark alone.
    """
    slotted = sdf.withColumn("slot", slot_time(F.col(time)))
    offset = F.abs(F.unix_seconds(time) - F.unix_seconds("slot"))
    admitted = slotted.where(offset <= TOLERANCE_S).withWatermark("slot", late)
    window = F.window("slot", f"{SLOT_MINUTES} minutes")
    return admitted.groupBy(window, stream).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(
        F.col("window.start").alias("slot"), stream, "n", "total"
    )


class _Closing(StatefulProcessor):
    """One row a key until its slot closes: event-time timers give it out and drop it. What comes later leaves as it is.

    `fold` joins the rows of a batch to the state, None at first.
    """

    def __init__(self, state: str, fold: Callable[[tuple | None, pd.DataFrame], tuple], close_s: int):
        self.state, self.fold, self.close_s = state, fold, close_s

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.open = handle, handle.getValueState("open", self.state)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        ends = (int(key[1]) + self.close_s) * 1000
        late = ends <= timerValues.getCurrentWatermarkInMs()
        for batch in rows:
            if late:
                yield batch.assign(kind="late")
            else:
                self.open.update(self.fold(self.open.get() if self.open.exists() else None, batch))
        if not late:
            self.handle.registerTimer(ends)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        if self.open.exists():
            names = [c.split()[0] for c in self.state.split(", ")]
            found = {c: [v] for c, v in zip(names, self.open.get(), strict=True)}
            self.open.clear()
            yield pd.DataFrame({"key": [key[0]], "slot_s": [int(key[1])], "kind": ["closed"], **found})

    def close(self) -> None:
        pass


def _closing(sdf: DataFrame, time: str, late: str, state: str, fold: Callable) -> DataFrame:
    """(kind, key, slot_s, state columns) of sdf (time, key, slot_s, the state's columns): closed slots, and rows later than `late`."""
    names = [c.split()[0] for c in state.split(", ")]
    # The watermark is of the time column, which does not go on: so Spark drops no late row before it is seen here.
    marked = sdf.withWatermark(time, late).select("key", "slot_s", *names)
    return marked.groupBy("key", "slot_s").transformWithStateInPandas(
        statefulProcessor=_Closing(state, fold, SLOT_S),
        outputStructType=f"kind string, key string, slot_s long, {state}",
        outputMode="append",
        timeMode="eventTime",
    )


def slots_and_late(sdf: DataFrame, *, time: str = "ts", stream: str = "stream", value: str = "value", late: str = "30 minutes") -> DataFrame:
    """Two outputs in one, told apart by `kind`: "closed", one (stream, slot_s, n, total) a slot, and "late", a row an observation.

    Observations out of tolerance of their slot are left out. A slot closes, once, when the watermark reaches its end; its state is
    dropped then, so what is kept is bounded by the slots open at a time. A late row has n 1 and its value as total. Needs RocksDB.
    """

    def fold(held: tuple | None, rows: pd.DataFrame) -> tuple:
        n, total = held or (0, 0.0)
        return int(n) + int(rows["n"].sum()), float(total) + float(rows["total"].sum())

    slot = F.unix_seconds(slot_time(F.col(time)))
    near = sdf.withColumn("slot_s", slot).where(F.abs(F.unix_seconds(time) - F.col("slot_s")) <= TOLERANCE_S)
    named = near.select(time, F.col(stream).alias("key"), "slot_s", F.lit(1).cast("long").alias("n"), F.coalesce(F.col(value).cast("double"), F.lit(0.0)).alias("total"))
    return _closing(named, time, late, "n long, total double", fold).withColumnRenamed("key", stream)


def latest_and_late(sdf: DataFrame, *, late: str = "30 minutes") -> DataFrame:
    """Like slots_and_late, of granules (satellite, slot, name, path): closed slots have their newest name and its path, late ones their own."""

    def fold(held: tuple | None, rows: pd.DataFrame) -> tuple:
        best = rows.sort_values(["name", "path"]).iloc[-1]
        new = (str(best["name"]), str(best["path"]))
        return new if held is None else max(new, (str(held[0]), str(held[1])))

    named = sdf.select("slot", F.col("satellite").alias("key"), F.unix_seconds("slot").alias("slot_s"), "name", "path")
    return _closing(named, "slot", late, "name string, path string", fold).withColumnRenamed("key", "satellite")


def stream_lookback(sdf: DataFrame, *, time: str = "ts", value: str = "value", late: str = "30 minutes") -> DataFrame:
    """Counts and sums over the six and a half hours that end with each slot."""
    window = F.window(time, "390 minutes", "30 minutes")
    return sdf.withWatermark(time, late).groupBy(window).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(
        F.col("window.start").alias("start"), F.col("window.end").alias("end"), "n", "total"
    )


def stream_latest(sdf: DataFrame, *, late: str = "30 minutes") -> DataFrame:
    """The newest version of each (satellite, slot) granule; exact repeats are dropped within the watermark."""
    once = sdf.withWatermark("slot", late).dropDuplicatesWithinWatermark(["satellite", "slot", "name"])
    return once.groupBy("satellite", "slot").agg(F.max_by("path", "name").alias("path"))


def storm_sessions(sdf: DataFrame, *, time: str = "ts", by: str = "season", gap: str = "180 minutes", late: str = "30 minutes") -> DataFrame:
    """Storms as sessions: members, extent and strongest score."""
    session = F.session_window(time, gap)
    return sdf.withWatermark(time, late).groupBy(session, by).agg(F.count("*").alias("members"), F.max("score").alias("score")).select(
        F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), by, "members", "score"
    )


def stream_verify(forecasts: DataFrame, observations: DataFrame, *, late: str = "1 hour") -> DataFrame:
    """Forecast rows (valid_time, lead, cell, member, rain_mm_h) meeting observations (obs_time, cell, observed)."""
    due = F.col("valid_time") + F.make_dt_interval(mins=(F.col("lead") + 1) * SLOT_MINUTES)
    f = forecasts.withColumn("due", due).withWatermark("due", late).alias("f")
    o = observations.withWatermark("obs_time", late).alias("o")
    same = (F.col("f.cell") == F.col("o.cell")) & (F.col("f.due") == F.col("o.obs_time"))
    return f.join(o, same).select("f.valid_time", "f.lead", "f.cell", "f.member", "f.rain_mm_h", "o.observed")


def stream_alerts(sdf: DataFrame, limits: DataFrame) -> DataFrame:
    """Rules that telemetry triggers: a stream-static join, no state."""
    return evaluate_rules(rule_join(sdf, limits)).where("is_met")


class _Keeper(StatefulProcessor):
    """A season's reservoir as two maps: history by place, records by time. A batch writes the entries that change."""

    def __init__(self, policy: Policy, capacity: int):
        self.policy, self.capacity = policy, capacity

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.history = handle.getMapState("history", "place double", "score double")
        self.records = handle.getMapState("records", "t_s long", "score double, key double")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows)).sort_values("t_s", kind="stable")
        history, records = ({k[0]: tuple(v) for k, v in m.iterator()} for m in (self.history, self.records))
        box = Reservoir(self.policy, self.capacity, [(p, s) for p, (s,) in history.items()], [(t, *v) for t, v in records.items()])
        codes = [box.offer(int(t), float(s), float(u), float(p))[0] for t, s, u, p in zip(new["t_s"], new["score"], new["draw"], new["place"], strict=True)]
        self._write(self.history, history, {p: (s,) for p, s in box.history.rows})
        self._write(self.records, records, box.records.rows)
        yield pd.DataFrame({"season": key[0], "t_s": new["t_s"].to_numpy(), "score": new["score"].to_numpy(), "code": codes})

    @staticmethod
    def _write(state: Any, before: dict, after: dict) -> None:
        for k in before.keys() - after.keys():
            state.removeKey((k,))
        for k, v in after.items():
            if before.get(k) != v:
                state.updateValue((k,), v)

    def close(self) -> None:
        pass


def stream_reservoir(sdf: DataFrame, policy: Policy = POLICY, capacity: int = 512) -> DataFrame:
    """Decisions for scored windows (season, t_s, score, draw, place), each season's state kept between batches.

    Needs the RocksDB state store. Within a batch rows are folded in time order.
    """
    return sdf.groupBy("season").transformWithStateInPandas(
        statefulProcessor=_Keeper(policy, capacity),
        outputStructType="season int, t_s long, score double, code string",
        outputMode="append",
        timeMode="none",
    )


def commit(batch: DataFrame, root: str, batch_id: int) -> None:
    """Say that a batch is whole. Until then no reader takes its rows."""
    spark = batch.sparkSession
    spark.createDataFrame([(batch_id,)], "batch long").coalesce(1).write.mode("overwrite").parquet(f"{root}/commits/{batch_id:012d}")


def committed(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """The rows of whole batches, with `day` and `batch`. schema: that of the rows."""
    done = spark.read.schema("batch long").option("recursiveFileLookup", True).parquet(f"{root}/commits")
    rows = spark.read.schema(f"{schema}, batch long, day date").parquet(f"{root}/windows")
    return rows.join(done, "batch", "left_semi")


def incremental_windows(sdf: DataFrame, root: str, checkpoint: str):
    """Append windows whose valid_time (seconds) no whole batch holds yet; each is built once.

    A batch's rows go to a folder of its own, which a repetition of the batch replaces, and count once the batch is
    committed. So a batch that fails at any point and runs again neither doubles windows nor loses them. Rows lie by batch and
    day, so that a batch reads only the days that it has windows of.
    """
    spark = sdf.sparkSession
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in sdf.schema)
    for part, columns in (("commits", "batch long"), ("windows", f"{schema}, batch long, day date")):
        spark.createDataFrame([], columns).write.mode("ignore").parquet(f"{root}/{part}/start" if part == "commits" else f"{root}/{part}/batch=-1/day=1970-01-01")

    def append(batch: DataFrame, batch_id: int) -> None:
        new = batch.dropDuplicates(["valid_time"]).withColumn("day", F.to_date(F.timestamp_seconds("valid_time")))
        days = [r.day for r in new.select("day").distinct().collect()]  # of one batch
        known = committed(batch.sparkSession, root, schema).where(F.col("day").isin(days) & (F.col("batch") != batch_id))
        new = new.join(known.select("valid_time"), "valid_time", "left_anti")
        new.repartition("day").write.mode("overwrite").partitionBy("day").parquet(f"{root}/windows/batch={batch_id}")
        commit(batch, root, batch_id)

    return sdf.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint)
