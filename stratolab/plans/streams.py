"""Registered queries: streams run over the given tables with availableNow, written to a table and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.dashboard import limits_table
from ..sources.windows import shared_path
from ..streaming import online
from .fixtures import view
from .products import FOLD, IDS, SEASON_CAPACITY, SEASON_POLICY, TELE, season_rows
from .registry import Registry
from .verification import rounded

R = Registry()
MAPPED = "CASE event_type WHEN 'view' THEN 'insat' WHEN 'click' THEN 'imdaa' WHEN 'purchase' THEN 'imd_surface' ELSE 'hem' END"


def arriving(s, df: DataFrame) -> DataFrame:
    """df as a file stream, a few files a batch."""
    path = shared_path(s, "stream-in")
    df.write.parquet(path)
    return s.readStream.schema(df.schema).option("maxFilesPerTrigger", 2).parquet(path)


def finished(s, out: DataFrame, mode: str = "append") -> DataFrame:
    """The stream's whole output. Update streams keep the last row that a key had."""
    path, check = shared_path(s, "stream-out"), shared_path(s, "stream-check")
    if mode == "append":
        writer = out.writeStream.format("parquet").option("path", path)
    else:

        def keep(batch: DataFrame, n: int) -> None:
            batch.withColumn("batch", F.lit(n)).write.mode("append").parquet(path)

        writer = out.writeStream.foreachBatch(keep).outputMode(mode)
    query = writer.option("checkpointLocation", check).trigger(availableNow=True).start()
    query.awaitTermination()
    return s.read.parquet(path)


def events(s, d):
    return view(s, d, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.expr(MAPPED).alias("stream"), "value", "user_id")


@R.add(f"""WITH a AS (SELECT {MAPPED} AS stream, value, CAST(floor((CAST(floor(epoch(ts)) AS bigint) + 900) / 1800) AS bigint) * 1800 AS slot_s, CAST(floor(epoch(ts)) AS bigint) AS s FROM events)
  SELECT stream, slot_s, count(*) AS n, round(sum(value), 4) AS total FROM a WHERE abs(s - slot_s) <= 420 GROUP BY ALL""")
def r1_stream_slots(s, d):
    out = finished(s, online.stream_slots(arriving(s, events(s, d)), late="60 days"), "update")
    last = out.groupBy("slot", "stream").agg(F.max_by(F.struct("n", "total"), "batch").alias("x"))
    return rounded(last.select("stream", F.unix_seconds("slot").alias("slot_s"), "x.n", "x.total"), 4)


@R.add(f"""WITH a AS (SELECT {MAPPED} AS stream, value, epoch_ms(ts) AS ms, CAST(floor(epoch(ts)) AS bigint) AS s, CAST(floor((CAST(floor(epoch(ts)) AS bigint) + 900) / 1800) AS bigint) * 1800 AS slot_s,
    CAST(floor(epoch(ts)) AS bigint) + CASE WHEN event_id % 50 = 0 THEN 7200 WHEN event_id % 10 = 0 THEN 1800 ELSE 0 END AS arrival FROM events),
  n AS (SELECT *, least((arrival - min(arrival) OVER ()) * 3 // (max(arrival) OVER () - min(arrival) OVER ()), 2) AS run FROM a), t AS (SELECT * FROM n WHERE abs(s - slot_s) <= 420),
  w AS (SELECT run, max(ms) AS ms FROM t GROUP BY run), j AS (SELECT t.*, (slot_s + 1800) * 1000 <= coalesce((SELECT max(w.ms) - 1800000 FROM w WHERE w.run < t.run), 0) AS late FROM t)
  SELECT 'late' AS kind, stream, slot_s, 1 AS n, round(value, 4) AS total FROM j WHERE late UNION ALL
  SELECT 'closed', stream, slot_s, count(*), round(sum(value), 4) FROM j WHERE NOT late AND (slot_s + 1800) * 1000 <= (SELECT max(ms) - 1800000 FROM w) GROUP BY stream, slot_s""")
def r1_stream_late(s, d):
    """Every tenth event arrives one slot after its time and every fiftieth four; three runs take what has arrived by then."""
    delay = F.when(F.col("event_id") % 50 == 0, 7200).when(F.col("event_id") % 10 == 0, 1800).otherwise(0)
    e = events(s, d).withColumn("arrival", F.unix_seconds("ts") + delay)
    ends = e.agg(F.min("arrival").alias("a"), F.max("arrival").alias("z")).first()
    run = F.least(F.floor((F.col("arrival") - ends.a) * 3 / (ends.z - ends.a)), F.lit(2))
    source, out, check = (shared_path(s, f"stream-{x}") for x in ("in", "out", "check"))
    key = "spark.sql.streaming.stateStore.providerClass"
    before = s.conf.get(key)
    s.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for k in range(3):
            part = e.where(run == k).select("ts", "stream", "value")
            part.write.mode("append").parquet(source)
            found = online.slots_and_late(s.readStream.schema(part.schema).parquet(source))
            query = found.writeStream.format("parquet").option("path", out).option("checkpointLocation", check).trigger(availableNow=True).start()
            query.awaitTermination()
    finally:
        s.conf.set(key, before)
    return rounded(s.read.parquet(out).select("kind", "stream", "slot_s", "n", "total"), 4)


@R.add("""WITH e AS (SELECT CAST(floor(epoch(ts) / 1800) AS bigint) * 1800 - 1800 * k AS start_s, value FROM events, (SELECT unnest(range(13)) AS k))
  SELECT start_s, start_s + 23400 AS end_s, count(*) AS n, round(sum(value), 4) AS total FROM e GROUP BY ALL""")
def r2_stream_lookback(s, d):
    out = finished(s, online.stream_lookback(arriving(s, events(s, d)), late="60 days"), "update")
    last = out.groupBy("start", "end").agg(F.max_by(F.struct("n", "total"), "batch").alias("x"))
    return rounded(last.select(F.unix_seconds("start").alias("start_s"), F.unix_seconds("end").alias("end_s"), "x.n", "x.total"), 4)


@R.add(f"""WITH a AS (SELECT {MAPPED} AS satellite, CAST(floor(epoch(ts) / 1800) AS bigint) * 1800 AS slot_s, 'v' || lpad(CAST(event_id % 100 AS varchar), 2, '0') AS name FROM events)
  SELECT satellite, slot_s, max(name) AS path FROM a GROUP BY ALL""")
def r3_stream_latest(s, d):
    e = events(s, d)
    slot = F.timestamp_seconds(F.floor(F.unix_seconds("ts") / 1800) * 1800)
    name = F.concat(F.lit("v"), F.lpad((F.col("event_id") % 100).cast("string"), 2, "0"))
    out = finished(s, online.stream_latest(arriving(s, e.select(F.col("stream").alias("satellite"), slot.alias("slot"), name.alias("name"), name.alias("path"))), late="60 days"), "update")
    return out.groupBy("satellite", F.unix_seconds("slot").alias("slot_s")).agg(F.max("path").alias("path"))


@R.add(f"WITH {FOLD} SELECT season, t_s, score, code FROM w")
def r4_stream_reservoir(s, d):
    """The same rows, a season's in time order, give the batch fold's decisions."""
    rows = season_rows(s, d)
    key = "spark.sql.streaming.stateStore.providerClass"
    before = s.conf.get(key)
    s.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        return finished(s, online.stream_reservoir(arriving(s, rows.repartition("season").sortWithinPartitions("season", "t_s")), SEASON_POLICY, SEASON_CAPACITY))
    finally:
        s.conf.set(key, before)


@R.add("""WITH e AS (SELECT user_id AS season, CAST(floor(epoch(ts)) AS bigint) AS s, value FROM events),
  g AS (SELECT *, sum(CASE WHEN gap <= 10800 THEN 0 ELSE 1 END) OVER (PARTITION BY season ORDER BY s) AS storm FROM (SELECT *, s - lag(s) OVER (PARTITION BY season ORDER BY s) AS gap FROM e))
  SELECT season, min(s) AS start_s, max(s) + 10800 AS end_s, count(*) AS members, round(max(value), 4) AS score FROM g GROUP BY season, storm""")
def r6_storm_sessions(s, d):
    e = events(s, d)
    whole = F.timestamp_seconds(F.unix_seconds("ts"))
    out = finished(s, online.storm_sessions(arriving(s, e.select(whole.alias("ts"), F.col("user_id").alias("season"), F.col("value").alias("score"))), late="60 days"), "complete")
    last = out.where(F.col("batch") == out.agg(F.max("batch")).first()[0])
    return rounded(last.select("season", F.unix_seconds("start").alias("start_s"), F.unix_seconds("end").alias("end_s"), "members", "score"), 4)


@R.add("""SELECT e.window_id, e.lead, e.cell, e.member, e.rain_mm_h, t.rain_mm_h AS observed FROM fx_ensemble e JOIN fx_target t USING (window_id, lead, cell)""")
def r7_stream_verify(s, d):
    base = F.timestamp_seconds(F.col("window_id") * 5184000 + 1496275200)
    fc = view(s, d, "fx_ensemble").withColumn("valid_time", base)
    due = F.timestamp_seconds(F.col("window_id") * 5184000 + 1496275200 + (F.col("lead") + 1) * 1800)
    ob = view(s, d, "fx_target").select(due.alias("obs_time"), "cell", F.col("rain_mm_h").alias("observed"))
    out = finished(s, online.stream_verify(arriving(s, fc.select("valid_time", "lead", "cell", "member", "rain_mm_h")), arriving(s, ob), late="10000 days"))
    w = ((F.unix_seconds("valid_time") - 1496275200) / 5184000).cast("long").alias("window_id")
    return out.select(w, "lead", "cell", "member", "rain_mm_h", "observed")


@R.add(f"""WITH {TELE}, r AS (SELECT event_id, region_id, 'flash-flood-critical' AS rule_id, iwv > li AND ctt_drop_30m > lc AS is_met FROM j UNION ALL
  SELECT event_id, region_id, 'cloudburst-warning', rainfall_rate > lr FROM j UNION ALL SELECT event_id, region_id, 'high-wind-watch', wind_gust > lw FROM j)
  SELECT event_id, region_id, rule_id, 'Triggered' AS status_text FROM r WHERE is_met""")
def r8_stream_alerts(s, d):
    ids = F.array(*map(F.lit, IDS))
    t = view(s, d, "fx_telemetry").withColumn("region_id", F.element_at(ids, (F.col("region_no") + 1).cast("int")))
    return finished(s, online.stream_alerts(arriving(s, t), limits_table(s))).select("event_id", "region_id", "rule_id", "status_text")


@R.add("SELECT DISTINCT CAST(floor(epoch(ts) / 1800) AS bigint) * 1800 AS valid_time FROM events")
def r9_incremental_windows(s, d):
    times = view(s, d, "events").select((F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 1800) * 1800).cast("long").alias("valid_time"))
    root, check = shared_path(s, "windows"), shared_path(s, "stream-check")
    query = online.incremental_windows(arriving(s, times.repartition(4)), root, check).trigger(availableNow=True).start()
    query.awaitTermination()
    return online.committed(s, root, "valid_time long").select("valid_time")
