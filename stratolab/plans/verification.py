"""Registered queries: verification, gate, district impacts, index."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import Grid
from ..operators import impact, index, verify
from .fixtures import view
from .registry import Registry

R = Registry()
SMALL = Grid(20.0, 20.25, 77.0, 77.25, 1 / 12, 4, 4)


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded alike in every query."""
    double = {f.name for f in df.schema if f.dataType.typeName() == "double"}
    return df.select(*[F.round(F.col(c), digits).alias(c) if c in double else F.col(c) for c in df.columns])


def ens(s, d):
    return view(s, d, "fx_ensemble")


def pairs(s, d):
    return verify.verify_join(ens(s, d), view(s, d, "fx_target"))


PAIRS = """p AS (SELECT e.*, t.rain_mm_h AS observed FROM fx_ensemble e JOIN fx_target t USING (window_id, lead, cell)
  WHERE t.rain_mm_h IS NOT NULL)"""
TABLE = """c AS (SELECT member, count_if(rain_mm_h >= 15 AND observed >= 15) AS hits,
    count_if(rain_mm_h < 15 AND observed >= 15) AS misses, count_if(rain_mm_h >= 15 AND observed < 15) AS false_alarms,
    count_if(rain_mm_h < 15 AND observed < 15) AS correct_negatives FROM p GROUP BY member)"""
SKILL = """s AS (SELECT avg(CASE WHEN hits + misses + false_alarms > 0 THEN hits / (hits + misses + false_alarms) END) AS csi,
    avg(CASE WHEN hits + misses > 0 THEN hits / (hits + misses) END) AS pod,
    avg(CASE WHEN hits + false_alarms > 0 THEN false_alarms / (hits + false_alarms) END) AS far,
    sum(hits + misses) AS events_observed FROM c)"""
MAE = """m AS (SELECT avg(e) AS mae FROM (SELECT abs(avg(rain_mm_h) - first(observed)) AS e FROM p
    GROUP BY window_id, lead, cell))"""
CRPS = """k AS (SELECT avg(a - b / 2) AS crps FROM (SELECT window_id, lead, cell,
      avg(abs(rain_mm_h - observed)) AS a FROM p GROUP BY ALL) x JOIN (SELECT l.window_id, l.lead, l.cell,
      avg(abs(l.rain_mm_h - r.rain_mm_h)) AS b FROM p l JOIN p r USING (window_id, lead, cell) GROUP BY ALL) y
      USING (window_id, lead, cell))"""


@R.add(f"WITH {PAIRS} SELECT window_id, lead, cell, member, rain_mm_h, observed FROM p")
def j15_verify_join(s, d):
    return pairs(s, d).select("window_id", "lead", "cell", "member", "rain_mm_h", "observed")


@R.add("""SELECT window_id, lead, cell, round(avg(rain_mm_h), 6) AS mean, max(rain_mm_h) AS max, min(rain_mm_h) AS min,
  quantile_disc(rain_mm_h, 0.5) AS median, round(stddev_samp(rain_mm_h), 6) AS std, count(*) AS members
  FROM fx_ensemble GROUP BY ALL""")
def a2_reduce_ensemble(s, d):
    return rounded(verify.reduce_ensemble(ens(s, d)))


@R.add("""SELECT window_id, lead, cell, round(avg(CASE WHEN rain_mm_h >= 15 THEN 1.0 ELSE 0.0 END), 6) AS probability
  FROM fx_ensemble GROUP BY ALL""")
def a3_exceedance(s, d):
    return rounded(verify.exceedance(ens(s, d), 15.0))


@R.add("""SELECT window_id, lead, cell, rain_class, round(avg(CASE WHEN rain_mm_h >= t THEN 1.0 ELSE 0.0 END), 6) AS probability
  FROM fx_ensemble, (VALUES ('light', 2.5), ('moderate', 7.5), ('heavy', 15), ('very_heavy', 35), ('extremely_heavy', 60)) v(rain_class, t)
  GROUP BY ALL""")
def a4_exceedance_classes(s, d):
    return rounded(verify.exceedance_classes(ens(s, d)))


@R.add(f"WITH {PAIRS}, {TABLE} SELECT * FROM c")
def a5_contingency(s, d):
    return verify.contingency(pairs(s, d), 15.0)


@R.add(f"""WITH {PAIRS} SELECT member, CAST(15 AS double) AS threshold, count_if(rain_mm_h >= 15 AND observed >= 15) AS hits,
  count_if(rain_mm_h < 15 AND observed >= 15) AS misses, count_if(rain_mm_h >= 15 AND observed < 15) AS false_alarms,
  count_if(rain_mm_h < 15 AND observed < 15) AS correct_negatives FROM p GROUP BY member""")
def a6_pool_tables(s, d):
    tables = verify.contingency(pairs(s, d), 15.0, by=["window_id"]).withColumn("threshold", F.lit(15.0))
    return verify.pool_tables(tables)


@R.add(f"""WITH {PAIRS}, {TABLE}, {SKILL} SELECT round(csi, 6) AS csi, round(pod, 6) AS pod, round(far, 6) AS far,
  CAST(events_observed AS bigint) AS events_observed FROM s""")
def a7_skill(s, d):
    return rounded(verify.skill(verify.contingency(pairs(s, d), 15.0)))


@R.add(f"WITH {PAIRS}, {MAE} SELECT round(mae, 6) AS mae FROM m")
def a8_ensemble_mae(s, d):
    return rounded(verify.ensemble_mae(pairs(s, d)))


@R.add(f"WITH {PAIRS}, {CRPS} SELECT round(crps, 6) AS crps FROM k")
def a9_crps(s, d):
    return rounded(verify.crps(pairs(s, d)))


SCORE = f"""WITH {PAIRS}, {TABLE}, {SKILL}, {MAE}, {CRPS} SELECT name, round(value, 6) AS value FROM (
  SELECT 'csi_heavy' AS name, csi AS value FROM s UNION ALL SELECT 'pod_heavy', pod FROM s
  UNION ALL SELECT 'far_heavy', far FROM s UNION ALL SELECT 'events_observed', CAST(events_observed AS double) FROM s
  UNION ALL SELECT 'mae', mae FROM m UNION ALL SELECT 'crps', crps FROM k
  UNION ALL SELECT 'windows', CAST(count(DISTINCT window_id) AS double) FROM p)"""


@R.add(SCORE)
def a10_score(s, d):
    return rounded(verify.score(pairs(s, d), 15.0, "heavy"))


@R.add("""SELECT round(avg(1 / (1 + exp(-(rain_mm_h - 15) / 2.0))), 6) AS soft FROM fx_target WHERE rain_mm_h IS NOT NULL""")
def a30_soft_exceedance(s, d):
    return rounded(verify.soft_exceedance(view(s, d, "fx_target"), 15.0, 2.0))


@R.add(f"""WITH {PAIRS} SELECT round(avg(abs(m - y) * greatest(0.0, least(24.0, y))), 6) AS score
  FROM (SELECT avg(rain_mm_h) AS m, first(observed) AS y FROM p GROUP BY window_id, lead, cell)""")
def a31_grid_cell_score(s, d):
    return rounded(verify.grid_cell_score(pairs(s, d)))


@R.add("SELECT * FROM fx_ensemble WHERE (lead + 1) % 2 = 0 AND (lead + 1) / 2 IN (1, 3, 6)")
def p20_reported_leads(s, d):
    return verify.reported_leads(ens(s, d), [1, 3, 6])


def halves(s, d):
    p = pairs(s, d)
    return [verify.score(p.where(f"member % 2 = {m}"), 15.0, "heavy") for m in (0, 1)]


def half_sql(m: int) -> str:
    return "(" + SCORE.replace("round(value, 6) AS value", "value").replace("FROM fx_ensemble e JOIN", f"FROM (SELECT * FROM fx_ensemble WHERE member % 2 = {m}) e JOIN") + ")"


@R.add(f"""SELECT name, round(a.value, 6) AS candidate, round(b.value, 6) AS incumbent FROM {half_sql(0)} a
  FULL JOIN {half_sql(1)} b USING (name)""")
def j19_gate_join(s, d):
    return rounded(verify.gate_join(*halves(s, d)))


@R.add(f"""WITH j AS (SELECT name, a.value AS c, b.value AS i FROM {half_sql(0)} a FULL JOIN {half_sql(1)} b USING (name)),
  w AS (SELECT max(c) FILTER (name = 'csi_heavy') - max(i) FILTER (name = 'csi_heavy') AS delta,
    max(c) FILTER (name = 'far_heavy') - max(i) FILTER (name = 'far_heavy') AS far_up,
    max(c) FILTER (name = 'crps') - max(i) FILTER (name = 'crps') AS crps_up,
    max(c) FILTER (name = 'events_observed') AS events FROM j),
  f AS (SELECT delta, list_filter([CASE WHEN events < 50 THEN 'event_floor' END,
      CASE WHEN delta < 0.005 THEN 'short_of_delta' END, CASE WHEN far_up > 0.02 THEN 'regressed:far_heavy' END,
      CASE WHEN crps_up > 0.02 THEN 'regressed:crps' END], lambda x: x IS NOT NULL) AS faults FROM w)
  SELECT len(faults) = 0 AS promote, round(delta, 6) AS delta,
    array_to_string(CASE WHEN len(faults) = 0 THEN ['improved'] ELSE faults END, ',') AS reasons FROM f""")
def d14_promotion_gate(s, d):
    decided = verify.promotion_gate(verify.gate_join(*halves(s, d)))
    return rounded(decided.withColumn("reasons", F.concat_ws(",", "reasons")))


RUNS = "(SELECT window_id AS model, lead AS step, avg(rain_mm_h) AS value FROM fx_target GROUP BY window_id, lead)"


@R.add(f"""WITH r AS {RUNS}, b AS (SELECT *, min(value) OVER (PARTITION BY model ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best,
    row_number() OVER (PARTITION BY model ORDER BY step DESC) AS n FROM r)
  SELECT model, step, round(value, 6) AS value, coalesce(value IS NOT NULL AND (best IS NULL OR value < best), false) AS is_best,
    n <= 3 AS kept FROM b""")
def w14_best_run(s, d):
    t = view(s, d, "fx_target").groupBy("window_id", "lead").agg(F.avg("rain_mm_h").alias("value"))
    runs = t.select(F.col("window_id").alias("model"), F.col("lead").alias("step"), "value")
    return rounded(verify.best_run(runs, "mae", by=["model"]))


# --- districts ----------------------------------------------------------------------


def districts(s, d):
    return view(s, d, "fx_district_cell")


@R.add("""SELECT state, district, round(sum(elevation_m * area_km2) / sum(area_km2), 6) AS mean FROM fx_district_cell
  JOIN fx_static USING (cell) GROUP BY ALL""")
def a19_district_mean(s, d):
    return rounded(impact.district_mean(view(s, d, "fx_static"), districts(s, d), "elevation_m"))


@R.add("""SELECT state, district, round(sum(CASE WHEN lulc IN (1, 2) THEN area_km2 ELSE 0 END) / sum(area_km2), 6) AS fraction
  FROM fx_district_cell JOIN fx_static USING (cell) GROUP BY ALL""")
def a20_district_class_fraction(s, d):
    return rounded(impact.district_class_fraction(view(s, d, "fx_static"), districts(s, d), [1, 2], "lulc"))


@R.add("SELECT state, district, round(sum(area_km2), 6) AS area_km2, count(*) AS cells FROM fx_district_cell GROUP BY ALL")
def a21_district_summary(s, d):
    return rounded(impact.district_summary(districts(s, d)))


PROB = """pr AS (SELECT window_id, lead, cell, avg(CASE WHEN rain_mm_h >= 15 THEN 1.0 ELSE 0.0 END) AS probability,
  max(rain_mm_h) AS intensity FROM fx_ensemble GROUP BY ALL)"""
IMPACT = f"""WITH {PROB}, tot AS (SELECT state, district, sum(area_km2) AS total FROM fx_district_cell GROUP BY ALL),
  l AS (SELECT window_id, state, district, lead, sum(CASE WHEN probability >= 0.15 THEN area_km2 ELSE 0 END) AS area,
    max(probability) AS p, max(intensity) AS mm FROM pr JOIN fx_district_cell USING (cell) GROUP BY ALL),
  q AS (SELECT *, area / total AS frac, round(area, 6) >= 150 OR round(area / total, 9) >= 0.05 AS ok FROM l JOIN tot USING (state, district)),
  i AS (SELECT window_id, state, district, max(p) AS peak_probability, arg_max(lead, (p, -lead)) AS peak_lead,
    min(lead) FILTER (ok) AS onset_lead, max(lead) FILTER (ok) AS expiry_lead, max(area) AS affected_area_km2,
    max(frac) AS affected_fraction, first(total) AS district_area_km2, max(mm) AS peak_intensity FROM q GROUP BY ALL),
  v AS (SELECT *, CASE WHEN peak_probability >= 0.7 AND peak_intensity >= 35 THEN 'severe'
    WHEN peak_probability >= 0.5 AND peak_intensity >= 15 THEN 'high' WHEN peak_probability >= 0.3 AND peak_intensity >= 7.5
    THEN 'moderate' WHEN peak_probability >= 0.15 AND peak_intensity >= 2.5 THEN 'low' END AS severity
    FROM i WHERE onset_lead IS NOT NULL)"""


def probability(s, d):
    v = F.col("rain_mm_h")
    return ens(s, d).groupBy("window_id", "lead", "cell").agg(
        F.avg((v >= 15).cast("double")).alias("probability"), F.max(v).alias("intensity")
    )


def impacts(s, d):
    return impact.extract_impacts(probability(s, d), districts(s, d), by=["window_id"])


COLS = """window_id, state, district, round(peak_probability, 6) AS peak_probability, peak_lead, onset_lead, expiry_lead,
  round(affected_area_km2, 6) AS affected_area_km2, round(affected_fraction, 6) AS affected_fraction,
  round(district_area_km2, 6) AS district_area_km2, peak_intensity, severity"""


@R.add(f"{IMPACT} SELECT {COLS} FROM v")
def a22_extract_impacts(s, d):
    return rounded(impacts(s, d))


@R.add(f"{IMPACT} SELECT {COLS} FROM v QUALIFY row_number() OVER (PARTITION BY window_id ORDER BY v.peak_probability DESC, state, district) <= 5")
def t1_rank_impacts(s, d):
    return rounded(impact.rank_impacts(impacts(s, d), 5, ["window_id"]))


@R.add(f"""WITH {PROB} SELECT window_id, cell, min(lead) FILTER (probability >= 0.9) AS onset_lead,
  max(lead) FILTER (probability >= 0.9) AS expiry_lead FROM pr GROUP BY ALL""")
def w10_onset_expiry(s, d):
    return impact.onset_expiry(probability(s, d), ["window_id", "cell"], 0.9)


@R.add(f"""WITH {PROB} SELECT window_id, lead, cell, CASE WHEN probability >= 0.7 AND intensity >= 35 THEN 'severe'
  WHEN probability >= 0.5 AND intensity >= 15 THEN 'high' WHEN probability >= 0.3 AND intensity >= 7.5 THEN 'moderate'
  WHEN probability >= 0.15 AND intensity >= 2.5 THEN 'low' END AS severity FROM pr""")
def d1_severity_band(s, d):
    p = probability(s, d)
    return p.select("window_id", "lead", "cell", impact.severity_band(F.col("probability"), F.col("intensity")).alias("severity"))


@R.add("""SELECT cell, array_to_string(list_sort(list(state || '/' || district)), ',') AS districts
  FROM fx_district_cell GROUP BY cell""")
def j13_districts_at(s, d):
    at = impact.districts_at(view(s, d, "fx_cell").select("cell"), districts(s, d))
    names = F.transform("districts", lambda x: F.concat(x["state"], F.lit("/"), x["district"]))
    return at.select("cell", F.concat_ws(",", F.array_sort(names)).alias("districts"))


@R.add("""SELECT t.* FROM fx_target t WHERE cell IN (SELECT cell FROM fx_district_cell WHERE district = 'NATION_1')""")
def j23_scope_district(s, d):
    dc = districts(s, d)
    state = dc.where("district = 'NATION_1'").select("state").first().state
    return impact.scope_district(view(s, d, "fx_target"), dc, state, "NATION_1").select("window_id", "lead", "cell", "rain_mm_h")


@R.add("SELECT DISTINCT state, district, cell FROM fx_district_cell")
def u5_dissolve(s, d):
    dc = districts(s, d)
    return impact.dissolve(dc.unionByName(dc)).select("state", "district", "cell")


@R.add(f"""{IMPACT} SELECT window_id, state, district, (onset_lead + 1) / 2 AS onset_hours, (expiry_lead + 1) / 2 AS expiry_hours,
  1496275200 + window_id * 86400 + (onset_lead + 1) * 1800 AS onset_s, 1496275200 + window_id * 86400 + (expiry_lead + 1) * 1800 AS expiry_s
  FROM v""")
def f11_impact_times(s, d):
    t = impacts(s, d).withColumn("valid_time", F.timestamp_seconds(F.col("window_id") * 86400 + 1496275200))
    out = impact.impact_times(t)
    return out.select(
        "window_id", "state", "district", "onset_hours", "expiry_hours",
        F.unix_seconds("onset_time").alias("onset_s"), F.unix_seconds("expiry_time").alias("expiry_s"),
    )


@R.add(f"""{IMPACT} SELECT state, district, round(peak_probability, 4) AS peak_probability, peak_lead, onset_lead, expiry_lead,
  round(affected_area_km2, 1) AS affected_area_km2, round(affected_fraction, 4) AS affected_fraction,
  round(district_area_km2, 1) AS district_area_km2, round(peak_intensity, 2) AS peak_intensity, severity FROM v""")
def f24_presented_impacts(s, d):
    return impact.presented_impacts(impacts(s, d))


@R.add(f"""WITH {PROB} SELECT window_id, cell, array_to_string(list(CAST(CAST(round(probability * 1000) AS bigint) AS varchar) ORDER BY lead), ',')
  AS series FROM pr GROUP BY ALL""")
def f23_point_series(s, d):
    out = impact.point_series(probability(s, d), ["window_id", "cell"])
    text = F.transform("series", lambda v: F.round(v * 1000).cast("long").cast("string"))
    return out.select("window_id", "cell", F.concat_ws(",", text).alias("series"))


@R.add(f"""WITH {PROB}, one AS (SELECT window_id, lead, cell, probability FROM pr)
  SELECT window_id, c.cell AS point_id, c.grid_row AS "row", c.grid_col AS "col",
    array_to_string(list(CAST(CAST(round(probability * 1000) AS bigint) AS varchar) ORDER BY lead), ',') AS series,
    round(max(probability), 6) AS peak_probability, arg_max(lead, (probability, -lead)) AS peak_lead,
    min(lead) FILTER (probability >= 0.15) AS onset_lead, max(lead) FILTER (probability >= 0.15) AS expiry_lead,
    first(n) AS n_districts
  FROM one JOIN fx_cell c USING (cell) JOIN (SELECT cell, count(*) AS n FROM fx_district_cell GROUP BY cell) k USING (cell)
  GROUP BY ALL""")
def d21_point_forecast(s, d):
    cells = view(s, d, "fx_cell").select("cell", F.col("grid_row").alias("row"), F.col("grid_col").alias("col"), "lat", "lon")
    now = probability(s, d).join(cells.select("cell", "row", "col"), "cell")
    dc = districts(s, d).join(cells.select("cell", "row", "col"), "cell")
    points = cells.select(F.col("cell").alias("point_id"), "lat", "lon")
    out = impact.point_forecast(points, now.select("window_id", "row", "col", "lead", "probability"), dc, SMALL, by=["window_id"])
    text = F.transform("series", lambda v: F.round(v * 1000).cast("long").cast("string"))
    out = out.withColumn("series", F.concat_ws(",", text)).withColumn("n_districts", F.size("districts"))
    return rounded(out.drop("districts"))


# --- index ----------------------------------------------------------------------------

# The record is the orders': seasons of its years, and how many orders the day of each valid time has.
MONTHS = [6, 7, 8, 9]
SPLIT = {"train_until": "1996-09-30 23:59:59", "validation_from": "1997-06-01 00:00:00"}
SEASON_SQL = """o AS (SELECT CAST(o_orderdate AS date) AS day, count(*) AS orders FROM orders GROUP BY 1), y AS (SELECT DISTINCT year(day) AS year FROM o),
  s AS (SELECT CAST(year AS int) AS year, 6 AS first_month, 9 AS last_month, make_timestamp(year, 6, 1, 0, 0, 0) AS a,
    make_timestamp(year, 9, 30, 23, 30, 0) AS b FROM y)"""


def seasons(s, d):
    years = view(s, d, "orders").select(F.year("o_orderdate").alias("y")).distinct().collect()  # one row a year
    return index.season_runs(s, sorted(r.y for r in years), MONTHS)


def recorded(s, d, times):
    """times with the orders of their day."""
    days = view(s, d, "orders").groupBy(F.to_date("o_orderdate").alias("day")).agg(F.count("*").alias("orders"))
    return times.withColumn("day", F.to_date("valid_time")).join(days, "day", "left").withColumn("orders", F.coalesce("orders", F.lit(0)))


def split(s, d):
    return index.split_times(index.valid_times(seasons(s, d)), **SPLIT)


@R.add(f"""WITH {SEASON_SQL} SELECT year, first_month, last_month, CAST(epoch(a) AS bigint) AS start_s, CAST(epoch(b) AS bigint) AS end_s,
  (SELECT CAST(coalesce(sum(orders), 0) AS bigint) FROM o WHERE day BETWEEN a AND b) AS orders FROM s""")
def w11_season_runs(s, d):
    runs = seasons(s, d)
    held = view(s, d, "orders").select(F.year("o_orderdate").alias("year"), F.col("o_orderdate").cast("timestamp").alias("at")).join(runs, "year")
    counts = held.where("at between season_start and season_end").groupBy("year", "season_start").agg(F.count("*").alias("orders"))
    return runs.join(counts, ["year", "season_start"], "left").select(
        "year", "first_month", "last_month", F.unix_seconds("season_start").alias("start_s"), F.unix_seconds("season_end").alias("end_s"),
        F.coalesce("orders", F.lit(0)).alias("orders"),
    )


TIMES_SQL = f"""{SEASON_SQL}, t AS (SELECT year, unnest(range(CAST(epoch(a) AS bigint) + 6 * 3600, CAST(epoch(b) AS bigint) - 6 * 3600 + 1, 1800)) AS t
  FROM s)"""


@R.add(f"WITH {TIMES_SQL} SELECT year, t AS valid_s, coalesce(orders, 0) AS orders FROM t LEFT JOIN o ON day = CAST(to_timestamp(t) AS date)")
def v1_valid_times(s, d):
    return recorded(s, d, index.valid_times(seasons(s, d))).select("year", F.unix_seconds("valid_time").alias("valid_s"), "orders")


SPLIT_SQL = f"""WITH {TIMES_SQL}, sp AS (SELECT year, t, CASE WHEN t + 21600 <= epoch(TIMESTAMP '1996-09-30 23:59:59') THEN 'train'
  WHEN t - 21600 >= epoch(TIMESTAMP '1997-06-01') THEN 'validation' ELSE 'discarded' END AS split FROM t)"""


@R.add(f"{SPLIT_SQL} SELECT year, t AS valid_s, split, coalesce(orders, 0) AS orders FROM sp LEFT JOIN o ON day = CAST(to_timestamp(t) AS date)")
def u2_split_times(s, d):
    return recorded(s, d, split(s, d)).select("year", F.unix_seconds("valid_time").alias("valid_s"), "split", "orders")


@R.add(f"""{SPLIT_SQL} SELECT split, count(*) AS windows, CAST(sum(coalesce(orders, 0)) AS bigint) AS orders FROM sp LEFT JOIN o ON day = CAST(to_timestamp(t) AS date)
  WHERE split = 'train' OR split = 'validation' GROUP BY split""")
def v2_build_index(s, d):
    return recorded(s, d, split(s, d)).where("split != 'discarded'").groupBy("split").agg(F.count("*").alias("windows"), F.sum("orders").alias("orders"))


@R.add(f"""{SPLIT_SQL} SELECT split, count(*) AS windows, min(t) AS first_s, max(t) AS last_s, min(t) - 21600 AS from_s, max(t) + 21600 AS to_s
  FROM sp GROUP BY split""")
def a32_split_summary(s, d):
    out = index.split_summary(split(s, d))
    seconds = {"first_s": "first_time", "last_s": "last_time", "from_s": "reaches_from", "to_s": "reaches_to"}
    return out.select("split", "windows", *[F.unix_seconds(c).alias(n) for n, c in seconds.items()])


@R.add(f"""{SPLIT_SQL} SELECT max(t) FILTER (split = 'train') + 21600 AS train_to, min(t) FILTER (split = 'validation') - 21600 AS validation_from,
  (SELECT count(*) FROM (SELECT t FROM sp WHERE split = 'train' INTERSECT SELECT t FROM sp WHERE split = 'validation')) AS shared FROM sp""")
def u3_disjoint(s, d):
    out = index.overlap(split(s, d))
    return out.select(F.unix_seconds("train_to").alias("train_to"), F.unix_seconds("validation_from").alias("validation_from"), "shared")


@R.add("""SELECT event_id FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-20' AND month(ts) IN (1, 6)""")
def p6_in_record(s, d):
    e = view(s, d, "events")
    ts = F.col("ts").cast("timestamp")
    return e.where(index.in_record(ts, start="2024-01-05", end="2024-01-20", months=[1, 6])).select("event_id")
