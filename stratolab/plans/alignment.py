"""Registered queries: slots, gaps, quality control, regridding."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geo, scalar
from ..functions.geo import Grid
from ..operators import qc, regrid, sync
from ..schema import BIT
from ..sources import catalog
from .fixtures import view
from .registry import Registry
from .verification import SMALL, rounded

R = Registry()
STREAMS = ["insat", "imdaa", "imd_surface", "hem"]
COARSE = Grid(6.0, 38.0, 68.0, 100.0, 4 / 3, 25, 25)


def frames(s, d):
    return view(s, d, "fx_frame").select(F.col("slot_s"), "stream", F.col("v").cast("double").alias("value"))


def span(s, d):
    r = view(s, d, "fx_frame").agg(F.min("slot_s").alias("a"), F.max("slot_s").alias("b")).first()
    return r.a, r.b


SPINE = """b AS (SELECT min(slot_s) AS a, max(slot_s) AS z FROM fx_frame),
  sp AS (SELECT unnest(range(a, z + 1, 1800)) AS slot_s FROM b),
  k AS (SELECT slot_s, stream FROM sp, (VALUES ('insat'), ('imdaa'), ('imd_surface'), ('hem')) v(stream)),
  j AS (SELECT k.slot_s, k.stream, CAST(f.v AS double) AS value, f.v IS NOT NULL AS present,
    CASE WHEN f.v IS NULL THEN 1 ELSE 0 END AS qc_flag FROM k LEFT JOIN fx_frame f USING (slot_s, stream))"""


def synced(s, d):
    a, z = span(s, d)
    return sync.synchronise(sync.slot_spine(s, a, z, STREAMS), frames(s, d))


@R.add(f"WITH {SPINE} SELECT * FROM j")
def j1_synchronise(s, d):
    return synced(s, d)


@R.add("""WITH {0} SELECT stream, count(*) AS n, count_if(NOT present) AS absent FROM j GROUP BY stream""".replace("{0}", SPINE))
def s9_complete_frames(s, d):
    return synced(s, d).groupBy("stream").agg(F.count("*").alias("n"), F.count_if(~F.col("present")).alias("absent"))


@R.add("""SELECT event_id, obs_s, station, value, CAST(floor((obs_s + 900) / 1800) AS bigint) * 1800 AS slot_s,
  obs_s - CAST(floor((obs_s + 900) / 1800) AS bigint) * 1800 AS offset_s FROM fx_obs
  WHERE abs(obs_s - CAST(floor((obs_s + 900) / 1800) AS bigint) * 1800) <= 420""")
def j2_admit(s, d):
    return sync.admit(view(s, d, "fx_obs"))


@R.add("""WITH r AS (SELECT slot_s AS rs, v FROM fx_frame WHERE stream = 'imdaa'),
  x AS (SELECT o.event_id, o.obs_s, r.rs, r.v, row_number() OVER (PARTITION BY o.event_id ORDER BY abs(r.rs - o.obs_s), r.rs DESC) AS k
    FROM fx_obs o JOIN r ON r.rs BETWEEN o.obs_s - 900 AND o.obs_s + 900)
  SELECT o.event_id, x.rs AS right_s, CAST(x.v AS double) AS value FROM fx_obs o LEFT JOIN x ON x.event_id = o.event_id AND k = 1""")
def j3_asof_nearest(s, d):
    left = view(s, d, "fx_obs").select("event_id", F.col("obs_s").alias("t_s"))
    right = frames(s, d).where("stream = 'imdaa'").select(F.col("slot_s").alias("t_s"), "value")
    return sync.asof_nearest(left, right, 900).select("event_id", "right_s", "value")


@R.add("""SELECT event_id, CAST(floor(obs_s / 3600) AS bigint) * 3600 AS snap_s, CAST(f.v AS double) AS value FROM fx_obs
  LEFT JOIN (SELECT * FROM fx_frame WHERE stream = 'imdaa') f ON f.slot_s = CAST(floor(obs_s / 3600) AS bigint) * 3600""")
def j4_asof_backward(s, d):
    left = view(s, d, "fx_obs").select("event_id", F.col("obs_s").alias("t_s"))
    right = frames(s, d).where("stream = 'imdaa'").select(F.col("slot_s").alias("t_s"), "value")
    return sync.asof_backward(left, right, 3600).select("event_id", "snap_s", "value")


@R.add("""SELECT o.event_id, CAST(f.v AS double) AS latest FROM fx_obs o ASOF LEFT JOIN
  (SELECT slot_s, v FROM fx_frame WHERE stream = 'imdaa') f ON o.obs_s >= f.slot_s""")
def j4_asof_latest(s, d):
    left = view(s, d, "fx_obs").select("event_id", F.col("obs_s").alias("t_s"), F.lit("imdaa").alias("stream"))
    right = frames(s, d).where("stream = 'imdaa'").select("stream", F.col("slot_s").alias("t_s"), "value")
    return sync.asof_latest(left, right, by=["stream"]).select("event_id", "latest")


@R.add("""SELECT t0_s, o + 12 AS t, t0_s + o * 1800 AS slot_s FROM (SELECT DISTINCT slot_s AS t0_s FROM fx_frame), (SELECT unnest(range(-12, 1)) AS o)""")
def w6_lookback(s, d):
    return sync.lookback(frames(s, d).select(F.col("slot_s").alias("t0_s")).distinct())


@R.add("""SELECT t0_s, o - 1 AS lead, t0_s + o * 1800 AS slot_s FROM (SELECT DISTINCT slot_s AS t0_s FROM fx_frame), (SELECT unnest(range(1, 13)) AS o)""")
def w7_leads(s, d):
    return sync.leads(frames(s, d).select(F.col("slot_s").alias("t0_s")).distinct())


RUN_SQL = f"""{SPINE}, n AS (SELECT *, row_number() OVER (PARTITION BY stream ORDER BY slot_s) - 1 AS i FROM j),
  h AS (SELECT stream, i, i - row_number() OVER (PARTITION BY stream ORDER BY i) AS g FROM n WHERE NOT present),
  r AS (SELECT stream, min(i) AS start, count(*) AS length FROM h GROUP BY stream, g)"""


@R.add(f"WITH {RUN_SQL} SELECT * FROM r")
def w1_runs(s, d):
    return sync.runs(synced(s, d), ["stream"], "slot_s", ~F.col("present"))


DAY = "CAST(floor(slot_s / 86400) AS bigint)"


@R.add(f"""WITH {SPINE}, q AS (SELECT *, {DAY} AS day FROM j), n AS (SELECT *, row_number() OVER (PARTITION BY stream, day ORDER BY slot_s) AS i FROM q),
  h AS (SELECT stream, day, i - row_number() OVER (PARTITION BY stream, day ORDER BY i) AS g FROM n WHERE NOT present),
  r AS (SELECT stream, day, g, count(*) AS length FROM h GROUP BY ALL), t AS (SELECT stream, day, max(length) AS lg, sum(length) AS tot FROM r GROUP BY ALL),
  o AS (SELECT stream, day, count_if(present) AS n FROM q GROUP BY ALL)
  SELECT o.stream, o.day, n > 0 AND coalesce(lg, 0) <= 2 AS accepted, CASE WHEN n = 0 THEN 'no observed frames in the sequence'
    WHEN lg > 2 THEN 'longest gap is ' || lg || ' frames, over the limit of 2' WHEN tot IS NULL THEN 'complete'
    ELSE tot || ' frames missing, longest run ' || lg END AS reason FROM o LEFT JOIN t USING (stream, day)""")
def w2_assess(s, d):
    f = synced(s, d).withColumn("day", F.floor(F.col("slot_s") / 86400).cast("long"))
    return sync.assess(f, ["stream", "day"], "slot_s", F.col("present"))


NEXT = f"""{SPINE}, n AS (SELECT *, last_value(value IGNORE NULLS) OVER pw AS pv, last_value(CASE WHEN present THEN slot_s END IGNORE NULLS) OVER pw AS po,
    first_value(value IGNORE NULLS) OVER nw AS nv, first_value(CASE WHEN present THEN slot_s END IGNORE NULLS) OVER nw AS no FROM j
  WINDOW pw AS (PARTITION BY stream ORDER BY slot_s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
    nw AS (PARTITION BY stream ORDER BY slot_s ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING))"""


@R.add(f"WITH {NEXT} SELECT stream, slot_s, po AS prev_order, pv AS prev_value, no AS next_order, nv AS next_value FROM n")
def w3_neighbours(s, d):
    return sync.neighbours(synced(s, d), ["stream"], "slot_s").select(
        "stream", "slot_s", "prev_order", "prev_value", "next_order", "next_value"
    )


@R.add(f"""WITH {NEXT} SELECT stream, slot_s, round(CASE WHEN present THEN value WHEN pv IS NOT NULL AND nv IS NOT NULL
    THEN pv + (nv - pv) * (slot_s - po) / (no - po) ELSE coalesce(pv, nv) END, 6) AS value,
  CASE WHEN present THEN NULL WHEN pv IS NOT NULL AND nv IS NOT NULL THEN 'linear' WHEN pv IS NOT NULL OR nv IS NOT NULL THEN 'hold'
    ELSE 'failed' END AS fill_method, CASE WHEN present THEN 0 WHEN coalesce(pv, nv) IS NULL THEN 4097 ELSE 2049 END AS qc_flag FROM n""")
def w4_fill_gaps(s, d):
    out = sync.fill_gaps(synced(s, d), ["stream"], "slot_s")
    return rounded(out.select("stream", "slot_s", "value", "fill_method", "qc_flag"))


@R.add(f"""WITH {NEXT} SELECT stream, slot_s, round(CASE WHEN present THEN value WHEN pv IS NOT NULL AND nv IS NOT NULL
    THEN pv + (nv - pv) * (slot_s - po) / (no - po) END, 6) AS value FROM n""")
def w15_lift(s, d):
    return rounded(sync.lift(synced(s, d), ["stream"], "slot_s", "continuous").select("stream", "slot_s", "value"))


ADVECT = """c AS (SELECT CAST(floor(obs_s / 21600) AS bigint) % 9 AS frame, event_id % 16 AS r, event_id % 13 AS c, avg(value) AS v FROM fx_obs GROUP BY ALL),
  b AS (SELECT frame, r, c, CASE WHEN frame % 3 <> 1 THEN v END AS v FROM c),
  fr AS (SELECT frame, avg(CASE WHEN v IS NULL THEN 0.0 ELSE 1.0 END) >= 0.25 AS ok FROM b GROUP BY frame),
  gp AS (SELECT frame, bf, af, (frame - bf) / (af - bf) AS s FROM (SELECT frame, ok, max(CASE WHEN ok THEN frame END) OVER (ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS bf,
    min(CASE WHEN ok THEN frame END) OVER (ORDER BY frame ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS af FROM fr) WHERE NOT ok AND bf IS NOT NULL AND af IS NOT NULL),
  tr AS (SELECT p.bf, p.af, floor(x.r / 8) AS tr, floor(x.c / 8) AS tc, dr, dc, avg(abs(x.v - y.v)) AS cost FROM (SELECT DISTINCT bf, af FROM gp) p JOIN b x ON x.frame = p.bf AND x.v IS NOT NULL
    CROSS JOIN (SELECT unnest(range(-2, 3)) AS dr) CROSS JOIN (SELECT unnest(range(-2, 3)) AS dc) JOIN b y ON y.frame = p.af AND y.r = x.r + dr AND y.c = x.c + dc AND y.v IS NOT NULL GROUP BY ALL),
  fl AS (SELECT bf, af, tr, tc, arg_min({'dr': dr, 'dc': dc}, (cost, abs(dr) + abs(dc), dr, dc)) AS m FROM tr GROUP BY ALL),
  wa AS (SELECT g.frame, s, r + CAST(round(s * coalesce(m.dr, 0)) AS bigint) AS r, c + CAST(round(s * coalesce(m.dc, 0)) AS bigint) AS c, v FROM gp g JOIN b ON b.frame = bf AND v IS NOT NULL
    LEFT JOIN fl ON fl.bf = g.bf AND fl.af = g.af AND tr = floor(r / 8) AND tc = floor(c / 8)),
  wb AS (SELECT g.frame, s, r + CAST(round((s - 1) * coalesce(m.dr, 0)) AS bigint) AS r, c + CAST(round((s - 1) * coalesce(m.dc, 0)) AS bigint) AS c, v FROM gp g JOIN b ON b.frame = af AND v IS NOT NULL
    LEFT JOIN fl ON fl.bf = g.bf AND fl.af = g.af AND tr = floor(r / 8) AND tc = floor(c / 8)),
  mv AS (SELECT frame, r, c, coalesce(e * (1 - s) + l * s, e, l) AS x FROM (SELECT frame, s, r, c, avg(v) AS e FROM wa GROUP BY ALL) FULL JOIN (SELECT frame, s, r, c, avg(v) AS l FROM wb GROUP BY ALL) USING (frame, s, r, c))"""


@R.add(f"""WITH {ADVECT} SELECT 0 AS seq, CAST(frame AS int) AS frame, CAST(r AS int) AS "row", CAST(c AS int) AS col, round(coalesce(v, x), 6) AS value, v IS NULL AND x IS NOT NULL AS filled,
  CASE WHEN v IS NULL AND x IS NOT NULL THEN 1024 ELSE 0 END AS qc_flag FROM b LEFT JOIN mv USING (frame, r, c)""")
def w5_fill_advective(s, d):
    """A drifting field of event counts with every third frame blanked."""
    e = view(s, d, "fx_obs").withColumn("frame", F.floor(F.col("obs_s") / 21600).cast("int") % 9)
    at = e.select(F.lit(0).alias("seq"), "frame", (F.col("event_id") % 16).cast("int").alias("row"), (F.col("event_id") % 13).cast("int").alias("col"), "value")
    cells = at.groupBy("seq", "frame", "row", "col").agg(F.avg("value").alias("value"))
    blank = cells.withColumn("value", F.when(F.col("frame") % 3 != 1, F.col("value")))
    return rounded(sync.fill_advective(blank, 8, 2))


@R.add(f"""WITH {SPINE} SELECT stream, round(avg(CASE WHEN present THEN 1.0 ELSE 0.0 END), 6) AS usable_fraction,
  round(avg(CASE WHEN present THEN 1.0 ELSE 0.0 END), 6) AS observed_fraction FROM j GROUP BY stream""")
def a13_fractions(s, d):
    return rounded(sync.fractions(synced(s, d), ["stream"]))


@R.add("""WITH x AS (SELECT stream, slot_s, row_number() OVER (PARTITION BY stream ORDER BY slot_s DESC) AS k FROM fx_frame) SELECT stream, slot_s FROM x WHERE k <= 4""")
def w8_last_frames(s, d):
    return sync.last_frames(frames(s, d), ["stream"], "slot_s", 4).select("stream", "slot_s")


@R.add("""SELECT stream, slot_s, CAST(floor(slot_s / 86400) AS bigint) * 86400 AS record_s FROM fx_frame""")
def f12_surface_record(s, d):
    return frames(s, d).select("stream", "slot_s", sync.surface_record(F.col("slot_s")).alias("record_s"))


@R.add("""WITH l AS (SELECT frame, quantile_cont(value, 0.01) AS a, quantile_cont(value, 0.99) AS b FROM fx_scan GROUP BY frame)
  SELECT frame, scan_row, scan_col, CASE WHEN value IS NULL OR a = b THEN 0
    ELSE CAST(floor(round(greatest(0, least(1, (value - a) / (b - a))) * 255, 9)) AS int) END AS level FROM fx_scan JOIN l USING (frame)""")
def a36_stretch_uint8(s, d):
    return sync.stretch_uint8(view(s, d, "fx_scan"), ["frame"]).select("frame", "scan_row", "scan_col", "level")


@R.add("""WITH f AS (SELECT frame, scan_row, 30 + scan_row % 3 AS height, 40 AS width FROM fx_scan GROUP BY ALL),
  c AS (SELECT frame, height, count(*) AS n, min(scan_row) AS o FROM f GROUP BY ALL),
  m AS (SELECT frame, arg_max(height, (n, -o)) AS modal FROM c GROUP BY frame)
  SELECT frame, scan_row, height, width, height = modal AS fits FROM f JOIN m USING (frame)""")
def a15_modal_shape(s, d):
    f = view(s, d, "fx_scan").select("frame", "scan_row").distinct()
    f = f.withColumns({"height": 30 + F.col("scan_row") % 3, "width": F.lit(40)})
    return sync.modal_shape(f, ["frame"], "scan_row")


@R.add("SELECT frame, scan_row AS level, scan_col, value FROM fx_scan WHERE scan_row = 5")
def p12_select_level(s, d):
    return sync.select_level(view(s, d, "fx_scan").withColumnRenamed("scan_row", "level"), 5)


# --- flags and cleaning -------------------------------------------------------------

NAMES = list(BIT)


@R.add("""SELECT event_id, (event_id % 8192) & 4103 = 0 AS usable, (event_id % 8192) & 7175 = 0 AS observed,
  array_to_string(list_filter([""" + ", ".join(f"CASE WHEN (event_id % 8192) & {b} <> 0 THEN '{n}' END" for n, b in BIT.items()) + """],
  lambda x: x IS NOT NULL), ',') AS names, ((event_id % 8192) | 64) & ~256 AS changed FROM events""")
def p1_flags(s, d):
    f = (F.col("event_id") % 8192).cast("long")
    e = view(s, d, "events").withColumn("f", f)
    changed = scalar.clear_flag(scalar.set_flag("f", "SCANLINE_DROPOUT"), "PARALLAX_UNCORRECTED")
    return e.select(
        "event_id", scalar.is_usable("f").alias("usable"), scalar.is_observed("f").alias("observed"),
        F.concat_ws(",", scalar.flag_names("f")).alias("names"), changed.alias("changed"),
    )


@R.add("SELECT user_id, bit_or(event_id % 8192) AS qc_flag FROM events GROUP BY user_id")
def a14_combined_flags(s, d):
    e = view(s, d, "events").select("user_id", (F.col("event_id") % 8192).alias("qc_flag"))
    return qc.combined_flags(e, ["user_id"]).select("user_id", "qc_flag")


@R.add("""SELECT event_id, NOT (value BETWEEN 0 AND 300) AS out_of_range, CASE WHEN value BETWEEN 0 AND 300 THEN value END AS masked,
  greatest(0, least(300, value)) AS clipped FROM fx_bounds""")
def p2_apply_bounds(s, d):
    masked = qc.apply_bounds(view(s, d, "fx_bounds").withColumn("clipped", F.col("value")), 0.0, 300.0)
    clipped = qc.apply_bounds(masked.withColumnsRenamed({"value": "masked", "out_of_range": "o"}), 0.0, 300.0, "clip", "clipped")
    return clipped.select("event_id", F.col("o").alias("out_of_range"), "masked", "clipped")


@R.add("""SELECT event_type, count_if(value NOT BETWEEN 0 AND 300) AS out_of_range, count(value) AS present,
  round(count_if(value NOT BETWEEN 0 AND 300) / count(value), 6) AS share, count_if(value NOT BETWEEN 0 AND 300) / count(value) >= 0.01 AS systematic
  FROM events GROUP BY event_type""")
def p3_bounds_report(s, d):
    e = view(s, d, "events").select("event_type", "value", F.col("value").alias("was"))
    return rounded(qc.bounds_report(qc.apply_bounds(e, 0.0, 300.0), ["event_type"], F.col("was").isNotNull()))


@R.add("SELECT event_id, CASE WHEN event_id % 100 <> 99 THEN CAST(event_id % 100 AS double) END AS value FROM events")
def p4_null_sentinel(s, d):
    return view(s, d, "events").select("event_id", scalar.null_sentinel((F.col("event_id") % 100).cast("double"), 99.0).alias("value"))


@R.add("""SELECT event_id, CASE WHEN event_id % 200 - 100 BETWEEN -90 AND 90 THEN event_id % 200 - 100 END AS lat,
  CASE WHEN event_id % 800 - 300 BETWEEN -180 AND 360 THEN event_id % 800 - 300 END AS lon FROM events""")
def p5_clean_geo(s, d):
    e = view(s, d, "events")
    return e.select("event_id", scalar.clean_lat(F.col("event_id") % 200 - 100).alias("lat"), scalar.clean_lon(F.col("event_id") % 800 - 300).alias("lon"))


@R.add("SELECT event_id, CASE WHEN event_id % 50 <> 7 THEN (event_id % 50) * 5e-1 - 3 END AS value FROM events")
def s6_unpack(s, d):
    raw = (F.col("event_id") % 50).cast("double")
    return view(s, d, "events").select("event_id", scalar.unpacked(raw, 7, 0.5, -3.0).alias("value"))


LUT = "lut AS (SELECT idx, 180 + idx * 0.25 AS kelvin FROM (SELECT unnest(range(0, 300)) AS idx))"


def lut(s):
    return s.range(300).select(F.col("id").alias("idx"), (180 + F.col("id") * 0.25).alias("kelvin"))


@R.add(f"""WITH {LUT} SELECT event_id, CAST(n.kelvin AS double) AS near, round(CAST(a.kelvin + (b.kelvin - a.kelvin) * (c - floor(c)) AS double), 6) AS lin
  FROM (SELECT event_id, (event_id % 1400) / 4 AS c FROM events) e LEFT JOIN lut n ON n.idx = CAST(round_even(c, 0) AS bigint)
  LEFT JOIN lut a ON a.idx = CAST(floor(c) AS bigint) LEFT JOIN lut b ON b.idx = CAST(ceil(c) AS bigint)""")
def p8_calibrate(s, d):
    e = view(s, d, "events").select("event_id", ((F.col("event_id") % 1400) / 4).alias("count"))
    near = qc.calibrate(e, lut(s)).withColumnRenamed("temperature", "near")
    both = qc.calibrate(near, lut(s), "linear").withColumnRenamed("temperature", "lin")
    return rounded(both.select("event_id", "near", "lin"))


STATS = """l AS (SELECT frame, scan_row, count(value) AS n, stddev_pop(value) AS sd, count_if(value >= 380) AS top FROM fx_scan GROUP BY ALL),
  z AS (SELECT *, n >= 8 AND sd < 60 AS constant_bad, n >= 8 AND top / greatest(n, 1) >= 0.1 AS saturated_bad FROM l)"""


def scans(s, d):
    return qc.scanline_stats(view(s, d, "fx_scan"), ["frame"], row="scan_row", width=32, tolerance=60.0, saturated_share=0.1, ceiling=380.0)


@R.add(f"WITH {STATS} SELECT frame, scan_row, n, round(sd, 6) AS spread, false AS fill_bad, coalesce(constant_bad, false) AS constant_bad, saturated_bad FROM z")
def a16_scanline_stats(s, d):
    return rounded(scans(s, d))


@R.add(f"""WITH {STATS} SELECT f.frame, f.scan_row, f.scan_col, CASE WHEN NOT (coalesce(constant_bad, false) OR saturated_bad) THEN f.value END AS value
  FROM fx_scan f JOIN z USING (frame, scan_row)""")
def a17_apply_dropout(s, d):
    return qc.apply_dropout(view(s, d, "fx_scan"), ["frame"], scans(s, d), row="scan_row")


@R.add("SELECT frame, coalesce(avg(CASE WHEN value >= 200 THEN 1.0 WHEN value IS NOT NULL THEN 0.0 END) >= 0.5, false) AS saturated FROM fx_scan GROUP BY frame")
def a18_is_saturated(s, d):
    return qc.is_saturated(view(s, d, "fx_scan"), ["frame"], 200.0, 0.5)


@R.add("""SELECT frame % 7 AS layer, bool_and(value IS NULL OR value = 9 OR value = round(value)) AS integral, count(value) FILTER (value <> 9) AS present,
  count(DISTINCT CAST(value AS int)) FILTER (value <> 9) AS classes FROM fx_scan GROUP BY ALL""")
def s8_static_layer_qc(s, d):
    cells = view(s, d, "fx_scan").withColumn("layer", F.col("frame") % 7)
    return qc.static_layer_qc(cells, fill=9.0, categorical=True, keys=["layer"]).withColumn("classes", F.size("classes").cast("long"))


@R.add("""WITH {0} SELECT frame, scan_row, scan_col, CASE WHEN NOT (coalesce(constant_bad, false) OR saturated_bad) AND f.value BETWEEN 0 AND 390
  THEN f.value END AS value FROM fx_scan f JOIN z USING (frame, scan_row)""".replace("{0}", STATS.replace("380", "390").replace("< 60", "< 0.01").replace("0.1 AS", "0.98 AS")))
def d18_frame_qc(s, d):
    cells = view(s, d, "fx_scan").withColumnRenamed("scan_row", "row")
    out = qc.frame_qc(cells, ["frame"], satellite=True, low=0.0, high=390.0, width=32)
    return out.select("frame", F.col("row").alias("scan_row"), "scan_col", "value")


# --- geometry ------------------------------------------------------------------------


@R.add("""SELECT event_id, lat BETWEEN 6 - 1e0 / 24 AND 38 + 1e0 / 24 AND lon BETWEEN 68 - 1e0 / 24 AND 100 + 1e0 / 24 AS inside,
  greatest(0, least(383, CAST(round_even((lat - 6) / (1e0 / 12), 0) AS int))) AS grid_row,
  greatest(0, least(383, CAST(round_even((lon - 68) / (1e0 / 12), 0) AS int))) AS grid_col FROM fx_swath""")
def f5_latlon_to_indices(s, d):
    w = view(s, d, "fx_swath").withColumn("at", geo.latlon_to_indices("lat", "lon"))
    return w.select("event_id", geo.in_domain("lat", "lon").alias("inside"), F.col("at.row").alias("grid_row"), F.col("at.col").alias("grid_col"))


@R.add("SELECT event_id, lat + 30 BETWEEN 6 - 1e0 / 24 AND 38 + 1e0 / 24 AS inside FROM fx_swath")
def p9_in_domain(s, d):
    return view(s, d, "fx_swath").select("event_id", geo.in_domain(F.col("lat") + 30, "lon").alias("inside"))


@R.add("""SELECT event_id, round(power(6371.0088, 2) * radians(1e0 / 12) * (sin(radians(6 + (event_id % 384) / 12 + 1e0 / 24)) -
  sin(radians(6 + (event_id % 384) / 12 - 1e0 / 24))), 6) AS area_km2 FROM events""")
def f4_cell_area(s, d):
    return rounded(view(s, d, "events").select("event_id", geo.cell_area_km2(F.col("event_id") % 384).alias("area_km2")))


@R.add("SELECT event_id, round(greatest(0, least(20000, (300 - value * 3) / 6.5 * 1000)), 6) AS height FROM fx_swath")
def f6_cloud_height(s, d):
    return rounded(view(s, d, "fx_swath").select("event_id", geo.cloud_height_m(F.col("value") * 3).alias("height")))


@R.add("""SELECT event_id, round(2 * 6371 * atan2(sqrt(h), sqrt(1 - h)), 6) AS km FROM (SELECT event_id, power(sin(radians(lat - 20) / 2), 2) +
  cos(radians(20)) * cos(radians(lat)) * power(sin(radians(lon - 80) / 2), 2) AS h FROM fx_swath)""")
def f10_haversine(s, d):
    return rounded(view(s, d, "fx_swath").select("event_id", geo.haversine_km(F.lit(20.0), F.lit(80.0), "lat", "lon").alias("km")))


@R.add("""SELECT event_id, round(sqrt(power(value, 2) + power(lat, 2)), 6) AS speed FROM fx_swath""")
def p18_wind_speed(s, d):
    return rounded(view(s, d, "fx_swath").select("event_id", scalar.wind_speed("value", "lat").alias("speed")))


NEAR = """g AS (SELECT r AS grid_row, c AS grid_col, 6 + r * (4e0 / 3) AS glat, 68 + c * (4e0 / 3) AS glon
    FROM (SELECT unnest(range(25)) AS r), (SELECT unnest(range(25)) AS c)),
  x AS (SELECT grid_row, grid_col, event_id, value, power(sin(radians(glat - lat) / 2), 2) + cos(radians(lat)) * cos(radians(glat)) *
    power(sin(radians(glon - lon) / 2), 2) AS h FROM g, fx_swath),
  k AS (SELECT *, 2 * 6371 * atan2(sqrt(h), sqrt(1 - h)) AS km FROM x)"""


@R.add(f"WITH {NEAR} SELECT grid_row, grid_col, arg_min(value, (round(km, 9), event_id)) AS value FROM k WHERE km <= 60 GROUP BY ALL")
def j5_regrid_nearest(s, d):
    points = view(s, d, "fx_swath")
    out = regrid.regrid_nearest(points, COARSE, radius_km=60.0, tie="event_id")
    return out.select(F.col("row").alias("grid_row"), F.col("col").alias("grid_col"), "value")


BILINEAR = """p AS (SELECT event_id AS k, 20 + (event_id * 37 % 2500) / 10000 AS lat, 77 + (event_id * 53 % 2500) / 10000 AS lon FROM events),
  a AS (SELECT *, round((lat - 20) * 12, 9) AS y, round((lon - 77) * 12, 9) AS x FROM p),
  w AS (SELECT k, CAST(floor(y) + i AS int) AS r, CAST(floor(x) + j AS int) AS c,
    (CASE i WHEN 1 THEN y - floor(y) ELSE 1 - y + floor(y) END) * (CASE j WHEN 1 THEN x - floor(x) ELSE 1 - x + floor(x) END) AS w
    FROM a, (VALUES (0), (1)) i(i), (VALUES (0), (1)) j(j)),
  v AS (SELECT lead, grid_row, grid_col, avg(rain_mm_h) AS value FROM fx_ensemble JOIN fx_cell USING (cell) GROUP BY ALL),
  u AS (SELECT DISTINCT lead FROM v)"""


@R.add(f"""WITH {BILINEAR}, z AS (SELECT u.lead, k, CASE WHEN count(*) = count(value) THEN sum(w * value) END AS value
  FROM w CROSS JOIN u LEFT JOIN v ON v.lead = u.lead AND grid_row = r AND grid_col = c WHERE w > 0 GROUP BY ALL)
  SELECT k, count(value) AS frames, round(sum(value), 3) AS total FROM z GROUP BY k""")
def j6_regrid_bilinear(s, d):
    """Every event's place, in every lead's mean frame."""
    cells = view(s, d, "fx_ensemble").join(view(s, d, "fx_cell"), "cell")
    cells = cells.groupBy("lead", F.col("grid_row").alias("row"), F.col("grid_col").alias("col")).agg(F.avg("rain_mm_h").alias("value"))
    k = view(s, d, "events").select(F.col("event_id").alias("k"))
    target = k.select("k", (20 + F.col("k") * 37 % 2500 / 10000).alias("lat"), (77 + F.col("k") * 53 % 2500 / 10000).alias("lon"))
    out = regrid.regrid_bilinear(cells, SMALL, target, ["k"], ["lead"])
    return rounded(out.groupBy("k").agg(F.count("value").alias("frames"), F.sum("value").alias("total")), 3)


@R.add("""SELECT window_id * 100 + lead AS slot, 'rain' AS channel, 0 AS level, grid_row AS "row", grid_col AS "col", round(avg(rain_mm_h), 6) AS value
  FROM fx_ensemble JOIN fx_cell USING (cell) GROUP BY ALL""")
def j7_regrid_stream(s, d):
    cells = view(s, d, "fx_ensemble").join(view(s, d, "fx_cell"), "cell")
    cells = cells.groupBy(
        (F.col("window_id") * 100 + F.col("lead")).alias("slot"), F.lit("rain").alias("channel"), F.lit(0).alias("level"),
        F.col("grid_row").alias("row"), F.col("grid_col").alias("col"), "lat", "lon",
    ).agg(F.avg("rain_mm_h").alias("value"))
    target = view(s, d, "fx_cell").select(F.col("grid_row").alias("row"), F.col("grid_col").alias("col"), "lat", "lon")
    return rounded(regrid.regrid_stream(cells, "continuous", SMALL, target))


@R.add("""SELECT stream, round(max(greatest(abs(lat - f), abs(lat - f))) * 111.32, 6) AS spread_km FROM (SELECT stream, slot_s % 7 AS cell,
    20 + (slot_s % 11) / 10 AS lat, first_value(20 + (slot_s % 11) / 10) OVER (PARTITION BY stream, slot_s % 7 ORDER BY slot_s) AS f
    FROM (SELECT stream, CAST(slot_s / 1800 AS bigint) AS slot_s FROM fx_frame)) GROUP BY stream""")
def a42_geolocation_spread(s, d):
    slot = (F.col("slot_s") / 1800).cast("long")
    f = frames(s, d).select("stream", (slot % 7).alias("cell"), slot.alias("frame"), (20 + (slot % 11) / 10).alias("lat"), (20 + (slot % 11) / 10).alias("lon"))
    return rounded(qc.geolocation_spread(f, ["stream"], ["cell"]).drop("shared"))


@R.add("SELECT stream AS satellite, max(slot_s) AS slot_s, arg_max(concat('v', lpad(CAST(n % 10 AS varchar), 2, '0')), concat('v', lpad(CAST(n % 10 AS varchar), 2, '0'))) AS version FROM fx_frame GROUP BY stream")
def s2_latest_granule(s, d):
    f = view(s, d, "fx_frame")
    version = F.concat(F.lit("v"), F.lpad((F.col("n") % 10).cast("string"), 2, "0"))
    cat = f.select(F.col("stream").alias("satellite"), F.lit(0).alias("slot"), version.alias("name"), version.alias("path"), "slot_s")
    newest = catalog.latest_granule(cat).withColumnRenamed("path", "version")
    last = cat.groupBy("satellite").agg(F.max("slot_s").alias("slot_s"))
    return newest.join(last, "satellite").select("satellite", "slot_s", "version")
