"""Registered queries: file names, stores, grids, polygons, parallax, channel checks, chunks and alert documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geo, scalar
from ..operators import advisory, assemble, attrib, impact, index, norm, qc, regrid, replay
from ..schema import BIT, CHANNELS
from ..sources import catalog, corpus, grd, grd_source, windows
from . import checks, products, verification
from .alignment import COARSE
from .fixtures import view
from .products import CH_SQL, CONTEXT, WIN_SQL, attr, context, policy, storm_rows, window
from .registry import Registry
from .verification import rounded

R = Registry()


def picked(values, index):
    """One of a few fixed values by an index counted from 0."""
    return F.element_at(F.array(*map(F.lit, values)), (index + 1).cast("int"))


def listed(values, index: str) -> str:
    """The same in SQL."""
    return "[" + ", ".join("NULL" if v is None else f"'{v}'" for v in values) + f"][CAST({index} AS int) + 1]"


# --- file names ----------------------------------------------------------------------


@R.add("""SELECT event_id, CASE event_id % 2 WHEN 0 THEN '3DIMG' ELSE '3DRIMG' END AS satellite,
  CASE WHEN event_id % 50 > 0 THEN CAST(floor(epoch(ts) / 60) AS bigint) * 60 END AS scan_s,
  CASE WHEN event_id % 50 > 0 THEN CAST(floor(epoch(ts) / 1800) AS bigint) * 1800 END AS slot_s FROM events""")
def s1_granule_catalog(s, d):
    """Names made of every event's time; one in fifty has an impossible date."""
    ts = F.col("ts").cast("timestamp")
    day = F.when(F.col("event_id") % 50 > 0, F.upper(F.date_format(ts, "ddMMMyyyy"))).otherwise("31FEB2024")
    name = F.concat(picked(["3DIMG", "3DRIMG"], F.col("event_id") % 2), F.lit("_"), day, F.lit("_"), F.date_format(ts, "HHmm"), F.lit("_L1C.h5"))
    found = catalog.with_slot(catalog.granule_catalog(view(s, d, "events").select("event_id", F.concat(F.lit("in/"), name).alias("path"))))
    return found.select("event_id", "satellite", F.unix_seconds("scan_time").alias("scan_s"), F.unix_seconds("slot").alias("slot_s"))


NWP_NAMES, NWP_LEVELS = ("u", "v", "t", "rh"), (850, 500, None)


@R.add(f"""WITH p AS (SELECT o_orderkey, {listed(NWP_NAMES, 'o_orderkey % 4')} AS variable, [850, 500, NULL][CAST(o_orderkey % 3 AS int) + 1] AS level,
    CAST(year(o_orderdate) AS int) AS year, CAST(month(o_orderdate) AS int) AS month FROM orders)
  SELECT *, 'nwp/' || variable || coalesce('_' || level, '') || '_' || year || lpad(CAST(month AS varchar), 2, '0') || '.nc' AS path FROM p""")
def s3_nwp_paths(s, d):
    k = F.col("o_orderkey")
    rows = view(s, d, "orders").select(
        "o_orderkey", picked(NWP_NAMES, k % 4).alias("variable"), picked(NWP_LEVELS, k % 3).alias("level"),
        F.year("o_orderdate").alias("year"), F.month("o_orderdate").alias("month"),
    )
    paths = catalog.render_nwp_path(rows, "nwp/").select("o_orderkey", "path")
    return catalog.parse_nwp_path(paths)


# --- grids ------------------------------------------------------------------------------

GRD = grd.GrdSpec(height=2, width=3)


@R.add("""WITH o AS (SELECT year(o_orderdate) AS y, CAST(o_orderdate AS date) AS day, o_custkey % 2 AS r, o_custkey % 3 AS c, CAST(count(*) AS double) AS value FROM orders GROUP BY ALL)
  SELECT CAST(day AS varchar) AS day, CAST(r AS int) AS "row", CAST(c AS int) AS col, 6.5 + r / 4 AS lat, 66.5 + c / 4 AS lon, value FROM o""")
def s4_read_grd(s, d):
    """Yearly grids of order counts, written as the archive lays them out and read by slices of days."""
    o = view(s, d, "orders").groupBy(
        F.to_date("o_orderdate").alias("date"), (F.col("o_custkey") % 2).cast("int").alias("row"), (F.col("o_custkey") % 3).cast("int").alias("col")
    ).agg(F.count("*").alias("value"))
    place = windows.shared_path(s, "grd")
    grd_source.write_days(o, place, GRD)
    out = grd_source.read_days(s, place, GRD).where("value is not null")
    return out.select(F.col("date").cast("string").alias("day"), "row", "col", "lat", "lon", F.col("value").cast("double").alias("value"))


@R.add("""WITH p AS (SELECT greatest(0, least(24, CAST(round_even((lat - 6) / (4e0 / 3), 0) AS int))) AS r, greatest(0, least(24, CAST(round_even((lon - 68) / (4e0 / 3), 0) AS int))) AS c
    FROM fx_swath WHERE lat BETWEEN 6 - 2e0 / 3 AND 38 + 2e0 / 3 AND lon BETWEEN 68 - 2e0 / 3 AND 100 + 2e0 / 3),
  g AS (SELECT r, c FROM (SELECT unnest(range(25)) AS r), (SELECT unnest(range(25)) AS c))
  SELECT CAST(g.r AS int) AS "row", CAST(g.c AS int) AS col, round(6 + g.r * (4e0 / 3), 6) AS lat, round(68 + g.c * (4e0 / 3), 6) AS lon,
    round(power(6371.0088, 2) * radians(4e0 / 3) * (sin(radians(6 + g.r * (4e0 / 3) + 2e0 / 3)) - sin(radians(6 + g.r * (4e0 / 3) - 2e0 / 3))), 3) AS area_km2, count(p.r) AS points
  FROM g LEFT JOIN p ON p.r = g.r AND p.c = g.c GROUP BY g.r, g.c""")
def s7_grid_cells(s, d):
    at = view(s, d, "fx_swath").select(geo.latlon_to_indices("lat", "lon", COARSE).alias("at")).where("at is not null")
    held = at.groupBy("at.row", "at.col").agg(F.count("*").alias("points"))
    cells = grd.grid_cells(s, COARSE).join(held, ["row", "col"], "left")
    return rounded(rounded(cells.drop("area_km2")).join(rounded(cells.select("row", "col", "area_km2"), 3), ["row", "col"]).withColumn("points", F.coalesce("points", F.lit(0))))


# Boxes about every supplier, a ring each; those of one nation are one district.
BOX = """b AS (SELECT n_name AS district, 8.013 + (s_suppkey * 7 % 240) / 10 AS y, 70.017 + (s_suppkey * 11 % 240) / 10 AS x FROM supplier JOIN nation ON n_nationkey = s_nationkey),
  g AS (SELECT r, c, 6 + r * (4e0 / 3) AS la, 68 + c * (4e0 / 3) AS lo FROM (SELECT unnest(range(25)) AS r), (SELECT unnest(range(25)) AS c))"""


def boxes(s, d):
    k = F.col("s_suppkey")
    at = view(s, d, "supplier").join(view(s, d, "nation"), F.col("n_nationkey") == F.col("s_nationkey")).select(
        F.lit("all").alias("state"), F.col("n_name").alias("district"), (8.013 + k * 7 % 240 / 10).alias("y"), (70.017 + k * 11 % 240 / 10).alias("x")
    )
    corner = lambda a, b: F.struct((F.col("y") + a).alias("lat"), (F.col("x") + b).alias("lon"))
    return at.select("state", "district", F.array(corner(-0.9, -1.1), corner(-0.9, 1.1), corner(0.9, 1.1), corner(0.9, -1.1)).alias("ring"))


@R.add(f"""WITH {BOX} SELECT DISTINCT district, CAST(r AS int) AS "row", CAST(c AS int) AS col FROM b JOIN g ON la + 2e0 / 3 >= y - 0.9 AND la - 2e0 / 3 <= y + 0.9
  AND lo + 2e0 / 3 >= x - 1.1 AND lo - 2e0 / 3 <= x + 1.1""")
def j12_cells_touched(s, d):
    return impact.district_cells(boxes(s, d), COARSE).select("district", "row", "col")


@R.add(f"""WITH {BOX} SELECT DISTINCT district, CAST(r AS int) AS "row", CAST(c AS int) AS col FROM b JOIN g ON la BETWEEN y - 0.9 AND y + 0.9 AND lo BETWEEN x - 1.1 AND x + 1.1""")
def j12_cells_within(s, d):
    return impact.district_cells(boxes(s, d), COARSE, "within").select("district", "row", "col")


@R.add("""WITH m AS (SELECT channel, map_row, map_col, sum(attribution) AS v FROM fx_attr GROUP BY ALL),
  a AS (SELECT o, greatest(0, least(7, (o + 0.5) * 0.5 - 0.5)) AS pos FROM (SELECT unnest(range(16)) AS o)),
  w AS (SELECT o, CAST(floor(pos) AS int) + i AS p, CASE i WHEN 0 THEN 1 - pos + floor(pos) ELSE pos - floor(pos) END AS w FROM a, (VALUES (0), (1)) t(i))
  SELECT channel, CAST(x.o AS int) AS "row", CAST(y.o AS int) AS col, round(sum(x.w * y.w * v), 6) AS value FROM m JOIN w x ON x.p = map_row AND x.w > 0 JOIN w y ON y.p = map_col AND y.w > 0 GROUP BY ALL""")
def j22_resize_map(s, d):
    maps = attr(s, d).groupBy("channel", F.col("map_row").alias("row"), F.col("map_col").alias("col")).agg(F.sum("attribution").cast("double").alias("value"))
    return rounded(regrid.resize_map(maps, 8, 16, ["channel"]))


# --- parallax ------------------------------------------------------------------------------

WGS = f"{geo.WGS84_A!r}", f"{geo.E2!r}"


def ecef_sql(lat: str, lon: str, h: str) -> tuple[str, str, str]:
    n = f"({WGS[0]} / sqrt(1 - {WGS[1]} * power(sin(radians({lat})), 2)))"
    return (
        f"({n} + {h}) * cos(radians({lat})) * cos(radians({lon}))",
        f"({n} + {h}) * cos(radians({lat})) * sin(radians({lon}))",
        f"({n} * (1 - {WGS[1]}) + {h}) * sin(radians({lat}))",
    )


def geodetic_sql(source: str, keep: str) -> str:
    """CTEs e0 to e5 over rows with x, y, z: latitude f in radians, and after five steps columns lat, lon, height as `gd`."""
    n = f"({WGS[0]} / sqrt(1 - {WGS[1]} * power(sin(f), 2)))"
    steps = [f"e0 AS (SELECT {keep}, x, y, z, sqrt(x * x + y * y) AS p, atan2(z, sqrt(x * x + y * y) * (1 - {WGS[1]})) AS f FROM {source})"]
    for i in range(5):
        steps.append(f"e{i + 1} AS (SELECT {keep}, x, y, z, p, atan2(z, p * (1 - {WGS[1]} * {n} / (p / greatest(cos(f), 1e-12)))) AS f FROM e{i})")
    return ", ".join(steps) + f", gd AS (SELECT {keep}, degrees(f) AS lat, degrees(atan2(y, x)) AS lon, p / greatest(cos(f), 1e-12) - {n} AS height FROM e5)"


_X, _Y, _Z = ecef_sql("lat", "lon", "(value * 100)")


@R.add(f"SELECT event_id, round({_X}, 3) AS x, round({_Y}, 3) AS y, round({_Z}, 3) AS z FROM fx_swath")
def f7_geodetic_to_ecef(s, d):
    at = view(s, d, "fx_swath").select("event_id", geo.geodetic_to_ecef("lat", "lon", F.col("value") * 100).alias("e"))
    return rounded(at.select("event_id", "e.*"), 3)


@R.add(f"WITH q AS (SELECT event_id, {_X} AS x, {_Y} AS y, {_Z} AS z FROM fx_swath), {geodetic_sql('q', 'event_id')} SELECT event_id, round(lat, 6) AS lat, round(lon, 6) AS lon, round(height, 3) + 0 AS height FROM gd")
def f8_ecef_to_geodetic(s, d):
    at = view(s, d, "fx_swath").select("event_id", geo.geodetic_to_ecef("lat", "lon", F.col("value") * 100).alias("e"))
    back = at.select("event_id", geo.ecef_to_geodetic("e.x", "e.y", "e.z").alias("g")).select("event_id", "g.lat", "g.lon", "g.height")
    return rounded(rounded(back.drop("height")).join(rounded(back.select("event_id", F.col("height")), 3), "event_id")).withColumn("height", F.col("height") + 0)


_GX, _GY, _GZ = ecef_sql("lat", "lon", "0")
_SAT = geo.WGS84_A + 35_786_000.0
_STRETCH = geo.WGS84_A / geo.WGS84_B
SHIFT = f"""sw AS (SELECT event_id, lat, lon, event_id % 4 AS frame, CASE WHEN event_id % 9 > 0 THEN greatest(0, least(20000, (300 - (200 + event_id % 110)) / 6.5 * 1000)) END AS h FROM fx_swath),
  rr AS (SELECT *, {_GX} - {_SAT!r} * cos(radians(82)) AS rx, {_GY} - {_SAT!r} * sin(radians(82)) AS ry, {_GZ} AS rz FROM sw),
  qq AS (SELECT *, rx * rx + ry * ry + power(rz * {_STRETCH!r}, 2) AS sq, 2 * (rx * {_SAT!r} * cos(radians(82)) + ry * {_SAT!r} * sin(radians(82))) AS al,
    power({_SAT!r}, 2) - power({geo.WGS84_A!r} + h, 2) AS o FROM rr),
  tt AS (SELECT *, CASE WHEN h > 0 AND al * al - 4 * sq * o >= 0 AND sq > 0 THEN (-al - sqrt(al * al - 4 * sq * o)) / (2 * sq) END AS t FROM qq),
  mo AS (SELECT event_id, rx * t + {_SAT!r} * cos(radians(82)) AS x, ry * t + {_SAT!r} * sin(radians(82)) AS y, rz * t AS z FROM tt WHERE t > 0), {geodetic_sql('mo', 'event_id')},
  pc AS (SELECT sw.event_id, frame, coalesce(gd.lat, sw.lat) AS lat, coalesce(gd.lon, sw.lon) AS lon, gd.lat IS NOT NULL AS moved, power(sin(radians(gd.lat - sw.lat) / 2), 2) +
    cos(radians(sw.lat)) * cos(radians(gd.lat)) * power(sin(radians(gd.lon - sw.lon) / 2), 2) AS hv FROM sw LEFT JOIN gd USING (event_id))"""


def seen(s, d):
    k = F.col("event_id")
    ctt = F.when(k % 9 > 0, (200 + k % 110).cast("double"))
    cells = view(s, d, "fx_swath").select("event_id", (k % 4).alias("frame"), "lat", "lon", ctt.alias("ctt"), F.lit(BIT["PARALLAX_UNCORRECTED"]).alias("qc_flag"))
    return qc.corrected_parallax(cells)


@R.add(f"WITH {SHIFT} SELECT event_id, round(lat, 6) AS lat, round(lon, 6) AS lon, moved, CASE WHEN moved THEN 0 ELSE 256 END AS qc_flag FROM pc")
def f9_parallax(s, d):
    return rounded(seen(s, d).select("event_id", "lat", "lon", "moved", "qc_flag"))


@R.add(f"""WITH {SHIFT} SELECT frame, round(avg(km), 4) AS mean_km, round(max(coalesce(km, 0)), 4) AS max_km, count_if(moved) AS cells_moved
  FROM (SELECT frame, moved, 2 * 6371 * atan2(sqrt(hv), sqrt(1 - hv)) AS km FROM pc) GROUP BY frame""")
def a43_parallax_report(s, d):
    return rounded(qc.parallax_report(seen(s, d), ["frame"]), 4)


# --- channels ---------------------------------------------------------------------------------

NAMES = [c[1] for c in CHANNELS] + ["radar"]


@R.add(f"""SELECT l_orderkey, l_linenumber, {listed(["u", "v", "t", "rh", "z", "q"], "l_partkey % 6")} || [200, 500, 700, 850, 900][CAST(l_suppkey % 5 AS int) + 1] AS channel,
  CASE WHEN l_partkey % 6 < 5 AND l_suppkey % 5 < 4 THEN {listed(["u", "v", "t", "rh", "z", "q"], "l_partkey % 6")} END AS variable,
  CASE WHEN l_partkey % 6 < 5 AND l_suppkey % 5 < 4 THEN [200, 500, 700, 850, 900][CAST(l_suppkey % 5 AS int) + 1] END AS level FROM lineitem""")
def p10_split_level(s, d):
    name = F.concat(picked(["u", "v", "t", "rh", "z", "q"], F.col("l_partkey") % 6), picked(["200", "500", "700", "850", "900"], F.col("l_suppkey") % 5))
    rows = view(s, d, "lineitem").select("l_orderkey", "l_linenumber", name.alias("channel"))
    return rows.withColumn("s", scalar.split_level_channel("channel")).select("l_orderkey", "l_linenumber", "channel", "s.variable", "s.level")


@R.add(f"""SELECT l_orderkey, l_linenumber, CASE WHEN k < 3 THEN 'insat' WHEN k < 23 THEN 'imdaa' WHEN k < 27 THEN 'imd_surface' WHEN k < 30 THEN 'static' ELSE 'unknown' END AS provenance,
  {listed(NAMES, "k")} AS channel FROM (SELECT *, l_partkey % 31 AS k FROM lineitem)""")
def p11_channel_provenance(s, d):
    rows = view(s, d, "lineitem").select("l_orderkey", "l_linenumber", picked(NAMES, F.col("l_partkey") % 31).alias("channel"))
    return rows.withColumn("provenance", scalar.channel_provenance("channel"))


@R.add("SELECT event_id, CASE WHEN event_id % 4 < 2 THEN 'EPSG:4326' END AS crs FROM events")
def p13_detect_crs(s, d):
    kind = picked(["regular_ll", "LatLon", "lambert", None], F.col("event_id") % 4)
    return view(s, d, "events").select("event_id", scalar.detect_crs(kind).alias("crs"))


@R.add("SELECT event_id, ['2t', 't2m', 'tp', 'other'][CAST(event_id % 4 AS int) + 1] AS name, ['temp_2m', 'temp_2m', 'imd_precip', NULL][CAST(event_id % 4 AS int) + 1] AS variable FROM events")
def p19_resolve_alias(s, d):
    aliases = s.createDataFrame([("temp_2m", "2t", "t2m"), ("imd_precip", "tp", "precip")], "variable string, short_name string, key string")
    cells = view(s, d, "events").select("event_id", picked(["2t", "t2m", "tp", "other"], F.col("event_id") % 4).alias("name"))
    return assemble.resolve_alias(cells, aliases).select("event_id", "name", "variable")


WIN_DIMS = [(0, "c0"), (1, "c1"), (2, "c2")]


def dims(s):
    return s.createDataFrame(WIN_DIMS, "idx int, channel string")


@R.add(f"WITH {WIN_SQL} SELECT valid_time, t, cell, value FROM w WHERE channel = 'c1'")
def p21_channel(s, d):
    return assemble.channel(window(s, d), dims(s), "c1").select("valid_time", "t", "cell", "value")


@R.add(f"WITH {WIN_SQL} SELECT CAST(right(channel, 1) AS int) AS idx, channel, count(*) AS cells FROM w GROUP BY ALL")
def u4_partition(s, d):
    """Channels found in the windows cover the declared ones exactly; else the job fails."""
    held = window(s, d).groupBy(F.substring("channel", 2, 1).cast("int").alias("idx"), "channel").agg(F.count("*").alias("cells"))
    assemble.assert_partition(held, dims(s))
    return held


@R.add(f"WITH {WIN_SQL} SELECT valid_time, CAST(right(channel, 1) AS int) AS channel_idx, channel, count(value) AS present FROM w GROUP BY ALL")
def v3_channel_order(s, d):
    w = assemble.stack_channels([window(s, d)], dims(s))
    assemble.assert_channel_order(w, dims(s))
    return w.groupBy("valid_time", "channel_idx", "channel").agg(F.count("value").alias("present"))


@R.add("SELECT year(o_orderdate) AS y, count(*) AS orders, 16 AS cells FROM orders GROUP BY 1")
def v15_dense_frames(s, d):
    """A frame of 4 x 4 cells a year; a frame with another number of cells fails the job."""
    years = view(s, d, "orders").groupBy(F.year("o_orderdate").cast("long").alias("y")).agg(F.count("*").alias("orders"))
    cells = years.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(15)))).select("y", "orders", F.floor(F.col("k") / 4).alias("row"), (F.col("k") % 4).alias("col"))
    assemble.assert_dense(cells, ["y"], 4, 4)
    return cells.groupBy("y", "orders").agg(F.count("*").cast("int").alias("cells"))


@R.add(f"""WITH {CH_SQL}, b AS (SELECT channel, CASE channel WHEN 'c0' THEN (ln(1 + pm) - lo) / (hi - lo) WHEN 'c1' THEN greatest(-6, least(6, (sqrt(pm) - mean) / std))
    WHEN 'c2' THEN greatest(-6, least(6, (pm - mean) / std)) END AS v FROM st)
  SELECT window_id, lead, cell, member, round(CASE channel WHEN 'c3' THEN value ELSE coalesce(v, 0) END, 6) + 0 AS baseline FROM ch JOIN b USING (channel)""")
def f22_expand_baseline(s, d):
    baseline = norm.channel_baseline(products.stats(s, d), policy(s))
    out = norm.expand_baseline(products.channels(s, d), baseline).select("window_id", "lead", "cell", "member", "baseline")
    return rounded(out).withColumn("baseline", F.col("baseline") + 0)


@R.add("""SELECT channel, round(sum(attribution), 6) AS total, round(abs(sum(attribution) - 100), 6) AS residual,
  abs(sum(attribution) - 100) <= 0.5 * greatest(abs(sum(attribution)), 1e-6) AS converged FROM fx_attr GROUP BY channel""")
def a28_convergence(s, d):
    return rounded(attrib.convergence_check(attr(s, d).withColumn("attribution", F.col("attribution").cast("double")), 100.0, 0.5, ["channel"]))


# --- stores ------------------------------------------------------------------------------------


@R.add(f"WITH {CH_SQL} SELECT channel, round(mean, 6) AS mean, round(std, 6) AS std, round(lo, 6) AS min, round(hi, 6) AS max, n AS count, 'lineitem' AS source FROM st")
def s10_load_channel_stats(s, d):
    """Statistics written as one JSON document and loaded again."""
    path = windows.shared_path(s, "channel-stats")
    entry = F.struct("channel", F.struct("mean", "std", "min", "max", "count", "source"))
    whole = products.stats(s, d).agg(F.to_json(F.map_from_entries(F.collect_list(entry))).alias("value"))  # one entry a channel
    whole.write.text(path)
    return rounded(windows.load_channel_stats(s, path, ["c0", "c1", "c2", "c3"]))


STORE_SQL = """SELECT o_orderkey, CAST(epoch(date_trunc('month', o_orderdate)) AS bigint) AS t, o_orderkey % 5 > 0 AS accepted, o_custkey AS v FROM orders"""


@R.add(f"SELECT t, count(*) AS windows, count_if(accepted) AS kept, coalesce(sum(CASE WHEN accepted THEN v END), 0) AS total FROM ({STORE_SQL}) GROUP BY t")
def s11_window_store(s, d):
    """A window an order, at its month, written under a fingerprint beside stale ones, and read back; rejected ones keep no values."""
    ok = F.col("o_orderkey") % 5 > 0
    w = view(s, d, "orders").select(
        F.date_trunc("month", "o_orderdate").alias("valid_time"), F.lit("input").alias("kind"), ok.alias("accepted"), F.when(~ok, F.lit("gap")).alias("reason"), F.col("o_custkey").alias("value")
    )
    w = w.repartition("valid_time")  # so that a day's folder has few files
    root, fp = windows.shared_path(s, "window-store"), windows.fingerprint({"frames": 13})
    windows.write_windows(w, root, fp)
    windows.write_windows(w.where("accepted"), root, windows.fingerprint({"frames": 12}))
    got = windows.read_windows(s, root, fp).groupBy(F.unix_seconds("valid_time").alias("t"))
    return got.agg(F.count("*").alias("windows"), F.count_if("accepted").alias("kept"), F.coalesce(F.sum("value"), F.lit(0)).cast("long").alias("total"))


@R.add("SELECT count(*) AS windows, count(*) * 13 * 30 * 384 * 384 * 4 AS bytes FROM (SELECT DISTINCT CAST(floor(epoch(ts) / 1800) AS bigint) FROM events)")
def s12_projected_bytes(s, d):
    slots = view(s, d, "events").select(F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 1800)).distinct()
    return windows.projected_bytes(slots, windows.bytes_per_window(13, 30, 384, 384))


@R.add("""SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'no front matter' WHEN 1 THEN 'missing severity_tier' ELSE CASE WHEN length(b) = 0 THEN 'empty body' END END AS skipped,
  CASE WHEN doc_id % 4 > 0 THEN length(b) ELSE 0 END AS body_chars FROM (SELECT doc_id, regexp_replace(regexp_replace(coalesce(text, ''), '^\\s+', ''), '\\s+$', '') AS b FROM documents)""")
def s13_parse_documents(s, d):
    """Every document's text behind front matter; some lack it, or one of its keys."""
    k = F.col("doc_id") % 4
    tier = F.when(k == 1, "").otherwise("severity_tier: high\n")
    front = F.when(k > 0, F.concat(F.lit("---\nhazard_class: flash_flood\n"), tier, F.lit("region: plains\n---\n"))).otherwise("")
    out = corpus.parse_documents(view(s, d, "documents").select("doc_id", F.concat(front, F.coalesce("text", F.lit(""))).alias("text")))
    return out.select("doc_id", "skipped", F.length("body").cast("long").alias("body_chars"))


@R.add("SELECT hazard_class, count(*) AS chunks FROM fx_chunk GROUP BY ALL")
def s14_chunk_store(s, d):
    """Chunks written with where they come from; a store of another model or width is refused (V11)."""
    path = windows.shared_path(s, "chunks")
    windows.write_chunks(view(s, d, "fx_chunk"), path, model="m", dims=64, corpus_label="sample")
    return windows.read_chunks(s, path, model="m", dims=64).groupBy("hazard_class").agg(F.count("*").alias("chunks"))


@R.add(verification.SCORE)
def s15_metrics(s, d):
    path = windows.shared_path(s, "metrics")
    windows.write_metrics(verification.a10_score(s, d), path)
    return windows.read_metrics(s, path)


@R.add(f"WITH {products.ROWS_SQL} SELECT t_s, score FROM sr ORDER BY score DESC, t_s LIMIT 10")
def s16_reservoir_file(s, d):
    """The ten strongest leads as a reservoir file; ten is its capacity."""
    path = windows.shared_path(s, "reservoir")
    rows = storm_rows(s, d).select("t_s", "score", F.col("score").alias("reservoir_key"))
    windows.save_reservoir(replay.weighted_reservoir(rows, 10, tie="t_s"), path, 10)
    return windows.load_reservoir(s, path, 10).select("t_s", "score")


@R.add("""SELECT o_orderkey, substr(sha256('{"clerk":"' || o_clerk || '","priority":"' || o_orderpriority || '"}'), 1, 16) AS fingerprint FROM orders"""
       .replace("o_clerk", "CAST(o_custkey AS varchar)"))
def f20_fingerprint(s, d):
    config = F.create_map(F.lit("priority"), "o_orderpriority", F.lit("clerk"), F.col("o_custkey").cast("string"))
    return view(s, d, "orders").select("o_orderkey", windows.fingerprint_of(config).alias("fingerprint"))


@R.add(f"""{verification.SPLIT_SQL} SELECT year, count(*) AS records FROM sp WHERE split = 'train' GROUP BY year""")
def v12_train_only(s, d):
    """Records of the training side; one of another side fails the job."""
    sides = verification.split(s, d)
    records = sides.where("split = 'train'").select("year", "valid_time")
    index.assert_train_only(records, sides)
    return records.groupBy("year").agg(F.count("*").alias("records"))


@R.add("""SELECT o_orderkey, array_to_string(list_filter([CASE WHEN k % 7 = 0 OR k % 11 = 0 THEN 'grid' END, CASE WHEN k % 13 = 0 OR k % 17 < 2 THEN 'time' END, CASE WHEN k % 5 = 0 THEN 'leak' END,
    CASE WHEN k % 19 = 0 THEN 'bands' END, CASE WHEN k % 3 = 0 OR k % 23 = 0 THEN 'replay' END, CASE WHEN k % 4 = 1 THEN 'methods' END, CASE WHEN k % 6 = 2 OR k % 29 = 0 THEN 'gates' END],
    lambda x: x IS NOT NULL), ',') AS faults FROM (SELECT o_orderkey, o_orderkey AS k FROM orders)""")
def v4_v10_config_faults(s, d):
    """A run's configuration an order, each wrong in places that its key says (V4 to V10 and V14)."""
    k = F.col("o_orderkey")
    wrong = lambda step, bad, good, at=0: F.when(k % step == at, F.lit(bad)).otherwise(F.lit(good))
    back = F.sequence(F.lit(-12), F.when(k % 13 == 0, F.lit(-1)).otherwise(F.lit(0)))
    runs = view(s, d, "orders").select(
        "o_orderkey", wrong(7, 96, 384).alias("height"), F.lit(384).alias("width"), F.lit(6.0).alias("lat_min"), F.lit(38.0).alias("lat_max"),
        wrong(11, 101.0, 68.0).alias("lon_min"), F.lit(100.0).alias("lon_max"), F.lit(1 / 12).alias("resolution"), back.alias("lookback"),
        F.when(k % 17 == 0, F.sequence(F.lit(2), F.lit(12))).otherwise(F.sequence(F.lit(1), F.lit(12))).alias("leads"), wrong(17, 7, 30, 1).alias("step_minutes"),
        F.lit("2017-06-01").alias("record_from"), F.lit("2020-09-30").alias("record_to"), F.lit("2017-06-01").alias("reference_from"),
        wrong(5, "2020-06-30", "2019-09-30").alias("reference_to"), F.lit("2019-09-30").alias("train_until"), F.lit("2020-06-01").alias("validation_from"),
        F.when(k % 19 == 0, F.array(F.lit(0.3), F.lit(0.15))).otherwise(F.array(F.lit(0.15), F.lit(0.3))).alias("bands"), F.array(F.lit(2.5), F.lit(7.5)).alias("classes"),
        wrong(3, 35.0, 15.0).alias("heavy_mm_h"), F.lit(15.0).alias("monitor_mm_h"), F.lit(5).alias("gate_frames"), wrong(23, 1.5, 0.9).alias("quantile"),
        F.lit("nearest").alias("categorical"), wrong(4, "linear", "hold", 1).alias("precipitation"), F.lit(0.0).alias("min_area"), wrong(6, 0.0, 0.05, 2).alias("min_fraction"),
        wrong(29, "", "district").alias("dissolve_key"), F.lit(20.0).alias("coast_m"), F.lit(500.0).alias("mountain_m"),
    )
    return checks.config_faults(runs).select("o_orderkey", F.concat_ws(",", "faults").alias("faults"))


# --- chunks and alert documents -------------------------------------------------------------------


@R.add("""WITH RECURSIVE p AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(coalesce(text, ''), '\\n\\s*\\n'), lambda x: regexp_replace(regexp_replace(x, '^\\s+', ''), '\\s+$', '')),
      lambda x: length(x) > 0) AS ps FROM documents),
  b AS (SELECT doc_id, array_to_string(ps, chr(10) || chr(10)) AS t, list_transform(range(1, len(ps) + 1), lambda k: list_sum(list_transform(ps[1:k], lambda x: length(x))) + 2 * (k - 1)) AS ends FROM p),
  c AS (SELECT doc_id, 0 AS n, CAST(0 AS bigint) AS start, CAST(0 AS bigint) AS done FROM b WHERE length(t) > 0 UNION ALL
    SELECT doc_id, n + 1, CASE WHEN reach > done THEN s0 WHEN e - f <= 1200 THEN e - 1200 ELSE s0 END,
      CASE WHEN reach > done THEN reach WHEN e - f <= 1200 THEN e WHEN gap > 0 THEN done + 1 + length(seg) - gap ELSE s0 + 1200 END
    FROM (SELECT *, substr(t, done + 2, s0 + 1200 - done) AS seg, instr(reverse(substr(t, done + 2, s0 + 1200 - done)), ' ') AS gap,
        CASE WHEN done = 0 OR NOT list_contains(ends, done) THEN done ELSE done + 2 END AS f
      FROM (SELECT c.*, t, ends, greatest(0, done - 150) AS s0, coalesce(list_max(list_filter(ends, lambda x: x <= greatest(0, done - 150) + 1200)), 0) AS reach,
          list_min(list_filter(ends, lambda x: x > done)) AS e FROM c JOIN b USING (doc_id) WHERE done < length(t))))
  SELECT doc_id, count(*) AS chunks, CAST(sum(done - start) AS bigint) AS reached, CAST(sum((n + 1) * start) AS bigint) AS places FROM c WHERE n > 0 GROUP BY doc_id""")
def f16_chunk_spans(s, d):
    """Of every document's whole text: how many chunks, and where they start and stop."""
    rows = view(s, d, "documents").select(F.col("doc_id").cast("string").alias("document"), F.col("text").alias("body"))
    cut = corpus.chunk_places(rows)
    return cut.groupBy(F.col("document").cast("long").alias("doc_id")).agg(
        F.count("*").alias("chunks"), F.sum(F.col("stop") - F.col("start")).alias("reached"), F.sum((F.col("n") + 2) * F.col("start")).alias("places")
    )


def alerted(s, d):
    """Impacts with context, times and a text of their own."""
    times = F.timestamp_seconds(F.col("window_id") * 86400 + 1496275200)
    rows = impact.impact_times(context(s, d).drop("onset_hours").withColumn("valid_time", times))
    guide = F.array(F.struct(F.lit("k1").alias("chunk_id"), F.lit("src").alias("source"), F.lit(" wait ").alias("text")))
    drive = F.array(F.struct(F.lit("u850").alias("channel"), F.lit("raised").alias("direction")))
    return rows.withColumns(
        {
            "corpus": F.lit("sample"), "grounded": F.lit(False), "headline": F.lit("H"), "description": F.lit("D"), "instruction": F.lit("I"),
            "cap_severity": advisory.cap_severity_floor(F.col("severity")), "cap_urgency": advisory.cap_urgency(F.col("onset_hours")), "cap_certainty": F.lit("Likely"),
            "guidelines": F.when(F.col("window_id") % 2 == 0, guide).otherwise(F.slice(guide, 1, 0)), "drivers": drive, "empty_reason": F.lit("none fits"),
        }
    )


ALERT_SQL = f"""{CONTEXT}, al AS (SELECT *, 'Heavy Rainfall - ' || CASE hazard_class WHEN 'flash_flood' THEN 'Flash Flood' ELSE 'Urban Waterlogging' END AS event,
  CASE WHEN onset_hours <= 2 THEN 'Immediate' WHEN onset_hours <= 6 THEN 'Expected' ELSE 'Future' END AS urgency, CASE severity WHEN 'low' THEN 'Minor' WHEN 'moderate' THEN 'Moderate'
  WHEN 'high' THEN 'Severe' ELSE 'Extreme' END AS cap_severity, district || ', ' || state AS area_desc, 1496275200 + window_id * 86400 AS sent_s FROM cx)"""


@R.add(f"WITH {ALERT_SQL} SELECT window_id, state, district, event, urgency, cap_severity, area_desc, sent_s, CAST(sent_s + onset_hours * 3600 AS bigint) AS onset_s FROM al")
def d12_build_alerts(s, d):
    built = advisory.build_alerts(alerted(s, d)).select("window_id", "state", "district", "alert.sent", F.col("alert.info")[0].alias("i"))
    return built.select(
        "window_id", "state", "district", "i.event", "i.urgency", F.col("i.severity").alias("cap_severity"), F.col("i.area")[0]["area_desc"].alias("area_desc"),
        F.unix_seconds("sent").alias("sent_s"), F.unix_seconds("i.onset").alias("onset_s"),
    )


@R.add(f"WITH {ALERT_SQL} SELECT window_id, state, district, event AS json_event, area_desc AS json_area, '<event>' || event || '</event>' AS xml_event FROM al")
def s17_alert_documents(s, d):
    built = windows.cap_xml(windows.cap_json(advisory.build_alerts(alerted(s, d))))
    at = lambda p: F.get_json_object("cap_json", f"$.info[0].{p}")
    return built.select(
        "window_id", "state", "district", at("event").alias("json_event"), at("area[0].area_desc").alias("json_area"),
        F.regexp_extract("cap_xml", "<event>.*?</event>", 0).alias("xml_event"),
    )


@R.add(f"""WITH {ALERT_SQL}, pt AS (SELECT *, expiry_lead / 2 + 0.5 AS expiry_hours FROM al), st AS (SELECT *, strftime(make_timestamp(sent_s * 1000000), '%Y-%m-%dT%H:%M:%SZ') AS sent,
    strftime(make_timestamp(CAST(sent_s + onset_hours * 3600 AS bigint) * 1000000), '%Y-%m-%dT%H:%M:%SZ') AS onset, strftime(make_timestamp(CAST(sent_s + expiry_hours * 3600 AS bigint) * 1000000), '%Y-%m-%dT%H:%M:%SZ') AS expiry FROM pt)
  SELECT window_id, state, district, array_to_string(['[situation]', 'place = ' || area_desc, 'issued = ' || sent, 'starts = ' || onset || ', in ' || printf('%.1f', onset_hours) || ' h',
    'ends = ' || expiry || ', in ' || printf('%.1f', expiry_hours) || ' h', 'chance of heavy rain = ' || CAST(CAST(round_even(peak_probability * 100, 0) AS int) AS varchar) || '%',
    'area hit = ' || CAST(CAST(round_even(affected_area_km2, 0) AS bigint) AS varchar) || ' km2, ' || CAST(CAST(round_even(affected_fraction * 100, 0) AS int) AS varchar) || '% of the place',
    'band = ' || severity, 'strongest rain = ' || CAST(CAST(round_even(peak_intensity, 0) AS bigint) AS varchar) || ' mm/h', 'hazard = ' || hazard_class, 'terrain = ' || region,
    '[what moved the forecast]', 'u850 raised it', '[guidelines to draw on]', CASE WHEN window_id % 2 = 0 THEN 'k1 from src: wait' ELSE 'nothing found: none fits' END], chr(10)) AS prompt FROM st""")
def f14_prompt_text(s, d):
    rows = alerted(s, d)
    return rows.select("window_id", "state", "district", advisory.prompt_text().alias("prompt"))
