"""Known answers: small inputs whose results are worked out by hand."""

from __future__ import annotations

import datetime as dt
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from stratolab.functions import geo, scalar
from stratolab.functions.geo import Grid
from stratolab.operators import advisory, assemble, dashboard, impact, index, norm, qc, regrid, replay, sync, verify
from stratolab.plans import checks, inputs
from stratolab.schema import BIT, CHANNELS
from stratolab.sources import catalog, corpus, grd, windows


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


# --- verification ------------------------------------------------------------------


def pairs(spark, members, observed):
    rows = [(0, 0, c, m, float(v), None if observed[c] is None else float(observed[c])) for m, vs in enumerate(members) for c, v in enumerate(vs)]
    frame = spark.createDataFrame(rows, "window_id int, lead int, cell int, member int, rain_mm_h double, observed double")
    return frame.where("observed is not null")


def test_contingency_counts(spark):
    said, seen = [[14, 3, 30, 1, 13]], [13, 12, 5, 0, 40]
    r = verify.contingency(pairs(spark, said, seen), 12.0).first()
    assert (r.hits, r.misses, r.false_alarms, r.correct_negatives) == (2, 1, 1, 1)
    s = verify.skill(verify.contingency(pairs(spark, said, seen), 12.0)).first()
    assert (s.csi, s.pod, s.far, s.events_observed) == (0.5, pytest.approx(2 / 3), pytest.approx(1 / 3), 3)


def test_threshold_is_inclusive_and_masks_count_nowhere(spark):
    r = verify.contingency(pairs(spark, [[12, 50, 4]], [12, None, 12.5]), 12.0).first()
    assert (r.hits, r.false_alarms, r.misses, r.correct_negatives) == (1, 0, 1, 0)


def test_undefined_score_is_null(spark):
    s = verify.skill(verify.contingency(pairs(spark, [[3, 5, 7]], [1, 2, 3]), 12.0)).first()
    assert s.csi is None and s.pod is None and s.far is None and s.events_observed == 0


def test_mean_over_members(spark):
    s = verify.skill(verify.contingency(pairs(spark, [[30], [40], [5]], [25]), 12.0)).first()
    assert s.csi == pytest.approx(2 / 3)


def test_pooling_counts_beats_averaging_scores(spark):
    rows = [(7, 3, 1, 0, 2, 12.0), (7, 0, 1, 4, 9, 12.0)]  # alone 3/4 and 0, pooled 3 of 9
    t = spark.createDataFrame(rows, "member int, hits int, misses int, false_alarms int, correct_negatives int, threshold double")
    assert verify.skill(verify.pool_tables(t)).first().csi == pytest.approx(1 / 3)
    mixed = t.unionByName(t.withColumn("threshold", F.lit(3.5)))
    with pytest.raises(Exception, match="do not pool"):
        verify.pool_tables(mixed).collect()


def test_mae_and_crps(spark):
    assert verify.ensemble_mae(pairs(spark, [[4], [9], [11]], [6])).first().mae == 2.0
    assert verify.crps(pairs(spark, [[7], [7], [7]], [3])).first().crps == 4.0
    assert verify.crps(pairs(spark, [[1], [5]], [4])).first().crps == 1.0  # mean distance 2, half the spread 1


def test_score_takes_the_metrics_asked_for(spark):
    p = pairs(spark, [[1, 20], [5, 20]], [4, 20])
    names = lambda m: {r.name for r in verify.score(p, 12.0, "heavy", m).collect()}
    assert names(("crps",)) == {"crps", "windows"} and names(("far", "mae")) == {"far_heavy", "events_observed", "mae", "windows"}
    got = {r.name: r.value for r in verify.score(p, 12.0, "heavy").collect()}
    assert got == {"csi_heavy": 1.0, "pod_heavy": 1.0, "far_heavy": 0.0, "events_observed": 2.0, "mae": 0.5, "crps": 0.5, "windows": 1.0}
    for wrong in ({"threshold": 0.0}, {"metrics": ("bias",)}, {"metrics": ()}):
        with pytest.raises(ValueError):
            verify.score(p, **({"threshold": 12.0, "band": "heavy"} | wrong))


def gate(spark, cand, inc):
    kind = "name string, value double"
    row = lambda m: [(k, v) for k, v in m.items()]
    return verify.promotion_gate(verify.gate_join(spark.createDataFrame(row(cand), kind), spark.createDataFrame(row(inc), kind))).first()


BASE = {"csi_heavy": 0.31, "far_heavy": 0.52, "crps": 2.4, "events_observed": 340.0}


@pytest.mark.parametrize(
    ("change", "promote", "reason"),
    [
        ({"csi_heavy": 0.35}, True, "improved"),
        ({"csi_heavy": 0.313}, False, "short_of_delta"),
        ({"csi_heavy": 0.35, "far_heavy": 0.6}, False, "regressed:far_heavy"),
        ({"csi_heavy": 0.35, "events_observed": 12.0}, False, "event_floor"),
        ({"csi_heavy": float("nan")}, False, "undefined_monitor"),
    ],
)
def test_gate_decisions(spark, change, promote, reason):
    r = gate(spark, BASE | change, BASE)
    assert r.promote is promote and reason in r.reasons


def test_gate_without_an_incumbent(spark):
    r = gate(spark, BASE, {})
    assert r.promote and r.reasons == ["first_model"] and r.delta is None
    r = gate(spark, BASE, {"crps": 2.6})
    assert r.promote and r.reasons == ["unknown_incumbent"]


def test_direction():
    assert verify.higher_is_better("csi_heavy") and not verify.higher_is_better("far_heavy")
    with pytest.raises(ValueError, match="direction"):
        verify.higher_is_better("bias")


# --- grid ------------------------------------------------------------------------------


def test_corners_and_outside(spark):
    at = lambda la, lo: one(spark, geo.latlon_to_indices(F.lit(la), F.lit(lo)).alias("x")).x
    assert tuple(at(6.0, 68.0)) == (0, 0) and tuple(at(38.0, 100.0)) == (383, 383)
    assert at(45.0, 77.0) is None and tuple(at(6 - 1 / 25, 68.0)) == (0, 0)


def test_areas(spark):
    rows = spark.range(384).select(geo.cell_area_km2(F.col("id")).alias("a")).agg(F.min("a"), F.max("a"), F.sum("a")).first()
    assert 67 < rows[0] < 68 and 85 < rows[1] < 86 and 9.0e6 < rows[2] * 384 < 1.3e7
    for lat, area in ((8, 85.0), (20, 80.7), (30, 74.4)):
        assert one(spark, geo.cell_area_km2(F.lit((lat - 6) * 12)).alias("a")).a == pytest.approx(area, abs=0.1)


def test_geodetic_round_trip(spark):
    e = geo.geodetic_to_ecef(F.lit(23.5), F.lit(78.25), F.lit(12_000.0))
    r = one(spark, geo.ecef_to_geodetic(e["x"], e["y"], e["z"]).alias("g")).g
    assert (r.lat, r.lon) == (pytest.approx(23.5, abs=1e-9), pytest.approx(78.25, abs=1e-9)) and r.height == pytest.approx(12_000, abs=1e-3)


def test_parallax(spark):
    p = lambda la, lo, h: one(spark, geo.parallax_corrected(F.lit(la), F.lit(lo), F.lit(h)).alias("p")).p
    under = p(0.0, 82.0, 12_000.0)
    assert (under.lat, under.lon) == (pytest.approx(0, abs=1e-9), pytest.approx(82, abs=1e-9))
    north = p(25.0, 82.0, 12_000.0)
    assert north.moved and 24.9 < north.lat < 25.0 and north.lon == pytest.approx(82, abs=1e-9)
    still = p(25.0, 75.0, 0.0)
    assert not still.moved and still.lat == 25.0
    assert one(spark, geo.cloud_height_m(F.lit(235.0)).alias("h")).h == pytest.approx(10_000)


def test_parallax_of_cells(spark):
    rows = [(1, 25.0, 75.0, 220.0, BIT["PARALLAX_UNCORRECTED"]), (1, 25.0, 75.0, None, BIT["PARALLAX_UNCORRECTED"])]
    cells = spark.createDataFrame(rows, "frame int, lat double, lon double, ctt double, qc_flag int")
    out = qc.corrected_parallax(cells)
    assert {(r.moved, r.qc_flag) for r in out.collect()} == {(True, 0), (False, BIT["PARALLAX_UNCORRECTED"])}
    rep = qc.parallax_report(out, ["frame"]).first()
    assert rep.cells_moved == 1 and 1 < rep.mean_km < 20 and rep.max_km == rep.mean_km


SQUARE = Grid(0.0, 9.0, 0.0, 9.0, 1.0, 10, 10)


def ring(*points):
    return [{"lat": float(a), "lon": float(b)} for a, b in points]


def test_polygons(spark):
    rows = [
        ("S", "square", ring((1.6, 1.6), (1.6, 4.4), (4.4, 4.4), (4.4, 1.6))),
        ("S", "ell", ring((5, 5), (5, 8), (6, 8), (6, 6), (8, 6), (8, 5))),
        ("S", "sliver", ring((7.1, 1.1), (7.1, 1.2), (7.2, 1.2), (7.2, 1.1))),
        ("S", "square", ring((1.6, 1.6), (1.6, 4.4), (4.4, 4.4), (4.4, 1.6))),
        ("S", "far", ring((50, 50), (50, 51), (51, 51))),
    ]
    polygons = spark.createDataFrame(rows, impact.POLYGON)
    within = impact.district_cells(polygons, SQUARE, "within")
    got = {}
    for r in within.collect():
        got.setdefault(r.district, set()).add((r.row, r.col))
    assert got["square"] == {(a, b) for a in (2, 3, 4) for b in (2, 3, 4)}
    assert "sliver" not in got and within.count() == sum(map(len, got.values()))
    touched = {}
    for r in impact.district_cells(polygons, SQUARE).collect():
        touched.setdefault(r.district, set()).add((r.row, r.col))
    assert touched["sliver"] == {(7, 1)} and got["square"] <= touched["square"] and (8, 8) not in touched["ell"]
    assert {r.district for r in impact.unresolved_districts(polygons, within).collect()} == {"sliver", "far"}


def test_scope_refuses_unknown_district(spark):
    dc = spark.createDataFrame([("S", "a", 1, 1.0)], "state string, district string, cell int, area_km2 double")
    with pytest.raises(ValueError, match="no district"):
        impact.scope_district(dc, dc, "S", "b")


# --- regrid ------------------------------------------------------------------------------


def test_constant_field_stays_constant(spark):
    src = Grid(0.0, 3.0, 0.0, 3.0, 1.0, 4, 4)
    cells = spark.range(16).select((F.col("id") / 4).cast("int").alias("row"), (F.col("id") % 4).cast("int").alias("col"), F.lit(7.0).alias("value"))
    target = spark.createDataFrame([(1, 0.5, 0.25), (2, 3.0, 3.0), (3, 2.999, 3.2)], "k int, lat double, lon double")
    got = {r.k: r.value for r in regrid.regrid_bilinear(cells, src, target, ["k"]).collect()}
    assert got[1] == got[2] == 7.0 and got[3] is None
    holed = cells.withColumn("value", F.when(F.col("id") != 0, F.col("value"))) if "id" in cells.columns else cells.where("row > 0 or col > 0")
    assert {r.k: r.value for r in regrid.regrid_bilinear(holed, src, target, ["k"]).collect()}[1] is None


def test_resize_map(spark):
    maps = spark.createDataFrame([(r, c, 5.0) for r in range(2) for c in range(2)], "row int, col int, value double")
    got = regrid.resize_map(maps, 2, 4).collect()
    assert len(got) == 16 and {r.value for r in got} == {5.0}
    ramp = spark.createDataFrame([(r, c, float(c)) for r in range(2) for c in range(2)], "row int, col int, value double")
    assert sorted({r.value for r in regrid.resize_map(ramp, 2, 4).collect()}) == [0.0, 0.25, 0.75, 1.0]


def test_categorical_regrid_takes_the_nearest(spark):
    cells = spark.createDataFrame([(0, "lulc", 0, 0, 0, 0.0, 0.0, 3.0), (0, "lulc", 0, 0, 1, 0.0, 1.0, 5.0)], "slot int, channel string, level int, row int, col int, lat double, lon double, value double")
    out = regrid.regrid_stream(cells, "categorical", SQUARE, cells, grid=Grid(0.0, 1.0, 0.0, 1.0, 0.5, 3, 3), radius_km=80.0)
    got = {(r.row, r.col): r.value for r in out.collect()}
    assert got[0, 0] == 3.0 and got[0, 2] == 5.0 and got[0, 1] in (3.0, 5.0)
    with pytest.raises(ValueError, match="kind"):
        regrid.regrid_stream(cells, "wavy", SQUARE, cells)


def test_axis_spacing(spark):
    axis = spark.createDataFrame([(0, 1.0), (1, 1.5), (2, 2.0)], "i int, v double")
    assert regrid.grid_spacing(axis).first().even
    assert not regrid.grid_spacing(axis.unionByName(spark.createDataFrame([(3, 9.0)], "i int, v double"))).first().even
    cells = grd.grid_cells(spark, SQUARE)
    assert cells.count() == 100 and grd.grid_axes(spark).count() == 129 + 135


# --- seasons -------------------------------------------------------------------------------


def test_seasons(spark):
    r = index.season_runs(spark, [2020], [6, 7, 8, 9]).first()
    assert (r.first_month, r.last_month, str(r.season_end)) == (6, 9, "2020-09-30 23:30:00")
    assert index.season_runs(spark, [2020], [3, 4, 9, 10]).count() == 2
    for months, step in (([12, 1, 2], 30), ([], 30), ([6], 7)):
        with pytest.raises(ValueError):
            index.season_runs(spark, [2020], months, step)


def test_first_and_last_valid_time(spark):
    t = index.valid_times(index.season_runs(spark, [2019], [6, 7, 8, 9])).agg(F.min("valid_time"), F.max("valid_time"), F.count("*")).first()
    assert (str(t[0]), str(t[1]), t[2]) == ("2019-06-01 06:00:00", "2019-09-30 17:30:00", 5832)


def test_split(spark):
    split = index.build_index(spark, [2017, 2018, 2019, 2020], [6, 7, 8, 9])
    years = {r.split: set(r.y) for r in split.groupBy("split").agg(F.collect_set(F.year("valid_time")).alias("y")).collect()}
    assert years["train"] == {2017, 2018, 2019} and years["validation"] == {2020}
    index.assert_disjoint(split)
    index.assert_train_only(split.where("split = 'train'").limit(3), split)
    with pytest.raises(ValueError):
        index.assert_train_only(split.where("split = 'validation'").limit(3), split)
    bad = split.withColumn("split", F.when(F.col("split") == "train", "validation").otherwise("train"))
    with pytest.raises(ValueError):
        index.assert_disjoint(bad)


# --- configuration ------------------------------------------------------------------------------


def test_default_config_is_sound():
    checks.check(checks.Config())
    assert len(CHANNELS) == 30 and [c[1] for c in CHANNELS][23] == "imd_precip"


@pytest.mark.parametrize(
    "wrong",
    [
        {"grid": Grid(resolution=0.25)},
        {"grid": Grid(lat_min=40.0)},
        {"lookback": (-2, 0)},
        {"lookback": (-2, -1)},
        {"leads": (2, 3)},
        {"step_minutes": 7},
        {"reference": ("2017-06-01", "2020-06-30")},
        {"bands": ((0.3, 2.5, "low"), (0.15, 7.5, "moderate"))},
        {"rain_classes": {"light": 5.0, "heavy": 2.0}},
        {"policy": replay.Policy(heavy_mm_h=35.0)},
        {"policy": replay.Policy(quantile=1.5)},
        {"required_streams": ("radar",)},
        {"methods": {"categorical": "linear", "precipitation": "hold"}},
        {"methods": {"categorical": "nearest", "precipitation": "linear"}},
        {"gates": (0.0, 0.0)},
        {"dissolve_key": ""},
        {"terrain_m": (500.0, 20.0)},
    ],
)
def test_wrong_configs_are_refused(wrong):
    with pytest.raises(ValueError):
        checks.check(checks.Config(**wrong))


def test_configuration_files(spark, tmp_path):
    import json

    (tmp_path / "grid.json").write_text(json.dumps({"grid": {"height": 384, "width": 384}, "leads": list(range(1, 7))}))
    (tmp_path / "replay.json").write_text(json.dumps({"policy": {"min_history": 7}, "bands": [[0.2, 3.0, "low"], [0.4, 9.0, "high"]]}))
    c = checks.read_config(spark, f"file://{tmp_path}")
    assert c.leads == (1, 2, 3, 4, 5, 6) and c.policy.min_history == 7 and c.bands[1] == (0.4, 9.0, "high") and c.monitor == "csi_heavy"
    for name, text in (("a", {"gird": {}}), ("b", {"grid": {"hieght": 3}}), ("c", {"leads": [1, 2]}), ("d", {"gates": [0.0, 0.0]})):
        (tmp_path / "extra.json").write_text(json.dumps(text))
        with pytest.raises(ValueError):
            checks.read_config(spark, f"file://{tmp_path}")


# --- scaling and channels -------------------------------------------------------------------------


def test_degenerate_spans(spark):
    z = scalar.normalised(F.lit(5.0), F.lit(5.0), F.lit(0.0), F.lit(1.0), F.lit(1.0), F.lit("minmax"))
    assert one(spark, z.alias("z")).z == 0.0
    far = scalar.normalised(F.lit(1e9), F.lit(0.0), F.lit(1.0), F.lit(0.0), F.lit(1.0), F.lit("zscore"))
    assert one(spark, far.alias("z")).z == 6.0


def test_missing_statistics_fail(spark):
    cells = spark.createDataFrame([("a", 1.0)], "channel string, value double")
    empty = spark.createDataFrame([], "channel string, mean double, std double, min double, max double")
    policy = spark.createDataFrame([("a", "zscore", None)], "channel string, method string, transform string")
    with pytest.raises(Exception, match="no statistics"):
        norm.normalise(cells, empty, policy).collect()


def test_channel_names(spark):
    r = one(spark, scalar.split_level_channel(F.lit("u850")).alias("a"), scalar.split_level_channel(F.lit("u123")).alias("b"), scalar.channel_provenance(F.lit("rh700")).alias("c"), scalar.channel_provenance(F.lit("soil_type")).alias("d"), scalar.detect_crs(F.lit("regular_ll")).alias("e"), scalar.detect_crs(F.lit("lambert")).alias("f"))
    assert tuple(r.a) == ("u", 850) and r.b is None and (r.c, r.d, r.e, r.f) == ("imdaa", "static", "EPSG:4326", None)


def test_channel_checks(spark):
    table = norm.channel_table(spark)
    assemble.assert_partition(table, table)
    with pytest.raises(ValueError):
        assemble.assert_partition(table.where("idx > 0"), table)
    window = table.select(F.col("idx").alias("channel_idx"), "channel")
    assemble.assert_channel_order(window, table)
    with pytest.raises(ValueError):
        assemble.assert_channel_order(window.withColumn("channel_idx", 29 - F.col("channel_idx")), table)
    with pytest.raises(KeyError):
        assemble.channel(window, table, "nope")
    assert assemble.channel(window, table, "u850").count() == 1


def test_alias_and_dense(spark):
    cells = spark.createDataFrame([("2t", 1.0), ("t2m", 2.0), ("x", 3.0)], "name string, value double")
    aliases = spark.createDataFrame([("temp_2m", "2t", "t2m")], "variable string, short_name string, key string")
    assert {r.name: r.variable for r in assemble.resolve_alias(cells, aliases).collect()} == {"2t": "temp_2m", "t2m": "temp_2m", "x": None}
    grid = spark.createDataFrame([(0, 0, 0), (0, 0, 1)], "f int, row int, col int")
    assemble.assert_dense(grid, ["f"], 1, 2)
    with pytest.raises(ValueError):
        assemble.assert_dense(grid, ["f"], 2, 2)


def test_shapes_must_match(spark):
    a = spark.createDataFrame([(0, 0, 0, 1.0), (0, 0, 1, 1.0)], "slot int, row int, col int, value double")
    with pytest.raises(Exception, match="shape"):
        assemble.attach_ctt(a, a.where("col = 0")).collect()


def test_long_runs_of_empty_lines(spark):
    rows = [(0, r, c, None if 3 <= r <= 6 or r == 9 else float(c)) for r in range(12) for c in range(10)]
    cells = spark.createDataFrame(rows, "frame int, row int, col int, value double")
    stats = qc.scanline_stats(cells, ["frame"], width=10)
    assert sorted(r.row for r in stats.where("fill_bad").collect()) == [3, 4, 5, 6]
    assert qc.dropout_report(stats, ["frame"]).first().qc_flag == BIT["SCANLINE_DROPOUT"]


# --- gaps -----------------------------------------------------------------------------------------


def test_moving_field_is_filled(spark):
    rows = []
    for f in range(3):
        for r in range(12):
            for c in range(12):
                v = 100.0 if (r, c) in {(4, 3 + 2 * f), (5, 3 + 2 * f)} else 0.0
                rows.append((0, f, r, c, None if f == 1 else v))
    out = sync.fill_advective(spark.createDataFrame(rows, "seq int, frame int, row int, col int, value double"), 12, 4)
    got = {(r.row, r.col): r.value for r in out.where("frame = 1").collect()}
    assert got[4, 5] == 100.0 and got[5, 5] == 100.0 and got[4, 3] == 0.0 and got[4, 7] == 0.0
    assert {r.qc_flag for r in out.where("frame = 1").collect()} == {BIT["GAP_FILLED_OPTICAL_FLOW"]}
    assert {r.qc_flag for r in out.where("frame != 1").collect()} == {0}


@pytest.mark.parametrize(("seen", "filled"), [(10, 0), (40, 144)])
def test_anchors_need_coverage(spark, seen, filled):
    """A frame with a value in fewer than a quarter of its cells is no anchor."""
    rows = [(0, f, r, c, 5.0 if f == 0 or (f == 2 and 12 * r + c < seen) else None) for f in range(3) for r in range(12) for c in range(12)]
    out = sync.fill_advective(spark.createDataFrame(rows, "seq int, frame int, row int, col int, value double"), 12, 2)
    assert out.where("filled and frame = 1").count() == filled


def test_missing_slots_stay_in_the_window(spark):
    """13 frames come out of 12, the missing one blended, categories not, statics in every frame."""
    grid = Grid(0.0, 1.0, 0.0, 1.0, 1.0, 2, 2)
    slots = [k * 1800 for k in range(13) if k != 5]
    frames = spark.createDataFrame([("insat", x, 0) for x in slots], "stream string, slot_s long, qc_flag int")
    cells = spark.createDataFrame(
        [(x, ch, r, c, float(r), float(c), float(v)) for x in slots for r in (0, 1) for c in (0, 1) for ch, v in (("rain", x / 1800), ("kind", 1 + 2 * (x > 9000)))],
        "slot_s long, channel string, row int, col int, lat double, lon double, value double",
    )
    static = spark.createDataFrame([("dem", r, c, 7.0) for r in (0, 1) for c in (0, 1)], "channel string, row int, col int, value double")
    channels = spark.createDataFrame(
        [(0, "g", "rain", "continuous", "none", None, False), (1, "g", "kind", "categorical", "none", None, False), (2, "s", "dem", "continuous", "none", None, True)],
        "idx int, grp string, channel string, kind string, method string, transform string, is_static boolean",
    )
    stats = norm.build_channel_stats(cells)
    times = spark.createDataFrame([(12 * 1800,), (40 * 1800,)], "t0_s long")
    got = inputs.build_inputs(times, frames, cells, static, stats, channels, channels, streams=["insat"], source=grid, target=grid)
    assert {r.valid_time for r in got.collect()} == {12 * 1800} and got.count() == 13 * 3 * 4
    at = {(r.t, r.channel_idx): r for r in got.where("row = 1 and col = 0").collect()}
    assert at[5, 0].value == 5.0 and at[5, 0].filled and at[4, 0].value == 4.0 and not at[4, 0].filled
    assert at[5, 1].value in (1.0, 3.0) and at[5, 2].value == 7.0 and not at[5, 2].filled
    assert all(r.valid and r.cell_valid for r in at.values())


# --- replay -----------------------------------------------------------------------------------------


def test_reservoir_fold():
    box = replay.Reservoir(replay.Policy(min_history=100, floor=0.1), capacity=2)
    hour = 3600
    said = [box.offer(t * hour, s, 0.5, t / 99)[0] for t, s in ((0, 0.0), (1, 0.05), (2, 0.5), (3, 0.4), (4, 0.6), (20, 0.3), (40, 0.2), (60, 0.9))]
    assert said == [
        "rejected_zero_score", "rejected_below_threshold", "admitted", "rejected_temporal_duplicate", "admitted",
        "admitted", "rejected_reservoir_key", "admitted_evicting",
    ]
    assert sorted(t / hour for t in box.records.rows) == [4, 60]
    again = replay.Reservoir(box.policy, 2, box.history.rows, [(t, *v) for t, v in box.records.rows.items()])
    assert again.offer(61 * hour, 0.1, 0.5, 0.7) == box.offer(61 * hour, 0.1, 0.5, 0.7) == ("rejected_temporal_duplicate", None, [])


def test_stream_equals_batch(spark, sf_dir):
    from stratolab.plans import products, streams

    key = lambda df: sorted((r.t_s, r.code) for r in df.select("t_s", "code").collect())
    assert key(streams.r4_stream_reservoir(spark, sf_dir)) == key(products.w9_decorrelate(spark, sf_dir))


# --- sources -----------------------------------------------------------------------------------------


def test_granules(spark):
    names = ["a/3DIMG_23SEP2017_0600_L1C_ASIA_MER.h5", "a/3DIMG_31FEB2017_0600_L1C.h5", "a/notes.txt"]
    cat = catalog.granule_catalog(spark.createDataFrame([(n,) for n in names], "path string"))
    got = {r.path: r.scan_time for r in cat.collect()}
    assert got[names[0]] == dt.datetime(2017, 9, 23, 6, 0) and got[names[1]] is None and got[names[2]] is None
    assert catalog.with_slot(cat).where("slot is not null").count() == 1


def test_nwp_paths(spark):
    rows = spark.createDataFrame([("u", 850, 2017, 7), ("t2m", None, 2017, 12)], "variable string, level int, year int, month int")
    paths = catalog.render_nwp_path(rows.where("level is not null"), "root/")
    assert paths.first().path == "root/u_850_201707.nc"
    r = catalog.parse_nwp_path(paths.select("path")).first()
    assert (r.variable, r.level, r.year, r.month) == ("u", 850, 2017, 7)


@pytest.mark.parametrize("year", [2019, 2020])
def test_grd(spark, tmp_path, year):
    spec = grd.GrdSpec(height=2, width=3)
    days = grd.days_in(year)
    data = np.arange(days * 6, dtype="<f4").reshape(days, 6)
    data[0, 0] = -999.0
    data[1, 1] = np.nan
    data.tofile(tmp_path / f"rain_{year}.grd")
    data[:-1].tofile(tmp_path / "short_2018.grd")
    out = grd.read_grd(spark, f"file://{tmp_path}", spec, 1, 2)
    good = {(str(r.date), r.row, r.col): r.value for r in out.where("fault is null and path not like '%short%'").collect()}
    assert len(good) == 12 and good[f"{year}-01-01", 0, 0] is None and good[f"{year}-01-02", 0, 1] is None
    assert good[f"{year}-01-02", 1, 2] == 11.0
    assert out.where("fault is not null").count() == (0 if grd.days_in(2018) == days - 1 else 1)


def test_corpus(spark, tmp_path):
    good = "---\nhazard_class: flash_flood\nseverity_tier: high\nregion: plains\nsource: S: 1\n---\nBody text.\n"
    (tmp_path / "a.md").write_text(good)
    (tmp_path / "b.md").write_text("no front matter")
    (tmp_path / "c.md").write_text("---\nhazard_class: x\n---\nBody")
    (tmp_path / "d.md").write_text(good.replace("Body text.", "  "))
    got = {r.path.rsplit("/", 1)[1]: r for r in corpus.read_corpus(spark, f"file://{tmp_path}").collect()}
    assert got["a.md"].skipped is None and got["a.md"].body == "Body text." and got["a.md"].metadata["source"] == "S: 1"
    assert got["b.md"].skipped == "no front matter" and got["d.md"].skipped == "empty body"
    assert got["c.md"].skipped == "missing severity_tier, region"


def test_chunker(spark):
    assert corpus.chunk_text("one\n\ntwo\n\nthree", 9, 0) == ["one\n\ntwo", "three"]
    assert corpus.chunk_text("one\n\ntwo\n\nthree", 9, 3) == ["one\n\ntwo", "wo\n\nthree"]
    assert corpus.chunk_text("x" * 2000 + " tail of it", 1200, 150)[-1].endswith("tail of it")
    long = "word " * 50
    cut = corpus.chunk_text(long, 40, 10)
    assert all(len(c) <= 40 for c in cut) and all(c.split() == ["word"] * len(c.split()) for c in cut[:1])
    assert corpus.chunk_text(None) == [] and corpus.chunk_text("  \n\n ") == []
    with pytest.raises(ValueError):
        corpus.chunk_text("x", 10, 10)
    docs = spark.createDataFrame([("d", "one\n\ntwo", {"a": "b"}), ("e", None, {})], "document string, body string, metadata map<string,string>")
    assert [(r.document, r.n, r.text) for r in corpus.chunks(docs, 4, 0).collect()] == [("d", 0, "one"), ("d", 1, "two")]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["a", "bcd", " ", "\n\n", "\n", "x" * 40, "é"]), max_size=60).map("".join), st.integers(1, 50), st.integers(0, 49))
def test_chunks_cover_the_text(body, size, overlap):
    if overlap >= size:
        return
    text, spans = corpus.chunk_spans(body, size, overlap)
    assert "".join(text.split()) == "".join(body.split())
    assert all(0 <= b - a <= size for a, b in spans)
    done = 0
    for a, b in spans:
        assert not text[done:a].strip() and done < b and done - a <= overlap
        done = b
    assert done == len(text)


def test_stores(spark, tmp_path):
    root = f"file://{tmp_path}"
    rows = [(dt.datetime(2017, 6, 1, 6), "input", True, None, 1.0), (dt.datetime(2017, 6, 2, 6), "input", False, "gap", 2.0)]
    w = spark.createDataFrame(rows, "valid_time timestamp, kind string, accepted boolean, reason string, value double")
    fp = windows.fingerprint({"b": 1, "a": [1, 2]})
    assert fp == windows.fingerprint({"a": [1, 2], "b": 1}) and len(fp) == 16
    windows.write_windows(w, f"{root}/w", fp)
    windows.write_windows(w, f"{root}/w", fp)
    windows.write_windows(w, f"{root}/w", "other")
    got = windows.read_windows(spark, f"{root}/w", fp).collect()
    assert len(got) == 2 and {(r.accepted, r.value) for r in got} == {(True, 1.0), (False, None)}
    assert windows.bytes_per_window(13, 30, 384, 384) == 230_031_360
    assert windows.projected_bytes(w, 10).first().bytes == 20
    m = spark.createDataFrame([("csi", 0.5), ("far", None)], "name string, value double")
    windows.write_metrics(m, f"{root}/m")
    assert sorted(map(tuple, windows.read_metrics(spark, f"{root}/m").collect()), key=str) == [("csi", 0.5), ("far", None)]
    r = spark.createDataFrame([(2, 0.5, -1.0), (1, 0.4, -2.0)], "t_s long, score double, reservoir_key double")
    windows.save_reservoir(r, f"{root}/r", 8)
    assert [x.t_s for x in windows.load_reservoir(spark, f"{root}/r", 8).collect()] == [1, 2]
    with pytest.raises(ValueError, match="capacity"):
        windows.load_reservoir(spark, f"{root}/r", 9)
    windows.write_chunks(m, f"{root}/c", model="m", dims=4, corpus_label="sample")
    with pytest.raises(Exception, match="(?i)exists"):
        windows.write_chunks(m, f"{root}/c", model="m", dims=4, corpus_label="sample")
    windows.write_chunks(m, f"{root}/c", model="m", dims=4, corpus_label="sample", force=True)
    with pytest.raises(ValueError, match="dimensions"):
        windows.read_chunks(spark, f"{root}/c", model="m", dims=8)


def test_channel_stats_file(spark, tmp_path):
    stats = '{"_meta": {}, "a": {"mean": 1, "std": 2, "min": 0, "max": 3, "count": 4, "source": "s"}, "b": {"mean": 1}}'
    (tmp_path / "s.json").write_text(stats)
    with pytest.raises(ValueError, match="b"):
        windows.load_channel_stats(spark, f"file://{tmp_path}/s.json", ["a"])
    (tmp_path / "s.json").write_text(stats.split(', "b"')[0] + "}")
    assert windows.load_channel_stats(spark, f"file://{tmp_path}/s.json", ["a"]).first()["mean"] == 1.0
    with pytest.raises(ValueError, match="z"):
        windows.load_channel_stats(spark, f"file://{tmp_path}/s.json", ["a", "z"])


# --- alerts ------------------------------------------------------------------------------------------


def alert_row(spark):
    t = dt.datetime(2020, 7, 1, 6)
    row = {
        "state": "S", "district": "D", "hazard_class": "flash_flood", "region": "plains", "corpus": "official", "grounded": True,
        "peak_probability": 0.75, "affected_area_km2": 160.04, "affected_fraction": 0.31, "peak_intensity": 36.5, "severity": "severe",
        "valid_time": t, "onset_time": t + dt.timedelta(hours=1), "expiry_time": t + dt.timedelta(hours=3), "onset_hours": 1.0,
        "expiry_hours": 3.0, "headline": "H", "description": "D", "instruction": "I", "cap_severity": "Extreme",
        "cap_urgency": "Immediate", "cap_certainty": "Likely", "empty_reason": None,
    }
    kind = ", ".join(f"{k} {'boolean' if isinstance(v, bool) else 'double' if isinstance(v, float) else 'timestamp' if isinstance(v, dt.datetime) else 'string'}" for k, v in row.items())
    df = spark.createDataFrame([tuple(row.values())], kind)
    g = F.array(F.struct(F.lit("k1").alias("chunk_id"), F.lit("src").alias("source"), F.lit(" text ").alias("text")))
    d = F.array(F.struct(F.lit("u850").alias("channel"), F.lit("raised").alias("direction")))
    return df.withColumns({"guidelines": g, "drivers": d, "defaulted": F.array(F.lit("region"))})


def test_alert_document(spark):
    built = advisory.build_alerts(alert_row(spark))
    a = built.first().alert
    pairs_ = {(p.value_name, p.value) for p in a.info[0].parameter}
    assert ("peak_probability", "0.7500") in pairs_ and ("ndma_citation", "k1") in pairs_ and ("forecast_driver", "u850:raised") in pairs_
    assert ("defaulted_labels", "region") in pairs_ and ("affected_area_km2", "160.0") in pairs_
    assert a.info[0].event == "Heavy Rainfall - Flash Flood" and a.info[0].area[0].area_desc == "D, S" and len(a.identifier) == 32
    assert '"identifier"' in windows.cap_json(built).first().cap_json
    assert windows.cap_xml(built).first().cap_xml.startswith("<alert>")


def test_prompt(spark):
    text = alert_row(spark).select(advisory.prompt_text().alias("p")).first().p
    for part in ("place = D, S", "starts = 2020-07-01T07:00:00Z, in 1.0 h", "heavy rain = 75%", "area hit = 160 km2, 31% of the place", "strongest rain = 36 mm/h", "not known = region", "u850 raised it", "k1 from src: text"):
        assert part in text, part
    empty = alert_row(spark).withColumns({"guidelines": F.slice("guidelines", 1, 0), "empty_reason": F.lit("none match")})
    assert "nothing found: none match" in empty.select(advisory.prompt_text().alias("p")).first().p


def test_event_peaks_and_timeline(spark):
    kind = "id int, series array<struct<risk:double,iwv:double,ctt:double>>, timeline array<struct<label:string,timestamp:string>>"
    df = spark.createDataFrame([(1, [(0.5, 40.0, 230.0), (0.9, 30.0, 210.0)], [("Issued", "t")])], kind)
    r = dashboard.event_peaks(df).first()
    assert (r.peak_risk, r.peak_iwv, r.lowest_ctt) == (0.9, 40.0, 210.0)
    assert df.select(dashboard.timeline(F.col("timeline")).alias("t")).first().t[0].time == "t"


def test_nan_is_missing(spark):
    r = one(spark, scalar.null_sentinel(F.lit(float("nan")), -999.0).alias("a"), scalar.filled(F.lit(float("inf")), 0.0).alias("b"), scalar.wind_speed(F.lit(3.0), F.lit(4.0)).alias("c"))
    assert r.a is None and r.b == 0.0 and math.isclose(r.c, 5.0)


def test_convergence(spark):
    from stratolab.operators import attrib

    a = spark.createDataFrame([(0.4,), (0.6,)], "attribution double")
    good, bad = attrib.convergence_check(a, 1.01).first(), attrib.convergence_check(a, 2.0).first()
    assert good.converged and not bad.converged and bad.residual == pytest.approx(1.0)


def test_empty_region_is_refused(spark):
    from stratolab.operators import attrib

    mask = spark.createDataFrame([(0, 0, False), (0, 1, False)], "map_row int, map_col int, mask boolean")
    with pytest.raises(Exception, match="empty"):
        attrib.pool_mean(mask, 2).collect()
    none = spark.createDataFrame([(0, 0, 0, 0.0)], "t int, map_row int, map_col int, share double")
    with pytest.raises(Exception, match="attention"):
        attrib.attention_share(none).collect()
    cells = spark.createDataFrame([(None,)], "rain_mm_h double")
    with pytest.raises(Exception, match="valid cell"):
        verify.soft_exceedance(cells, 15.0, 1.0).collect()
