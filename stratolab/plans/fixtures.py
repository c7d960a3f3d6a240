"""Fixture views over the given tables, as SQL that Spark and DuckDB both run."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

# {name} stands for a table or another view; {epoch} for whole seconds of events.ts.
VIEWS = {
    "fx_ensemble": """
        SELECT 12 * (year(l_shipdate) - 1992) + month(l_shipdate) AS window_id, l_suppkey % 12 AS lead, l_partkey % 16 AS cell,
          l_orderkey % 8 AS member, CAST(CAST(sum(l_quantity) AS bigint) % 61 AS double) AS rain_mm_h
        FROM {lineitem} GROUP BY 1, 2, 3, 4""",
    "fx_target": """
        SELECT window_id, lead, cell, CASE WHEN s % 10 = 0 THEN NULL ELSE CAST(s % 61 AS double) END AS rain_mm_h
        FROM (SELECT 12 * (year(o_orderdate) - 1992) + month(o_orderdate) AS window_id, o_custkey % 12 AS lead, o_orderkey % 16 AS cell,
            sum(CAST(floor(o_totalprice) AS bigint)) AS s
          FROM {orders} GROUP BY 1, 2, 3) t""",
    "fx_cell": """
        SELECT cell, CAST(floor(cell / 4) AS int) AS grid_row, CAST(cell % 4 AS int) AS grid_col,
          20 + floor(cell / 4) / 12 AS lat, 77 + (cell % 4) / 12 AS lon
        FROM (SELECT DISTINCT cell FROM {fx_ensemble}) t""",
    "fx_area": """
        SELECT *, power(6371.0088, 2) * radians(1e0 / 12)
          * (sin(radians(lat + 1e0 / 24)) - sin(radians(lat - 1e0 / 24))) AS area_km2
        FROM {fx_cell}""",
    "fx_district_cell": """
        SELECT r.r_name AS state, n.n_name AS district, c.cell, c.area_km2
        FROM {fx_area} c JOIN {nation} n
          ON n.n_nationkey = c.cell % 5 OR (c.cell % 4 = 0 AND n.n_nationkey = (c.cell + 2) % 5)
        JOIN {region} r ON r.r_regionkey = n.n_regionkey""",
    "fx_static": """
        SELECT cell, CAST((cell * 97) % 900 AS double) AS elevation_m, CAST(cell % 6 AS int) AS lulc FROM {fx_cell}""",
    "fx_frame": """
        SELECT stream, CAST(floor(s / 1800) AS bigint) * 1800 AS slot_s, count(*) AS n, sum(event_id % 1000) AS v
        FROM (SELECT {epoch} AS s, event_id, CASE event_type WHEN 'view' THEN 'insat' WHEN 'click' THEN 'imdaa'
            WHEN 'purchase' THEN 'imd_surface' WHEN 'signup' THEN 'hem' ELSE 'hem_bad' END AS stream
          FROM {events}) t GROUP BY 1, 2""",
    "fx_obs": """
        SELECT event_id, {epoch} AS obs_s, user_id % 10 AS station, CAST(event_id % 1000 AS double) AS value
        FROM {events}""",
    "fx_bounds": "SELECT event_id, value FROM {events}",
    "fx_scan": """
        SELECT CAST(floor(({epoch}) / 86400) AS bigint) AS frame, user_id % 10 AS scan_row, event_id % 32 AS scan_col,
          min(CASE WHEN event_type = 'error' THEN NULL ELSE CAST(event_id % 400 AS double) END) AS value
        FROM {events} GROUP BY 1, 2, 3""",
    "fx_swath": """
        SELECT event_id, 6 + ((event_id * 37) % 3200) / 100 AS lat, 68 + ((event_id * 53) % 3200) / 100 AS lon,
          CAST(event_id % 100 AS double) AS value
        FROM {events}""",
    "fx_attr": """
        SELECT l_linenumber - 1 AS t, concat('ch', CAST(l_suppkey % 30 AS varchar(9))) AS channel, l_partkey % 8 AS map_row,
          l_orderkey % 8 AS map_col, sum(l_quantity) - 25 * count(*) AS attribution
        FROM {lineitem} GROUP BY 1, 2, 3, 4""",
    "fx_share": """
        SELECT t, map_row, map_col, CAST(n AS double) / sum(n) OVER (PARTITION BY map_row, map_col) AS share
        FROM (SELECT l_linenumber - 1 AS t, l_partkey % 8 AS map_row, l_orderkey % 8 AS map_col, count(*) AS n
          FROM {lineitem} GROUP BY 1, 2, 3) t""",
    "fx_window_attr": """
        SELECT l_suppkey AS window_id, l_linenumber - 1 AS t, concat('ch', CAST(l_partkey % 30 AS varchar(9))) AS channel, l_partkey % 8 AS map_row,
          l_orderkey % 8 AS map_col, sum(l_quantity) - 25 * count(*) AS attribution
        FROM {lineitem} GROUP BY 1, 2, 3, 4, 5""",
    "fx_window_share": """
        SELECT l_suppkey AS window_id, l_linenumber - 1 AS t, l_partkey % 8 AS map_row, l_orderkey % 8 AS map_col, CAST(count(*) AS double) / 64 AS share
        FROM {lineitem} WHERE l_suppkey % 7 > 0 GROUP BY 1, 2, 3, 4""",
    "fx_window_check": """
        SELECT l_suppkey AS window_id, sum(CASE WHEN l_linenumber > 1 THEN l_quantity - 25 ELSE 0 END) AS difference,
          4 + l_suppkey % 5 AS attributed, 8 AS served
        FROM {lineitem} GROUP BY l_suppkey""",
    "fx_chunk": """
        SELECT e.vec_id AS chunk_id, e.embedding,
          CASE WHEN d.lang IN ('en', 'de') THEN 'flash_flood' ELSE 'urban_waterlogging' END AS hazard_class,
          CASE d.n_chars % 4 WHEN 0 THEN 'low' WHEN 1 THEN 'moderate' WHEN 2 THEN 'high' ELSE 'severe' END
            AS severity_tier,
          CASE d.doc_id % 3 WHEN 0 THEN 'coastal' WHEN 1 THEN 'plains' ELSE 'mountainous' END AS region
        FROM {embeddings} e JOIN {documents} d ON d.doc_id = e.vec_id""",
    "fx_telemetry": """
        SELECT event_id, user_id % 8 AS region_no, CAST(event_id % 70 AS double) AS iwv,
          CAST((event_id * 7) % 16 AS double) AS ctt_drop_30m, CAST((event_id * 11) % 140 AS double) AS rainfall_rate,
          CAST((event_id * 13) % 90 AS double) AS wind_gust
        FROM {events}""",
    "fx_alert": """
        SELECT event_id AS id, CASE event_id % 3 WHEN 0 THEN 'thunderstorm' WHEN 1 THEN 'cloudburst' ELSE 'flash_flood'
            END AS hazard_type,
          CASE event_id % 4 WHEN 0 THEN 'low' WHEN 1 THEN 'moderate' WHEN 2 THEN 'high' ELSE 'severe' END AS severity,
          CASE user_id % 5 WHEN 0 THEN 'active' WHEN 1 THEN 'acknowledged' WHEN 2 THEN 'escalated' WHEN 3 THEN 'resolved'
            ELSE 'false_alarm' END AS status,
          CAST(event_id % 101 AS double) AS risk_score, concat('Region ', CAST(user_id % 8 AS varchar(9))) AS region_name,
          concat('State ', CAST(user_id % 3 AS varchar(9))) AS state,
          6 + ((event_id * 37) % 3200) / 100 AS lat, 68 + ((event_id * 53) % 3200) / 100 AS lng, {epoch} AS created_s
        FROM {events}""",
}
_EPOCH = {"spark": "unix_seconds(CAST(ts AS timestamp))", "duckdb": "CAST(floor(epoch(ts)) AS bigint)"}


def _needs(name: str) -> list[str]:
    return [n for n in re.findall(r"\{(\w+)\}", VIEWS[name]) if n != "epoch"]


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A fixture view, or a given table."""
    if name not in VIEWS:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    parts = {n: view(spark, sf_dir, n) for n in _needs(name)}
    return spark.sql(VIEWS[name].replace("{epoch}", _EPOCH["spark"]), **parts)


def oracle(sql: str) -> str:
    """DuckDB SQL with the fixture views that it names, as common table expressions."""
    order: list[str] = []

    def add(name: str) -> None:
        if name in VIEWS and name not in order:
            for n in _needs(name):
                add(n)
            order.append(name)

    for name in re.findall(r"\bfx_\w+\b", sql):
        add(name)
    ctes = []
    for n in order:
        body = re.sub(r"\{(\w+)\}", r"\1", VIEWS[n].replace("{epoch}", _EPOCH["duckdb"]))
        ctes.append(f"{n} AS ({body})")
    sql = sql.strip()
    if not ctes:
        return sql
    if sql[:15].upper() == "WITH RECURSIVE ":
        return "WITH RECURSIVE " + ",\n".join(ctes) + ",\n" + sql[15:]
    if sql[:5].upper() == "WITH ":
        return "WITH " + ",\n".join(ctes) + ",\n" + sql[5:]
    return "WITH " + ",\n".join(ctes) + "\n" + sql
