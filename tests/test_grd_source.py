"""The yearly archive as a data source: slices, day filters, whole files only."""

from __future__ import annotations

import datetime as dt
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratolab.sources import grd, grd_source

SPEC = grd.GrdSpec(height=2, width=3)


def archive(folder, *years):
    for year in years:
        days = grd.days_in(year)
        data = np.arange(days * 6, dtype="<f4").reshape(days, 6)
        data[0, 0], data[1, 1] = -999.0, np.nan
        data.tofile(folder / f"rain_{year}.grd")


def test_equals_whole_files(spark, tmp_path):
    archive(tmp_path, 2019, 2020)
    np.zeros(7, "<f4").tofile(tmp_path / "short_2018.grd")
    np.zeros(7, "<f4").tofile(tmp_path / "nameless.grd")
    (tmp_path / "notes.txt").write_text("not a grid")
    uri = f"file://{tmp_path}"
    pick = lambda df: sorted((str(r.date), r.row, r.col, r.lat, r.lon, r.value, r.fault) for r in df.where("value is not null").collect())
    assert pick(grd_source.read_days(spark, uri, SPEC)) == pick(grd.read_grd(spark, uri, SPEC))
    faults = grd_source.read_days(spark, uri, SPEC).where("fault is not null").collect()
    assert {os.path.basename(r.path) for r in faults} == {"short_2018.grd", "nameless.grd"}
    assert grd_source.read_days(spark, uri, SPEC).count() == (365 + 366) * 6 + 2


def test_a_day_reads_one_slice(spark, tmp_path):
    archive(tmp_path, 2019, 2020)
    whole = grd_source.read_days(spark, f"file://{tmp_path}", SPEC, slice_days=10)
    assert whole.rdd.getNumPartitions() == 37 + 37
    day = whole.where(F.col("date") == dt.date(2020, 12, 31))
    assert day.rdd.getNumPartitions() == 1
    assert [r.value for r in day.orderBy("row", "col").collect()] == [365.0 * 6 + k for k in range(6)]
    turn = whole.where((F.col("date") > dt.date(2019, 12, 30)) & (F.col("date") < dt.date(2020, 1, 3)))
    assert turn.rdd.getNumPartitions() == 2 and turn.count() == 3 * 6
    listed = whole.where(F.col("date").isin(dt.date(2019, 3, 1), dt.date(2019, 3, 5)))
    assert listed.rdd.getNumPartitions() == 1 and listed.count() == 12
    assert whole.where(F.col("date") == dt.date(1999, 1, 1)).count() == 0


def test_a_slice_reads_its_own_bytes(tmp_path):
    from pyspark.sql.datasource import EqualTo

    archive(tmp_path, 2019)
    reader = grd_source.GrdReader({"path": str(tmp_path), "height": "2", "width": "3"})
    assert list(reader.pushFilters([EqualTo(("date",), dt.date(2019, 2, 1))]))
    (only,) = reader.partitions()
    assert (only.first, only.last) == (32, 32)
    (batch,) = reader.read(only)
    assert batch.num_rows == 6


def test_round_trip(spark, tmp_path):
    rows = [("2020-02-29", 1, 2, 5.0), ("2020-12-31", 0, 0, 7.0), ("2019-01-01", 0, 1, 3.0), ("2019-01-01", 0, 1, 4.0), (None, 0, 0, 1.0), ("2019-05-05", 0, 0, None)]
    cells = spark.createDataFrame(rows, "date string, row int, col int, value double").withColumn("date", F.to_date("date"))
    place = f"file://{tmp_path}/made"
    grd_source.write_days(cells, place, SPEC)
    assert sorted(os.listdir(tmp_path / "made")) == ["2019.grd", "2020.grd"]
    back = grd_source.read_days(spark, place, SPEC).where("value is not null")
    assert sorted((str(r.date), r.row, r.col, r.value) for r in back.collect()) == [
        ("2019-01-01", 0, 1, 4.0), ("2020-02-29", 1, 2, 5.0), ("2020-12-31", 0, 0, 7.0),
    ]
    with pytest.raises(Exception, match="there already"):
        grd_source.write_days(cells, place, SPEC)
    assert sorted(os.listdir(tmp_path / "made")) == ["2019.grd", "2020.grd"]
    grd_source.write_days(cells.where("date < '2020-01-01'").withColumn("value", F.lit(9.0)), place, SPEC, "overwrite")
    assert back.where("value = 9").count() == 2 and back.where("date >= '2020-01-01'").count() == 2
    empty = f"file://{tmp_path}/empty"
    grd_source.write_days(cells.limit(0), empty, SPEC)
    assert grd_source.read_days(spark, empty, SPEC).count() == 0
