"""The yearly `.grd` archive as a data source: slices of days read by their bytes, files written day by day.

`pyarrow.fs` opens the files, so the path is any URI that it knows and that driver and workers share. For other
stores there is `grd.read_grd`, which reads whole files through Spark.
"""

from __future__ import annotations

import datetime as dt
import re
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    LessThan,
    LessThanOrEqual,
    WriterCommitMessage,
)

from .grd import GrdSpec, days_in

READ = "path string, date date, row int, col int, value float, fault string"
NAMES = ["path", "date", "row", "col", "value", "fault"]
KINDS = [pa.string(), pa.date32(), pa.int32(), pa.int32(), pa.float32(), pa.string()]


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a URI or an absolute path, and the path in it."""
    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", uri).rstrip("/"))


@dataclass
class Slice(InputPartition):
    """Days first to last of a year's file, or a file's fault."""

    path: str
    year: int | None
    first: int = 0
    last: int = -1
    fault: str | None = None


@dataclass
class Written(WriterCommitMessage):
    """Files of a task that are whole: (temporary, final) paths."""

    files: list[tuple[str, str]]


class GrdSource(DataSource):
    """Options: path, height, width, fill, and slice_days, the days a task reads at most."""

    @classmethod
    def name(cls) -> str:
        return "grd"

    def schema(self) -> str:
        return READ

    def reader(self, schema) -> GrdReader:
        return GrdReader(self.options)

    def writer(self, schema, overwrite: bool) -> GrdWriter:
        return GrdWriter(self.options, schema.names, overwrite)


def _shape(options) -> tuple[int, int, np.float32]:
    spec = GrdSpec()
    return int(options.get("height", spec.height)), int(options.get("width", spec.width)), np.float32(options.get("fill", spec.fill))


class GrdReader(DataSourceReader):
    """Day filters cut the slices; a task seeks to its first day and reads no other bytes."""

    def __init__(self, options) -> None:
        self.uri, self.slice_days = options["path"], int(options.get("slice_days", 64))
        self.height, self.width, self.fill = _shape(options)
        self.first, self.last = dt.date.min, dt.date.max

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        day = dt.timedelta(days=1)
        for f in filters:
            if getattr(f, "attribute", None) == ("date",):
                values = [v for v in (f.value if isinstance(f, In) else [f.value]) if v is not None] if hasattr(f, "value") else []
                if values and isinstance(f, EqualTo | In | GreaterThanOrEqual):
                    self.first = max(self.first, min(values))
                if values and isinstance(f, EqualTo | In | LessThanOrEqual):
                    self.last = min(self.last, max(values))
                if values and isinstance(f, GreaterThan) and values[0] < dt.date.max:
                    self.first = max(self.first, values[0] + day)
                if values and isinstance(f, LessThan) and values[0] > dt.date.min:
                    self.last = min(self.last, values[0] - day)
            yield f  # Spark filters once more, so nothing hangs on this being exact

    def partitions(self) -> list[Slice]:
        """One listing of the folder: a file a year, and as many slices as the days asked for need."""
        store, root = opened(self.uri)
        every_day = (self.first, self.last) == (dt.date.min, dt.date.max)
        found = []
        for info in store.get_file_info(fs.FileSelector(root)):
            if info.type != fs.FileType.File or not info.path.lower().endswith(".grd"):
                continue
            named = re.search(r"(\d{4})\.grd$", info.path, re.IGNORECASE)
            year = int(named[1]) if named and int(named[1]) > 0 else None
            if year is None or info.size != days_in(year) * self.height * self.width * 4:
                if every_day:
                    why = "no year in the name" if year is None else f"{info.size} bytes are not {days_in(year)} days"
                    found.append(Slice(info.path, year, fault=why))
                continue
            start, end = dt.date(year, 1, 1), dt.date(year, 12, 31)
            low, high = max(start, self.first), min(end, self.last)
            a, b = (low - start).days + 1, (high - start).days + 1
            found += [Slice(info.path, year, k, min(k + self.slice_days - 1, b)) for k in range(a, b + 1, self.slice_days)]
        # A source needs a task even where no file qualifies.
        return found or [Slice(root, None)]

    def read(self, part: Slice) -> Iterator[pa.RecordBatch]:
        if part.fault:
            columns = [[part.path], [None], [None], [None], [None], [part.fault]]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, KINDS, strict=True)], names=NAMES)
        if part.last < part.first:
            return
        cells = self.height * self.width
        rows = pa.array(np.repeat(np.arange(self.height, dtype=np.int32), self.width))
        cols = pa.array(np.tile(np.arange(self.width, dtype=np.int32), self.height))
        paths, clean = pa.repeat(pa.scalar(part.path), cells), pa.nulls(cells, pa.string())
        store, _ = opened(self.uri)
        with store.open_input_file(part.path) as held:
            for day in range(part.first, part.last + 1):
                v = np.frombuffer(held.read_at(cells * 4, (day - 1) * cells * 4), "<f4").astype(np.float32)
                missing = ~np.isfinite(v) | (np.abs(v - self.fill) < 1e-3)
                date = pa.scalar(dt.date(part.year, 1, 1) + dt.timedelta(days=day - 1), pa.date32())
                made = [paths, pa.repeat(date, cells), rows, cols, pa.array(v, mask=missing), clean]
                yield pa.RecordBatch.from_arrays(made, names=NAMES)


class GrdWriter(DataSourceArrowWriter):
    """Rows (year, day, row, col, value) in order of year and day, a year whole in one task.

    A task holds one day's slab. It writes under a name of its own; commit moves whole files to their places, so that a
    lost task leaves nothing that a reader takes for a year.
    """

    def __init__(self, options, names: list[str], overwrite: bool) -> None:
        self.uri, self.names, self.overwrite = options["path"], names, overwrite
        self.height, self.width, self.fill = _shape(options)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, root = opened(self.uri)
        store.create_dir(root)
        files: list[tuple[str, str]] = []
        out, year, day, slab = None, None, 0, None
        empty = np.full((self.height, self.width), self.fill, "<f4")

        def until(last: int) -> None:
            """Write the open slab and empty days up to `last`."""
            nonlocal day, slab
            while day <= last:
                out.write((empty if slab is None else slab).tobytes())
                day, slab = day + 1, None

        for batch in iterator:
            v = {n: batch.column(n).to_numpy(zero_copy_only=False) for n in ("year", "day", "row", "col", "value")}
            turns = np.flatnonzero((np.diff(v["year"]) != 0) | (np.diff(v["day"]) != 0)) + 1
            for part in np.split(np.arange(batch.num_rows), turns):
                if not len(part):
                    continue
                y, d = int(v["year"][part[0]]), int(v["day"][part[0]])
                if y != year:
                    if out:
                        until(days_in(year))
                        out.close()
                    files.append((f"{root}/_{uuid.uuid4().hex}", f"{root}/{y:04d}.grd"))
                    out, year, day, slab = store.open_output_stream(files[-1][0]), y, 1, None
                if not day <= d <= days_in(y):
                    raise ValueError(f"day {d} of {y} is out of order or out of range")
                if d > day:
                    until(d - 1)
                slab = empty.copy() if slab is None else slab
                slab[v["row"][part], v["col"][part]] = v["value"][part]
        if out:
            until(days_in(year))
            out.close()
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        store, _ = opened(self.uri)
        files = [pair for m in messages if m for pair in m.files]
        held = [new for _, new in files if store.get_file_info(new).type != fs.FileType.NotFound]
        if held and not self.overwrite:
            self.abort(messages)
            raise ValueError(f"{held[0]} is there already")
        for old, new in files:
            store.move(old, new)

    def abort(self, messages: list[Written | None]) -> None:
        store, _ = opened(self.uri)
        for old, _new in (pair for m in messages if m for pair in m.files):
            if store.get_file_info(old).type != fs.FileType.NotFound:
                store.delete_file(old)


def _options(path: str, spec: GrdSpec) -> dict:
    return {"path": path, "height": str(spec.height), "width": str(spec.width), "fill": str(spec.fill)}


def write_days(cells: DataFrame, path: str, spec: GrdSpec = GrdSpec(), mode: str = "append") -> None:
    """Cells (date, row, col, value) as yearly files; absent cells and nulls are filled.

    Of rows that name one cell the largest value stays. A row without a date, row or column is left out. Mode `append`
    refuses years that are there, `overwrite` replaces them; other years stay.
    """
    spark = cells.sparkSession
    spark.dataSource.register(GrdSource)
    day = cells.where("date is not null and row is not null and col is not null").select(
        F.year("date").alias("year"), F.dayofyear("date").alias("day"), F.col("row").cast("int"), F.col("col").cast("int"),
        F.coalesce(F.col("value").cast("float"), F.lit(spec.fill).cast("float")).alias("value"),
    )
    ordered = day.repartition("year").sortWithinPartitions("year", "day", "row", "col", "value")
    ordered.write.format("grd").options(**_options(path, spec)).mode(mode).save()


def read_days(spark: SparkSession, path: str, spec: GrdSpec = GrdSpec(), slice_days: int = 64) -> DataFrame:
    """(path, date, row, col, lat, lon, value, fault) of the archive's files; fill and non-finite values are null.

    Filters on `date` choose the bytes that are read. A file whose size does not fit its year gives one row with a
    fault, where no days are asked for. An empty folder gives no rows.
    """
    spark.dataSource.register(GrdSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    cells = spark.read.format("grd").options(**_options(path, spec), slice_days=str(slice_days)).load()
    return cells.select(
        "path", "date", "row", "col",
        (F.lit(spec.lat_min) + F.col("row") * spec.resolution).alias("lat"),
        (F.lit(spec.lon_min) + F.col("col") * spec.resolution).alias("lon"), "value", "fault",
    )
