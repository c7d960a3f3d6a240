"""Windows over packed frames: a tile's values are an array, so time is worked on inside a row.

Cells are shuffled once, to the tile and the stretch of slots they belong to; a stretch also holds the frames
that its first windows look back on. Lookback, gaps, filling and masks are then array functions, and a window
costs no shuffle. A row holds tile^2 x (stretch + lookback) x channels values at most.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import Grid
from ..functions.scalar import filled, is_observed
from ..schema import BIT, LOOKBACK
from .sync import SLOT_S


@dataclass(frozen=True)
class Layout:
    """How a grid's frames are packed: square tiles, and stretches of slots with what windows look back on."""

    grid: Grid
    tile: int = 16
    stretch: int = 48
    offsets: tuple[int, ...] = LOOKBACK
    step_s: int = SLOT_S

    def __post_init__(self) -> None:
        if self.tile < 1 or max(self.offsets) > 0 or self.stretch < -min(self.offsets):
            raise ValueError("tiles have cells, windows look back, and no farther than a stretch")

    @property
    def size(self) -> tuple[Column, Column]:
        """Rows and columns of the tile (tile_row, tile_col): fewer at the grid's edge."""
        one = lambda c, n: F.least(F.lit(self.tile), F.lit(n) - F.col(c) * self.tile)
        return one("tile_row", self.grid.height), one("tile_col", self.grid.width)

    @property
    def places(self) -> Column:
        high, wide = self.size
        return high * wide

    def placed(self, cells: DataFrame) -> DataFrame:
        """cells (row, col, ..) with tile_row, tile_col and place, the number within the tile row by row; others are left out."""
        inside = cells.where(F.col("row").between(0, self.grid.height - 1) & F.col("col").between(0, self.grid.width - 1))
        tiles = {f"tile_{c}": F.floor(F.col(c) / self.tile).cast("int") for c in ("row", "col")}
        _, wide = self.size
        place = (F.col("row") - F.col("tile_row") * self.tile) * wide + F.col("col") - F.col("tile_col") * self.tile
        return inside.withColumns(tiles).withColumn("place", place.cast("int"))

    def unplaced(self, tiles: DataFrame, place: str) -> DataFrame:
        """tiles (tile_row, tile_col, place) with row and col instead."""
        _, wide = self.size
        row = F.col("tile_row") * self.tile + F.floor(F.col(place) / wide)
        col = F.col("tile_col") * self.tile + F.col(place) % wide
        return tiles.withColumns({"row": row.cast("int"), "col": col.cast("int")}).drop("tile_row", "tile_col", place)

    def own(self, slot: Column) -> Column:
        """The stretch that a slot's window belongs to."""
        return F.floor(slot / (self.stretch * self.step_s)).cast("long")

    def stretches(self, slot: Column) -> Column:
        """The stretches whose windows look at a slot: its own and perhaps the next."""
        return F.array_distinct(F.array(self.own(slot), self.own(slot - min(self.offsets) * self.step_s)))

    def slots(self, time: str) -> Column:
        """The window's slots, oldest first."""
        return F.array(*[F.col(time) + o * self.step_s for o in self.offsets])


def _tasks(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def dense(held: Column, places: Column) -> Column:
    """Values in order of place from an array of (place, value), each place once; null where there is none."""
    sorted_ = F.array_sort(held)
    some = F.transform(F.sequence(F.lit(0), places - 1), lambda p: F.get(F.filter(held, lambda x: x["place"] == p), F.lit(0))["value"])
    # Nearly always there is a value for every place.
    return F.when(F.size(held) == places, F.transform(sorted_, lambda x: x["value"])).otherwise(some)


def judge(times: DataFrame, frames: DataFrame, streams: list[str], layout: Layout, limit: int = 2) -> DataFrame:
    """(t0_s, stream, observed, accepted): one row a window and stream, `observed` one boolean a slot, oldest first.

    frames: (stream, slot_s, qc_flag), one row each; an absent frame is as MISSING_FILE. A window is refused
    without an observed frame or with more than `limit` frames missing in a row.
    """
    named = frames.where(F.col("stream").isin(streams)).withColumn("stretch", F.explode(layout.stretches(F.col("slot_s"))))
    flags = named.groupBy("stretch").agg(F.collect_list(F.struct("stream", "slot_s", "qc_flag")).alias("held"))
    wanted = times.select("t0_s", layout.own(F.col("t0_s")).alias("stretch"))
    each = wanted.join(flags, "stretch", "left").withColumn("stream", F.explode(F.array(*map(F.lit, streams))))
    mine = F.map_from_entries(F.transform(F.filter("held", lambda x: x["stream"] == F.col("stream")), lambda x: F.struct(x["slot_s"], x["qc_flag"])))
    each = each.select("t0_s", "stream", F.coalesce(mine, F.create_map().cast("map<bigint,int>")).alias("flags"))
    seen = F.transform(layout.slots("t0_s"), lambda slot: is_observed(F.coalesce(F.try_element_at("flags", slot), F.lit(BIT["MISSING_FILE"]))))
    return each.select("t0_s", "stream", seen.alias("observed")).withColumn("accepted", accepted(F.col("observed"), limit))


def accepted(observed: Column, limit: int = 2) -> Column:
    """Whether an array of booleans has a true one and no more than `limit` false ones in a row."""
    gaps = F.sequence(F.lit(0), F.size(observed) - (limit + 1))
    gap = F.exists(gaps, lambda k: ~F.exists(F.slice(observed, k + 1, limit + 1), lambda x: x))
    long = F.when(F.size(observed) > limit, gap).otherwise(F.lit(False))
    return F.exists(observed, lambda x: x) & ~long


def pack(cells: DataFrame, layout: Layout) -> DataFrame:
    """One row a (tile_row, tile_col, stretch): map frames of channel_idx to a map of slot_s to the tile's values.

    cells: (slot_s, channel_idx, row, col, value), a cell of a frame once. One shuffle, of the cells and of the
    share of them that two stretches look at.
    """
    placed = layout.placed(cells).withColumn("stretch", F.explode(layout.stretches(F.col("slot_s"))))
    tile = ["tile_row", "tile_col", "stretch"]
    # All that follows groups within what one task holds; few bytes here make many windows, so tasks aren't merged by size.
    placed = placed.select(*tile, "channel_idx", "slot_s", "place", "value").repartition(_tasks(cells), *tile)
    values = placed.groupBy(*tile, "channel_idx", "slot_s").agg(F.collect_list(F.struct("place", "value")).alias("held"))
    values = values.select(*tile, "channel_idx", "slot_s", dense(F.col("held"), layout.places).alias("values"))
    slots = values.groupBy(*tile, "channel_idx").agg(F.map_from_entries(F.collect_list(F.struct("slot_s", "values"))).alias("slots"))
    return slots.groupBy(*tile).agg(F.map_from_entries(F.collect_list(F.struct("channel_idx", "slots"))).alias("frames"))


def series(frames: Column, places: Column) -> Column:
    """Frames, arrays by place or null where a frame is missing, turned: for each place its values in time."""
    return F.transform(F.sequence(F.lit(0), places - 1), lambda p: F.transform(frames, lambda f: F.get(f, p)))


def fill_series(values: Column, blended: Column) -> Column:
    """Structs (value, filled): nulls between values blended linearly, or the nearer one, the earlier of equals, taken
    where `blended` is false; nulls before all or after all values held; all null stays null."""
    known = F.filter(F.transform(values, lambda v, k: F.when(v.isNotNull(), k)), lambda k: k.isNotNull())

    def at(v: Column, t: Column) -> Column:
        before = F.array_max(F.filter(known, lambda k: k < t))
        after = F.array_min(F.filter(known, lambda k: k > t))
        near = F.transform(F.array(F.struct(before.alias("p"), after.alias("q"))), lambda n: between(n, t))[0]
        made = F.when(v.isNull(), near).otherwise(v)
        return F.struct(made.alias("value"), (v.isNull() & made.isNotNull()).alias("filled"))

    def between(n: Column, t: Column) -> Column:
        p, q = F.get(values, n["p"]), F.get(values, n["q"])
        share = (t - n["p"]) / (n["q"] - n["p"])
        nearer = F.when(share <= 0.5, p).otherwise(q)
        return F.when(p.isNotNull() & q.isNotNull(), F.when(blended, p + (q - p) * share).otherwise(nearer)).otherwise(F.coalesce(p, q))

    return F.transform(values, at)


def windows(times: DataFrame, tiles: DataFrame, static: DataFrame, channels: list[tuple[int, bool, bool]], layout: Layout) -> DataFrame:
    """One row a window, tile and channel: (valid_time, channel_idx, tile_row, tile_col, values, filled, valid, cell_valid).

    The last four are arrays by frame of arrays by place. times: t0_s; tiles as from pack(); static: (channel_idx, tile_row,
    tile_col, values), the same in each frame. channels: (channel_idx, is_static, blended); all come out, whether they have cells
    or not. Missing values are filled from the window's other frames; valid: there is a finite one after that, and others are
    0; cell_valid: all dynamic channels of the cell have one.
    """
    grid, moving, still = layout.grid, [c for c in channels if not c[1]], [c for c in channels if c[1]]
    count = lambda n: F.sequence(F.lit(0), F.lit(-(-n // layout.tile) - 1))
    fixed = static.groupBy("tile_row", "tile_col").agg(F.map_from_entries(F.collect_list(F.struct("channel_idx", "values"))).alias("fixed"))
    # Stretches with a window, each with its windows: at most `stretch` a row.
    due = times.groupBy(layout.own(F.col("t0_s")).alias("stretch")).agg(F.collect_set("t0_s").alias("due"))
    every = due.withColumn("tile_row", F.explode(count(grid.height))).withColumn("tile_col", F.explode(count(grid.width)))
    tile = ["tile_row", "tile_col", "stretch"]
    held = every.repartition(_tasks(times), *tile).join(tiles, tile, "left").join(fixed, ["tile_row", "tile_col"], "left")
    one = held.withColumn("valid_time", F.explode("due")).withColumn("places", layout.places)
    at = layout.slots("valid_time")

    def dynamic(idx: int, blended: bool) -> Column:
        slots = F.try_element_at("frames", F.lit(idx))
        frames = F.transform(at, lambda slot: F.try_element_at(slots, slot))
        return F.transform(series(frames, F.col("places")), lambda s: fill_series(s, F.lit(blended)))

    def constant(idx: int) -> Column:
        kept = F.try_element_at("fixed", F.lit(idx))
        each = lambda p: F.array_repeat(F.struct(F.get(kept, p).alias("value"), F.lit(False).alias("filled")), len(layout.offsets))
        return F.transform(F.sequence(F.lit(0), F.col("places") - 1), each)

    named = lambda idx, s: F.struct(F.lit(idx).alias("channel_idx"), s.alias("series"))
    one = one.select("valid_time", "tile_row", "tile_col", "places", "frames", "fixed")
    one = one.withColumn("moving", F.array(*[named(i, dynamic(i, b)) for i, _, b in moving]) if moving else F.lit(None).cast("array<struct<channel_idx:int,series:array<array<struct<value:double,filled:boolean>>>>>"))
    one = one.withColumn("still", F.array(*[named(i, constant(i)) for i, _, _ in still]) if still else F.lit(None).cast(one.schema["moving"].dataType))
    steps, places = F.sequence(F.lit(0), F.lit(len(layout.offsets) - 1)), F.sequence(F.lit(0), F.col("places") - 1)
    turned = lambda of: F.transform(steps, lambda t: F.transform(places, lambda p: of(t, p)))
    whole = turned(lambda t, p: F.forall("moving", lambda c: F.get(F.get(c["series"], p), t)["value"].isNotNull()))
    one = one.withColumn("cell_valid", whole if moving else turned(lambda t, p: F.lit(True)))
    none = F.array().cast(one.schema["moving"].dataType)
    each = one.withColumn("c", F.explode(F.concat(F.coalesce("moving", none), F.coalesce("still", none))))
    each = each.select("valid_time", "c.channel_idx", "tile_row", "tile_col", "places", "cell_valid", F.col("c.series").alias("series"))
    value = lambda t, p: F.get(F.get("series", p), t)["value"]
    finite = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    return each.select(
        "valid_time", "channel_idx", "tile_row", "tile_col",
        turned(lambda t, p: filled(value(t, p))).alias("values"),
        turned(lambda t, p: F.get(F.get("series", p), t)["filled"]).alias("filled"),
        turned(lambda t, p: finite(value(t, p))).alias("valid"), "cell_valid",
    )


def unpacked(packed: DataFrame, layout: Layout) -> DataFrame:
    """packed windows a row a cell: (valid_time, t, channel_idx, row, col, value, valid, filled, cell_valid)."""
    frames = packed.select("valid_time", "channel_idx", "tile_row", "tile_col", F.posexplode(F.arrays_zip("values", "valid", "filled", "cell_valid")).alias("t", "f"))
    zipped = F.arrays_zip(*[F.col(f"f.{c}").alias(c) for c in ("values", "valid", "filled", "cell_valid")])
    cells = frames.select("valid_time", "t", "channel_idx", "tile_row", "tile_col", F.posexplode(zipped).alias("place", "x"))
    named = cells.select("valid_time", "t", "channel_idx", "tile_row", "tile_col", "place", F.col("x.values").alias("value"), "x.valid", "x.filled", "x.cell_valid")
    return layout.unplaced(named, "place").select("valid_time", "t", "channel_idx", "row", "col", "value", "valid", "filled", "cell_valid")


def summary(packed: DataFrame) -> DataFrame:
    """Per (valid_time, t, channel_idx): cells, how many are filled, valid and cell_valid, and the values' sum, without unpacking."""
    frames = packed.select("valid_time", "channel_idx", F.posexplode(F.arrays_zip("values", "valid", "filled", "cell_valid")).alias("t", "f"))
    true = lambda c: F.size(F.filter(F.col(f"f.{c}"), lambda x: x))
    total = F.aggregate("f.values", F.lit(0.0), lambda a, x: a + x)
    parts = frames.select("valid_time", "t", "channel_idx", F.size("f.values").alias("cells"), *[true(c).alias(c) for c in ("filled", "valid", "cell_valid")], total.alias("total"))
    return parts.groupBy("valid_time", "t", "channel_idx").agg(*[F.sum(c).alias(c) for c in ("cells", "filled", "valid", "cell_valid", "total")])
