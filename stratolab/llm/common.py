"""What the operators of this package share: scratch tables and small helpers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.windows import shared_path


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share."""
    return shared_path(spark, f"stratolab-{name}")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: what follows recovers from the files."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def utf8(text) -> F.Column:
    """A text's bytes; null stays null."""
    return F.encode(text, "UTF-8")


def crc32_of(text) -> F.Column:
    return F.crc32(F.coalesce(utf8(text), F.lit(b"")))


HOT = 1000


def spread_join(left: DataFrame, right: DataFrame, key: str, total: int, how: str = "inner") -> DataFrame:
    """left joined to right, whose one row a key says in `copies` how many of left's `total` rows have it.

    At most HOT keys have more than total / HOT rows. Their rows of right, a proven bound,
    are broadcast, so left's rows of such a key stay where they are; the others are shuffled by the key.
    """
    limit = total // HOT + 1
    hot = F.broadcast(right.where(F.col("copies") > limit))
    cold = left.join(hot.select(key), key, "left_anti").join(right.where(F.col("copies") <= limit), key, how)
    return left.join(hot, key).unionByName(cold)


BITMAP, BITMAPS = 32_768, 2048  # bits of one of Spark's bitmaps, and how many are broadcast at most: 8 MB


def parted(rows: DataFrame, keys: DataFrame, columns: list[str], count: int) -> tuple[DataFrame, DataFrame]:
    """rows whose `columns` may stand in keys, and those whose certainly don't, by a bitmap of hashes.

    The second need not be shuffled to meet keys. Of the rows that don't stand in about `count` keys a sixteenth
    is in the first part, and more where these are beyond four million. The columns hold no nulls.
    """
    size = BITMAP * min(BITMAPS, 16 * count // BITMAP + 1)
    at = F.pmod(F.xxhash64(*columns), F.lit(size))
    number, bit = F.floor(F.col("at") / BITMAP).cast("int"), F.pmod("at", F.lit(BITMAP))
    maps = keys.select(at.alias("at")).groupBy(number.alias("bitmap")).agg(F.bitmap_construct_agg(bit).alias("bits"))
    byte = F.conv(F.hex(F.substr("bits", F.floor(bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    may = F.coalesce(F.getbit(byte, F.pmod("at", F.lit(8)).cast("int")) == 1, F.lit(False))
    marked = rows.withColumn("at", at).withColumn("bitmap", number).join(F.broadcast(maps), "bitmap", "left")
    return marked.where(may).select(rows.columns), marked.where(~may).select(rows.columns)
