"""Exact quantiles by repeated histograms: bounded memory, no sorting, no group held in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.windows import shared_path


def _stored(df: DataFrame) -> DataFrame:
    path = shared_path(df.sparkSession, "stratolab-bounds")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def quantiles(rows: DataFrame, keys: list[str], value: str, share: float, *, bins: int = 1024) -> DataFrame:
    """(keys, n, quantile): the linear quantile of each group's finite values, exactly, and how many there are.

    A round splits the range that holds the wanted rank into `bins` parts, counts values in them, partly on the map side, and
    keeps the part with the rank, tightened to the values in it, until that is one value. Parts of the first round are even in
    the logarithm and those of the others in the value, so about seven rounds tell any doubles apart. A last pass finds the
    next larger value. Groups without a finite value have no row; null keys are keys.
    """
    if not 0 <= share <= 1:
        raise ValueError("a share lies between 0 and 1")
    names = [f"k{i}" for i in range(len(keys))]
    finite = F.col(value).isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf"))
    # Halved, so that differences of finite doubles are finite; of numbers below 1e-307 that may cost the last bit.
    v = rows.where(finite).select(*[F.col(c).alias(k) for c, k in zip(keys, names, strict=True)], (F.col(value).cast("double") / 2).alias("v"))
    if not names:
        v, names = v.withColumn("k0", F.lit(0)), ["k0"]
    whole = v.groupBy(*names).agg(F.count("v").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
    rank = ((F.col("n") - 1) * share).alias("at")
    bounds = _stored(whole.select(*names, "n", rank, "low", "high", F.lit(0).cast("long").alias("below")))

    def met(open_: DataFrame) -> DataFrame:
        same = [v[k].eqNullSafe(open_[f"_{k}"]) for k in names]
        return v.join(open_, same)

    def scaled(c: str, first: bool) -> Column:
        """A non-decreasing image of a value; the smallest double's logarithm is above -745."""
        x = F.col(c)
        return F.when(x == 0, F.lit(0.0)).otherwise(F.signum(x) * (F.log(F.abs(x)) + 745)) if first else x

    first = True
    while not bounds.where("low < high").isEmpty():
        wide = bounds.where("low < high").select(*[F.col(k).alias(f"_{k}") for k in names], "n", "at", "low", "high", "below")
        inside = met(wide).where(F.col("v").between(F.col("low"), F.col("high")))
        v_at, low, high = (scaled(c, first) for c in ("v", "low", "high"))
        part = F.coalesce(F.least(F.floor(F.try_divide(v_at - low, high - low) * bins), F.lit(bins - 1)), F.lit(0))
        first = False
        ranges = [*names, "n", "at", "below"]
        counted = inside.groupBy(*ranges, part.alias("part")).agg(F.count("*").alias("c"), F.min("v").alias("low"), F.max("v").alias("high"))
        # At most `bins` rows a group.
        upto = F.sum("c").over(Window.partitionBy(*names).orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
        placed = counted.withColumn("below", F.col("below") + F.coalesce(upto, F.lit(0)))
        wanted = F.floor("at").between(F.col("below"), F.col("below") + F.col("c") - 1)
        closer = placed.where(wanted).select(*names, "n", "at", "low", "high", "below")
        bounds = _stored(bounds.where("low = high").unionByName(closer))

    found = bounds.select(*[F.col(k).alias(f"_{k}") for k in names], "n", "at", F.col("low").alias("here"), "below")
    above = met(found).groupBy(*names, "n", "at", "here", "below").agg(
        F.count_if(F.col("v") == F.col("here")).alias("same"), F.min(F.when(F.col("v") > F.col("here"), F.col("v"))).alias("next")
    )
    share_of = F.col("at") - F.floor("at")
    beyond = F.floor("at") + 1 >= F.col("below") + F.col("same")
    made = F.when(beyond & (share_of > 0), F.col("here") + (F.col("next") - F.col("here")) * share_of).otherwise(F.col("here")) * 2
    return above.select(*[F.col(k).alias(c) for c, k in zip(keys, names, strict=False)], "n", made.alias("quantile"))
