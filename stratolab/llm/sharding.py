"""Sharding by balanced label propagation, with DataFrame functions only.

Documents of equal text are linked. Each starts in a shard by its hash. In a
round, a group's members look at how many of their neighbours each shard holds,
and move to the fullest one (or the fullest few, if the group is larger than a
shard) within that shard's quota. Unlinked documents cut no edge wherever they
are, so they make room: a last step moves them, and only if need be others,
until counts are at most one apart. That is the law `rows`.

Texts are read once; what goes through the rounds is a few numbers a row. The
rows of a very large group are not moved to meet its counts: those few counts are
broadcast. A shard's queue is cut into as many buckets as its size asks for.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import crc32_of, spread_join, stored, utf8


def _facts(docs: DataFrame, id_col: str, text_col: str, shards: int) -> DataFrame:
    text = F.col(text_col)
    facts = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 16).cast("long").alias("size"),
        crc32_of(text).cast("long").alias("text_crc32"),
        F.unhex(F.sha2(utf8(text), 256)).alias("grp"),
    )
    return facts.withColumn("shard", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(shards)).cast("int"))


def _room(linked: DataFrame, cap: int, shards: int) -> list[int]:
    """How many more linked rows each shard takes; one number a shard."""
    held = {r.shard: r["count"] for r in linked.groupBy("shard").count().collect()}
    return [max(0, cap - held.get(s, 0)) for s in range(shards)]


def _propagated(linked: DataFrame, total: int, room: list[int], cap: int, buckets: int) -> DataFrame:
    """One round: linked rows (.., grp, shard, moved) with shards after the moves that quotas allow."""
    linked = linked.drop("moved")
    counts = linked.groupBy("grp", "shard").agg(F.count("*").alias("c"))
    at = lambda shard: F.element_at(F.array(*map(F.lit, room)), shard + 1)
    order = Window.partitionBy("grp").orderBy(F.desc("c"), F.xxhash64("grp", "shard"), "shard")
    ranked = counts.withColumns({"n": F.sum("c").over(Window.partitionBy("grp")), "place": F.row_number().over(order)})
    # A group larger than a shard has several homes. At most as many rows a group as shards.
    homes = F.ceil(F.max("n") / F.lit(max(1, cap))).cast("int")
    targets = ranked.groupBy("grp").agg(
        F.sort_array(F.collect_list(F.struct("place", "shard", "c", (at(F.col("shard")) > 0).alias("free")))).alias("t"),
        homes.alias("homes"),
        F.max("n").alias("copies"),
    )
    home = F.exists(F.slice("t", 1, F.col("homes")), lambda x: x["shard"] == F.col("shard"))
    own = F.filter("t", lambda x: x["shard"] == F.col("shard"))[0]
    free = F.slice(F.filter("t", lambda x: x["free"]), 1, F.col("homes"))
    pick = F.try_element_at(free, (F.pmod(F.xxhash64("doc_id", "grp"), F.greatest(F.size(free), F.lit(1))) + 1).cast("int"))
    looked = spread_join(linked, targets, "grp", total).withColumn("pick", pick)
    looked = looked.withColumn("to", F.when(~home & (F.col("pick.place") < own["place"]), F.col("pick")))
    looked = looked.select(*linked.columns, F.col("to.shard").alias("target"), F.col("to.c").alias("gain"))
    stay = looked.where("target is null").select(*linked.columns, F.lit(False).alias("moved"))
    bucket = F.pmod(F.xxhash64("doc_id", "shard"), F.lit(buckets))
    queue = Window.partitionBy("target", "bucket").orderBy(F.desc("gain"), "grp", "doc_id")
    free = at(F.col("target"))
    share = F.floor(free / buckets) + F.when(F.col("bucket") < free % buckets, 1).otherwise(0)
    moved = (
        looked.where("target is not null")
        .withColumn("bucket", bucket)
        .withColumn("moved", F.row_number().over(queue) <= share)
        .withColumn("shard", F.when(F.col("moved"), F.col("target")).otherwise(F.col("shard")))
        .select(*linked.columns, "moved")
    )
    return stay.unionByName(moved)


def _levelled(rows: DataFrame, total: int, shards: int, buckets: int) -> DataFrame:
    """rows with shard and slot such that counts are at most one apart; linked rows keep their places first."""
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "size"), F.lit(buckets)).cast("int"))
    cells = stored(rows.groupBy("shard", "single", "bucket").count(), "shard-cells")
    quota = [total // shards + (s < total % shards) for s in range(shards)]
    held = [0] * shards
    for r in cells.groupBy("shard").agg(F.sum("count").alias("n")).collect():  # one row a shard
        held[r.shard] = r.n
    kept = [min(h, q) for h, q in zip(held, quota, strict=True)]
    surplus, needs, free = [], [], []
    over = under = 0
    for s in range(shards):
        surplus.append(over)
        over += held[s] - kept[s]
        free.append(under)
        under += quota[s] - kept[s]
        needs.append(under)
    before = Window.partitionBy("shard").orderBy("single", "bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = cells.select("shard", "single", "bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start"))
    place = Window.partitionBy("shard", "single", "bucket").orderBy("doc_id", "text_crc32")
    at = lambda values, index: F.element_at(F.array(*[F.lit(v).cast("long") for v in values]), index + 1)
    ranked = rows.join(starts, ["shard", "single", "bucket"]).withColumn(
        "rank", F.col("start") + F.row_number().over(place) - 1
    )
    index = at(surplus, F.col("shard")) + F.col("rank") - at(quota, F.col("shard"))
    to = F.size(F.filter(F.array(*[F.lit(v).cast("long") for v in needs]), lambda x: x <= F.col("index")))
    goes = F.col("rank") >= at(quota, F.col("shard"))
    return (
        ranked.withColumn("index", index)
        .withColumn("to", F.when(goes, to).otherwise(F.col("shard")))
        .withColumn(
            "slot", F.when(goes, at(kept, F.col("to")) + F.col("index") - at(free, F.col("to"))).otherwise(F.col("rank"))
        )
        .drop("shard")
        .withColumnRenamed("to", "shard")
    )


def shard(
    docs: DataFrame, *, shards: int = 40, rounds: int = 3, bucket_rows: int = 1000, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row of docs.

    Law `rows`: shard counts are at most one apart, and slots of a shard run from
    0 without a gap; grown_shard is null under it. A null text has size 16 and
    no links; an empty text is linked with other empty texts. Rows that repeat,
    and null ids, are placed like others. An empty table gives no row.
    """
    facts = stored(_facts(docs, id_col, text_col, shards), "shard-facts")
    total = facts.count()
    sizes = facts.where("grp is not null").groupBy("grp").count().where("count > 1").select("grp")
    sizes = stored(sizes, "linked-groups")
    linked = stored(facts.join(sizes, "grp", "left_semi").select(facts.columns), "linked")
    single = facts.join(sizes, "grp", "left_anti").select(facts.columns)
    cap = total // shards
    buckets = cap // bucket_rows + 1  # queues a shard, so that one task sorts no whole shard
    n_linked = linked.count()
    for _ in range(rounds):
        room = _room(linked, cap, shards)
        linked = stored(_propagated(linked, n_linked, room, cap, buckets), "linked")
        if linked.where("moved").isEmpty():
            break
    rows = linked.drop("moved").withColumn("single", F.lit(False)).unionByName(single.withColumn("single", F.lit(True)))
    rows = stored(rows.drop("grp"), "placed")
    return _levelled(rows, total, shards, buckets).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
