"""Mixing sources to target weights along a curriculum whose weights change with training time.

Every source has a weight schedule: knots of time, from 0 to 1, and weight, straight in between.
Its area is the source's weight; areas share out the words to be taken, and no source gives more
than `most` times what it has. A source's documents stand in an order drawn from a hash and are read
pass after pass. By time t a source must have given as much of its target as its schedule's area up to t is
of the whole area. That cumulative demand is inverted: the place of a document on its source's line, in
words, gives the time at which it is due, which is its training position. Sorting by position
puts the mix in order.

Plan: one row a document, without its text, is range-sorted by source and drawn order, so a
source of any size is spread over tasks; running sums are taken within sorted parts and carried
from part to part by the parts' sums. Nothing but one row a part reaches the driver.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import pairwise

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

WORD = r"[^\x20\x09-\x0D]+"
Knots = Sequence[tuple[float, float]]
# Weights 3, 1 and 2 for the sources in order, repeating: the first fades, the third grows, their sum is even.
SCHEDULES: tuple[Knots, ...] = (((0.0, 4.0), (1.0, 2.0)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 1.0), (1.0, 3.0)))


def areas(knots: Knots) -> list[float]:
    """The schedule's area from its first knot up to each knot."""
    times, weights = [k[0] for k in knots], [k[1] for k in knots]
    if len(knots) < 2 or times[0] != 0 or times[-1] != 1 or any(a >= b for a, b in pairwise(times)) or min(weights) < 0:
        raise ValueError("a schedule's times rise from 0 to 1, its weights are not negative")
    found = [0.0]
    for (t0, w0), (t1, w1) in pairwise(knots):
        found.append(found[-1] + (t1 - t0) * (w0 + w1) / 2)
    if not found[-1]:
        raise ValueError("a schedule needs a weight above zero")
    return found


def due(share: Column, knots: Knots) -> Column:
    """The time at which the schedule's area reaches `share`, 0 to 1, of the whole: its integral inverted."""
    upto = areas(knots)
    wanted, time = share * F.lit(upto[-1]), F.lit(1.0)
    for i in reversed(range(len(knots) - 1)):
        (t0, w0), (t1, w1) = knots[i], knots[i + 1]
        part = F.greatest(wanted - F.lit(upto[i]), F.lit(0.0))
        # The area is a quadratic of the time into the segment; its root without cancellation.
        root = F.sqrt(F.greatest(F.lit(w0 * w0) + part * F.lit(2 * (w1 - w0) / (t1 - t0)), F.lit(0.0)))
        into = F.when(root + F.lit(w0) > 0, part * 2 / (root + F.lit(w0))).otherwise(F.lit(0.0))
        here = F.least(F.lit(t0) + into, F.lit(t1))
        time = here if i == len(knots) - 2 else F.when(wanted < F.lit(upto[i + 1]), here).otherwise(time)
    return time


def running(df: DataFrame, order: list[str], value: str, name: str, parts: int) -> DataFrame:
    """df with long `name`: the sum of `value` over all rows that stand before in `order`, which no two rows may share.

    Rows are range-sorted into `parts` parts and written with their part; the sums of the parts before
    are one number a part.
    """
    dealt = df.repartitionByRange(parts, *[F.col(c).asc_nulls_first() for c in order]).withColumn("__part", F.spark_partition_id())
    dealt = stored(dealt, "running")
    sums = sorted((r["__part"], r["s"]) for r in dealt.groupBy("__part").agg(F.sum(value).alias("s")).collect())
    starts, at = {}, 0
    for part, s in sums:
        starts[part], at = at, at + s
    if not starts:
        return dealt.drop("__part").withColumn(name, F.lit(0).cast("long"))
    before = F.element_at(F.lit([starts.get(p, 0) for p in range(max(starts) + 1)]).cast("array<bigint>"), F.col("__part") + 1)
    earlier = Window.partitionBy("__part").orderBy(*[F.col(c).asc_nulls_first() for c in order]).rowsBetween(Window.unboundedPreceding, -1)
    return dealt.withColumn(name, before + F.coalesce(F.sum(value).over(earlier), F.lit(0))).drop("__part")


def targets(sources: DataFrame, *, share: float, most: float) -> DataFrame:
    """sources (source_size long, weight double, ..) with double `target`, the words each is to give.

    Together they give `share` times all sizes, each by its weight. What a source would give above
    `most` times its size is shared among the others by weight, until none is above. A round finds the
    sources that are above and is one aggregation; every round but the last adds some.
    """
    if not 0 <= share <= most:
        raise ValueError("the share can't exceed what all sources may give together")
    cap = F.col("source_size") * F.lit(float(most))
    level, full = None, -1
    while True:
        above = F.lit(False) if level is None else F.col("weight") * F.lit(level) > cap
        got = sources.agg(
            F.sum("source_size").alias("all"),
            F.sum(F.when(above, F.col("source_size")).otherwise(0)).alias("spent"),
            F.sum(F.when(above, 0.0).otherwise(F.col("weight"))).alias("weights"),
            F.count(F.when(above, 1)).alias("full"),
        ).first()
        if got.full == full or not got.weights:
            break
        full, level = got.full, (share * got["all"] - most * got.spent) / got.weights
    given = F.col("weight") * F.lit(level or 0.0)
    return sources.withColumn("target", F.when(given > cap, cap).otherwise(given))


def plan(docs: DataFrame, *, schedules: Sequence[Knots] = SCHEDULES, share: float = 1.5, most: int = 2, parts: int | None = None) -> DataFrame:
    """What the mix takes: one row for all repeats of a (doc_id, source, text).

    Columns doc_id, source, tie (md5 of the text), size (words), repeats (equal rows), source_size, target, taken, the words
    taken of all repeats, and takes: (repeat, pass, words, position) of each time one is read, words > 0. A source's line
    is its documents in order of md5("<doc_id>"), null first, then doc_id and tie, and repeats one behind the other.
    It is read up to the source's target, rounded to a whole number, so the document in which that falls gives its
    first words only; the line starts again after its end, `most` times in all. Sources in code-point
    order, null last, have `schedules` in turn. Null and blank texts have no words and take no part;
    tables without words, or empty, give targets of 0 and nothing taken.
    """
    tasks = parts or max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), docs.sparkSession.sparkContext.defaultParallelism)
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.md5(F.encode(F.coalesce("text", F.lit("")), "UTF-8")).alias("tie"), size.alias("size"))
    rows = stored(slim.groupBy("doc_id", "source", "tie", "size").agg(F.count("*").alias("repeats")), "mix-rows")

    found = rows.groupBy("source").agg(F.sum(F.col("size") * F.col("repeats")).alias("source_size"))
    ranked = running(found.withColumns({"last": F.col("source").isNull(), "one": F.lit(1).cast("long")}), ["last", "source"], "one", "rank", min(tasks, 32))
    kind = F.pmod("rank", F.lit(len(schedules))).cast("int")
    weight = F.element_at(F.array(*[F.lit(areas(k)[-1]) for k in schedules]), kind + 1)
    sources = stored(ranked.select("source", "rank", "source_size", kind.alias("kind"), weight.alias("weight")), "mix-sources")
    aimed = targets(sources, share=share, most=most).withColumn("stop", F.round("target").cast("long"))
    starts = running(aimed, ["rank"], "source_size", "source_start", min(tasks, 32))

    drawn = F.md5(F.encode(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "UTF-8"))
    total = rows.withColumns({"drawn": drawn, "last": F.col("source").isNull(), "words": F.col("size") * F.col("repeats")})
    line = running(total, ["last", "source", "drawn", "doc_id", "tie"], "words", "start", tasks)
    # Sources are few beside documents; a large table of them is left to adaptive skew joins.
    same = line["source"].eqNullSafe(starts["source"])
    placed = line.join(starts, same).select(line["*"], *[starts[c] for c in ("source_size", "source_start", "target", "stop", "kind")])
    at = F.col("start") - F.col("source_start")

    def take(k: Column, p: Column) -> Column:
        begin = at + k * F.col("size") + p * F.col("source_size")
        words = F.greatest(F.least(F.col("stop") - begin, F.col("size")), F.lit(0))
        fraction = begin / F.greatest(F.col("stop"), F.lit(1))
        position = F.element_at(F.array(*[due(fraction, s) for s in schedules]), F.col("kind") + 1)
        return F.struct(k.alias("repeat"), p.alias("pass"), words.alias("words"), position.alias("position"))

    nth = F.explode(F.sequence(F.lit(0).cast("long"), F.col("repeats") - 1))
    passes = F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda p: take(F.col("k"), p))
    one = placed.withColumn("k", nth).withColumn("takes", F.filter(passes, lambda x: x["words"] > 0))
    taken = F.aggregate("takes", F.lit(0).cast("long"), lambda a, x: a + x["words"])
    return one.select("doc_id", "source", "tie", "size", "source_size", "target", taken.alias("taken"), "takes")


def mixed(docs: DataFrame, *, salt_rows: int = 500, **options) -> DataFrame:
    """The mix in training order: each document as often as it is taken, with double mix_position and long mix_words.

    Rows are range-sorted by position, so that files written from them, one after the other, are in order. mix_words is
    the number of the text's first words that count. Of rows that are equal in doc_id, source and text one stands for
    all. Extra columns are carried; those named mix_position or mix_words are replaced.
    """
    docs = docs.drop("mix_position", "mix_words")
    key = [F.coalesce(F.col("doc_id").cast("long"), F.lit(0)), F.col("doc_id").isNull(), F.coalesce(F.col("source").cast("string"), F.lit("")), F.col("source").isNull(), F.md5(F.encode(F.coalesce("text", F.lit("")), "UTF-8"))]
    names = [f"k{i}" for i in range(len(key))]
    found = plan(docs, **options)
    each = found.select("takes", *[c.alias(n) for c, n in zip([*key[:4], F.col("tie")], names, strict=True)], F.explode("takes").alias("take"))
    # Repeats beyond salt_rows meet a copy of their text in another task.
    salted = each.select(*names, F.floor(F.col("take.repeat") / salt_rows).alias("salt"), F.col("take.position").alias("mix_position"), F.col("take.words").alias("mix_words"))
    whole = docs.select(F.struct("*").alias("row"), *[c.alias(n) for c, n in zip(key, names, strict=True)])
    salts = salted.groupBy(*names).agg(F.max("salt").alias("salts"))
    texts = whole.dropDuplicates(names).join(salts, names).withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), "salts")))
    out = salted.join(texts, [*names, "salt"]).select("row.*", "mix_position", "mix_words")
    return out.repartitionByRange(F.col("mix_position")).sortWithinPartitions("mix_position")


def report(docs: DataFrame, **options) -> DataFrame:
    """Per document row: doc_id, size, source_size, target, taken, and the position of its first word, null if none is taken.

    Repeated rows are rows of their own, one behind the other on their source's line. An empty table gives no rows.
    """
    found = plan(docs, **options)
    first = F.array_min(F.transform("takes", lambda x: x["position"]))
    return found.select("doc_id", "size", "source_size", "target", "taken", first.alias("first_position"))


ORACLE_SQL = """WITH s AS (SELECT doc_id, source, md5(coalesce(text, '')) AS tie, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS bigint) AS size FROM documents),
  src AS (SELECT source, CAST(sum(size) AS bigint) AS source_size FROM s GROUP BY source),
  w AS (SELECT *, CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS int) AS kind FROM src),
  o AS (SELECT *, [3.0::double, 1.0::double, 2.0::double][kind + 1] AS weight FROM w),
  f AS (SELECT *, 2 * source_size / weight AS fills FROM o),
  c AS (SELECT f.source, any_value(f.fills) AS fills, (1.5::double * sum(g.source_size)::double - 2 * coalesce(sum(g.source_size) FILTER (WHERE g.fills < f.fills), 0)::double)
      / sum(g.weight) FILTER (WHERE g.fills >= f.fills) AS level FROM f, f AS g GROUP BY f.source),
  lv AS (SELECT arg_min(level, fills) AS level FROM c WHERE level <= fills),
  t AS (SELECT source, kind, source_size, CASE WHEN weight * level > 2 * source_size THEN 2.0::double * source_size ELSE weight * level END AS target FROM o, lv),
  l AS (SELECT doc_id, size, source_size, target, kind, round(target) AS stop,
      coalesce(sum(size) OVER (PARTITION BY s.source ORDER BY md5(coalesce(CAST(doc_id AS varchar), '')), doc_id NULLS FIRST, tie ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::double AS a
    FROM s JOIN t ON s.source IS NOT DISTINCT FROM t.source),
  q AS (SELECT *, a / greatest(stop, 1) * [3.0::double, 1.0::double, 2.0::double][kind + 1] AS area, [4.0::double, 1.0::double, 1.0::double][kind + 1] AS w0, [-2.0::double, 0.0::double, 2.0::double][kind + 1] AS rise FROM l)
  SELECT doc_id, size, source_size, target, CAST(greatest(least(stop - a, size), 0) + greatest(least(stop - a - source_size, size), 0) AS bigint) AS taken,
    CASE WHEN size > 0 AND stop > a THEN least(2 * area / (sqrt(w0 * w0 + 2 * area * rise) + w0), 1) END AS first_position FROM q"""
