"""Spelling variants: words one edit apart, found exactly through pairs of trie nodes.

All words stand in two tries, one read forward and one backward, whose nodes are numbered. A word cut before code point i
is the pair (node of its first i code points, node of the rest), and no other word has that pair. Left
out code point i, it is the pair (node of the first i, node of what follows i). Two words with one pair
of the second kind differ by a replacement; one of the first kind and one of the second, by an insertion. So a
join of integer pairs finds exactly the words that are near, without a candidate too many.

Nodes are numbered from words in order: those new with a word are its prefixes longer than what it shares
with the word before. Parts of a range-sorted table are numbered apart; a part's first word may share a prefix with
words of earlier parts, and takes the numbers of those nodes from the path of the last word before.

Plan: words are counted with partial aggregation. At a pair there meet at most one word cut there and one
word for each letter that may be left out, so what is gathered at a pair is bounded by the alphabet; pairs of
words are never written out: each word gets its count and its best neighbour from the pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
DROPPED = 199  # of hashes, every so-manieth loses a code point


def words(docs: DataFrame, *, shortest: int = 6, least: int = 5) -> DataFrame:
    r"""(word, n) of the words of all texts with `shortest` code points or more that occur `least` times or more.

    Words are maximal runs of [A-Za-zÀ-ÿ], A-Z lower-cased. Of a run whose unsigned crc32 h of "<doc_id>:<run>"
    is a multiple of 199, the code point at h modulo its length is deleted first. A null id is an empty string there;
    null texts have no words; repeated rows count each.
    """
    run = F.explode(F.regexp_extract_all("text", F.lit(f"[A-Za-z\\u00C0-\\u00FF]{{{shortest},}}"), F.lit(0)))
    runs = docs.select("doc_id", run.alias("run")).select("doc_id", F.translate("run", UPPER, UPPER.lower()).alias("run"))
    h = F.crc32(F.encode(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), "run"), "UTF-8"))
    at = (F.col("h") % F.length("run")).cast("int")
    short = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    word = F.when(F.col("h") % DROPPED == 0, short).otherwise(F.col("run"))
    kept = runs.withColumn("h", h).select(word.alias("word")).where(F.length("word") >= shortest)
    return kept.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def shared(a: str, b: str) -> int:
    """The length of the longest common prefix."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if a[low:middle] == b[low:middle] else (low, middle - 1)
    return low


def numbered(found: list[str], path: list[int], last: str | None, new: int) -> Iterator[list[int]]:
    """Node numbers of the prefixes, the empty one first, of each of the sorted words.

    `last` and `path` are the word before and its numbers; new nodes are numbered from `new`.
    """
    for word in found:
        same = -1 if last is None else shared(last, word)
        path = path[: same + 1] + list(range(new, new + len(word) - same))
        new += len(word) - same
        last = word
        yield path


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per part: its number, first and last word, how many nodes are new there, and the last word's path.

    Nodes are numbered from 0; prefixes of the first word may belong to parts before, so its path counts as new here.
    """
    first = last = None
    path: list[int] = []
    part = new = 0
    for batch in batches:
        if batch.num_rows:
            part, found = batch.column(0)[0].as_py(), batch.column(1).to_pylist()
            first = found[0] if first is None else first
            for path in numbered(found, path, last, new):
                new = max(new, path[-1] + 1)
            last = found[-1]
    if first is not None:
        yield pa.RecordBatch.from_arrays(
            [pa.array([part]), pa.array([first]), pa.array([last]), pa.array([new]), pa.array([path], pa.list_(pa.int64()))],
            names=["part", "first", "last", "new", "path"],
        )


def _paths(starts: dict[int, tuple[int, str | None, list[int]]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None
        for batch in batches:
            if not batch.num_rows:
                continue
            found = batch.column(1).to_pylist()
            new, last, path = state or starts[batch.column(0)[0].as_py()]
            made = []
            for path in numbered(found, path, last, new):
                new = max(new, path[-1] + 1)
                made.append(path)
            state = new, found[-1], path
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(made, pa.list_(pa.int64()))], names=["word", "path"])

    return run


def tries(found: DataFrame, parts: int) -> DataFrame:
    """(word, path): for each of the distinct, non-null words, the trie nodes of its prefixes, the empty one first.

    Two prefixes have one number where, and only where, they are equal. One row a part reaches the driver: two words
    and a path.
    """
    dealt = found.select("word").repartitionByRange(parts, "word").withColumn("part", F.spark_partition_id())
    dealt = stored(dealt.sortWithinPartitions("word"), "trie-words")
    # A written part is read whole by one task, in order.
    sorted_ = dealt.repartition(parts, "part").sortWithinPartitions("part", "word").select("part", "word")
    ends = sorted_.mapInArrow(_split(_ends), "part long, first string, last string, new long, path array<long>").collect()
    starts: dict[int, tuple[int, str | None, list[int]]] = {}
    new, last, path = 0, None, []
    for r in sorted(ends, key=lambda r: r["part"]):
        starts[r["part"]] = (new, last, path)
        # The last word's path within its part, with the prefixes that it shares with earlier parts put in.
        same = -1 if last is None else shared(last, r["first"])
        both = min(same, shared(r["first"], r["last"]))
        path = path[: both + 1] + [new + k - (same + 1) for k in r["path"][both + 1 :]]
        new, last = new + r["new"] - (same + 1), r["last"]
    return sorted_.mapInArrow(_split(_paths(starts)), "word string, path array<long>")


def _split(work):
    """work done on each run of batches of one part; a task may hold several parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting = _pieces(batches)
        held = next(waiting, None)
        while held is not None:
            part, after = held.column(0)[0].as_py(), []

            def one(first=held, part=part, after=after):
                yield first
                for piece in waiting:
                    if piece.column(0)[0].as_py() != part:
                        after.append(piece)
                        return
                    yield piece

            yield from work(one())
            held = after[0] if after else None

    return run


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        parts = batch.column(0).to_numpy()
        cut = [0, *(np.flatnonzero(np.diff(parts)) + 1).tolist(), len(parts)]
        yield from (batch.slice(a, b - a) for a, b in zip(cut, cut[1:], strict=False) if b > a)


def pairs(named: DataFrame) -> DataFrame:
    """(head, tail, cut, fresh, neg, id) of each place of the words (id, word, n, path, back): integers only.

    cut: the word is cut there, and otherwise has a code point left out, which is fresh unless it repeats the one
    before: leaving out any of a run of equal ones gives the same word, so the first stands for all. neg is -n.
    """
    length, letters = F.length("word"), F.split("word", "")

    def place(i: Column, tail: Column, cut: bool, fresh: Column) -> Column:
        return F.struct(F.get("path", i).alias("head"), F.get("back", tail).alias("tail"), F.lit(cut).alias("cut"), fresh.alias("fresh"))

    whole = F.transform(F.sequence(F.lit(0), length), lambda i: place(i, length - i, True, F.lit(False)))
    new = lambda i: (i == 0) | (F.get("letters", i) != F.get("letters", i - 1))
    less = F.transform(F.sequence(F.lit(0), length - 1), lambda i: place(i, length - i - 1, False, new(i)))
    spelt = named.where(length > 0).withColumn("letters", letters)
    return spelt.select("id", (-F.col("n")).alias("neg"), F.explode(F.concat(whole, less)).alias("p")).select("p.*", "neg", "id")


def near(found: DataFrame, *, parts: int | None = None) -> DataFrame:
    """(id, word, n, n_near, best_n, best_id) of the distinct words (word, n): how many are one edit away, and the best of those.

    One edit is a code point inserted, deleted or replaced. Ids are in code-point order. The best near word is that of
    largest n, of several the first in code-point order; null where no word is near. Null and empty words are left out.
    """
    tasks = parts or int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = found.where("word is not null and word != ''")
    forward = tries(found, tasks)
    backward = tries(found.select(F.reverse("word").alias("word")), tasks).select(F.reverse("word").alias("word"), F.col("path").alias("back"))
    # A word's own node is its id: nodes are numbered in the order of words.
    named = stored(found.join(forward, "word").join(backward, "word").select(F.element_at("path", -1).alias("id"), "word", "n", "path", "back"), "trie-paths")
    met = pairs(named).groupBy("head", "tail").agg(F.collect_list(F.struct("cut", "fresh", "neg", "id")).alias("m")).where(F.size("m") > 1)

    def judged(x: Column) -> Column:
        """What the pair tells its member x: how many words it is near to here, and the best of them."""
        mates = F.filter(
            "m",
            lambda y: F.when(x["cut"], ~y["cut"] & y["fresh"]).when(y["cut"], x["fresh"]).otherwise(y["id"] != x["id"]),
        )
        best = F.array_min(F.transform(mates, lambda y: F.struct(y["neg"].alias("neg"), y["id"].alias("id"))))
        return F.struct(x["id"].alias("id"), F.size(mates).cast("long").alias("n_near"), best.alias("best"))

    told = met.select(F.explode(F.transform("m", judged)).alias("t")).select("t.*").where("n_near > 0")
    totals = told.groupBy("id").agg(F.sum("n_near").alias("n_near"), F.min("best").alias("best"))
    out = named.select("id", "word", "n").join(totals, "id", "left")
    return out.select("id", "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), (-F.col("best.neg")).alias("best_n"), F.col("best.id").alias("best_id"))


def roots(links: DataFrame) -> DataFrame:
    """(id, root) of links (id, to), one a row of an id, that go round in no circle: where following them ends.

    Each round every id takes the end of its end, so rounds are the logarithm of the longest chain.
    """
    ends = stored(links.select("id", "to"), "ends")
    while True:
        onward = ends.select(F.col("id").alias("to"), F.col("to").alias("next"))
        moved = stored(ends.join(onward, "to", "left").select("id", F.coalesce("next", "to").alias("to"), F.col("next").isNotNull().alias("open")), "ends")
        ends = moved.select("id", "to")
        if moved.where("open").isEmpty():
            return ends.withColumnRenamed("to", "root")


def groups(found: DataFrame, *, times: int = 5, parts: int | None = None) -> DataFrame:
    """Per distinct word (word, n): word, n, n_near, its form and root, and form_n.

    The form is the best near word if its n is `times` (above 1) the word's or more, else null; the root is the last of the
    forms that follow from the word, or itself. No words give no rows.
    """
    if times < 2:
        raise ValueError("a form must be commoner than its word")
    judged = stored(near(found, parts=parts).withColumn("to", F.when(F.col("best_n") >= F.col("n") * times, F.col("best_id"))), "variants")
    ended = roots(judged.where("to is not null").select("id", "to"))
    name = lambda c: judged.select(F.col("id").alias(c), F.col("word").alias(f"{c}_word"))
    linked = judged.where("to is not null").join(ended, "id").join(name("to"), "to").join(name("root"), "root")
    linked = linked.select("word", "n", "n_near", F.col("to_word").alias("form"), F.col("root_word").alias("root"), F.col("best_n").alias("form_n"))
    none = F.lit(None)
    alone = judged.where("to is null").select("word", "n", "n_near", none.cast("string").alias("form"), F.col("word").alias("root"), none.cast("long").alias("form_n"))
    return linked.unionByName(alone)


def report(docs: DataFrame) -> DataFrame:
    """Variant groups of the words of whole texts: at least 6 code points, at least 5 occurrences, forms 5 times as common."""
    return groups(stored(words(docs), "words"))
