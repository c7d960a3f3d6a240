"""Near copies by Jaccard similarity of word shingles: long SimHash sketches find them, sets decide.

A text's sketch is the SimHash of its distinct 5-word shingles in 512 bits: 64
positional bytes in 16 groups of four. Postings are kept for every two bytes of
a group, so a pair meets where it shares two bytes of any group. Two sets of
Jaccard similarity 0.8 differ in about 15 % of the bits (their cosine is 0.889)
and share a byte with probability 0.27; the pair is missed if no group shares
two, with probability 0.4 %, and 0.03 % at 0.85.

Inside a list pairs are screened on 256 bits of the sketch, and a spanning forest
of the links leaves the task. Unrelated texts that meet in a list pass that with a
probability of about 1e-12, so links join texts that are alike: even of 100 million texts a
dozen pairs or so are linked by chance. Texts that links join are then compared as whole shingle
sets, group by group; only pairs whose similarity reaches the threshold count.

Lists grow with the corpus (8000 texts each at 500 million), and all pairs of a list are compared
at any size: which pairs are found is a matter of their texts alone. The work in lists of unrelated texts
grows with the square of their length; a spanning forest of alike texts takes time linear in it.

Only where a caller gives `refine_at`, which the pipeline does not, are lists beyond it
refined: a text goes on in 16 lists, each by one further byte of its sketch, which are 256 times
shorter where texts are unrelated, so a list's work falls to a sixteenth; twice at most. A
pair that met in a refined list meets again with probability 99.3 % at similarity 0.8, and such a pair
meets in seven lists on average; so then a pair may be lost for the size of the corpus. Lists
that are long because their texts are alike are not refined.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored
from .components import components

WORDS, SCREENED = 8, 4  # 64-bit words of a sketch, and those that postings carry
PAIRS = [(4 * g + i, 4 * g + j) for g in range(2 * WORDS) for i, j in combinations(range(4), 2)]
CARRIED = sum(j < 8 * SCREENED for _, j in PAIRS)
FURTHER = 16  # bytes that a long list is refined by
_TOP = 1 << 23  # set in lists of two bytes, so that keys of refined lists, 12 bits longer, differ from theirs
MARKS = [f"s{i}" for i in range(SCREENED)]
# Of 256 bits 39 differ at similarity 0.8 and 120 between unrelated texts that share two bytes, with deviations of 6 and 8.
MOST_BITS = 66


def shingles(text: str | None, size: int = 5) -> np.ndarray:
    """Sorted hashes of the distinct word shingles; a shorter text is one shingle, a blank one has none."""
    found = (text or "").encode().lower().split()
    if not found:
        return np.empty(0, dtype=np.uint64)
    line = b" ".join(found)
    if len(found) <= size:
        return np.array([xxhash.xxh64_intdigest(line, 42)], dtype=np.uint64)
    ends = np.cumsum([len(w) + 1 for w in found])
    starts = np.concatenate(([0], ends[:-1]))[: len(found) - size + 1].tolist()
    stops = (ends[size - 1 :] - 1).tolist()
    one = xxhash.xxh64_intdigest
    return np.unique(np.array([one(line[a:b], 42) for a, b in zip(starts, stops, strict=True)], dtype=np.uint64))


def sketch(hashes: np.ndarray) -> bytes:
    """Bits that are set in more than half of the hashes, each stretched to 512 bits."""
    ones = np.zeros(64 * WORDS, dtype=np.int64)
    step = np.arange(1, WORDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for at in range(0, len(hashes), 255):  # sums of 255 rows fit a byte
        x = hashes[at : at + 255, None] + step
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
        ones += np.unpackbits(x.view(np.uint8), axis=1).sum(axis=0, dtype=np.uint8)
    return np.packbits(2 * ones > len(hashes)).tobytes()


def _sketches(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sketch(shingles(t, size)) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(found, pa.binary())], names=["id", "node", "sketch"]
            )

    return run


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    first, second = (np.array(x) for x in zip(*PAIRS, strict=True))
    base = (np.arange(len(PAIRS)) << 16) + _TOP
    for whole in batches:
        for at in range(0, whole.num_rows, 1000):
            batch = whole.slice(at, 1000)
            raw = np.frombuffer(b"".join(batch.column(1).to_pylist()), dtype=np.uint8).reshape(-1, 8 * WORDS)
            lists = base + (raw[:, first].astype(np.int64) << 8) + raw[:, second]
            some = raw.view(np.int64)[:, :SCREENED]
            columns = [lists.ravel()]
            columns += [np.repeat(v, len(PAIRS)) for v in (batch.column(0).to_numpy(), *some.T)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["list", "node", *MARKS])


def _deeper(level: int):
    """Postings of lists marked `deep` once for each further byte, others as they are.

    Of the 28 carried bytes outside the list's own group the first level takes 16, the second
    the 16 that follow, in a ring, the one by which the list was refined.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["list", "node", *MARKS]
        for whole in batches:
            for at in range(0, whole.num_rows, 4000):
                batch = whole.slice(at, 4000)
                deep = batch.column(len(names)).fill_null(False)
                yield pa.RecordBatch.from_arrays(batch.filter(pc.invert(deep)).columns[: len(names)], names=names)
                lists, node, *marks = (c.to_numpy() for c in batch.filter(deep).columns[: len(names)])
                raw = np.stack(marks, axis=1).view(np.uint8).reshape(-1, 8 * SCREENED)
                group = ((lists >> 12 * level + 16) & 127) // 6
                start = (lists >> 8 & 15) + 1 if level else np.zeros_like(lists)
                step = (start[:, None] + np.arange(FURTHER)) % 28
                byte = np.take_along_axis(raw, (4 * group[:, None] + 4 + step) % (8 * SCREENED), axis=1)
                longer = (lists[:, None] << 12) + (np.arange(FURTHER) << 8) + byte
                columns = [longer.ravel(), *(np.repeat(c, FURTHER) for c in (node, *marks))]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)

    return run


def _forest(count: int, near: Callable[[int, np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of 0 to count-1: breadth first over what is not yet reached; near says who links."""
    left, a, b = np.arange(count), [], []
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            at = queue.pop()
            good = near(at, left)
            if good.any():
                got = left[good]
                a.append(np.full(len(got), at))
                b.append(got)
                queue.extend(got)
                left = left[~good]
    none = np.empty(0, dtype=np.int64)
    return (np.concatenate(a), np.concatenate(b)) if a else (none, none)


def _runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[pa.Array]]:
    """Columns of whole runs of rows with equal values in the first `keys` columns, several runs at once."""
    kept: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        new = pa.Table.from_batches([batch])
        rows = new if kept is None else pa.concat_tables([kept, new])
        change = _cuts([rows.column(i).to_numpy() for i in range(keys)])
        done = int(change[-1]) if len(change) else 0  # the last run may go on in the next batch
        kept = rows.slice(done)
        if done:
            yield [c.combine_chunks() for c in rows.slice(0, done).columns]
    if kept is not None and kept.num_rows:
        yield [c.combine_chunks() for c in kept.columns]


def _cuts(keys: list[np.ndarray]) -> np.ndarray:
    return np.flatnonzero(np.any([np.diff(k) != 0 for k in keys], axis=0)) + 1


def _edges(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _screened(batches: Iterator[pa.RecordBatch], refined: bool = False) -> Iterator[pa.RecordBatch]:
    """Edges of each posting list's forest.

    An edge whose ends share an earlier list, as far as the carried bytes show,
    is left to that list: there its ends are joined. Where lists were refined they need
    not meet there, so each list gives all its edges.
    """
    first, second = (np.array(x) for x in zip(*PAIRS[:CARRIED], strict=True))
    for columns in _runs(batches, 2):
        lists, parts, nodes, *some = (c.to_numpy(zero_copy_only=False) for c in columns)
        marks = np.stack(some, axis=1).view(np.uint64)
        cut = _cuts([lists, parts])
        starts, stops = np.concatenate(([0], cut)), np.concatenate((cut, [len(lists)]))
        two = starts[stops - starts == 2]
        good = two[np.bitwise_count(marks[two] ^ marks[two + 1]).sum(axis=1) <= MOST_BITS]
        a, b = [good], [good + 1]
        more = stops - starts > 2
        for s, t in zip(starts[more].tolist(), stops[more].tolist(), strict=True):
            here = marks[s:t]
            p, q = _forest(t - s, lambda at, left, m=here: np.bitwise_count(m[at] ^ m[left]).sum(axis=1) <= MOST_BITS)
            a.append(p + s)
            b.append(q + s)
        a, b = np.concatenate(a), np.concatenate(b)
        if refined:
            yield _edges(nodes[a], nodes[b])
            continue
        same = (marks[a] ^ marks[b]).view(np.uint8).reshape(-1, 8 * SCREENED) == 0
        shared = same[:, first] & same[:, second]
        mine = np.where(shared.any(axis=1), shared.argmax(axis=1) == (lists[a] - _TOP) >> 16, True)
        yield _edges(nodes[a[mine]], nodes[b[mine]])


def _sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingles(t, size).tobytes() for t in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(found, pa.binary())], names=["root", "parts", "node", "shingles"]
            )

    return run


def exact_forest(sets: list[np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the pairs of sets with Jaccard similarity of percent or more."""
    sizes = np.array([len(x) for x in sets])
    ends = np.concatenate(([0], np.cumsum(sizes)))
    _, place = np.unique(np.concatenate(sets), return_inverse=True)

    def near(at: int, left: np.ndarray) -> np.ndarray:
        hit = np.zeros(len(place), dtype=bool)
        hit[place[ends[at] : ends[at + 1]]] = True
        upto = np.concatenate(([0], np.cumsum(hit[place])))
        both = upto[ends[left + 1]] - upto[ends[left]]
        return both * (100 + percent) >= percent * (sizes[at] + sizes[left])

    return _forest(len(sets), near)


def _verified(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in _runs(batches, 2):
            roots, parts, nodes = (c.to_numpy(zero_copy_only=False) for c in columns[:3])
            cut = _cuts([roots, parts])
            for s, t in zip([0, *cut.tolist()], [*cut.tolist(), len(roots)], strict=True):
                a, b = exact_forest([np.frombuffer(x.as_py(), dtype=np.uint64) for x in columns[3][s:t]], percent)
                yield _edges(nodes[s + a], nodes[s + b])

    return run


def _dealt(rows: DataFrame, parts: str, deal_by: str) -> DataFrame:
    """rows once for each pair of parts that their own part stands in, as long `part`."""
    n, mine = F.col(parts), F.pmod(F.xxhash64(deal_by, F.lit(1)), F.col(parts))
    pair = lambda o: (F.least(o, mine) * n + F.greatest(o, mine)).cast("long")
    return rows.withColumn("part", F.explode(F.transform(F.sequence(F.lit(0), n - 1), pair)))


def _id(df: DataFrame) -> list[F.Column]:
    return [F.coalesce(df["id"], F.lit(0)).alias("k0"), df["id"].isNull().alias("k1")]


def linked(texts: DataFrame, block: int, refine_at: int | None = None) -> DataFrame:
    """Links (a, b) of texts (node, sketch): a spanning forest of what each posting list joins.

    All pairs of a list are compared, unless lists beyond refine_at are to be refined, which may lose pairs.
    """
    schema = "list long, node long, " + ", ".join(f"{m} long" for m in MARKS)
    posted = texts.select("node", "sketch").mapInArrow(_postings, schema)
    refined = False

    def over(rows: DataFrame) -> DataFrame:
        least = block if refine_at is None else min(block, refine_at)
        return stored(rows.groupBy("list").count().where(F.col("count") > least), "long-lists")

    long = over(posted)
    if refine_at is not None:
        # By chance a list of two bytes holds 1 / 65536 of all texts, a refined one 1 / 256 of its list; far fuller ones hold alike texts.
        chance = (F.col("count") > refine_at) & (4096 * F.col("count") <= texts.count())
    for level in range(0 if refine_at is None else 2):
        deep = stored(long.where(chance), "deep-lists")
        if deep.isEmpty():
            break
        marked = posted.join(deep.select("list", F.lit(True).alias("deep")), "list", "left").select("list", "node", *MARKS, "deep")
        posted, refined = marked.mapInArrow(_deeper(level), schema), True
        long = over(posted)
        parents = deep.select(F.col("list").alias("parent"), F.col("count").alias("held"))
        long = long.join(parents, F.shiftright("list", 12) == F.col("parent"), "left").drop("parent")
        chance = (F.col("count") > refine_at) & (16 * F.col("count") <= F.col("held"))
    long = long.where(F.col("count") > block).select("list", F.ceil(F.col("count") / block).alias("parts"))
    if long.isEmpty():
        listed = posted.withColumn("part", F.lit(0).cast("long"))
    else:
        sized = posted.join(long, "list", "left").withColumn("parts", F.coalesce("parts", F.lit(1).cast("long")))
        listed = _dealt(sized, "parts", "node")
    listed = listed.select("list", "part", "node", *MARKS).repartition("list", "part")
    listed = listed.sortWithinPartitions("list", "part", "node")
    if not refined:
        return listed.mapInArrow(_screened, "a long, b long")
    return listed.mapInArrow(lambda batches: _screened(batches, True), "a long, b long").distinct()


def representatives(
    docs: DataFrame, *, shingle: int = 5, percent: int = 80, block: int = 20_000, set_block: int = 128, refine_at: int | None = None
) -> DataFrame:
    """docs with one row of each group of near copies: that of the smallest doc_id; columns unchanged.

    Groups are the components of texts linked at Jaccard similarity percent / 100
    or more. Texts are told apart by a 64-bit hash, so rows that share a doc_id
    but not the text are decided apart. Null, empty and blank texts are one group.
    Rows with null ids stay only in groups where no row has an id, and then all
    stay: nothing tells them apart. Repeated rows of the kept id and text leave one.

    Posting lists longer than `block`, and groups of more than `set_block` texts, are cut
    into parts; each pair of parts is worked on as a list of its own, so no pair is missed. With `refine_at`, lists longer than that are refined
    by further bytes first, which saves work on more than some five hundred million texts and may miss pairs that whole lists find.
    """
    named = docs.select(
        F.col("doc_id").cast("long").alias("id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("node"), "text"
    )
    rows = named.mapInArrow(_sketches(shingle), "id long, node long, sketch binary")
    texts = stored(rows.groupBy("node", "sketch").agg(F.min("id").alias("id")), "sketches")
    loose = components(linked(texts, block, refine_at))

    # More parts for larger groups, up to 16; then parts of 8 * set_block texts.
    parts = F.greatest(F.least(F.lit(16), F.ceil(F.col("count") / set_block)), F.ceil(F.col("count") / (8 * set_block)))
    groups = loose.join(loose.groupBy("root").count().select("root", parts.cast("long").alias("parts")), "root")
    wanted = texts.join(groups, "node").select("root", "parts", "node", "id")
    wanted = wanted.select("root", "parts", "node", *_id(wanted))
    whole = named.select("node", "text", *_id(named)).join(wanted, ["k0", "k1", "node"])
    whole = whole.dropDuplicates(["k0", "k1", "node"]).select("root", "parts", "node", "text")
    sets = whole.mapInArrow(_sets(shingle), "root long, parts long, node long, shingles binary")
    listed = _dealt(sets, "parts", "node").select("root", "part", "node", "shingles").repartition("root", "part")
    links = listed.sortWithinPartitions("root", "part", "node").mapInArrow(_verified(percent), "a long, b long")

    roots = components(links)
    grouped = texts.select("node", "id").join(roots, "node", "left").select("node", "id", F.coalesce("root", "node").alias("root"))
    keeper = F.min(F.when(F.col("id").isNotNull(), F.struct("id", "node")))
    smallest = stored(grouped.groupBy("root").agg(keeper.alias("keeper")), "keepers")
    nameless = grouped.where("id is null").join(smallest.where("keeper is null"), "root").select("id", "node")
    kept = smallest.where("keeper is not null").select("keeper.*").unionByName(nameless)
    kept = kept.select("node", *_id(kept))

    keys = ["__k0", "__k1", "__node"]
    doc_id = F.col("doc_id").cast("long")
    parts = [F.coalesce(doc_id, F.lit(0)), doc_id.isNull(), F.xxhash64(F.coalesce("text", F.lit("")))]
    # The row goes along as one struct, so its columns may have any name.
    joined = docs.select(F.struct("*").alias("row"), *[p.alias(k) for p, k in zip(parts, keys, strict=True)])
    joined = joined.join(kept.toDF("__node", "__k0", "__k1"), keys, "left_semi")
    # Deduplicated by the join's own keys, so its partitioning serves both.
    one = joined.where("not __k1").dropDuplicates(keys)
    return joined.where("__k1").unionByName(one).select("row.*")
