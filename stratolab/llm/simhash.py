"""SimHash near-duplicates through a byte-position inverted index with count filtering.

Fingerprints of 64 bits are 8 positional bytes. Two that differ in at most 4
bits differ in at most 4 bytes, so they share at least 4 positional bytes: the
guaranteed minimum. Every fingerprint is posted under its positional bytes; a pair
with the minimum shares one of the first five positions, so these are enough. In a
posting list, each pair's shared positional bytes are tallied, only pairs that
reach the minimum are verified on their bits, and the others go.

A list of one positional byte holds 1/256 of all fingerprints. So that lists stay
near `list_rows` at any size, an index of many fingerprints refines each posting by
a second and a third shared position: pairs in such a list start with a tally of 2
or 3, and a pair with the minimum meets in the list of its first ones. A list's pairs
never leave its task: what leaves is a spanning forest of its links, fewer edges than members.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import spread_join, stored
from .components import components


def fingerprint(text: str | None, shingle: int = 4) -> int:
    """The unsigned SimHash of a text's word shingles; 0 without a word."""
    found = (text or "").encode().lower().split()
    if not found:
        return 0
    if len(found) <= shingle:
        hashes = [xxhash.xxh64_intdigest(b" ".join(found), 42)]
    else:
        line = b" ".join(found)
        ends = np.cumsum([len(w) + 1 for w in found])
        starts = np.concatenate(([0], ends[:-1]))[: len(found) - shingle + 1].tolist()
        stops = (ends[shingle - 1 :] - 1).tolist()
        one = xxhash.xxh64_intdigest
        hashes = [one(line[a:b], 42) for a, b in zip(starts, stops, strict=True)]
    return _majority(np.array(hashes, dtype=np.uint64))


def _majority(hashes: np.ndarray) -> int:
    """Bits that are set in more than half of the hashes."""
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 14):
        part = hashes[at : at + (1 << 14)].astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """(doc_id, fp): the fingerprint of each row's whole text, as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(t, shingle) for t in batch.column(1).to_pylist()]
            signed = np.array(found, dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(signed)], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, fp long")


def postings(minimum: int, depth: int, size: int = 8) -> list[tuple[int, ...]]:
    """Sets of `depth` positions that hold the first ones of any `minimum` of `size` positions."""
    return [
        t for t in combinations(range(size), depth) if all(p <= size - minimum + k for k, p in enumerate(t))
    ]


def tally(one: np.uint64 | np.ndarray, others: np.ndarray) -> np.ndarray:
    """How many positional bytes each of the others shares with one."""
    x = one ^ others
    for shift in (4, 2, 1):
        x |= x >> np.uint64(shift)
    return 8 - np.bitwise_count(x & np.uint64(0x0101010101010101))  # a byte's lowest bit: some bit differs


def links_in_list(fps: np.ndarray, most: int, minimum: int, verified: list[int] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links among distinct fps: breadth first over what is not yet reached.

    verified takes in how many pairs came to the comparison of bits, for tests.
    """
    left, a, b = fps.copy(), [], []
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            at = queue.pop()
            near = np.flatnonzero(tally(at, left) >= minimum)
            if verified is not None:
                verified.append(len(near))
            near = near[np.bitwise_count(at ^ left[near]) <= most]
            if len(near):
                got = left[near]
                a.append(np.full(len(got), at))
                b.append(got)
                queue.extend(got)
                left = np.delete(left, near)
    none = np.empty(0, dtype=np.uint64)
    return (np.concatenate(a), np.concatenate(b)) if a else (none, none)


def _forest(most: int, minimum: int):
    """Over rows sorted by posting list: the forest of each list's links."""

    def edges(lists: np.ndarray, parts: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
        cut = np.flatnonzero((np.diff(lists) != 0) | (np.diff(parts) != 0)) + 1
        starts, stops = np.concatenate(([0], cut)), np.concatenate((cut, [len(lists)]))
        sizes = stops - starts
        two = starts[sizes == 2]
        two = two[tally(fps[two], fps[two + 1]) >= minimum]
        good = two[np.bitwise_count(fps[two] ^ fps[two + 1]) <= most]
        a, b = [fps[good]], [fps[good + 1]]
        for s, t in zip(starts[sizes > 2].tolist(), stops[sizes > 2].tolist(), strict=True):
            p, q = links_in_list(np.unique(fps[s:t]), most, minimum)
            a.append(p)
            b.append(q)
        return pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate(v).view(np.int64)) for v in (a, b)], names=["a", "b"]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = tuple(np.empty(0, dtype=t) for t in (np.int64, np.int64, np.uint64))
        for batch in batches:
            if not batch.num_rows:
                continue
            new = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
            new[2] = new[2].view(np.uint64)
            rows = [np.concatenate(v) for v in zip(kept, new, strict=True)]
            change = np.flatnonzero((np.diff(rows[0]) != 0) | (np.diff(rows[1]) != 0))
            done = change[-1] + 1 if len(change) else 0  # the last list may go on in the next batch
            kept = tuple(v[done:] for v in rows)
            if done:
                yield edges(*(v[:done] for v in rows))
        if len(kept[0]):
            yield edges(*kept)

    return run


def links(fps: DataFrame, *, max_bits: int = 4, list_rows: int = 2000, block: int = 4000) -> DataFrame:
    """Edges (a, b) that span exactly the components of distinct fps linked at max_bits or fewer bits.

    Postings are of one position while a list of unrelated fingerprints is list_rows or
    fewer, else of two or three. A list longer than `block`, of fingerprints that are alike, is
    cut into parts, and each pair of parts is worked on as a list of its own, so a task holds
    at most two parts and no pair is missed. max_bits is 0 to 7: at least one byte must be shared.
    """
    if not 0 <= max_bits <= 7:
        raise ValueError("fingerprints must share a byte: 0 to 7 differing bits")
    minimum = 8 - max_bits
    count = fps.count()
    depth = next((d for d in (1, 2) if d < minimum and count <= list_rows * 256**d), min(3, minimum))
    keys = [
        F.struct(F.lit(n).alias("positions"), F.col("fp").bitwiseAND(F.lit(_signed(sum(0xFF << (8 * p) for p in t)))).alias("bytes"))
        for n, t in enumerate(postings(minimum, depth))
    ]
    posted = fps.select("fp", F.explode(F.array(*keys)).alias("k"))
    posted = posted.select("fp", F.xxhash64("k.positions", "k.bytes").alias("list"))
    long = posted.groupBy("list").count().where(F.col("count") > block)
    long = stored(long.select("list", F.ceil(F.col("count") / block).cast("int").alias("parts")), "long-lists")
    if long.isEmpty():
        dealt = posted.select("list", F.lit(0).cast("long").alias("part"), "fp")
    else:
        sized = posted.join(long, "list", "left")
        mine = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
        pairs = F.transform(
            F.sequence(F.lit(0), F.col("parts") - 1),
            lambda o: (F.least(o, F.col("mine")) * F.col("parts") + F.greatest(o, F.col("mine"))).cast("long"),
        )
        some = F.when(F.col("parts").isNull(), F.array(F.lit(0).cast("long"))).otherwise(pairs)
        dealt = sized.withColumn("mine", mine).select("list", F.explode(some).alias("part"), "fp")
    dealt = dealt.repartition("list", "part").sortWithinPartitions("list", "part", "fp")
    return dealt.mapInArrow(_forest(max_bits, minimum), "a long, b long")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def near_duplicates(docs: DataFrame, *, shingle: int = 4, max_bits: int = 4) -> DataFrame:
    """Per row: doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable).

    Null, empty and blank texts have fingerprint zero and are linked like any
    other. Rows may repeat; each gives a row. A null doc_id is no candidate for
    component_id, which is null only where every document reachable has none.
    """
    marked = stored(fingerprints(docs, shingle), "fingerprints")
    counted = marked.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("copies"))
    distinct = stored(counted, "distinct-fps")
    roots = components(links(distinct.select("fp"), max_bits=max_bits))
    grouped = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "first", "copies", F.coalesce("root", "fp").alias("root")
    )
    smallest = grouped.groupBy("root").agg(F.min("first").alias("component_id"))
    classes = stored(grouped.join(smallest, "root").select("fp", "copies", "component_id"), "classes")
    return spread_join(marked, classes, "fp", marked.count()).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )
