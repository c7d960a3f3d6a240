"""The pipeline's near-duplicate stage against brute-force Jaccard similarity."""

from __future__ import annotations

import random

import corpus_pipeline
import numpy as np
import pyarrow as pa
import pytest
from stratolab.llm import near_copies


def brute_sets(text, size=5):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


def brute_kept(rows):
    """Ids of the smallest row of each component at similarity 0.8 or more; rows are (id, text), ids not null."""
    rows = sorted(rows, key=str)
    sets, root = [brute_sets(t) for _, t in rows], list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both):
                root[top(i)] = top(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[top(i)] = min(d, least.get(top(i), d))
    return sorted(least.values())


def edited(rng, words, share):
    """words with one run replaced, so that about share of the shingles of both stay shared."""
    n = len(words)
    gone = round((1 - share) / (1 + share) * n)
    at = rng.randrange(5, n - gone - 5)
    return words[:at] + [f"new{rng.random()}" for _ in range(max(1, gone - 4))] + words[at + max(1, gone - 4) :]


def near_rows(n=60):
    rng = random.Random(3)
    rows = []
    for k in range(n):
        words = [f"w{rng.randrange(10**6)}" for _ in range(rng.randrange(60, 400))]
        rows.append((10 * k, " ".join(words)))
        for i, share in enumerate((0.7, 0.78, 0.82, 0.86, 0.9)):
            rows.append((10 * k + 1 + i, " ".join(edited(rng, words, share))))
    return rows


@pytest.mark.parametrize("options", [{}, {"block": 5, "set_block": 2}])
def test_stage_is_brute_force_jaccard(spark, sf_dir, options):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    docs = docs.unionByName(spark.createDataFrame(near_rows(), "doc_id long, text string").selectExpr("doc_id + 1000000 AS doc_id", "text"))
    stage = corpus_pipeline.near_duplicate_stage(spark, docs, sf_dir) if not options else near_copies.representatives(docs, **options)
    got = sorted(r.doc_id for r in stage.collect())
    want = brute_kept([tuple(r) for r in docs.collect()])
    # Nothing below 0.8 may go; a pair in some hundreds may be missed by every list.
    assert set(want) <= set(got)
    assert len(got) - len(want) <= 3


def test_rows_without_words_and_repeats(spark):
    rows = [(5, "alpha beta"), (5, "alpha beta"), (3, None), (2, ""), (4, " \n"), (9, "ALPHA  beta")]
    kept = near_copies.representatives(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r.doc_id for r in kept.collect()) == [2, 5]
    assert near_copies.representatives(kept.limit(0)).count() == 0


def test_rows_that_share_an_id_or_have_none(spark):
    own = [" ".join(f"{k}{i}" for i in range(40)) for k in "abcd"]
    rows = [(7, own[0]), (7, own[1]), (1, own[2]), (None, own[2]), (None, own[3]), (None, own[3])]
    kept = near_copies.representatives(spark.createDataFrame(rows, "doc_id long, text string"))
    # Both texts of id 7 stay; the null row of a group with an id goes, those of a group without one stay.
    assert sorted(map(tuple, kept.collect()), key=str) == sorted([*rows[:3], *rows[4:]], key=str)


def test_unrelated_texts_are_not_linked(spark):
    """Sketches of 40,000 unrelated texts: with two bytes shared and 128 bits compared some 400 pairs would be linked."""
    from pyspark.sql import functions as F

    texts = spark.range(40_000).select(F.col("id").alias("node"), F.unhex(F.sha2(F.col("id").cast("string"), 512)).alias("sketch"))
    near = texts.limit(1).select(F.lit(1_000_000).cast("long").alias("node"), "sketch")
    links = near_copies.linked(texts.unionByName(near), 20_000).collect()
    assert len(links) > 0 and all(1_000_000 in (r.a, r.b) for r in links)
    assert len({(r.a, r.b) for r in links}) == 1


def test_refined_lists_keep_links(spark):
    """Every list of two or more is refined, some twice; pairs that differ in 15 % of the bits still meet, unrelated texts don't."""
    rng = np.random.default_rng(5)
    bits = rng.integers(0, 2, (20_000, 512), dtype=np.uint8)
    pairs = 1000
    bits[pairs : 2 * pairs] = bits[:pairs] ^ (rng.random((pairs, 512)) < 0.15)
    rows = [(i, bytearray(b.tobytes())) for i, b in enumerate(np.packbits(bits, axis=1))]
    texts = spark.createDataFrame(rows, "node long, sketch binary")

    def links(**options):
        return {tuple(sorted(r)) for r in near_copies.linked(texts, 20_000, **options).collect()}

    plain, refined = links(), links(refine_at=1)
    assert all(b - a == pairs for a, b in plain | refined)
    assert refined <= plain and len(refined) > 0.985 * len(plain) > 0.97 * pairs


def test_long_lists_are_refined_by_bytes_they_do_not_use():
    """Postings of one text, refined twice: each key goes on with a byte of the sketch that it does not hold yet."""
    sketch = bytes(range(64))  # a byte's value is its position
    [first] = near_copies._postings(iter([pa.RecordBatch.from_pydict({"node": [7], "sketch": [sketch]})]))
    keys = {k: {k >> 8 & 255, k & 255} for k in first.column(0).to_pylist()}
    rows = first
    for level in range(2):
        marked = pa.RecordBatch.from_arrays([*rows.columns, pa.array([True] * rows.num_rows)], names=[*rows.schema.names, "deep"])
        rows = pa.Table.from_batches(near_copies._deeper(level)(iter([marked]))).combine_chunks().to_batches()[0]
        longer = rows.column(0).to_pylist()
        assert len(set(longer)) == 16 * len(keys)
        assert all(k & 255 not in keys[k >> 12] for k in longer)
        keys = {k: keys[k >> 12] | {k & 255} for k in longer}


def test_long_lists_lose_no_pair_for_the_size_of_the_corpus(spark, monkeypatch):
    """A list of 9000 texts gives every pair within the bound, also where the corpus counts as 2 ** 40 texts."""
    rng = np.random.default_rng(11)
    pairs = 600
    bits = rng.integers(0, 2, (9000, 512), dtype=np.uint8)
    bits[pairs : 2 * pairs] = bits[:pairs] ^ (rng.random((pairs, 512)) < 0.23)
    bits[:, :16] = 0  # all share the first list
    packed = np.packbits(bits, axis=1)
    near = np.flatnonzero((bits[:pairs, :256] != bits[pairs : 2 * pairs, :256]).sum(axis=1) <= near_copies.MOST_BITS)
    texts = spark.createDataFrame([(i, bytearray(b.tobytes())) for i, b in enumerate(packed)], "node long, sketch binary")
    monkeypatch.setattr(type(texts), "count", lambda self: 1 << 40)
    got = {tuple(sorted(r)) for r in near_copies.linked(texts, 20_000).collect()}
    assert len(near) > pairs / 2
    assert got >= {(i, i + pairs) for i in near.tolist()}
