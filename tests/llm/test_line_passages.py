"""Short repeated passages in otherwise different documents."""

from __future__ import annotations

import random

import pytest
from stratolab.llm import common, line_dedup


@pytest.mark.parametrize("count", [1, 2, 3])
def test_short_passages_leave_one_copy(spark, count):
    passages = [[f"passage {p} line {i} " + "and its words " * 20 for i in range(count)] for p in range(20)]
    rows = []
    for d in range(2):
        for p, passage in enumerate(passages):
            rows.append((100 * d + p, "\n".join([f"own {d} {p} a", f"own {d} {p} b", *passage, f"own {d} {p} c"])))
    got = line_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows)
    for r in got:
        d, p = divmod(r.doc_id, 100)
        own = [f"own {d} {p} a", f"own {d} {p} b", f"own {d} {p} c"]
        assert r.text.split("\n") == (own[:2] + (passages[p] if d == 0 else []) + own[2:])
        assert r.n_removed_lines == (count if d else 0)


def test_short_single_lines_stay(spark):
    rows = [(d, f"own {d}\n" + "word " * 48 + "end\n" + f"also own {d}") for d in range(3)]
    got = line_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.text) for r in got} == set(rows)


def test_documents_that_keep_all_lines_are_not_shuffled(spark):
    """Of 400 long texts two share a passage: far fewer bytes are shuffled than the texts have."""
    rng = random.Random(2)
    line = lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz ", k=1000))
    shared = [line(), line()]
    rows = [(d, "\n".join([line() for _ in range(20)] + (shared if d in (7, 300) else []))) for d in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    written = lambda: spark.sparkContext._jsc.sc().statusStore().executorSummary("driver").totalShuffleWrite()
    before, threshold = written(), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as where tables are large
    got = {r.doc_id: r.text for r in line_dedup.dedup(docs, local_places=0).collect()}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    shuffled = written() - before
    assert got == {d: t if d != 300 else "\n".join(t.split("\n")[:20]) for d, t in rows}
    assert shuffled < sum(len(t) for _, t in rows) / 4, shuffled


@pytest.mark.parametrize("count", [0, 5, 5000])
def test_bitmaps_lose_no_row(spark, monkeypatch, count):
    """Also where the bitmaps are too small for the keys."""
    monkeypatch.setattr(common, "BITMAPS", 1)
    rows = spark.range(-20_000, 20_000).selectExpr("id", "id % 7 AS tie", "id AS other")
    keys = rows.where(f"pmod(id, 40000) < {count}").select("id", "tie")
    may, never = common.parted(rows, keys, ["id", "tie"], count)
    may, never = ({tuple(r) for r in x.collect()} for x in (may, never))
    assert len(may) + len(never) == 40_000 and not may & never
    assert {(r.id, r.tie) for r in keys.collect()} <= {r[:2] for r in may}
    assert len(may) <= count + 40_000 * count / 32_768
